"""Joining two tables of names by spelling, with an index instead of a comparison of all pairs.

Two names are one if the mean similarity of their paired words reaches the
tolerance (``functions.names``). So the pairs' deficits, edits over the longer
word's length, add up to at most ``(1 - tolerance) * n`` for n words. That bounds
the edits of a whole name by its own longest word, whatever the other name is
(``edits_allowed``). Candidates share a key, and each kind of key is complete for
the names it is for:

- a few edits (``FEW``): what is left after letters are taken out of its words. Two
  names within k edits leave something equal when k letters are taken from the
  longer one and k less the difference from the other. k and the difference follow
  from the lengths of both names' words (their shapes), and shapes that are more
  than k apart don't meet, so nearly all names have a few keys only.
- more edits, short words: a word. As many words as there are edits may differ, so
  two such names share one of each one's (edits + 1) rarest words, by their counts
  in both tables.
- words so long that they may differ themselves, or so many words that one may be
  left over: some word of one is near one of the other by the same tolerance, so
  all words, and what is left of them, are keys. Words too long for that meet by
  their lengths.

Keys of the first kind hold nearly a whole name, so a common word makes none of
them common. Equal names are one row from the start. The join compares numbers of
letters; spelling is compared for what leaves it, each pair once. Names without a
word match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions.names import TOLERANCE, pairing, tokens
from inkspark.operators.sides import small

#: Edits up to which keys are made by taking letters out.
FEW = 2
#: Guards bounds against rounding, on the side of more candidates.
SLACK = 1e-9


def distinct_names(rows: DataFrame, key: str, name: str, side: str) -> DataFrame:
    """One row for each name: its words, these as text, the smallest key and the number of rows; columns end in the side."""
    found = rows.select(F.col(key).alias("key"), tokens(F.col(name)).alias("words")).filter(F.size("words") > 0)
    groups = found.withColumn("name", F.array_join("words", " ")).groupBy("name", "words").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    return groups.select(*(F.col(c).alias(f"{c}_{side}") for c in groups.columns))


def edits_allowed(words: Column, tolerance: float) -> Column:
    """So many edits a name of these words differs in at most from one that matches; null if a word may be left over."""
    share = F.size(words) * (1 - tolerance)
    longest = F.array_max(F.transform(words, F.char_length))
    one_more = (F.size(words) + 1) * (1 - tolerance)
    return F.when(one_more < 1 - SLACK, F.floor(share * longest / (1 - share) + SLACK).cast("int"))


def word_edits(word: Column, tolerance: float) -> Column:
    """So many edits a word differs in at most from one that is as similar as the tolerance."""
    return F.floor(F.char_length(word) * (1 - tolerance) / tolerance + SLACK).cast("int")


def _without_one(texts: Column) -> Column:
    """What is left of each text when a letter is taken out of one of its words, words in order again."""
    letters = lambda s: F.filter(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.substring(s, i, F.lit(1)) != " ")
    rest = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s)))
    left = lambda s: F.transform(letters(s), lambda i: F.array_join(F.array_sort(F.split(rest(s, i), " ")), " "))
    return F.array_distinct(F.flatten(F.transform(texts, lambda s: F.when(s != "", left(s)).otherwise(F.array().cast("array<string>")))))


def left_over(text: Column, edits: Column) -> Column:
    """A text and what is left of it after up to so many letters (``FEW`` at most) are taken out."""
    none = F.array(text)
    one = _without_one(none)
    return F.when(edits == 0, none).when(edits == 1, F.concat(none, one)).otherwise(F.concat(none, one, _without_one(one)))


def taken_out(text: Column, letters: Column) -> Column:
    """What is left of a text after exactly so many letters (``FEW`` at most) are taken out."""
    none = F.array(text)
    return F.when(letters == 0, none).when(letters == 1, _without_one(none)).otherwise(_without_one(_without_one(none)))


def _next_shapes(shapes: Column) -> Column:
    """Each shape with one of its lengths greater or less by one."""
    changed = lambda s, i: F.array_sort(F.transform(s, lambda n, j: n + F.when(j == F.floor(i / 2), F.when(i % 2 == 0, 1).otherwise(-1)).otherwise(0)))
    return F.array_distinct(F.flatten(F.transform(shapes, lambda s: F.transform(F.sequence(F.lit(0), 2 * F.size(s) - 1), lambda i: changed(s, i)))))


def _shapes(l: DataFrame, r: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of shapes (sorted lengths of words) that names within ``FEW`` edits may have, and how many letters are taken from each side.

    Edits of a pair add up to at most ``(1 - tolerance) * n`` of the longest word
    of both, and at least to the sum of what the lengths differ by in their order.
    """
    left, right = (side.select(f"shape_{s}", F.col("edits").alias(f"edits_{s}")).filter("edits is not null").distinct() for side, s in ((l, "l"), (r, "r")))
    none = F.array("shape_l")
    one = _next_shapes(none)
    near = left.withColumn("shape_r", F.explode(F.array_distinct(F.concat(none, one, _next_shapes(one)))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    longest = F.greatest(F.array_max("shape_l"), F.array_max("shape_r"))
    edits = F.least("edits_l", "edits_r", F.floor(F.size("shape_l") * (1 - tolerance) * longest + SLACK).cast("int"))
    pairs = near.join(right, "shape_r").filter(F.least("edits_l", "edits_r") <= FEW).withColumn("k", edits)
    pairs = pairs.filter(total(F.zip_with("shape_l", "shape_r", lambda a, b: F.abs(a - b))) <= F.col("k")).withColumn("more", total(F.col("shape_l")) - total(F.col("shape_r")))
    return pairs.select("shape_l", "shape_r", (F.col("k") + F.least("more", F.lit(0))).alias("out_l"), (F.col("k") - F.greatest("more", F.lit(0))).alias("out_r"))


def _word_keys(word: Column, tolerance: float, side: str) -> Column:
    """Keys of a word that may differ itself: the left side asks for all lengths it may match."""
    nothing = F.array().cast("array<string>")
    edits, length = word_edits(word, tolerance), F.char_length(word)
    reach = edits if side == "l" else F.lit(0)
    lengths = F.transform(F.sequence(length - reach, length + reach), lambda n: F.concat(F.lit("#"), n.cast("string")))
    partner = F.floor((length + edits) * (1 - tolerance) / tolerance + SLACK)  # edits of the longest word it may match
    return F.concat(F.when(edits <= FEW, left_over(word, edits)).otherwise(nothing), F.when(partner > FEW, lengths).otherwise(nothing))


def _keys(named: DataFrame, counts: DataFrame | None, shapes: DataFrame, tolerance: float, side: str) -> DataFrame:
    """Each name (with its number of words and edits) under each of its keys."""
    words, hashed = F.col(f"words_{side}"), lambda kind, xs: F.explode(F.transform(xs, lambda s: F.xxhash64(F.lit(kind), s)))
    kept = [f"name_{side}", f"key_{side}", f"n_{side}", "edits", "size"]
    left = F.transform(taken_out(F.col(f"name_{side}"), F.col(f"out_{side}")), lambda s: F.xxhash64(F.lit(0), "shape_l", "shape_r", s))
    whole = named.join(shapes, f"shape_{side}").select(*kept, F.explode(left).alias("key"))
    if counts is None:
        return whole
    more = named.filter(F.col("odd") | (F.col("edits") > FEW))
    ranked = more.withColumn("word", F.explode(F.array_distinct(words))).join(counts, "word").groupBy(*named.columns).agg(F.array_sort(F.collect_list(F.struct("count", "word"))).alias("l"))
    rarest = F.when(F.col("odd"), F.col("l.word")).otherwise(F.slice("l.word", F.lit(1), F.col("edits") + 1))
    near = F.array_distinct(F.flatten(F.transform(words, lambda w: _word_keys(w, tolerance, side))))
    return whole.unionByName(ranked.select(*kept, hashed(1, rarest).alias("key"))).unionByName(more.filter("odd").select(*kept, hashed(2, near).alias("key")))


def _counts(l: DataFrame, r: DataFrame) -> DataFrame | None:
    """How many names each word stands in, if any name needs that."""
    more = F.col("odd") | (F.col("edits") > FEW)
    if l.filter(more).isEmpty() or r.filter(more).isEmpty():
        return None
    every = l.filter(more).select(F.explode(F.array_distinct("words_l")).alias("word")).unionByName(r.filter(more).select(F.explode(F.array_distinct("words_r")).alias("word")))
    return every.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def candidates(l: DataFrame, r: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs of names (of ``distinct_names``) that share a key and whose lengths allow a match."""
    sides = []
    for names, side in ((l, "l"), (r, "r")):
        words = F.col(f"words_{side}")
        edits = edits_allowed(words, tolerance)
        odd = edits.isNull() | ((edits > FEW) & F.exists(words, lambda w: word_edits(w, tolerance) > 0))
        sides.append(names.withColumns({"edits": edits, "odd": odd, "size": F.size(words), f"shape_{side}": F.array_sort(F.transform(words, F.char_length))}))
    counts, shapes = _counts(*sides), small(_shapes(*sides, tolerance))
    left, right = (_keys(names, counts, shapes, tolerance, side) for names, side in zip(sides, "lr", strict=True))
    right = right.withColumnsRenamed({"key": "key2", "edits": "edits2", "size": "size2"})
    apart = F.abs(F.char_length("name_l") - F.char_length("name_r"))
    # A name that may lack a word only matches others that may.
    fits = F.when(F.col("edits").isNull() | F.col("edits2").isNull(), F.col("edits").isNull() & F.col("edits2").isNull()).otherwise((F.col("size") == F.col("size2")) & (apart <= F.least("edits", "edits2")))
    met = left.join(right, (F.col("key") == F.col("key2")) & fits).dropDuplicates(["name_l", "name_r"])
    # Words are read from their text again, which is shorter to carry.
    return met.withColumns({f"words_{side}": F.split(f"name_{side}", " ") for side in "lr"}).select(*l.columns, *r.columns)


def spelling_join(left: DataFrame, right: DataFrame, key: str, name: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs of different spellings that match, one of each table: name, smallest key and number of rows of each, similarity, and the words that differ.

    Rows of the same words are one name; ``distinct_names`` tells which.
    """
    pairs = candidates(distinct_names(left, key, name, "l"), distinct_names(right, key, name, "r"), tolerance)
    scored = pairs.withColumn("p", pairing(F.col("words_l"), F.col("words_r")))
    return scored.select("name_l", "key_l", "n_l", "name_r", "key_r", "n_r", F.col("p.similarity").alias("similarity"), F.col("p.differing").alias("differing")).filter(F.col("similarity") >= tolerance)
