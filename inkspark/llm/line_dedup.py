"""Line dedup by content-defined chunks.

Lines with more than white space are cut into chunks. A rolling hash over the
hashes of two neighbouring lines says whether a boundary lies between them: it
does (1) if that pair of lines occurs once in the corpus, (2) if it occurs less
often than the pair before or after it, which is a passage's edge, or (3) if the
hash's first hexadecimal digit is below ``boundary_below`` (one in eight), which
cuts long passages into chunks of eight lines on average. All three depend on
the lines only and not on where they stand, so chunks don't shift with what is
around them. A line left alone between two boundaries, of which one isn't of
kind 1, belongs to the chunks of two lines that it makes with its neighbours
there. A line of ``long_line_words`` words is a passage by itself and a chunk.

Chunks that occur twice or more in the corpus with the same bytes are removed,
but for the first occurrence in order of doc_id and place. Where a chunk occurs
once but its pairs of lines occur elsewhere in other chunks, its pairs are the
chunks. Lines of white space go only with a chunk around them.

Steps: (1) hash pairs of lines (128 bits) and count them, pre-aggregated;
(2) pairs that occur again get their counts; boundaries and chunks come from
windows over a document's own pairs; (3) count chunks; (4) join what repeats to
the texts, once, and compare each chunk's whole bytes; (5) take lines out. Only
hashes and places are shuffled but for step 4. Joins on a hash have one row for
each repeated hash on one side, and adaptive execution splits partitions of
frequent ones. Nothing is collected but whether any bytes differ.

Defined results: null text stays null; an empty text stays empty; rows with the
same doc_id and text count each but are one document, which changes alike; a
document all of whose lines are repeats becomes empty; columns other than text
stay as they are, whatever their names, but for ``n_lines`` and ``n_removed``,
which are the operator's. Chunks of equal hashes and unequal bytes stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import BREAKS, scope, words_of, written


@dataclass(frozen=True)
class LineRules:
    #: A boundary if the rolling hash's first hexadecimal digit is below this.
    boundary_below: str = "2"
    #: Lines of so many words are passages.
    long_line_words: int = 50


KEY = ["__doc", "__text_hash"]


def _hashes(keyed: DataFrame, rules: LineRules) -> DataFrame:
    """Of each full line: its place; hashes of its pair with the next one (null: none) and whether that is a boundary; its own hashes if it is long."""
    own = F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(BREAKS)) != "")
    rows = keyed.filter(F.col("text").isNotNull()).select(*KEY, own.alias("__own"))
    rows = rows.select(*KEY, F.posexplode(F.arrays_zip(F.col("__own").alias("a"), F.slice("__own", F.lit(2), F.size("__own")).alias("b"))).alias("j", "l")).select(*KEY, "j", F.col("l.a").alias("a"), F.col("l.b").alias("b"))
    paired = lambda c: F.when(F.col("b").isNotNull(), c)
    long = lambda c: F.when((F.char_length("a") >= 2 * rules.long_line_words - 1) & (F.size(words_of(F.col("a"))) >= rules.long_line_words), c)
    return rows.select(
        *KEY, "j",
        paired(F.xxhash64("a", "b")).alias("p1"), paired(F.xxhash64(F.lit(1), "a", "b")).alias("p2"),
        paired(F.substring(F.md5(F.concat(F.md5("a"), F.md5("b"))), 1, 1) < rules.boundary_below).alias("bit"),
        long(F.xxhash64(F.lit(2), "a")).alias("l1"), long(F.xxhash64(F.lit(3), "a")).alias("l2"),
    )


def _pairs(hashes: DataFrame) -> DataFrame:
    """Pairs of lines that occur again: place, hashes, whether a boundary lies between (cut) and beside (first, last of their stretch)."""
    pairs = hashes.filter(F.col("p1").isNotNull()).select(*KEY, "j", "p1", "p2", "bit")
    counts = written(pairs.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lines-pairs")
    found = pairs.join(counts, ["p1", "p2"]).repartition(*KEY).dropDuplicates([*KEY, "j"])
    line = Window.partitionBy(*KEY).orderBy("j")
    found = found.withColumns({"before": F.lag("j").over(line) == F.col("j") - 1, "after": F.lead("j").over(line) == F.col("j") + 1, "n_before": F.lag("n").over(line), "n_after": F.lead("n").over(line)})
    rarer = lambda beside, n: F.coalesce(F.col(beside) & (F.col("n") < F.col(n)), F.lit(False))
    found = found.withColumn("cut", F.col("bit") | rarer("before", "n_before") | rarer("after", "n_after"))
    # Whether the line before (after) this pair's boundary stands alone.
    found = found.withColumns({"alone_before": ~F.coalesce("before", F.lit(False)) | F.lag("cut").over(line), "alone_after": ~F.coalesce("after", F.lit(False)) | F.lead("cut").over(line)})
    found = found.withColumn("chunk", F.sum((~F.col("cut") & F.col("alone_before")).cast("long")).over(line))
    return written(found.select(*KEY, "j", "p1", "p2", "cut", (F.col("alone_before") | F.col("alone_after")).alias("beside"), "chunk"), "lines-shared")


def _chunks(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """All chunks that may occur again: first and last line, hashes, and their pairs."""
    inside = F.struct("j", "p1", "p2")
    several = pairs.filter(~F.col("cut")).groupBy(*KEY, "chunk").agg(F.array_sort(F.collect_list(inside)).alias("pairs"))
    two = pairs.filter("cut and beside").select(*KEY, F.array(inside).alias("pairs"))
    place = [F.get("pairs", 0)["j"].alias("first"), (F.get("pairs", F.size("pairs") - 1)["j"] + 1).alias("last"), F.xxhash64("pairs.p1").alias("h1"), F.xxhash64("pairs.p2").alias("h2")]
    chunks = several.select(*KEY, "pairs").unionByName(two).select(*KEY, *place, "pairs")
    alone = hashes.filter(F.col("l1").isNotNull()).select(*KEY, F.col("j").alias("first"), F.col("j").alias("last"), F.col("l1").alias("h1"), F.col("l2").alias("h2")).distinct()
    return chunks.unionByName(alone, allowMissingColumns=True)


def _firsts(places: DataFrame, hashes: list[str], first: str) -> DataFrame:
    """The first place (at) of each chunk that occurs again."""
    at = F.struct(*KEY, F.col(first).alias("first"))
    return places.groupBy(*hashes).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at")).filter("n > 1").drop("n")


def _occurrences(keyed: DataFrame, rules: LineRules) -> DataFrame:
    """Places (first, last) of chunks that repeat, their hashes, and whether the place isn't the first (again)."""
    hashes = written(_hashes(keyed, rules), "lines-hashes")
    pairs = _pairs(hashes)
    chunks = written(_chunks(pairs, hashes), "lines-chunks")
    firsts = written(_firsts(chunks, ["h1", "h2"], "first"), "lines-firsts")
    again = ~F.struct(*KEY, "first").eqNullSafe(F.col("at"))
    columns = [*KEY, "first", "last", "h1", "h2", "again"]
    whole = chunks.join(firsts, ["h1", "h2"]).withColumn("again", again).select(*columns)
    # Chunks that don't repeat as a whole, though their pairs do: each pair is a chunk.
    loose = written(chunks.join(firsts, ["h1", "h2"], "left_anti").select(*KEY, F.explode("pairs").alias("x")).select(*KEY, "x.*").distinct(), "lines-loose")
    starts = written(_firsts(pairs.join(loose.select("p1", "p2").distinct(), ["p1", "p2"], "left_semi"), ["p1", "p2"], "j"), "lines-starts")
    named = [F.xxhash64(F.lit(4), "p1").alias("h1"), F.xxhash64(F.lit(4), "p2").alias("h2")]
    small = loose.join(starts, ["p1", "p2"]).withColumn("first", F.col("j")).withColumn("again", again).filter("again").select(*KEY, "first", (F.col("first") + 1).alias("last"), *named, "again")
    kept = starts.select("at.*", (F.col("at.first") + 1).alias("last"), *named, F.lit(False).alias("again"))
    return whole.unionByName(small).unionByName(kept)


def _with_chunks(keyed: DataFrame, occurrences: DataFrame, label: str) -> DataFrame:
    """Each row with its repeated chunks (null: none). Texts are shuffled here, and only here."""
    by_doc = occurrences.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last", "h1", "h2", "again")).alias("__chunks")).withColumnsRenamed({"__doc": "__doc2", "__text_hash": "__text_hash2"})
    same = keyed["__doc"].eqNullSafe(by_doc["__doc2"]) & (keyed["__text_hash"] == by_doc["__text_hash2"])
    return written(keyed.join(by_doc, same, "left").drop("__doc2", "__text_hash2"), label)


def _unequal(rows: DataFrame) -> DataFrame:
    """Hashes of chunks whose bytes aren't the same everywhere: a table that only a collision of 128 bits fills.

    The least and the greatest text of a hash must be equal. Both are combined
    before the shuffle, so a passage in a third of all documents is one row a task.
    """
    own = F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(BREAKS)) != "")
    parts = rows.filter(F.col("__chunks").isNotNull()).select(own.alias("own"), "__chunks").select(F.explode(F.transform("__chunks", lambda c: F.struct(c["h1"].alias("h1"), c["h2"].alias("h2"), F.array_join(F.slice("own", c["first"] + 1, c["last"] - c["first"] + 1), "\n").alias("s")))).alias("c"))
    return parts.groupBy("c.h1", "c.h2").agg(F.min("c.s").alias("least"), F.max("c.s").alias("most")).filter("least <> most").select("h1", "h2")


def line_dedup(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents with repeated chunks taken out of text, and n_lines, n_removed (lines)."""
    others = [c for c in documents.columns if c not in ("text", "n_lines", "n_removed")]
    keyed = documents.select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__text_hash"), "text", F.struct(*others).alias("__row"))
    with scope() as tables:
        occurrences = written(_occurrences(keyed.select(*KEY, "text"), rules), "lines-places")
        tables.discard(occurrences)
        rows = _with_chunks(keyed, occurrences, "lines-rows")
        unequal = written(_unequal(rows), "lines-unequal")
        if not unequal.isEmpty():
            rows = _with_chunks(keyed, occurrences.join(unequal, ["h1", "h2"], "left_anti"), "lines-rows")
    full = F.filter(F.transform(F.split("text", "\n"), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: F.btrim(x["s"], F.lit(BREAKS)) != "")
    gone = F.filter("__chunks", lambda c: c["again"])
    rows = rows.withColumns({"__lines": F.split("text", "\n"), "__gone": F.when(F.size(gone) > 0, gone)})
    rows = rows.withColumn("__full", F.when(F.col("__gone").isNotNull(), F.transform(full, lambda x: x["i"])))
    taken = F.flatten(F.transform("__gone", lambda c: F.sequence(F.get("__full", c["first"]), F.get("__full", c["last"]))))
    rows = rows.withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), taken)))
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines"))
    n_removed = F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(F.size("__lines") - F.size("__kept"))
    rows = rows.withColumns({"n_lines": n_lines.cast("long"), "n_removed": n_removed.cast("long"), "__new": text})
    columns = [F.col("__new").alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in documents.columns if c in ("text", *others)]
    return rows.select(*columns, "n_lines", "n_removed")


def line_dedup_sql(rules: LineRules = LineRules(), documents: str = "documents") -> str:
    """The same in DuckDB SQL (doc_id, text, n_lines, n_removed), for tables whose doc_id are distinct."""
    return rf"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from {documents}),
f as (select doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') as idx from d where text is not null),
u as (select doc_id, unnest(range(1, len(idx) + 1)) as j, list_transform(idx, lambda i: ls[i]) as own from f),
w as (select doc_id, j, own[j] as a, own[j + 1] as b, j < len(own) as paired from u),
p as (select *, count(*) over (partition by a, b) as n, substr(md5(md5(a) || md5(b)), 1, 1) < '{rules.boundary_below}' as bit from w where paired),
s as (select *, coalesce(lag(j) over l = j - 1, false) as bef, coalesce(lead(j) over l = j + 1, false) as aft, lag(n) over l as nb, lead(n) over l as na from p where n > 1 window l as (partition by doc_id order by j)),
c as (select *, bit or (bef and n < nb) or (aft and n < na) as cut from s),
e as (select *, not bef or lag(cut) over l as ab, not aft or lead(cut) over l as aa from c window l as (partition by doc_id order by j)),
g as (select *, sum(case when not cut and ab then 1 else 0 end) over (partition by doc_id order by j rows unbounded preceding) as k from e),
h as (select doc_id, min(j) as x, max(j) + 1 as y from g where not cut group by doc_id, k
  union all select doc_id, j, j + 1 from g where cut and (ab or aa)
  union all select doc_id, j, j from w where len(regexp_extract_all(a, '[^ 	-
]+')) >= {rules.long_line_words}),
t as (select h.doc_id, x, y, list_transform(idx, lambda i: ls[i])[x:y] as body from h join f using (doc_id)),
r as (select *, count(*) over (partition by body) as n, row_number() over (partition by body order by doc_id, x) as nth from t),
q as (select distinct doc_id, j from (select doc_id, unnest(range(x, y)) as j from r where n = 1)),
z as (select doc_id, j, row_number() over (partition by a, b order by doc_id, j) as nth from g),
o as (select doc_id, x, y from r where nth > 1 union all select doc_id, j, j + 1 from z semi join q using (doc_id, j) where nth > 1),
m as (select o.doc_id, list_distinct(flatten(list(range(idx[x], idx[y] + 1)))) as gone from o join f using (doc_id) group by o.doc_id)
select d.doc_id, case when gone is null then text else array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(gone, i)), lambda i: ls[i]), chr(10)) end as text,
  cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_removed
from d left join m using (doc_id)"""
