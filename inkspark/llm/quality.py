"""Quality rules: base counts and distribution divergence from language references.

Everything here is DataFrame expressions. Two histograms describe a document:
shares of character classes, and shares of its language's most common words
(lower case, without punctuation) among its words, the rest last. A language's
common words and their shares are counted over all documents of that language.
Its class reference is a robust mean of its documents that pass the base rules
and are long enough: the plain mean first, then one in which a document weighs
less the farther it is from the first, so that junk doesn't pull it. The
Jensen-Shannon distance (base 2, so from 0 to 1) of both histograms to the
references must be within limits. A histogram of few characters or words says
nothing, so each distance counts only from a minimum length on.

A language of fewer than ``min_reference_words`` words has no word reference, nor
has a row without lang: such rows are judged by classes alone, against the
mean over all languages. Letters without case, and marks, count as small letters, so
that classes of all scripts are alike.

Steps: texts are read once for the common words (counts by language and word,
pre-aggregated) and once for each document's counts, which go to a table in the
shared folder; references and distances read that table. No texts are shuffled.
The references, one row a language, are sent to all executors behind a check of
their number.

Defined results: null text counts as empty. An empty text has no words and so
fails the base rules. With no document that qualifies for a reference the
divergence doesn't judge. Equal rows are judged alike, each by itself; further
columns are ignored. The steps run when ``quality`` is called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import BREAKS, text_of, words_of, written

#: Character classes as patterns. Letters that aren't capitals are the first class; then these, and what none of them takes.
CLASSES = {"upper": r"\p{Lu}+", "digit": r"[0-9]+", "point": r"""[.,;:!?'"()-]+""", "symbols": r"[#*$%&|<>]+", "breaks": r"[\x20\x09-\x0D]+"}
N_CLASSES = len(CLASSES) + 2
LETTERS_AND_BREAKS = r"[\p{L}\p{M}\x20\x09-\x0D]+"

#: Digits up to one in so many characters count as small letters: numbers, dates and addresses are no sign of junk.
USUAL_DIGITS = 5
#: Largest number of languages whose references are sent to all executors: some 2 KB each.
BROADCAST_LANGUAGES = 5_000
#: Largest number of languages whose words are a set in the plan.
SET_LANGUAGES = 100


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Words of a language's histogram.
    common_words: int = 20
    #: From so many words of a language on it has a word reference.
    min_reference_words: int = 5_000
    #: From so many characters or words on, a distance counts.
    min_chars: int = 200
    min_histogram_words: int = 150
    #: Largest Jensen-Shannon distances of a kept document.
    max_class_distance: float = 0.13
    max_word_distance: float = 0.325


def _repeated_places(words: str) -> list[tuple[str, Column]]:
    """Columns to add one after the other to an array of words; the last, __sorted, has the places of 3-word windows found twice or more.

    A packed window is one long: the upper 40 bits of its hash, then its place.
    Sorted (a primitive sort), equal windows stand side by side. If two
    different hashes share their upper bits, or places need over 24 bits, whole
    64-bit hashes are sorted with the places instead. Equal 64-bit hashes within
    one text count as equal windows. Each array is a column of its own, so that
    none is made again for each element of another.
    """
    w, h, p, whole = F.col(words), F.col("__windows"), F.col("__packed"), F.col("__whole")
    none = F.array().cast("array<long>")
    low = (1 << 24) - 1
    k = F.col("__keys")
    windows = F.when(F.size(k) >= 3, F.transform(F.slice(k, F.lit(1), F.size(k) - 2), lambda x, i: F.xxhash64(x, F.get(k, i + 1), F.get(k, i + 2)))).otherwise(none)
    packed = F.when(F.col("__distinct") < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, 24), 24).bitwiseOR(i.cast("long"))))).otherwise(none)
    top = lambda x: F.shiftright(x, 24)
    clash = (F.size(p) > low) | (F.size(F.array_distinct(F.transform(p, top))) < F.col("__distinct"))
    with_places = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
    quick = F.transform(F.filter(p, lambda x, i: (top(x) == top(F.get(p, i - 1))) | (top(x) == top(F.get(p, i + 1)))), lambda x: x.bitwiseAND(F.lit(low)))
    exact = F.transform(F.filter(whole, lambda x, i: (x.h == F.get(whole, i - 1).h) | (x.h == F.get(whole, i + 1).h)), lambda x: x.i)
    # The first tests are cheap; the next ones run only for texts with repeats.
    return [
        ("__keys", F.transform(w, lambda x: F.xxhash64(x))), ("__windows", windows), ("__distinct", F.size(F.array_distinct(h))), ("__packed", packed),
        ("__whole", F.when((F.size(p) > 0) & clash, with_places)), ("__sorted", F.when(F.size(p) == 0, none).otherwise(F.sort_array(F.coalesce(exact, quick)))),
    ]


def _covered(places: Column) -> Column:
    """Words in windows of three that start at the places of a sorted array."""
    steps = F.transform(places, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, i + 1) - x, F.lit(3).cast("long"))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _plain_words(text: Column) -> Column:
    """Words in lower case without punctuation and digits; the first and the last may be empty."""
    return F.split(F.lower(text), r"[^\p{L}\p{M}]+")


def common_words(documents: DataFrame, rules: QualityRules) -> DataFrame:
    """The most common words of each language and their shares of all its words: lang, words, shares."""
    each = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").alias("__lang"), F.explode(_plain_words(F.col("text"))).alias("__word"))
    counts = written(each.filter("__word <> ''").groupBy("__lang", "__word").agg(F.count(F.lit(1)).alias("__n")), "quality-words")
    totals = counts.groupBy("__lang").agg(F.sum("__n").alias("__total")).filter(F.col("__total") >= rules.min_reference_words)
    # The filter on the row number cuts each task's rows to the first ones before the shuffle.
    place = F.row_number().over(Window.partitionBy("__lang").orderBy(F.desc("__n"), "__word"))
    top = counts.withColumn("__place", place).filter(F.col("__place") <= rules.common_words).join(totals, "__lang")
    listed = F.array_sort(F.collect_list(F.struct("__place", "__word", (F.col("__n") / F.col("__total")).alias("__share"))))
    return written(top.groupBy("__lang").agg(listed.alias("__l")).select("__lang", F.col("__l.__word").alias("__ref_words"), F.col("__l.__share").alias("__ref_shares")), "quality-common")


def _side(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= BROADCAST_LANGUAGES else small


def _counts(documents: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id and lang, the base counts, and counts of classes and of the language's common words."""
    text = F.col("__text")
    n = common.count()
    at = documents.select("doc_id", F.col("lang").alias("__lang"), text_of().alias("__text")).join(_side(common, n), "__lang", "left")
    # What is left without letters and breaks is short, so the other classes are counted in that.
    rest = F.regexp_replace(text, LETTERS_AND_BREAKS, "")
    gone = {f"__n_no_{name}": F.char_length(F.regexp_replace(text, CLASSES[name], "")) for name in ("upper", "breaks")} | {"__chars": F.char_length(text)}
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BREAKS)) != "")
    at = at.select("doc_id", "__lang", "__ref_words", "__ref_shares", *(c.cast("long").alias(k) for k, c in gone.items()), rest.alias("__rest"), words_of(text).alias("__words"), lines.alias("__lines"), _plain_words(text).alias("__plain"))
    # Of few languages, all their words are a set in the plan, which leaves less to compare with each.
    every = sorted({w for r in common.select("__ref_words").collect() for w in r[0]}) if n <= SET_LANGUAGES else []
    hits = F.filter("__plain", lambda w: w.isin(every)) if every else F.col("__plain")
    at = at.withColumn("__hits", hits)
    for name, column in _repeated_places("__words"):
        at = at.withColumn(name, column)
    in_rest = {f"__n_no_{name}": F.col("__chars") - (F.char_length("__rest") - F.char_length(F.regexp_replace("__rest", CLASSES[name], ""))) for name in ("digit", "point", "symbols")}
    at = at.withColumns(in_rest | {"__letters": F.col("__n_no_breaks") - F.char_length("__rest")})
    taken = lambda k: F.col("__chars") - F.col(f"__n_no_{k}")
    at = at.withColumn("__usual", F.least(taken("digit"), F.floor(F.col("__chars") / USUAL_DIGITS)))
    classes = [F.col("__letters") - taken("upper") + F.col("__usual"), taken("upper"), taken("digit") - F.col("__usual"), taken("point"), taken("symbols"), taken("breaks")]
    return at.select(
        "doc_id",
        "__lang",
        "__ref_shares",
        F.size("__words").cast("long").alias("n_words"),
        F.col("__n_no_breaks").alias("word_chars"),
        taken("symbols").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("__sorted")).alias("n_repeat_words"),
        "__chars",
        F.array(*classes).alias("__classes"),
        F.size(F.array_remove("__plain", "")).cast("long").alias("__n_plain"),
        F.transform("__ref_words", lambda r: (F.size("__hits") - F.size(F.array_remove("__hits", r))).cast("long")).alias("__common"),
    )


def _shares(counts: Column, size: Column) -> Column:
    """Shares of a size, the rest last."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    rest = F.array(F.greatest(size - total, F.lit(0).cast("long")))
    return F.transform(F.concat(counts, rest), lambda x: x / F.greatest(size, F.lit(1).cast("long")).cast("double"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares: from 0 to 1. Null if one is."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def _means(fit: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean class histogram, by language or over all."""
    mean = lambda i: F.sum(F.get("__p", i) * F.col("__weight")) / F.sum("__weight")
    return fit.groupBy(*by).agg(F.array(*(mean(i) for i in range(N_CLASSES))).alias("__mean"))


def _with_mean(rows: DataFrame, means: DataFrame, overall: DataFrame, n: int) -> DataFrame:
    """Rows with their language's mean, or that over all (one row, or none without documents)."""
    found = overall.select("__mean").first()
    rest = F.array(*map(F.lit, found["__mean"])) if found and found["__mean"] else F.lit(None).cast("array<double>")
    joined = rows.join(_side(means, n), "__lang", "left") if n else rows.withColumn("__mean", F.lit(None).cast("array<double>"))
    return joined.withColumn("__mean", F.coalesce("__mean", rest))


def quality(documents: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Base counts, distances and verdict for each document (doc_id, text, lang)."""
    failed = (F.col("n_words") < rules.min_words) | (F.lit(100).cast("long") * F.col("n_repeat_words") > F.lit(rules.max_repeat_percent).cast("long") * F.col("n_words"))
    counts = _counts(documents, common_words(documents, rules)).withColumn("base_failed", failed)
    words = F.when(F.col("n_words") >= rules.min_histogram_words, jensen_shannon(_shares(F.col("__common"), F.col("__n_plain")), F.col("__q")))
    counts = counts.withColumns({"__p": _shares(F.col("__classes"), F.col("__chars")), "__q": F.concat("__ref_shares", F.array(F.lit(1.0) - F.aggregate("__ref_shares", F.lit(0.0), lambda s, x: s + x)))})
    base = ["doc_id", "__lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    table = written(counts.select(*base, "__chars", "__p", words.alias("word_distance")), "quality")
    fit = table.filter(~F.col("base_failed") & (F.col("__chars") >= rules.min_chars))
    known = fit.filter(F.col("__lang").isNotNull())
    first = written(_means(known.withColumn("__weight", F.lit(1.0)), ["__lang"]), "quality-means")
    n = first.count()
    all_first = _means(fit.withColumn("__weight", F.lit(1.0)), [])
    far = _with_mean(fit, first, all_first, n).withColumn("__weight", 1 / (1 + F.pow(jensen_shannon(F.col("__p"), F.col("__mean")) / rules.max_class_distance, F.lit(6.0)))).drop("__mean")
    second = written(_means(far.filter(F.col("__lang").isNotNull()), ["__lang"]), "quality-means")
    judged = _with_mean(table, second, _means(far, []), n).withColumn("class_distance", F.when(F.col("__chars") >= rules.min_chars, jensen_shannon(F.col("__p"), F.col("__mean"))))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= rules.max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= rules.max_word_distance)
    return judged.select(*(c for c in base if c != "__lang"), (~F.col("base_failed") & near).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def quality_sql(rules: QualityRules = QualityRules(), documents: str = "documents") -> str:
    """The same in DuckDB SQL, distances to six places, for tables whose doc_id are distinct."""
    taken = lambda pattern: f"(n - length(regexp_replace(t, '{pattern}', '', 'g')))"
    point = CLASSES["point"].replace("'", "''")
    divergence = lambda p, q: f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: case when {p}[i] > 0 then {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) else 0 end + case when {q}[i] > 0 then {q}[i] * log2({q}[i] / (({p}[i] + {q}[i]) / 2)) else 0 end)) / 2, 0))"
    with_rest = lambda counts, size: f"list_transform(list_append({counts}, greatest({size} - list_sum({counts}), 0)), lambda x: x / greatest({size}, 1)::double)"
    means = lambda weight: "[" + ", ".join(f"sum(p[{i + 1}] * {weight}) / sum({weight})" for i in range(N_CLASSES)) + "]"
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as t, length(coalesce(text, '')) as n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}]+'), lambda w: w <> '') as plain, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from {documents}),
win as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as often from (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d))),
rep as (select doc_id, count(distinct i + k) as n_repeat from win, (values (0), (1), (2)) as v(k) where often > 1 group by doc_id),
cnt as (select lang, w, count(*) as n from (select lang, unnest(plain) as w from d where lang is not null) group by lang, w),
top as (select lang, w, n / (sum(n) over (partition by lang))::double as share, sum(n) over (partition by lang) as total, row_number() over (partition by lang order by n desc, w) as place from cnt),
ref as (select lang, list(w order by place) as words, list(share order by place) as shares from top where place <= {rules.common_words} and total >= {rules.min_reference_words} group by lang),
b as (select doc_id, d.lang, len(ws)::bigint as n_words, (n - {taken(CLASSES["breaks"])})::bigint as word_chars, {taken(CLASSES["symbols"])}::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words, n, plain, words, shares,
    {taken("[\\p{L}\\p{M}]+")} as letters, {taken(CLASSES["upper"])} as upper, {taken(CLASSES["digit"])} as digit, {taken(point)} as point, {taken(CLASSES["breaks"])} as space
    from d left join rep using (doc_id) left join ref on d.lang = ref.lang),
s as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed, least(digit, n // {USUAL_DIGITS}) as usual,
    list_transform(words, lambda w: len(list_filter(plain, lambda x: x = w))) as common, list_append(shares, 1 - list_sum(shares)) as q from b),
h as (select *, {with_rest("[letters - upper + usual, upper, digit - usual, point, n_symbols, space]", "n")} as p, {with_rest("common", "len(plain)")} as wp from s),
w as (select *, case when n_words >= {rules.min_histogram_words} and words is not null then {divergence("wp", "q")} end as word_distance from h),
fit as (select lang, p from w where not base_failed and n >= {rules.min_chars}),
m1 as (select lang, {means("1.0::double")} as m from fit where lang is not null group by lang), a1 as (select {means("1.0::double")} as m from fit),
f2 as (select fit.lang, p, coalesce(m1.m, a1.m) as m from fit left join m1 on fit.lang = m1.lang cross join a1),
f3 as (select lang, p, 1 / (1 + power({divergence("p", "m")} / {rules.max_class_distance}, 6)) as weight from f2),
m2 as (select lang, {means("weight")} as m from f3 where lang is not null group by lang), a2 as (select {means("weight")} as m from f3),
j as (select w.*, coalesce(m2.m, a2.m) as m from w left join m2 on w.lang = m2.lang cross join a2),
r as (select *, case when n >= {rules.min_chars} and m[1] is not null then {divergence("p", "m")} end as class_distance from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(class_distance, 0) <= {rules.max_class_distance} and coalesce(word_distance, 0) <= {rules.max_word_distance} as kept, round(class_distance, 6) as class_distance, round(word_distance, 6) as word_distance from r"""
