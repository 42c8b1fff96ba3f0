"""Names on two documents: keys, folding, similarity and pairing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspark.functions.mrz import transliterate

# Digraphs with what they fold to, separators of compounds, and the least similarity of a match.
DIGRAPHS = {"UE": "U", "SS": "S", "PH": "F"}
SEPARATORS = "-.,"
TOLERANCE = 0.95


def name_key(name: Column) -> Column:
    """Capitals without diacritics, with single spaces."""
    return F.trim(F.regexp_replace(transliterate(name), r"\s+", " "))


def number_key(number: Column) -> Column:
    """A document number to join on: capitals without white space and filler."""
    return F.regexp_replace(F.upper(number), r"[\s<]", "")


def tokens(name: Column) -> Column:
    """Sorted words of a name's key, compounds split and digraphs folded from the left."""
    folded = F.regexp_replace(name_key(name), f"[{SEPARATORS}]", " ")
    # No folded letter completes another digraph, so one pass for each is one pass from the left.
    for pair, letter in DIGRAPHS.items():
        folded = F.regexp_replace(folded, pair, letter)
    return F.array_sort(F.filter(F.split(folded, " "), lambda w: w != ""))


def similarity(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length; two empty texts are alike."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    # What both begin or end with costs no edits.
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / longest


def _taken(over: list[str], spare: list[str], known: dict[tuple[str, str], float]) -> tuple[float, list[tuple[str, str]]]:
    """Each word of one side in turn takes the most similar free word of the other (the greater of equals): the similarities' sum, and the pairs. ``known`` keeps what was compared, by both words in order."""
    free, total, pairs = sorted(spare), 0.0, []
    for word in over:
        scores = []
        for other in free:
            pair = (word, other) if word < other else (other, word)
            if pair not in known:
                known[pair] = _ratio(*pair)
            scores.append(known[pair])
        best = max(range(len(free)), key=lambda i: (scores[i], free[i]))
        total += scores[best]
        pairs.append((word, free.pop(best)))
    return total, pairs


def paired(a: list[str], b: list[str]) -> tuple[float | None, list[tuple[str, str]]]:
    """Mean similarity of words paired one to one, the better of both directions, and its pairs. The shorter side is filled up with empty words, which are like nothing."""
    width = max(len(a), len(b))
    if not width:
        return None, []
    left, right = ([*x, *[""] * (width - len(x))] for x in (a, b))
    known: dict[tuple[str, str], float] = {}
    total, pairs = max(_taken(left, right, known), _taken(right, left, known))
    return total / width, pairs


@F.pandas_udf(T.DoubleType())
def paired_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two arrays of words as ``paired`` gives it. Null if neither has a word, since nothing was compared.

    Which word is free depends on the words before, so this is no set operation.
    """
    return pd.Series([None if x is None or y is None else paired(list(x), list(y))[0] for x, y in zip(a, b, strict=True)], dtype="float64")


_DIFFERING = T.ArrayType(T.StructType([T.StructField("one", T.StringType()), T.StructField("other", T.StringType())]))


@F.pandas_udf(T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("differing", _DIFFERING)]))
def pairing(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """As ``paired_similarity``, with the pairs of words that differ; a word that nothing is left for is paired with an empty one."""
    out = []
    for x, y in zip(a, b, strict=True):
        score, pairs = (None, []) if x is None or y is None else paired(list(x), list(y))
        out.append((score, [{"one": p, "other": q} for p, q in pairs if p != q]))
    return pd.DataFrame(out, columns=["similarity", "differing"]).astype({"similarity": "float64"})


def names_match(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two names are of one person, as far as spelling says."""
    return paired_similarity(tokens(a), tokens(b)) >= tolerance


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word stands for one character.

    Characters are taken from a plane of 65,536 private ones, written as two
    UTF-16 units, so there are enough for all words of two names or pages.
    """
    known = F.array_distinct(F.concat(a, b))
    unit = lambda x: F.lpad(F.hex(x), 4, "0")
    at = lambda x: F.array_position(known, x) - 1
    letter = lambda x: F.decode(F.unhex(F.concat(unit(F.lit(0xDB80) + F.shiftright(at(x), 10)), unit(F.lit(0xDC00) + at(x).bitwiseAND(F.lit(0x3FF))))), "UTF-16BE")
    letters = lambda xs: F.array_join(F.transform(xs, letter), "")
    apart = F.levenshtein(letters(a), letters(b))
    return F.when(F.size(known) <= 65_536, apart).otherwise(F.raise_error(F.lit("over 65,536 different words")).cast("int"))
