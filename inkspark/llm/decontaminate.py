"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space runs as one space.
An item of n characters may differ in k = n // chars_per_edit edits. Cut into
k + 1 pieces, at least one piece of any match is unharmed, so an Aho-Corasick
automaton of all pieces finds every match's neighbourhood in one pass over the
text; Myers' bit-parallel edit distance then verifies the item against the
window of its length plus k on both sides. Documents are read once for each
block of items; no shuffle.

Items come to the driver in blocks of at most ``block_chars`` characters, one at a
time: a block's matches are written before the next one is sent, so what the
driver and each executor hold is bounded whatever the benchmark's size.

Defined results: null or empty texts have no match; null, empty and repeated
items: empty ones are left out, repeated ones are each reported. Each pair of
document row and item gives at most one row, its best match (least distance,
then first). Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import written

CHARS_PER_EDIT = 16
BLOCK_CHARS = 2_000_000
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
FIELDS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length that cover the item, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """Least distance (at most k) of the pattern to a substring of text, and where the first such substring ends."""
    m = len(pattern)
    masks = peq(pattern) if masks is None else masks
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def peq(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick

        self.items = [(i, t, len(t) // chars_per_edit) for i, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for at, piece in pieces(text, k):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item found."""
        starts: dict[int, list[int]] = {}
        if not self.items:
            return []
        for last, (length, places) in self.automaton.iter(text):
            for n, at in places:
                starts.setdefault(n, []).append(last - length + 1 - at)
        found = []
        for n, all_starts in starts.items():
            item_id, item, k = self.items[n]
            best, reach = None, None
            for s in sorted(set(all_starts)):
                if best and best[0] == 0:
                    break
                if text.startswith(item, s) if s >= 0 else False:
                    best = (0, s, s + len(item))
                    break
                if reach is not None and s <= reach:
                    continue  # the window before took this start in
                if n not in self.masks:
                    self.masks[n] = peq(item)
                # One window for all starts up to k further on.
                a, b = max(0, s - k), min(len(text), s + len(item) + 2 * k)
                reach = s + k
                got = myers(item, text[a:b], k, self.masks[n])
                if got and (best is None or got[0] < best[0]):
                    end = a + got[1]
                    best = (got[0], self._start(item, text, max(0, end - len(item) - k), end), end)
            if best:
                found.append((item_id, *best))
        return found

    @staticmethod
    def _start(item: str, text: str, a: int, end: int) -> int:
        """Where a match that ends at ``end`` starts: the same search backwards."""
        got = myers(item[::-1], text[a:end][::-1], len(item))
        return end - got[1] if got else a


_matchers: dict[int, Matcher] = {}


def _matcher(shared, chars_per_edit: int) -> Matcher:
    """One automaton for each worker process and block."""
    if shared.value[0] not in _matchers:
        _matchers.clear()
        _matchers[shared.value[0]] = Matcher(shared.value[1], chars_per_edit)
    return _matchers[shared.value[0]]


def contaminated(documents: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs (doc_id, item_id) with distance, start and end in the normalized text."""
    spark = documents.sparkSession
    items = benchmark.select("item_id", "text").filter("text is not null and item_id is not null")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    longest = items.agg(F.max(F.char_length("text"))).first()[0] or 0
    # Twice as many blocks as would do, since hashing fills them unevenly; one item is never divided.
    n_blocks = 1 if total <= block_chars else 1 + 2 * total // max(block_chars - longest, longest, 1)
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    texts = documents.select("doc_id", "text")

    def scan(shared):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, chars_per_edit)
            for batch in batches:
                texts = batch.column("text")
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True) if t.is_valid for hit in matcher.find(normalized(t.as_py()))]
                columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)

        return of

    def sent(b: int):
        rows = items.filter(block == b).collect()
        return spark.sparkContext.broadcast((uuid.uuid4().int, [(r["item_id"], n) for r in rows if (n := normalized(r["text"]))]))

    if n_blocks == 1:
        return texts.mapInArrow(scan(sent(0)), SCHEMA)
    found = []
    for b in range(n_blocks):
        shared = sent(b)
        found.append(written(texts.mapInArrow(scan(shared), SCHEMA), "decontaminated"))
        shared.destroy()  # so the driver and the executors hold one block at a time
    return reduce(DataFrame.unionByName, found)
