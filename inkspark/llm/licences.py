"""License scans by fuzzy short-notice search.

Base: places where a phrase's words stand consecutively. Method: each notice may
differ by some edits; cut into one piece more than that, one piece of any match
is unharmed. An Aho-Corasick automaton of these seeds finds candidate places in
the lower-case text, and the regex library's bounded-error matching verifies the
notice in a window around them and reports its span and errors.

Notices differ by a name, and an edit budget could turn one name into another.
So each has words that must stand in its span without any error, one after the
other: the licence's name. Names that begin alike are told apart by whole words,
to which hyphens and points belong (by-nc isn't by-nc-sa).

A text's score is 1 for an exact base phrase, else 1 less the share of errors of
its best notice, else 0.

Defined results: null or empty texts have no words, places or labels. A notice
found again counts once for a label; of overlapping spans, of one notice or
several, the one of fewest errors stays (then the longest, then the first). Rows are independent; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Names of licences as "under the ... license" has them, by label.
NAMES = {
    "mit": ["mit", "expat"], "x11": ["x11"], "apache": ["apache", "apache software"], "bsd": ["bsd", "new bsd", "modified bsd", "bsd 2-clause", "bsd 3-clause", "2-clause bsd", "3-clause bsd"], "isc": ["isc"],
    "gpl": ["gpl", "gnu gpl", "gnu general public"], "lgpl": ["lgpl", "gnu lgpl", "gnu lesser general public", "gnu library general public"], "agpl": ["agpl", "gnu agpl", "gnu affero general public"],
    "mpl": ["mozilla public", "mpl"], "epl": ["eclipse public", "epl"], "eupl": ["european union public", "eupl"], "cddl": ["common development and distribution", "cddl"], "zlib": ["zlib"], "artistic": ["artistic"],
    "bsl-1.0": ["boost software"], "ofl": ["sil open font"], "psf": ["python software foundation"], "postgresql": ["postgresql"], "ncsa": ["ncsa"], "openssl": ["openssl"], "php": ["php"], "ruby": ["ruby"], "vim": ["vim"],
    "ms-pl": ["microsoft public"], "ms-rl": ["microsoft reciprocal"], "afl": ["academic free"], "osl": ["open software"], "upl": ["universal permissive"], "cecill": ["cecill"], "unlicense": ["unlicense"],
}
#: Creative Commons terms, short and in full.
CC = {
    "by": "attribution", "by-sa": "attribution-sharealike", "by-nd": "attribution-noderivatives", "by-nc": "attribution-noncommercial",
    "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderivatives",
}
#: Short notices by label, as licences ask to print them, with the words that must stand in them as they are.
NOTICES = [
    *((f"{verb}under the {name} license", label, name) for label, names in NAMES.items() for name in names for verb in ("", "released ", "licensed ", "distributed ")),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit", "permission"),
    ("permission to use, copy, modify, and/or distribute this software for any purpose", "isc", "permission"),
    ("licensed under the apache license, version 2.0", "apache", "apache"),
    ("you may not use this file except in compliance with the license", "apache", "compliance"),
    ("you can redistribute it and/or modify it under the terms of the gnu general public license", "gpl", "gnu general"),
    ("you can redistribute it and/or modify it under the terms of the gnu lesser general public license", "lgpl", "gnu lesser"),
    ("you can redistribute it and/or modify it under the terms of the gnu affero general public license", "agpl", "gnu affero"),
    ("gnu lesser general public license", "lgpl", "gnu lesser"),
    ("gnu affero general public license", "agpl", "gnu affero"),
    ("redistribution and use in source and binary forms, with or without modification", "bsd", "binary"),
    ("subject to the terms of the mozilla public license", "mpl", "mozilla"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered"),
    ("dedicated to the public domain", "public-domain", "public domain"),
    ("all rights reserved.", "all-rights-reserved", "rights reserved"),
    ("spdx-license-identifier:", "spdx", "spdx-license-identifier"),
    *((f"licensed under cc {terms}", f"cc-{terms}", terms) for terms in CC),
    *((f"under cc-{terms}", f"cc-{terms}", f"cc-{terms}") for terms in CC),
    *((f"creative commons {long}", f"cc-{terms}", long) for terms, long in CC.items()),
    ("licensed under cc0", "cc0", "cc0"),
    ("creative commons zero", "cc0", "commons zero"),
]
CHARS_PER_EDIT = 9
FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.string())),
])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"


#: A whole word: hyphens and points inside belong to it.
WHOLE = re.compile(r"[^\W_]+(?:[-.+][^\W_]+)*")


class Notices:
    """Bounded-error search for the notices: (text, label, words that must stand in it)."""

    def __init__(self, notices: list[tuple[str, str, str]] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.notices = [(text, label, len(text) // chars_per_edit, must.split()) for text, label, must in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}") for text, _, k, _ in self.notices]
        self.chars = [{c: text.count(c) for c in set(text)} for text, *_ in self.notices]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (text, _, k, _) in enumerate(self.notices):
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                where.setdefault(text[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for seed, places in where.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, errors) of notices in a lower-case text."""
        starts: dict[int, list[int]] = {}
        for last, (length, places) in self.seeds.iter(text):
            for n, at in places:
                starts.setdefault(n, []).append(last - length + 1 - at)
        found = []
        for n, places in starts.items():
            notice, label, k, _ = self.notices[n]
            after = -1
            for s in sorted(set(places)):
                if s < after:
                    continue  # within the window before
                a, b = max(0, s - k), min(len(text), s + len(notice) + 2 * k)
                after = s + k + 1
                if m := self._verify(n, notice, text, s, a, b):
                    found.append((label, *m))
        return apart(found)

    def _verify(self, n: int, notice: str, text: str, s: int, a: int, b: int) -> tuple[int, int, int] | None:
        _, _, k, must = self.notices[n]
        # Cheap and exact bounds first: the name stands there, and a match lacks at most k of the notice's characters.
        if any(text.find(w, a, b) < 0 for w in must):
            return None
        if s >= 0 and text.startswith(notice, s):
            return (s, s + len(notice), 0) if self._named(must, text, s, s + len(notice)) else None
        window = text[a:b]
        if sum(max(0, c - window.count(x)) for x, c in self.chars[n].items()) > k:
            return None
        m = self.patterns[n].search(window)
        if not m or not self._named(must, text, a + m.start(), a + m.end()):
            return None
        return a + m.start(), a + m.end(), sum(m.fuzzy_counts)

    @staticmethod
    def _named(must: list[str], text: str, a: int, b: int) -> bool:
        """Whether the words stand in the span, whole, one after the other. A word at the span's end may reach beyond it, and so isn't it."""
        words = []
        for m in WHOLE.finditer(text, max(0, a - 40)):
            if m.start() >= b:
                break
            if m.end() > a:
                words.append(m.group())
        return any(words[i : i + len(must)] == must for i in range(len(words) - len(must) + 1))


def apart(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Of overlapping spans the one of fewest errors, then the longest, then the first."""
    from bisect import bisect_left, insort

    kept: list[tuple[str, int, int, int]] = []
    spans: list[tuple[int, int]] = []  # of those kept: apart from each other and in order
    for f in sorted(found, key=lambda f: (f[3], f[1] - f[2], f[1], f[0])):
        i = bisect_left(spans, (f[1], f[2]))
        if (i == 0 or spans[i - 1][1] <= f[1]) and (i == len(spans) or f[2] <= spans[i][0]):
            insort(spans, (f[1], f[2]))
            kept.append(f)
    return kept


_notices: list[Notices] = []


def scan(text: str | None, notices: Notices) -> tuple:
    lower = (text or "").encode().lower().decode()  # of bytes: A-Z only
    n_words = len(WORD.findall(lower))
    places, base = [], set()
    if any(p.rpartition(" ")[2] in lower for p, _ in PHRASES):
        words = WORD.findall(lower)
        for phrase, label in PHRASES:
            parts = phrase.split()
            for i, w in enumerate(words):
                if w == parts[0] and words[i : i + len(parts)] == parts:
                    places.append(i)
                    base.add(label)
    found = notices.find(lower) if lower else []
    labels = base | {f[0] for f in found}
    best = max((1 - e / (b - a) for _, a, b, e in found if b > a), default=0.0)
    score = 1.0 if base else max(0.0, min(1.0, best))
    spans = [f"{label}:{a}:{b}:{e}" for label, a, b, e in sorted(found, key=lambda f: (f[1], f[2], f[0]))]
    return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def licences(documents: DataFrame) -> DataFrame:
    """Word and phrase counts, labels, score and spans (label:start:end:errors, code points) of each document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _notices:
            _notices.append(Notices())
        for batch in batches:
            rows = [scan(t.as_py(), _notices[0]) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * (len(FIELDS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(FIELDS)[1:], strict=True))], schema=FIELDS)

    return documents.select("doc_id", "text").mapInArrow(of, SCHEMA)
