"""Personal data by a semi-Markov conditional random field over base patterns.

Base patterns give emails, IP addresses, card numbers and phone numbers, and are
always kept. The field adds what they miss: obfuscated or unusually written ones
of these kinds, and secrets (passwords, tokens, access keys).

The field scores whole spans: a candidate is 1 to ``MAX_WORDS`` neighbouring
words (entities are bounded), and its features look at the span as a whole, such
as how many digits it has together, a check sum, or a keyword at its front; a
weight for each two neighbouring labels joins the spans. Dynamic programming
over segments chooses boundaries and kinds jointly; words of no entity are
segments of one word. Weights are trained here in numpy by maximum likelihood
(forward and backward sums over all labelled segmentations) on sentences made by
a seeded generator, ``TRAINING`` of them, so no row of the data is used as a
label. A worker keeps the fitted field; the driver fits it once.

Only neighbourhoods of words with a digit, an @, a = or a cue can hold an
entity, so only those are decoded; all of a text's neighbourhoods are, whole,
whatever the length of words and runs. Neighbourhoods that meet are one.

Defined results: null or empty texts have no spans. An added span that overlaps
a base span is left out. Rows are independent; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS, "secret"]
MAX_WORDS = 5
TRAINING = 500
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
#: What can be part of an entity: a digit, an @ or =, a spoken dot, or a key's name. Literal first characters keep the search fast.
TRIGGER = re.compile(r"[0-9@=]|\b(?:[Dd]ot|DOT|[Pp]ass(?:word|wd|phrase)|[Pp]wd|[Ss]ecret|[Tt]oken|[Bb]earer)\b")
COUNTS = [*(f"n_{k}" for k in KINDS), *(f"n_added_{k}" for k in KINDS), "n_secret", "n_spans"]
FIELDS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), *((n, pa.int64()) for n in COUNTS[len(KINDS) :])])
SCHEMA = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in FIELDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base pattern; each @ is looked at once, so long runs cost no more than their length."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# The field


KEYED = re.compile(r"(?i)(?:password|passwd|passphrase|pwd|token|secret|(?:api|access|secret|auth)[_-]?(?:key|token))\s*[=:]\s*[\"']?([^\s\"',;]{6,})[\"']?")
BEARER = re.compile(r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{16,}")
KEY_SHAPE = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?:ghp|gho|ghs)_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
SPOKEN_AT = re.compile(r" ?[\[({<]?(?:at|AT|@)[\])}>]? ?")
SPOKEN_DOT = re.compile(r" ?[\[({<]?(?:dot|DOT|\.)[\])}>]? ?[A-Za-z]{2,6}\Z")
HOST = re.compile(r"(?:[A-Za-z0-9-]+ ?[\[({<]?(?:dot|DOT|\.)[\])}>]? ?)*[A-Za-z0-9-]+")


def _spoken(core: str) -> bool:
    """Whether it is an address with its @ or dots in words. Each possible at is looked at once, so long words cost their length."""
    end = SPOKEN_DOT.search(core, max(0, len(core) - 20))
    begin = LOCAL.match(core)
    if not end or not begin:
        return False
    host = end.start()  # the host's last part: back over its characters
    while host > 0 and (core[host - 1].isalnum() or core[host - 1] == "-"):
        host -= 1
    for m in SPOKEN_AT.finditer(core):
        if m.start() > begin.end():
            return False
        loose = len(m.group()) > 2  # apart from both sides, not two letters in a word
        if loose and 0 < m.start() and m.end() <= end.start() and (m.end() >= host or len(core) - m.end() <= 200 and HOST.fullmatch(core, m.end(), end.start())):
            return True
    return False


def features(words: list[str], a: int, b: int) -> list[str]:
    """Whole-span features of words a to b (exclusive)."""
    span = " ".join(words[a:b])
    core = span.strip(".,;:!?\"'()[]<>")
    digits = re.sub(r"[^0-9]", "", core)
    letters = re.sub(r"[^A-Za-z]", "", core)
    out = ["bias", f"words={b - a}"]
    if not digits and "@" not in core and "=" not in core:
        out.append("bare")
    n = len(digits)
    out.append(f"digits={'0' if not n else '1-8' if n < 9 else '9-12' if n < 13 else '13-15' if n < 16 else '16-19' if n < 20 else 'more'}")
    if digits and not letters:
        out.append("numeric")
        if 13 <= n <= 19 and luhn(digits):
            out.append("numeric luhn")
        if core.startswith(("+", "00")):
            out.append("numeric plus")
        if re.fullmatch(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}", core):
            out.append("numeric area")
        if re.fullmatch(r"[0-9]{4}(?:[ .-][0-9]{4}){2,3}(?:[ .-][0-9]{1,3})?", core):
            out.append("numeric fours")
        parts = core.split(".")
        if len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts):
            out.append("four octets")
        if len(parts := re.split(r" ?[\[(]?\.[\])]? ?", core)) == 4 and core.count(".") == 3 and len(core) > len(".".join(parts)) and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts):
            out.append("spaced octets")
    at = core.find("@")
    if at > 0 and LOCAL.fullmatch(core, 0, at) and DOMAIN.fullmatch(core, at):
        out.append("address")
    elif _spoken(core):
        out.append("spoken address")
    if m := KEYED.fullmatch(core):
        out += ["keyed value"] + ["keyed mixed"] * bool(re.search("[0-9]", m[1])) + ["keyed by ="] * ("=" in core)
    if BEARER.fullmatch(core):
        out.append("bearer")
    if KEY_SHAPE.fullmatch(core):
        out.append("key shape")
    if b - a == 1 and len(core) >= 20 and digits and letters:
        out.append("long mixed")
    if a and re.search(r"(?i)(?:call|phone|tel|fax|mobile)\W*$", words[a - 1][-12:]):
        out.append("after phone cue")
    if a and re.search(r"(?i)(?:card|visa|mastercard)\W*$", words[a - 1][-12:]):
        out.append("after card cue")
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis, keepdims=True), -1e300)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis) if x.size else x.sum(axis)


class Field:
    """A log-linear model of labelled segmentations: spans' features, and neighbouring labels."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(LABELS)))
        self.next = np.zeros((len(LABELS), len(LABELS)))  # weight of a label (column) after another (row); before the first stands "none"

    def segments(self, words: list[str], grow: bool = False) -> list[tuple[int, int, list[int]]]:
        out = []
        for b in range(1, len(words) + 1):
            for a in range(max(0, b - MAX_WORDS), b):
                names = features(words, a, b)
                out.append((a, b, [self.index.setdefault(f, len(self.index)) if grow else self.index[f] for f in names if grow or f in self.index]))
        return out

    def scores(self, segments: list[tuple[int, int, list[int]]]) -> np.ndarray:
        s = np.stack([self.w[f].sum(0) for _, _, f in segments])
        s[[i for i, (a, b, _) in enumerate(segments) if b - a > 1], 0] = -np.inf  # no entity: one word
        return s

    def chances(self, n: int, segments: list[tuple[int, int, list[int]]], s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Logarithm of the sum over all labelled segmentations of n words; chance of each segment and label; expected number of each two neighbouring labels."""
        k = len(LABELS)
        fore, back = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k))
        fore[0, 0] = 0
        come, go = np.zeros((n + 1, k)), np.full((n + 1, k), -np.inf)  # sums up to a segment's start, and from it on, by its label
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for i, (a, b, _) in enumerate(segments):
            by_end[b].append(i)
            by_start[a].append(i)
        starts = np.array([a for a, _, _ in segments])
        ends = np.array([b for _, b, _ in segments])
        for b in range(n + 1):
            if b:
                fore[b] = _log_sum(s[by_end[b]] + come[starts[by_end[b]]], 0)
            come[b] = _log_sum(fore[b][:, None] + self.next, 0)
        for a in range(n - 1, -1, -1):
            go[a] = _log_sum(s[by_start[a]] + back[ends[by_start[a]]], 0)
            back[a] = _log_sum(self.next + go[a], 1)
        total = float(_log_sum(fore[n], 0))
        chance = np.exp(come[starts] + s + back[ends] - total)
        pairs = np.exp(fore[:n, :, None] + self.next + go[:n, None, :] - total).sum(0)
        return total, chance, pairs

    def fit(self, data: list[tuple[list[str], list[tuple[int, int, int]]]], rounds: int = 60, rate: float = 1.0, prior: float = 0.0002) -> None:
        """Maximum likelihood with a Gaussian prior, by adaptive gradient steps over all sentences."""
        made = [(len(words), self.segments(words, True), gold) for words, gold in data]
        self.w = np.zeros((len(self.index), len(LABELS)))
        flat = [(np.repeat(np.arange(len(segs)), [len(f) for _, _, f in segs]), np.concatenate([f for _, _, f in segs])) for _, segs, _ in made]
        gold_w, gold_next = np.zeros_like(self.w), np.zeros_like(self.next)
        for _, segs, gold in made:
            by = {(a, b): f for a, b, f in segs}
            last = 0
            for a, b, k in gold:
                gold_w[by[a, b], k] += 1
                gold_next[last, k] += 1
                last = k
        total_w, total_next = np.full_like(self.w, 1e-8), np.full_like(self.next, 1e-8)
        for _ in range(rounds):
            g, t = gold_w - prior * len(data) * self.w, gold_next - prior * len(data) * self.next
            for (n, segs, _), (rows, cols) in zip(made, flat, strict=True):
                s = np.zeros((len(segs), len(LABELS)))
                np.add.at(s, rows, self.w[cols])
                s[[i for i, (a, b, _) in enumerate(segs) if b - a > 1], 0] = -np.inf
                _, chance, pairs = self.chances(n, segs, s)
                np.add.at(g, cols, -chance[rows])
                t -= pairs
            total_w += g * g
            total_next += t * t
            self.w += rate * g / np.sqrt(total_w)
            self.next += rate * t / np.sqrt(total_next)

    def decode(self, words: list[str]) -> list[tuple[int, int, str]]:
        """Entities of the best labelled segmentation. Of equal ones, the later start of the last segment.

        What is kept for each word is one score and one step back for each label, so a run of any length is decoded whole.
        """
        n, k = len(words), len(LABELS)
        come = [np.zeros(k)] * (n + 1)  # best score up to a segment's start, by its label
        origin = [np.zeros(k, np.int64)] * (n + 1)  # the label before
        first = np.full(k, -np.inf)
        first[0] = 0
        come[0], origin[0] = (first[:, None] + self.next).max(0), (first[:, None] + self.next).argmax(0)
        steps: list[np.ndarray] = []  # start of the best segment that ends here, by its label
        best = first
        for b in range(1, n + 1):
            best, step = np.full(k, -np.inf), np.zeros(k, np.int64)
            for a in range(max(0, b - MAX_WORDS), b):
                at = [self.index[f] for f in features(words, a, b) if f in self.index]
                got = self.w[at].sum(0) + come[a]
                if b - a > 1:
                    got[0] = -np.inf
                better = got >= best
                best, step = np.where(better, got, best), np.where(better, a, step)
            steps.append(step)
            onward = best[:, None] + self.next
            come[b], origin[b] = onward.max(0), onward.argmax(0)
        out, at, label = [], n, int(best.argmax()) if n else 0
        while at:
            a = int(steps[at - 1][label])
            if label:
                out.append((a, at, LABELS[label]))
            at, label = a, int(origin[a][label])
        return out[::-1]


MIXED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def sentence(rng: random.Random) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Words with entities and what resembles them, and the segmentation (start, end, label)."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(1, 9)))
    mixed = lambda n, s="abcdef0123456789": "".join(rng.choice(s) for _ in range(n))

    def card() -> str:
        d = "4" + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def entity() -> tuple[str, str]:
        kind = rng.choice(LABELS[1:])
        if kind == "email":
            return kind, rng.choice([f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.com", f"{word()}@{word()}.org", f"{word()} at {word()} dot com", f"{word()} [at] {word()} [dot] org", f"{word()}(at){word()}(dot)net", f"{word()}.{word()} at {word()}.{word()} dot org", f"{word()} (at) {word()} (dot) com"])
        if kind == "ip":
            return kind, rng.choice([".", ".", "[.]", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            c = card()
            return kind, rng.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4))])
        if kind == "phone":
            return kind, rng.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"{num(3)}.{num(3)}.{num(4)}"])
        return kind, rng.choice([f"password={mixed(18)}", f'token = "{mixed(40)}"', "AKIA" + mixed(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), f"api_key={mixed(24)}", f"secret: {mixed(20)}", f"ghp_{mixed(36)}", f"Password: {word()}{word()}{num(2)}", f"password: {word()}{num(1)}{word()}!{word()}", f"pwd={word()}{word()}{num(1)}", f"passwd={word()}{word()}{word()}", f"Bearer {mixed(30, MIXED)}", f"bearer {mixed(20, MIXED)}.{mixed(40, MIXED)}", f"access_token={mixed(30, MIXED)}", f"sk-{mixed(32, MIXED)}", f"xoxb-{num(12)}-{mixed(24, MIXED)}"])

    def decoy() -> str:
        return rng.choice([
            num(rng.randint(1, 8)), f"{num(4)}-{rng.randint(10, 12)}-{num(2)}", f"{num(1)}.{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(2)}%", f"x = {num(2)}", f"n={num(1)}", f"version {num(1)}.{num(1)}.", f"at {word()}", f"{word()} at {word()} and {word()}",
            f"{word()}{num(2)}", f"{num(rng.randint(20, 30))}", f"{num(2)} {num(2)} {num(2)}", f"$ {num(3)}", f"token {word()}", f"password {word()}", f"dot {word()}", "1" + num(15), f"{num(3)} {num(4)}", f"{num(2)}:{num(2)}", f"secret {word()}", f"a token of {word()}", f"Password: {rng.choice(['is', 'the', 'none', ''])} {word()}", f"token: a {word()}", f"bearer of {word()}", f"{word()}={word()}", f"dot {word()} dot", f"at {word()} dot", f"{num(1)} . {num(2)}", f"{word()}{num(1)}{word()}", f"http://{word()}.com/?q={word()}{num(3)}",
        ])

    words: list[str] = []
    gold: list[tuple[int, int, int]] = []

    def plain(n: int) -> None:
        for _ in range(n):
            gold.append((len(words), len(words) + 1, 0))
            words.append(word() + rng.choice(["", "", "", ",", "."]))

    plain(rng.randint(0, 3))
    for _ in range(rng.randint(1, 2)):
        if rng.random() < 0.6:
            kind, text = entity()
            parts = (text + rng.choice(["", "", ".", ","])).split()
            gold.append((len(words), len(words) + len(parts), LABELS.index(kind)))
            words += parts
        else:
            for part in decoy().split():
                gold.append((len(words), len(words) + 1, 0))
                words.append(part)
        plain(rng.randint(1, 3))
    return words, gold


@lru_cache(maxsize=2)
def trained(seed: int = 3, n: int = TRAINING) -> Field:
    """A field fitted to n generated sentences; the seed fixes the result. One process fits it once."""
    rng, field = random.Random(seed), Field()
    field.fit([sentence(rng) for _ in range(n)])
    return field


def neighbourhoods(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) around what can be part of an entity: up to MAX_WORDS + 1 before and MAX_WORDS after. Runs that meet are one."""
    near: list[list[tuple[int, int]]] = []
    done = 0
    for spot in TRIGGER.finditer(text):
        if near and spot.start() < done:
            continue
        a = spot.start()
        for _ in range(MAX_WORDS + 1):
            while a > done and text[a - 1] in " \t\n\x0b\x0c\r":
                a -= 1
            while a > done and text[a - 1] not in " \t\n\x0b\x0c\r":
                a -= 1
        if not near or a > done:
            near.append([])
        words, last = near[-1], None
        for m in WORD.finditer(text, a):
            if TRIGGER.search(text, m.start(), m.end()):
                last = len(words)
            elif last is not None and len(words) > last + MAX_WORDS:
                break
            words.append((m.start(), m.end()))
            done = m.end()
    return near


def added_spans(text: str, field: Field, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Entities that the field finds and the base has no part of."""
    taken: list[list[int]] = []  # what the base covers, in order and apart
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    found = []
    for words in neighbourhoods(text):
        for i, j, kind in field.decode([text[a:b] for a, b in words]):
            a, b = words[i][0], words[j - 1][1]
            core = text[a:b]
            b -= len(core) - len(core.rstrip(".,;:!?\"'()[]<>"))
            a += len(core) - len(core.lstrip(".,;:!?\"'[]<>"))
            at = bisect_right(starts, b - 1) - 1  # the last base span that starts before this one's end
            if a < b and (at < 0 or taken[at][1] <= a):
                found.append((kind, a, b))
    return sorted(found)


def scan(text: str | None, field: Field) -> tuple:
    """The columns of one text but its id, in the order of FIELDS."""
    text = text or ""
    base = base_spans(text)
    added = added_spans(text, field, base)
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    order = [*KINDS, "secret"]
    every = sorted([*base, *added], key=lambda s: (order.index(s[0]), s[1], s[2]))
    many = lambda spans, kind: sum(s[0] == kind for s in spans)
    return *(many(base, k) for k in KINDS), hashlib.sha256(line.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in every), *(many(added, k) for k in order), len(every)


def personal_data(documents: DataFrame) -> DataFrame:
    """Base counts and digest, all spans (kind:start:end, code points), and counts of those the field adds, of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(trained())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py(), shared.value) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * (len(FIELDS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(FIELDS)[1:], strict=True))], schema=FIELDS)

    return documents.select("doc_id", "text").mapInArrow(of, SCHEMA)
