"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes (lower-case A-Z) are read in windows of ``WINDOW`` positions, and
``MARGIN`` more on either side for the states to settle in; windows overlap by
their margins only, so every byte of the text is labelled once, by one pass
forwards and one backwards over its surroundings, across words, breaks and
windows' ends. Each label is a probability for each language; a document's
probabilities are the mean over all its positions. The network is trained here,
in numpy, by backpropagation through time with Adam.

Training rows: at most ``per_language`` documents of each language, chosen by
hash of doc_id (fewer if there are over ``sample_rows`` / ``per_language``
languages, but one at least), and of each a stretch of ``chars_each``
characters from anywhere in it. That is the sample which the driver holds.
Rows with crc32(doc_id) mod 4 = 2, or without doc_id or lang, are never learned
from. Predictions see the text only.

Defined results: null text, and text without a letter, is ``und`` with score 0;
so is every text if there is nothing to learn from. Ties go to the language
first in order. Rows are independent; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and what may be one: some numbers match, too.
MAYBE_LETTER = re.compile(r"[^\W\d_]")
WINDOW = 160
MARGIN = 16
#: Largest number of languages whose shares are sent to all executors: some 30 bytes each.
BROADCAST_LANGUAGES = 100_000
#: Windows run at once.
BATCH = 2048
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
FIELDS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass(frozen=True)
class LanguageRules:
    per_language: int = 250
    sample_rows: int = 50_000
    chars_each: int = 2_000
    embedding: int = 8
    hidden: int = 10
    steps: int = 300
    batch: int = 96
    length: int = 32
    rate: float = 0.02
    seed: int = 11


def has_letter(text: str) -> bool:
    """Whether a character is a letter. Numbers such as a half or a circled one aren't."""
    return any(m.group().isalpha() for m in MAYBE_LETTER.finditer(text))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(errors="replace").lower(), np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Embedding, two gated recurrent layers side by side, one linear output at each position."""

    def __init__(self, languages: list[str], rules: LanguageRules):
        e, h, n = rules.embedding, rules.hidden, len(languages)
        rng = np.random.default_rng(rules.seed)
        near = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.languages, self.h = languages, h
        self.p = {"E": near(256, e) * 4, "V": near(2 * h, n), "c": np.zeros(n, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": near(e, 3 * h), f"U{d}": near(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States at all positions of one direction. x: batch, time. Where the mask is 0 the state stays."""
        h, n, wide = self.h, *x.shape
        table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]
        u = self.p[f"U{d}"]
        state, out, kept = np.zeros((n, h), np.float32), np.zeros((n, wide, h), np.float32), []
        for t in range(wide) if d == "f" else range(wide - 1, -1, -1):
            given, on = table[x[:, t]], mask[:, t, None]
            gates = _sigmoid(given[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(given[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            new = state + on * z * (c - state)
            if keep:
                kept.append((t, state, z, r, c, on))
            out[:, t] = state = new
        return out, kept

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each language at each position. x: time, batch; the result too, and languages last.

        The same as _run, with time first and the gates' halves in the weights.
        """
        h, (wide, n) = self.h, x.shape
        scores = np.empty((wide, n, len(self.languages)), np.float32)
        for k, d in enumerate("fb"):
            scale = np.repeat(np.float32([0.5, 1.0]), [2 * h, h])
            table = ((self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]) * scale).astype(np.float32)
            u = (self.p[f"U{d}"] * scale).astype(np.float32)
            gate, cand = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
            v = np.ascontiguousarray(self.p["V"][k * h : (k + 1) * h]).astype(np.float32)
            state = np.zeros((n, h), np.float32)
            for t in range(wide) if d == "f" else range(wide - 1, -1, -1):
                given = table[x[t]]
                g = state @ gate
                g += given[:, : 2 * h]
                np.tanh(g, out=g)
                g += 1
                g *= 0.5
                c = (g[:, h:] * state) @ cand
                c += given[:, 2 * h :]
                np.tanh(c, out=c)
                c -= state
                c *= g[:, :h]
                state = state + c
                if k:
                    scores[t] += state @ v
                else:
                    np.matmul(state, v, out=scores[t])
        scores += self.p["c"].astype(np.float32)
        scores -= scores.max(2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(2, keepdims=True)
        return scores

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        h, p = self.h, self.p
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        scores = both @ p["V"] + p["c"]
        scores = np.exp(scores - scores.max(2, keepdims=True))
        probs = scores / scores.sum(2, keepdims=True)
        total = mask.sum()
        rows = np.arange(len(y))
        loss = -(np.log(probs[rows, :, y] + 1e-9) * mask).sum() / total
        delta = probs.copy()
        delta[rows, :, y] -= 1
        delta *= mask[:, :, None] / total
        g = {"V": np.einsum("nth,ntl->hl", both, delta), "c": delta.sum((0, 1)), "E": np.zeros_like(p["E"])}
        back = delta @ p["V"].T
        for k, d in enumerate("fb"):
            u, w = p[f"U{d}"], p[f"W{d}"]
            gu, gx = np.zeros_like(u), np.zeros((256, 3 * h), np.float32)
            carry = np.zeros((len(y), h), np.float32)
            for t, state, z, r, c, on in reversed(runs[d][1]):
                dh = carry + back[:, t, k * h : (k + 1) * h]
                dz, dc = on * dh * (c - state), on * dh * z
                ds = dh * (1 - on * z)
                ac = dc * (1 - c * c)
                from_c = ac @ u[:, 2 * h :].T
                ar = from_c * state * r * (1 - r)
                az = dz * z * (1 - z)
                a = np.concatenate([az, ar, ac], 1)
                ds += from_c * r + a[:, : 2 * h] @ u[:, : 2 * h].T
                gu[:, : 2 * h] += state.T @ a[:, : 2 * h]
                gu[:, 2 * h :] += (r * state).T @ ac
                np.add.at(gx, x[:, t], a)
                carry = ds
            g[f"U{d}"], g[f"b{d}"] = gu, gx.sum(0)
            g[f"W{d}"] = p["E"].T @ gx
            g["E"] += gx @ w.T
        return float(loss), g


def train(samples: list[tuple[str, str]], rules: LanguageRules = LanguageRules()) -> Network | None:
    """A network from (lang, text) samples; None if there is nothing to learn. The seed fixes the result.

    Each step takes stretches of ``length`` bytes from anywhere in the samples.
    """
    codes: dict[str, list[np.ndarray]] = {}
    for lang, text in samples:
        if has_letter(text):
            codes.setdefault(lang, []).append(np.concatenate([[32], _codes(text), [32]]).astype(np.uint8))
    if not codes:
        return None
    languages = sorted(codes)
    own = [codes[k] for k in languages]
    net, rng = Network(languages, rules), np.random.default_rng(rules.seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, rules.steps + 1):
        y = rng.integers(0, len(languages), rules.batch)
        x = np.zeros((rules.batch, rules.length), np.int64)
        mask = np.zeros(x.shape, np.float32)
        for i, k in enumerate(y):
            text = own[k][rng.integers(len(own[k]))]
            at = rng.integers(max(1, len(text) - rules.length + 1))
            part = text[at : at + rules.length]
            x[i, : len(part)], mask[i, : len(part)] = part, 1
        _, g = net.gradients(x, mask, y)
        rate = rules.rate * min(1.0, 2 * (1 - step / (rules.steps + 1)))
        for k in net.p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Reader:
    """Pools the labels of texts' positions."""

    def __init__(self, net: Network):
        self.net = net

    def read(self, texts: list[str | None]) -> list[tuple[str, float]]:
        codes = [_codes(t) if t and has_letter(t) else None for t in texts]
        totals = np.zeros((len(texts), len(self.net.languages)))
        sizes = np.zeros(len(texts))
        pending: list[tuple[int, np.ndarray, int, int]] = []  # text, window, first position that counts, one past the last
        for i, own in enumerate(codes):
            if own is None:
                continue
            sizes[i] = len(own)
            wide = WINDOW + 2 * MARGIN
            padded = np.full(max(len(own) + 2 * MARGIN, wide), 32, np.uint8)
            padded[MARGIN : MARGIN + len(own)] = own
            for at in range(0, len(own), WINDOW):
                start = min(at, len(padded) - wide)  # the last window is moved to the text's end
                low = MARGIN + at - start
                pending.append((i, padded[start : start + wide], low, min(low + len(own) - at, MARGIN + WINDOW if start == at else wide - MARGIN)))
                if len(pending) == BATCH:
                    self._pool(pending, totals)
                    pending = []
        self._pool(pending, totals)
        return [self._best(totals[i], sizes[i]) for i in range(len(texts))]

    def _pool(self, windows: list[tuple[int, np.ndarray, int, int]], totals: np.ndarray) -> None:
        if not windows:
            return
        labels = self.net.labels(np.stack([w for _, w, _, _ in windows], 1))
        at = np.arange(labels.shape[0])[:, None]
        counts = (at >= [w[2] for w in windows]) & (at < [w[3] for w in windows])
        labels *= counts[:, :, None]
        np.add.at(totals, [w[0] for w in windows], labels.sum(0, dtype=np.float64))

    def _best(self, total: np.ndarray, size: float) -> tuple[str, float]:
        if not size:
            return "und", 0.0
        k = int(total.argmax())
        return self.net.languages[k], float(min(1.0, total[k] / size))


def held_out():
    """Whether a row is left for testing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame, rules: LanguageRules = LanguageRules()) -> list[tuple[str, str]]:
    """(lang, text) samples, bounded by the rules. One count for each language comes to the driver first."""
    fit = documents.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in fit.groupBy("lang").count().collect()}
    if not counts:
        return []
    each = max(1, min(rules.per_language, rules.sample_rows // len(counts)))
    # Twice the share that gives so many rows; what is above is cut by hash below. Of a language of few rows all are read.
    span = 1 << 30
    shares = documents.sparkSession.createDataFrame([(k, min(span, span * 2 * each // n + 1) if n > 4 * each else span) for k, n in counts.items()], "lang string, share long")
    chosen = fit.select("lang", "text", "doc_id", F.xxhash64("doc_id").alias("h")).join(F.broadcast(shares) if len(counts) <= BROADCAST_LANGUAGES else shares, "lang").filter(F.pmod("h", F.lit(span)) < F.col("share"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("text") - rules.chars_each, F.lit(0)).cast("long") + 1).cast("int") + 1
    part = F.substring(F.col("text"), start, F.lit(rules.chars_each)).alias("text")
    rows = chosen.select("lang", part, "h").orderBy("h", "lang", "text").collect()
    taken: dict[str, list[str]] = {}
    for r in rows:
        if len(own := taken.setdefault(r["lang"], [])) < each:
            own.append(r["text"])
    return [(k, t) for k in sorted(taken) for t in taken[k]]


def languages(documents: DataFrame, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document (doc_id, text, lang). The network is trained when this is called."""
    net = train(training_rows(documents, rules), rules)
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                got = Reader(shared.value).read(texts) if shared.value else [("und", 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=FIELDS)

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(of, SCHEMA)
