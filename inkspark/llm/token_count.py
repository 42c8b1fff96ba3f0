"""Token counts of a unigram tokenizer without making tokens.

Aho-Corasick finds all vocabulary pieces in a word, by their ends and, at one
end, the longest first. Viterbi keeps for each place the best score and how many
pieces lead there, no back pointers. A later candidate must be strictly better,
so of equal scores the one whose last piece starts first wins; a character that
no piece covers alone costs the least score less ten, and neighbouring unknown
characters are one token. These are the rules of the tokenizers library's
Unigram model, and counts are equal to its.

Text is cut before each space, the space becoming the word's first character, as
that library's Metaspace does; no piece reaches over such a cut, so words are
counted alone, and each worker keeps the counts of up to ``CACHE`` words.

The vocabulary is read on the driver from a sentencepiece file (its ordinary
pieces and their scores as they stand) and sent to executors: tens of thousands
of pieces, whatever the corpus. Nothing is trained.

Defined results: null and empty texts have no tokens. Rows are independent;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 500_000
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def unigram_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """The unknown token, then the ordinary pieces of a sentencepiece file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)
    return [("<unk>", 0.0)] + [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Counter:
    """Counts tokens of texts."""

    def __init__(self, pieces: list[tuple[str, float]], cache: int = CACHE):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.cache = cache

    def word(self, word: str) -> int:
        """Tokens of one word, by count-only Viterbi."""
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        single = [False] * n
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, match in self.automaton.iter(word):
            ends[last].append(match)
            if match[0] == 1:
                single[last] = True
        for last in range(n):
            best, steps, is_unknown = None, 0, False
            for length, value in ends[last]:
                start = last + 1 - length
                total = score[start] + value
                if best is None or total > best:
                    best, steps, is_unknown = total, count[start] + 1, False
            if not single[last]:
                total = score[last] + self.unknown
                if best is None or total > best:
                    best, steps, is_unknown = total, count[last] + (not unknown[last]), True
            score[last + 1], count[last + 1], unknown[last + 1] = best, steps, is_unknown
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        spaced = text.replace(" ", SPACE)
        words = (spaced[1:] if spaced[0] == SPACE else spaced).split(SPACE)
        known, total = self.known, 0
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        for w in words:
            got = known.get(w)
            if got is None:
                got = self.word(SPACE + w)
                if len(w) <= 64:  # so that what is kept has a bound
                    if len(known) >= self.cache:
                        known.clear()
                    known[w] = got
            total += got
        return total


_counters: dict[int, Counter] = {}


def _counter(shared) -> Counter:
    """One automaton for each worker process and vocabulary."""
    key, pieces = shared.value
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(pieces)
    return _counters[key]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars (code points) and n_tokens of each row."""
    shared = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().int, unigram_pieces(vocabulary)))

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        counter = _counter(shared)
        return pd.Series([counter.text(t) for t in texts], dtype="int64")

    return documents.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), n_tokens("text").alias("n_tokens"))
