"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton finds every vocabulary piece in a text; a dynamic
program over the places where pieces end carries the best score up to there and
how many pieces it took.  Ties follow the sentencepiece library: at each end the
pieces are tried from the longest on and only a greater score displaces one; a
character that is no piece itself may be unknown, tried last, and counts as its
UTF-8 bytes.  The library adds scores as 32-bit floats from the text's start.

A piece holds the space mark only at its start, or holds nothing else, so no
piece crosses from one word into the next.  Where scores are multiples of a
power of two, float sums are exact up to ``exact`` in size; so far the words of
a text are independent and each is solved once and remembered.  A text beyond
that goes through the same program whole, rounding as the library does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat
from math import inf, log2

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.bpe import _Cache
from leafmill.llm.common import map_batches, slices

MARK = "▁"
#: Scores of ranked pieces are multiples of one over this.
STEPS = 4
_RUN = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")


def rank_score(rank: int) -> float:
    """A Zipf score for the vocabulary's rank-th piece, in quarters of a bit."""
    return -round(STEPS * log2(rank + 2)) / STEPS


def load_pieces(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece model and their scores.

    A unigram model has scores of its own.  Another's say in which order its
    pieces were merged; those pieces get ``rank_score`` by their place.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    plain = [p for p in model.pieces if p.type == p.NORMAL]
    if model.trainer_spec.model_type == model.trainer_spec.UNIGRAM:
        return {p.piece: p.score for p in plain}
    return {p.piece: rank_score(k) for k, p in enumerate(plain)}


class UnigramCounter:
    """``count(text)``: pieces, of them bytes of unknown characters, and the best score."""

    def __init__(self, pieces: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), float(np.float32(score))))
        self.automaton.make_automaton()
        self.unknown = float(np.float32(min(pieces.values()) - 10.0))
        quarters = all(float(s * STEPS).is_integer() for s in (*pieces.values(), self.unknown))
        apart = all(MARK not in p[1:] or not p.strip(MARK) for p in pieces)
        self.exact = 2.0**24 / STEPS if quarters and apart else 0.0
        self.lines = not any("\n" in p for p in pieces)
        self.singles = {p for p in pieces if len(p) == 1}
        self.begun = _Cache(lambda w: self._word(MARK + w, self.begun))
        self.bare = _Cache(lambda w: self._word(w, self.bare))

    def solve(self, text: str, add: Callable[[float, float], float]) -> tuple[int, int, float]:
        """The program over a text with its marks; ``add`` sums two scores."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        taken: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        best[0] = 0.0
        found = self.automaton.iter(text)
        last, match = next(found, (n, None))
        for end in range(n):
            top, source, single = None, 0, False
            while last == end:
                size, score = match
                total = add(best[end + 1 - size], score)
                if top is None or total > top:
                    top, source = total, size
                single |= size == 1
                last, match = next(found, (n, None))
            if not single:
                total = add(best[end], self.unknown)
                if top is None or total > top:
                    top, source = total, 0
            if source:
                count, odd = taken[end + 1 - source]
                taken[end + 1] = count + 1, odd
            else:
                count, odd = taken[end]
                size = len(text[end].encode())
                taken[end + 1] = count + size, odd + size
            best[end + 1] = top
        return *taken[n], best[n]

    @staticmethod
    def _packed(count: int, odd: int, score: float) -> int:
        """One integer whose sums are the sums of all three."""
        return count | odd << 32 | round(-score * STEPS) << 64

    def _word(self, word: str, own: _Cache) -> int:
        if self.lines and "\n" in word:
            first, *rest = word.split("\n")
            head = self.begun[first[1:]] if first[:1] == MARK else self.bare[first]
            return head + len(rest) * self._packed(1, 1, self.unknown) + sum(map(self.bare.__getitem__, rest))
        if not self.singles.issuperset(word):
            return self._packed(*self.solve(word, float.__add__))
        best, taken = [0.0, *repeat(-inf, len(word))], [0] * (len(word) + 1)  # as in solve, where no character is unknown
        for end, (size, score) in self.automaton.iter(word):
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1] = total
                taken[end + 1] = taken[end + 1 - size] + 1
        return self._packed(taken[-1], 0, best[-1])

    def count(self, text: str | None) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        if self.exact:
            if MARK in text or "  " in text or text[0] == " ":
                marked = MARK + text.replace(" ", MARK)
                total = sum(self.begun[run[1:]] for run in _RUN.findall(marked))
            else:
                total = sum(map(self.begun.__getitem__, text.split(" ")))
            score = -(total >> 64) / STEPS
            if -score < self.exact:
                return total & 0xFFFFFFFF, total >> 32 & 0xFFFFFFFF, score
        return self.solve(MARK + text.replace(" ", MARK), lambda a, b: float(np.float32(a) + np.float32(b)))


_counters: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """One for each worker process."""
    if path not in _counters:
        _counters[path] = UnigramCounter(load_pieces(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_unknown, score`` of each whole text.

    ``n_unknown`` counts the bytes of unknown characters, each a token.  A null
    or empty text has no tokens and the score 0; a text of any length is counted
    whole.  Equal texts get equal rows; a null id stays null; no rows give no
    rows; other columns are not looked at.
    """

    def make():
        own = counter(path)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                found = [own.count(t) for t in part.column("text").to_pylist()]
                n, odd, score = zip(*found, strict=True)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(odd, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_unknown", "score"])

        return step

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), make, "doc_id long, n_tokens long, n_unknown long, score double")
