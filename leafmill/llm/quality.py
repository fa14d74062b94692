"""Quality rules: exact counts for each text, and an isolation forest on them.

The forest sees shares only, so a document's length alone never makes it odd.
Its trees split anywhere in the whole box of possible shares, not only between
the rows there: so many junk documents of one kind cannot pass for usual by
being many.  As the splits need no rows, every row labelled good is counted in
every tree, task by task.  The threshold is calibrated on all labelled rows of
both kinds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import map_batches, saved, slices
from leafmill.llm.words import SPACE, windows, words_of

_SPACES = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Symbols a word, words equal to the one before, repeated words, capitals; each x as x / (x + its half).
FEATURES = {"symbols": 0.1, "doubled": 0.1, "repeated": 0.1, "capitals": 0.2}


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _flags(b"#*$%&|<>")
_UPPER = _flags(bytes(range(65, 91)))
_LEAD = ~_flags(bytes(range(0x80, 0xC0)))


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(_SPACES))


def repeated_words(hashes: np.ndarray, size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    seen = windows(hashes, size)
    ordered = np.sort(seen)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    marks = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(seen, twice))
    np.add.at(marks, at, 1)
    np.add.at(marks, at + size, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (a column for each of BASE) and FEATURES (0 to 1) of each text."""
    words = words_of(texts)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[words.text[1:]] - sums[words.text[:-1]]

    data, n = words.data, words.counts.astype(np.int64)
    chars = total(_LEAD[data] & ~SPACE[data])
    symbols = total(_SYMBOL[data])
    texts_py = texts.to_pylist()
    dup = np.array([_dup_lines(t) for t in texts_py], np.int64)
    hashes = words.hashes()
    spans = list(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True))
    repeats = np.array([repeated_words(hashes[a:b]) if b - a > 5 else 0 for a, b in spans], np.int64)
    same = np.zeros(len(hashes) + 1, np.int64)
    same[2:] = hashes[1:] == hashes[:-1]
    same[words.first[:-1][n > 0] + 1] = 0
    doubled = np.cumsum(same)[words.first]
    base = np.stack([n, chars, symbols, dup, repeats], axis=1)
    some, letters = np.maximum(n, 1), np.maximum(chars, 1)
    shares = np.stack([symbols / some, np.diff(doubled) / some, repeats / some, total(_UPPER[data]) / letters], axis=1)
    features = shares / (shares + np.array(list(FEATURES.values())))
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])


class IsolationForest:
    """Trees of random splits of the unit box, and how many rows lie in each part.

    A split takes any feature and any place in what is left of the box, so a
    part of it that no row is in is cut off early: short paths are odd.  A part
    is split until of ``sample`` rows, dealt as all rows are, one is expected
    there or none.  ``rows`` may be left out: ``plant`` makes the splits,
    ``leaves`` counts rows, and ``fill`` takes the sum of such counts.
    """

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 17):
        self.plant(len(rows), rows.shape[1], trees, sample, seed)
        self.fill(self.leaves(rows))

    @classmethod
    def planted(cls, n: int, width: int, trees: int = 100, sample: int = 256, seed: int = 17) -> IsolationForest:
        """A forest for n rows of that width, none of them counted yet."""
        out = cls.__new__(cls)
        out.plant(n, width, trees, sample, seed)
        return out

    def plant(self, n: int, width: int, trees: int, sample: int, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.sample = min(sample, n)
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        inner, size = 2**self.depth - 1, 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, size), -1, np.int16)
        self.feature[:, :inner] = random.integers(width, size=(trees, inner))
        self.split = np.zeros((trees, size))
        share = random.random((trees, inner))
        low, high = np.zeros((trees, size, width)), np.ones((trees, size, width))
        every = np.arange(trees)
        for node in range(inner):
            f = self.feature[:, node]
            at = low[every, node, f] + share[:, node] * (high[every, node, f] - low[every, node, f])
            self.split[:, node] = at
            for child in (2 * node + 1, 2 * node + 2):
                low[:, child], high[:, child] = low[:, node], high[:, node]
            high[every, 2 * node + 1, f] = low[every, 2 * node + 2, f] = at
        self.length = np.zeros((trees, size))

    def _ends(self, t: int, rows: np.ndarray) -> np.ndarray:
        """The node of tree t where each row's path ends."""
        node, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(self.depth):
            f = self.feature[t, node]
            right = rows[every, np.maximum(f, 0)] >= self.split[t, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """How many rows lie in each lowest part of each planted tree."""
        inner = 2**self.depth - 1
        return np.stack([np.bincount(self._ends(t, rows) - inner, minlength=inner + 1) for t in range(len(self.feature))])

    def fill(self, leaves: np.ndarray) -> None:
        counts = np.zeros(self.feature.shape, np.int64)
        inner = 2**self.depth - 1
        counts[:, inner:] = leaves
        for node in range(inner - 1, -1, -1):
            counts[:, node] = counts[:, 2 * node + 1] + counts[:, 2 * node + 2]
        expected = counts * (self.sample / np.maximum(1, counts[:, :1]))
        self.feature[expected <= 1] = -1
        depths = np.floor(np.log2(np.arange(counts.shape[1]) + 1))
        self.length = np.where(self.feature < 0, depths + np.vectorize(self.usual, otypes=[float])(expected), 0.0)

    @staticmethod
    def usual(n: float) -> float:
        """The mean path length of an unsuccessful search among n rows, whole or not."""
        return 0.0 if n <= 1 else 2 * (np.log(n - 0.5) + 1 / (24 * (n - 0.5) ** 2) + 0.5772156649) - 2 * (n - 1) / n

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 is odd, below 0.5 is usual."""
        total = np.zeros(len(rows))
        for t in range(len(self.feature)):
            total += self.length[t, self._ends(t, rows)]
        return 2.0 ** -(total / len(self.feature) / max(self.usual(self.sample), 1e-9))


@dataclass(frozen=True)
class QualityModel:
    forest: IsolationForest | None
    threshold: float

    def odd(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.forest is None or not len(features):
            return np.zeros(len(features)), np.zeros(len(features), bool)
        scores = self.forest.score(features)
        return scores, scores > self.threshold


def calibrate(scores: np.ndarray, bad: np.ndarray, good_loss: float) -> float:
    """The least threshold above which at most ``good_loss`` of the good rows lie."""
    good = np.sort(scores[~bad])
    if not len(good) or not bad.any():
        return np.inf
    limit = good[min(len(good) - 1, int(np.ceil(len(good) * (1 - good_loss))))]
    # Midway to the nearest bad row above, so that neither side sits on the edge.
    above = scores[bad & (scores > limit)]
    return float((limit + above.min()) / 2) if len(above) else float(limit)


def _at_rank(scores: DataFrame, rank: int) -> float:
    """The score of that rank (from 0) in a table of ``bits``, a float's from 0 on.

    Such bits are in the order of the floats: 16 of them at a time, from the
    highest, the one group is found that holds the rank.
    """
    value, known = 0, scores
    for shift in (48, 32, 16, 0):
        groups = known.groupBy(F.shiftright("bits", shift).alias("high")).agg(F.count("*").alias("n")).toPandas().sort_values("high")  # at most 65,536 rows
        upto = groups["n"].cumsum().to_numpy()
        at = int(np.searchsorted(upto, rank, "right"))
        value = int(groups["high"].iloc[at])
        rank -= int(upto[at - 1]) if at else 0
        known = scores.where(F.shiftright("bits", shift) == value)
    return float(np.int64(value).view(np.float64))


def calibrate_table(scores: DataFrame, good: int, good_loss: float) -> float:
    """``calibrate`` on a written table of ``bits`` and ``bad``, ``good`` of them not bad, and some bad."""
    limit = _at_rank(scores.where("not bad"), min(good - 1, int(np.ceil(good * (1 - good_loss)))))
    above = scores.where(F.col("bad") & (F.col("bits") > F.lit(int(np.float64(limit).view(np.int64))))).agg(F.min("bits")).first()[0]
    return limit if above is None else (limit + float(np.int64(above).view(np.float64))) / 2


MEASURES = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), "features array<double>"])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the columns of BASE and ``features`` of each row."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                base, features = measure(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), *(pa.array(base[:, k]) for k in range(5)), pa.array(features.tolist(), pa.list_(pa.float64()))], ["doc_id", *BASE, "features"])

        return step

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), make, MEASURES)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))


def learn(measured: DataFrame, labels: DataFrame, good_loss: float = 0.001) -> QualityModel:
    """Fit on all labelled rows of a written table of ``measures``.

    Rows that fail the base rules are decided already and take no part.  Of
    labels that repeat an id the worst counts; rows that repeat an id count
    each.  Only counts of parts and groups reach the driver, as many whatever
    the input.  With no labelled row of either kind the forest rejects nothing.
    """
    ids = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    ids = ids.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    passed = measured.where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").select("doc_id", "features")
    rows = saved(passed.join(ids, "doc_id").select("features", "bad"), "labelled")
    many = {r.bad: r.n for r in rows.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    good = many.get(False, 0)
    if good < 2 or not many.get(True):
        return QualityModel(None, np.inf)
    forest = IsolationForest.planted(good, len(FEATURES))

    def count():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            leaves = forest.leaves(_features(batch)).ravel()
            some = np.flatnonzero(leaves)
            yield pa.record_batch([pa.array(some), pa.array(leaves[some])], ["leaf", "n"])

        return step

    counted = map_batches(rows.where("not bad").select("features"), count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    leaves = np.zeros((len(forest.feature), 2**forest.depth), np.int64)
    leaves.ravel()[counted["leaf"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    forest.fill(leaves)

    def score():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch([pa.array(forest.score(_features(batch)).view(np.int64)), batch.column("bad")], ["bits", "bad"])

        return step

    return QualityModel(forest, calibrate_table(saved(map_batches(rows, score, "bits long, bad boolean"), "scores"), good, good_loss))


def train(docs: DataFrame, labels: DataFrame, good_loss: float = 0.001) -> QualityModel:
    """``learn`` from all labelled rows of ``docs``."""
    return learn(saved(measures(docs), "measures"), labels, good_loss)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, oddness double"


def judge(measured: DataFrame, model: QualityModel) -> DataFrame:
    """The counts and the verdict of each row of ``measures``."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            failed = base_failed(np.stack([batch.column(c).to_numpy() for c in BASE], axis=1))
            scores, odd = model.odd(_features(batch))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *BASE)), pa.array(failed), pa.array(~failed & ~odd), pa.array(scores)], ["doc_id", *BASE, "base_failed", "kept", "oddness"])

        return step

    return map_batches(measured, make, SCHEMA)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and the verdict of each row; other columns are not looked at.

    A null or empty text has no words and fails the base rules; a text of any
    length is counted whole.  Equal texts get equal rows, a null id stays null,
    no rows give no rows.
    """
    return judge(measures(docs, id_col, text_col), model)


def learn_and_judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score_documents`` by a model of the same rows, each of them measured once."""
    measured = saved(measures(docs), "measures")
    return judge(measured, learn(measured, labels))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the rules keep.

    A null or empty text has no words, so it goes; repeated rows stay or go
    together.
    """

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                base, features = measure(part.column(text_col))
                yield part.filter(pa.array(~base_failed(base) & ~model.odd(features)[1]))

        return step

    return map_batches(docs, make, docs.schema)
