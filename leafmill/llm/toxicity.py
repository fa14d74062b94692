"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are whole words and word beginnings, lower-cased, by 64-bit hash; the
ones used are picked from labelled rows.  One weight vector serves all ordered
thresholds: P(grade > k) = sigmoid(w x - t_k).

Labels say toxic or not.  The grades 1 to 3 of toxic rows come from how dense
the picked features are in them, cut at the thirds of the labelled toxic rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import map_batches, saved, slices
from leafmill.llm.quality import calibrate
from leafmill.llm.words import words_of

#: Bytes that end a word: all of ASCII but letters and the apostrophe.
GAPS = np.array([b < 128 and not (65 <= b <= 90 or 97 <= b <= 122 or b == 39) for b in range(256)])
PREFIXES: list[int | None] = [None, 4, 5, 6, 7, 8]
_SLOTS = 1 << 20
#: Over how many tasks the bounded sample is spread; ``limit`` leaves it in one.
TASKS = 24


class Picker:
    """Finds the picked features among many hashes: a table of slots, then the whole hash."""

    def __init__(self, picked: np.ndarray):
        self.picked = np.sort(picked.astype(np.uint64))
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[(self.picked & np.uint64(_SLOTS - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where picked hashes stand, and which they are."""
        at = np.flatnonzero(self.slots[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.picked, hashes[at]), len(self.picked) - 1)
        ok = self.picked[which] == hashes[at]
        return at[ok], which[ok]


def features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of each kind for all words, each word's text, and the words of each text."""
    words = words_of(texts, GAPS)
    kinds = words.prefix_hashes(PREFIXES, lower=True)
    with np.errstate(over="ignore"):
        kinds = [h + np.uint64(k) for k, h in enumerate(kinds)]
    return kinds, np.repeat(np.arange(len(texts)), words.counts), words.counts


def counts(texts: pa.Array, picker: Picker) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and count of each picked feature there, and each text's words."""
    kinds, owner, n = features(texts)
    size = max(1, len(picker.picked))
    pairs = []
    for h in kinds:
        at, which = picker.find(h)
        pairs.append(owner[at] * size + which)
    keys, many = np.unique(np.concatenate(pairs).astype(np.int64), return_counts=True)
    return keys // size, keys % size, many, n


@dataclass(frozen=True)
class ToxicityModel:
    picker: Picker
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float

    def grades(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2 of each text."""
        row, which, many, _ = counts(texts, self.picker)
        score = np.bincount(row, self.weights[which] * np.log1p(many), len(texts)) if len(row) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int, penalty: float = 0.01, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts that minimise the cumulative logistic loss (Adam).

    The cuts are the first and the logarithms of the gaps, so they stay ordered.
    """
    n, top = len(grades), 3
    above = (grades[:, None] > np.arange(top)[None, :]).astype(float)
    w, free = np.zeros(size), np.array([2.0, 0.0, 0.0])
    m1, m2 = np.zeros(size + top), np.zeros(size + top)
    for step in range(1, steps + 1):
        cuts = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
        score = np.bincount(rows, values * w[cols], n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -40, 40)))
        error = (p - above) / n
        gw = np.bincount(cols, values * error.sum(axis=1)[rows], size) + penalty * w / n
        gc = -error.sum(axis=0)
        gf = np.array([gc.sum(), gc[1:].sum() * np.exp(free[1]), gc[2] * np.exp(free[2])])
        g = np.concatenate([gw, gf])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, free = w - move[:size], free - move[size:]
    return w, np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, picked: int = 500, good_loss: float = 0.002) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows, the first by a hash of doc_id.

    Labels without an id are left out, and of labels that repeat an id the
    toxic one counts; of rows that repeat an id the least by a hash of its text
    takes part, whole.  Equal texts count once.  The sample is put in order
    before anything is fitted, so equal tables give equal models.  Without rows
    of either kind nothing is toxic.  A feature is picked when, even at the lower end of
    what its counts allow, about half of the texts that have it are toxic; of
    those, the ``picked`` that most toxic texts have.  The threshold on
    P(grade > 0) is a half, or less where that calls at most ``good_loss`` of the
    clean labelled rows toxic.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(9))
    ids = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(sample)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    mine = mine.where("text is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    mine = mine.groupBy(F.sha2("r.text", 256).alias("sha")).agg(F.max("toxic").alias("toxic"), F.first("r.text").alias("text"))
    mine = saved(mine.repartition(TASKS), "toxic-sample")

    def distinct():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                kinds, owner, _ = features(part.column("text"))
                keys = np.unique(np.concatenate([np.stack([owner, h.view(np.int64)], axis=1) for h in kinds]), axis=0)
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(keys[:, 1]), pa.array(toxic[keys[:, 0]].astype(np.int64))], ["hash", "toxic"])

        return step

    odds = map_batches(mine.select("text", "toxic"), distinct, "hash long, toxic long").groupBy("hash").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    share, z = F.col("bad") / F.col("all"), 2.2
    least_share = (share + z * z / 2 / F.col("all") - z * F.sqrt(share * (1 - share) / F.col("all") + z * z / 4 / F.col("all") ** 2)) / (1 + z * z / F.col("all"))
    top = odds.where((F.col("bad") * 2 > F.col("all")) & (least_share > 0.45)).orderBy(F.desc("bad"), "all", "hash").limit(picked).toPandas()
    picker = Picker(top["hash"].to_numpy(np.int64).view(np.uint64))

    def hits():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                row, which, many, n = counts(part.column("text"), picker)
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = [(which[a:b], many[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([part.column("sha"), part.column("toxic"), pa.array(n.astype(np.int64)), pa.array([x for x, _ in lists], pa.list_(pa.int64())), pa.array([y for _, y in lists], pa.list_(pa.int64()))], ["sha", "toxic", "n", "which", "many"])

        return step

    got = map_batches(mine.select("sha", "text", "toxic"), hits, "sha string, toxic int, n long, which array<long>, many array<long>").toPandas().sort_values("sha", ignore_index=True)
    toxic = got["toxic"].to_numpy() == 1 if len(got) else np.zeros(0, bool)
    if not toxic.any() or toxic.all() or not len(picker.picked):
        return ToxicityModel(picker, np.zeros(len(picker.picked)), np.array([40.0, 41.0, 42.0]), 1.0)
    lengths = got["which"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(got)), lengths)
    cols, many = np.concatenate(got["which"].to_numpy()).astype(np.int64), np.concatenate(got["many"].to_numpy()).astype(float)
    density = np.bincount(rows, many, len(got)) / np.maximum(1, got["n"].to_numpy())
    thirds = np.quantile(density[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + (density > thirds[0]) + (density > thirds[1]), 0)
    weights, cuts = fit(rows, cols, np.log1p(many), grades, len(picker.picked))
    score = np.bincount(rows, weights[cols] * np.log1p(many), len(got))
    p = 1 / (1 + np.exp(-np.clip(score - cuts[0], -40, 40)))
    return ToxicityModel(picker, weights, cuts, min(0.5, calibrate(p, toxic, good_loss)))


SCHEMA = "doc_id long, severity double, grade int, p_toxic double, toxic boolean, kept boolean"


def grade_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``severity`` (expected grade, 0 to 3), the likeliest ``grade``, the verdict.

    A null or empty text has no features and gets what a text of unknown words
    gets; a text of any length is read whole.  Equal texts get equal rows, a
    null id stays null, of grades that tie the lowest is the likeliest, no rows
    give no rows; other columns are not looked at.
    """

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                above = model.grades(part.column("text"))
                each = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
                toxic = above[:, 0] > model.threshold
                yield pa.record_batch([part.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0].copy()), pa.array(toxic), pa.array(~toxic)], ["doc_id", "severity", "grade", "p_toxic", "toxic", "kept"])

        return step

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), make, SCHEMA)


def keep_civil(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are not toxic.

    A null or empty text has no features; by a model with positive cuts it
    stays.  Repeated rows stay or go together.
    """

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.grades(part.column(text_col))[:, 0] <= model.threshold))

        return step

    return map_batches(docs, make, docs.schema)
