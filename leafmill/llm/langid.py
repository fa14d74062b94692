"""Language of whole texts by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of a fixed length, each overlapping
the one before by the widest filter less one, so every place is seen.  Filters
of several widths run over embedded bytes, each filter keeps its greatest value
in a window, and a linear layer gives a score for each language.  A text's
scores are the means of its windows' scores, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import first_ids, map_batches, slices
from leafmill.llm.words import text_bytes

UNKNOWN = "und"


@dataclass(frozen=True)
class Shape:
    """``window`` bytes; ``filters`` of each of ``widths`` over ``embed`` numbers a byte."""

    window: int = 256
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16

    @property
    def widest(self) -> int:
        return max(self.widths)

    @property
    def stride(self) -> int:
        return self.window - self.widest + 1

    @property
    def size(self) -> int:
        return self.filters * len(self.widths)

    def mask(self) -> np.ndarray:
        """Which of the widest window's numbers each filter may look at."""
        reach = np.repeat(self.widths, self.filters) * self.embed
        return (np.arange(self.widest * self.embed)[:, None] < reach[None, :]).astype(np.float32)


@dataclass
class ByteNet:
    shape: Shape
    langs: list[str]
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    order: list[str] = field(default=("embed", "conv", "bias", "out", "out_bias"), repr=False)

    @classmethod
    def fresh(cls, shape: Shape, langs: list[str], seed: int = 4) -> ByteNet:
        random = np.random.default_rng(seed)

        def normal(*size: int, scale: float) -> np.ndarray:
            return (random.standard_normal(size) * scale).astype(np.float32)

        k = shape.widest * shape.embed
        return cls(shape, langs, normal(256, shape.embed, scale=0.5), normal(k, shape.size, scale=k**-0.5) * shape.mask(), np.zeros(shape.size, np.float32), normal(shape.size, len(langs), scale=shape.size**-0.5), np.zeros(len(langs), np.float32))

    def places(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes under the widest filter at each place: windows, places, numbers."""
        x = np.ascontiguousarray(self.embed[windows])
        n, length, d = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - self.shape.widest + 1, self.shape.widest * d), (s[0], s[1], s[2]), writeable=False)

    def scores(self, windows: np.ndarray, block: int = 256) -> np.ndarray:
        """A row of language scores for each window of bytes."""
        rows = []
        for at in range(0, len(windows), block):
            places = self.places(windows[at : at + block])
            n, p, k = places.shape
            top = (places.reshape(n * p, k) @ self.conv).reshape(n, p, -1).max(axis=1)
            rows.append(np.maximum(top + self.bias, 0) @ self.out + self.out_bias)
        return np.concatenate(rows) if rows else np.zeros((0, len(self.langs)), np.float32)

    def train(self, windows: np.ndarray, langs: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.004, seed: int = 5) -> None:
        """Adam on the softmax loss, each language weighing the same in all."""
        random = np.random.default_rng(seed)
        weight = 1.0 / np.maximum(1, np.bincount(langs, minlength=len(self.langs)))
        weight = (weight[langs] * len(langs) / (weight > 0).sum()).astype(np.float32)
        names, mask, steps = list(self.order), self.shape.mask(), 0
        m1 = {k: np.zeros_like(getattr(self, k)) for k in names}
        m2 = {k: np.zeros_like(getattr(self, k)) for k in names}
        total = epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(len(windows)), max(1, -(-len(windows) // batch))):
                grads = self._gradients(windows[rows], langs[rows], weight[rows])
                grads["conv"] *= mask
                steps += 1
                now = rate * (1 - steps / (total + 1))
                for k in names:
                    m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, (getattr(self, k) - now * (m1[k] / (1 - 0.9**steps)) / (np.sqrt(m2[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32))

    def _gradients(self, windows: np.ndarray, langs: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        places = self.places(windows)
        n, p, k = places.shape
        conv = (places.reshape(n * p, k) @ self.conv).reshape(n, p, -1)
        at = conv.argmax(axis=1)
        top = np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(top, 0)
        scores = hidden @ self.out + self.out_bias
        p_lang = softmax(scores)
        p_lang[np.arange(n), langs] -= 1
        error = p_lang * (weight / n)[:, None]
        back = (error @ self.out.T) * (top > 0)
        seen = places[np.arange(n)[:, None], at]  # windows, filters, numbers
        down = back[:, :, None] * self.conv.T[None]
        d, widest = self.shape.embed, self.shape.widest
        which = windows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(widest)]
        embed = np.zeros_like(self.embed)
        np.add.at(embed, which.ravel(), down.reshape(-1, widest, d).reshape(-1, d))
        return {"embed": embed, "conv": np.einsum("nf,nfk->kf", back, seen), "bias": back.sum(axis=0), "out": hidden.T @ error, "out_bias": error.sum(axis=0)}


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text of each, and how many of its bytes are real.

    The last window of a text is filled up with spaces; an empty text has none.
    """
    data, first = text_bytes(texts)
    sizes = np.diff(first)
    many = np.where(sizes > 0, np.maximum(1, -(-(sizes - shape.widest + 1) // shape.stride)), 0)
    owner = np.repeat(np.arange(len(sizes)), many)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * shape.stride
    real = np.minimum(shape.window, sizes[owner] - begin)
    at = (first[:-1][owner] + begin)[:, None] + np.arange(shape.window)
    filled = np.concatenate([data, np.full(shape.window, 32, np.uint8)])
    windows = filled[np.minimum(at, len(filled) - 1)]
    windows[np.arange(shape.window) >= real[:, None]] = 32
    return windows, owner, real


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 4


def has_letter(text: str | None) -> bool:
    """Whether a character of ``text`` is a letter; numerals such as U+00BD and U+2167 are none."""
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, shape: Shape = Shape(), held_out: int = 2, sample: int = 2_000, longest: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """Fit on a bounded sample: at most ``sample`` labelled rows of at most ``longest`` bytes.

    The rows are the first by a hash of their id; each is read whole.  Only rows
    with an id, a text and a language outside the held-out fold take part.  Of
    rows that repeat an id one takes part, the least by a hash of its text, and
    of ties by its language.  None if there is no such row, as in an empty table.
    """
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    mine = mine.where(F.col("lang").isNotNull() & (fold("doc_id") != held_out) & F.octet_length("text").between(1, longest))
    ids = F.broadcast(first_ids(mine, 4, sample))  # at most ``sample`` ids

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                windows, owner, _ = windows_of(part.column("text"), shape)
                rows = pa.array(owner)
                yield pa.record_batch([part.column("doc_id").take(rows), part.column("lang").take(rows), pa.array(np.arange(len(owner))), pa.array([w.tobytes() for w in windows], pa.binary())], ["doc_id", "lang", "place", "bytes"])

        return step

    one = mine.join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text")
    got = map_batches(one, make, "doc_id long, lang string, place long, bytes binary").toPandas().sort_values(["doc_id", "place"])
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    net = ByteNet.fresh(shape, langs)
    net.train(np.frombuffer(b"".join(got["bytes"]), np.uint8).reshape(-1, shape.window), np.searchsorted(langs, got["lang"].to_numpy(str)))
    return net


def predict(docs: DataFrame, net: ByteNet | None, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each whole text.

    ``score`` is the language's probability.  A text that is null or has no
    letter is ``und`` with the score 0, as is every text where nothing could be
    learned.  A null id is not held out.  Only the text is looked at, whole and
    at any length, in windows; of languages that tie the first by name is taken.
    Repeated rows get equal rows; no rows give no rows.
    """

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text", 1 << 20):
                n = part.num_rows
                letters = np.array([has_letter(t) for t in part.column("text").to_pylist()])
                names, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if net is not None and letters.any():
                    windows, owner, real = windows_of(part.column("text"), net.shape)
                    scores = net.scores(windows).astype(np.float64) * real[:, None]
                    total = np.stack([np.bincount(owner, scores[:, k], n) for k in range(len(net.langs))], axis=1)
                    p = softmax(total / np.maximum(1, np.bincount(owner, real, n))[:, None])
                    names[letters] = np.array(net.langs, object)[p.argmax(axis=1)][letters]
                    score[letters] = p.max(axis=1)[letters]
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")
