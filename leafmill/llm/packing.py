"""Best-two-fit packing of whole documents into sequences of a fixed length.

Pieces of one length are alike, so the plan needs only how many pieces each
length has: at most ``capacity`` numbers, whatever the input.  The driver fills
bins from those counts, one pattern of lengths at a time with the number of
times it can be repeated; each piece then finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import bpe
from leafmill.llm.common import map_batches, saved, slices, unused


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: full ones, the first maybe shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document's ids with ``end_id`` after them.

    ``with_ids`` adds the ids, as little-endian unsigned 32-bit integers.
    """
    def make():
        encoder = bpe.file_batches(path, True)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                row, number, start, length, crc, own = [], [], [], [], [], []
                ids, first = bpe.with_ends(*encoder.encode(part.column("text")), end_id)
                data, first = memoryview(ids.tobytes()), first.tolist()
                for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    for k, (s, n) in enumerate(cut(b - a, capacity)):
                        chunk = data[4 * (a + s) : 4 * (a + s + n)]
                        row.append(i)
                        number.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(chunk))
                        if with_ids:
                            own.append(bytes(chunk))
                columns = [part.column("doc_id").take(pa.array(row, pa.int32())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch([*columns, pa.array(own, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

        return step

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), make, PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns of lengths, greatest first, and how often each is used.

    A bin takes the longest piece that fits until none does.  If a gap is left,
    its smallest piece gives way to the two unpacked pieces that fill the gap
    and its place best, where they fill more than it did.  A pattern stays the
    next choice while its lengths last, so it is used that often at once.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, many in counts.items():
        left[n] = many
    out = []
    while (there := np.flatnonzero(left)).size:
        bin_, room, used = [], capacity, {}
        at = there.size - 1
        while room and at >= 0:
            n = int(there[at])
            fit = min(room // n, int(left[n]))
            if fit:
                bin_ += [n] * fit
                used[n] = fit
                room -= n * fit
            at -= 1
        if room and len(bin_) > 1:
            small = bin_[-1]
            free = left.copy()
            for n, k in used.items():
                free[n] -= k
            if pair := best_two(free, small, small + room):
                bin_ = sorted([*bin_[:-1], *pair], reverse=True)
                used = {n: bin_.count(n) for n in bin_}
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        out.append((times, bin_))
    return out


def best_two(free: np.ndarray, more: int, most: int) -> tuple[int, int] | None:
    """Of the lengths in ``free`` two with the greatest sum over ``more`` and up to ``most``."""
    there = np.flatnonzero(free[: most + 1])
    if not there.size:
        return None
    partner = np.searchsorted(there, most - there, "right") - 1
    same = (partner >= 0) & (there[np.maximum(partner, 0)] == there) & (free[there] < 2)
    partner = partner - same
    ok = partner >= 0
    if not ok.any():
        return None
    sums = np.where(ok, there + there[np.maximum(partner, 0)], -1)
    i = int(sums.argmax())
    return (int(there[i]), int(there[partner[i]])) if sums[i] > more else None


class Places:
    """Where the pieces of each length go, by rank: a few numbers for each pattern and length."""

    def __init__(self, patterns: list[tuple[int, list[int]]], capacity: int):
        rank = np.zeros(capacity + 1, np.int64)
        rows, base = [], 0
        for times, lengths in patterns:
            for n in dict.fromkeys(lengths):
                k = lengths.count(n)
                rows.append((n, rank[n], base, k, sum(x for x in lengths if x > n)))
                rank[n] += k * times
            base += times
        rows.sort()
        self.length, self.first, self.base, self.many, self.offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
        self.key = (self.length << 48) + self.first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece of that rank (from 0) among its length."""
        at = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        within = rank - self.first[at]
        return self.base[at] + within // self.many[at], self.offset[at] + within % self.many[at] * length


def pack(parts: DataFrame, capacity: int = 1024, group: int = 200_000) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; it needs ``length``, ``doc_id``, ``piece``.

    Ranks among equal lengths are counted in salted groups of about ``group``
    rows at most, so a length that most pieces have is no single task's.  The
    order within them is that of all columns, so a piece's place hangs on what
    the table holds and not on where; rows that repeat are one row with its
    number of copies until the ranks are known, and then dealt out.
    """
    names = parts.columns
    salt, rank, before, copies, copy = unused(names, "salt", "rank", "before", "copies", "copy")
    parts = saved(parts.groupBy(*names).agg(F.count("*").alias(copies)), "pieces")
    counted = parts.groupBy("length").agg(F.sum(copies).alias("n"), F.max(copies).alias("most")).toPandas()
    counts = dict(zip(counted["length"].tolist(), counted["n"].tolist(), strict=True))
    most = max(counted["most"].tolist(), default=0)
    places = Places(plan(counts, capacity), capacity)
    salts = max(64, -(-max(counts.values(), default=0) // group))
    salted = parts.withColumn(salt, F.pmod(F.xxhash64(*names), F.lit(salts)))
    sizes = salted.groupBy("length", salt).agg(F.sum(copies).alias("n"))
    upto = sizes.select("length", salt, (F.sum("n").over(Window.partitionBy("length").orderBy(salt)) - F.col("n")).alias(before))
    order = Window.partitionBy("length", salt).orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = salted.withColumn(rank, F.sum(copies).over(order) - F.col(copies)).join(upto, ["length", salt])
    ranked = ranked.select(*names, (F.col(before) + F.col(rank)).cast("long").alias(rank), copies)
    if most > group:
        ranked = ranked.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1, F.lit(group))))
        ranked = ranked.repartition(rank, copy).select(*names, (F.col(rank) + F.col(copy)).alias(rank), F.least(F.lit(group), F.col(copies) - F.col(copy)).alias(copies))
    if most > 1:
        ranked = ranked.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
        ranked = ranked.select(*names, (F.col(rank) + F.col(copy)).alias(rank))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column(rank).to_numpy())
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*names).schema) + ", sequence_id long, offset long"
    return map_batches(ranked, make, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's pieces with the sequence and the place of each.

    A null or empty text is its end id alone; a longer one than ``capacity`` is
    cut, whatever its length.  Rows that repeat an id and text
    are packed as often as they come; a null id stays null; no rows give no
    rows; other columns are not looked at.
    """
    return pack(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), capacity)
