"""A content-addressed store of token ids.

Each document's ids are cut where a rolling hash of the last ids says so, so
equal passages give equal chunks wherever they stand.  A chunk is named by the
hash of its bytes and stored once; a document is a recipe of chunk names.  The
store is three Parquet tables under one path:

``chunks/kind=chunk``  name, payload (ids, little-endian, 2 or 4 bytes each)
``recipes``            part, key, before, doc_id, n_tokens, names, root; parts, and
                       keys in each, in ascending doc_id order; ``before`` counts
                       the ids of the part before this document
``manifest``           part, block, documents, tokens, before, root: Merkle roots over
                       the roots of up to ``BLOCK`` recipes

Reading checks every payload against its name, every recipe against its root,
and every root and count against the manifest, and fails where one does not hold.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import bpe
from leafmill.llm.common import map_batches, new_path, slices
from leafmill.llm.words import mix, stream

NAME = 16  # bytes of a chunk's name
LEAST, MOST, MEAN_BITS = 64, 1024, 8
BLOCK = 4096  # recipes under one root of the manifest


class StoreError(RuntimeError):
    """What is stored is not what its name or root says."""


def named(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=NAME).digest()


@cache
def _gears(size: int) -> np.ndarray:
    return stream(41, size)


def cuts(ids: np.ndarray, first: np.ndarray, vocabulary: int) -> list[list[int]]:
    """The chunk ends of each document; ``first`` has where each begins in ``ids``, and the end.

    The hash at a place covers 16 ids; a chunk has ``LEAST`` ids or more, so
    it never reaches into the document before.
    """
    with np.errstate(over="ignore"):
        h = _gears(vocabulary)[ids]
        for k in (1, 2, 4, 8):
            shifted = h.copy()
            shifted[k:] += h[:-k] << np.uint64(k)
            h = shifted
    places = np.flatnonzero((h >> np.uint64(64 - MEAN_BITS)) == 0) + 1
    lows = np.searchsorted(places, first[:-1], "right").tolist()
    highs = np.searchsorted(places, first[1:], "left").tolist()
    out = []
    for a, b, low, high in zip(first[:-1].tolist(), first[1:].tolist(), lows, highs, strict=True):
        ends, at = [], a
        for place in places[low:high].tolist() if high > low else ():
            while place - at > MOST:
                at += MOST
                ends.append(at)
            if place - at >= LEAST:
                at = place
                ends.append(at)
        while b - at > MOST:
            at += MOST
            ends.append(at)
        if b > at:
            ends.append(b)
        out.append(ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; leaves and nodes are hashed apart."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0] if level else hashlib.sha256(b"").digest()


def recipe_root(names: bytes) -> bytes:
    return merkle([names[i : i + NAME] for i in range(0, len(names), NAME)])


_RECIPE, _CHUNK = "doc_id long, n_tokens long, names binary, root binary", "name binary, payload binary"
_SPLIT = f"kind string, spread long, {_RECIPE}, {_CHUNK}"
_COLUMNS = [f.split()[0] for f in _SPLIT.split(", ")]


def _split(docs: DataFrame, path: str, end_id: int, vocabulary: int) -> DataFrame:
    """Recipes, and among them the chunks that a task meets for the first time.

    ``spread`` deals rows out: equal chunks to one place, recipes anywhere.
    """
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def make():
        encoder = bpe.file_batches(path, False)
        met: set[bytes] = set()
        count = 0

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal count
            for part in slices(batch, "text"):
                ids, first = bpe.with_ends(*encoder.encode(part.column("text")), end_id)
                data, size = memoryview(ids.astype(width).tobytes()), np.dtype(width).itemsize
                recipes, fresh, payloads = [], [], []
                for start, ends in zip(first.tolist(), cuts(ids, first, vocabulary), strict=False):
                    names = []
                    for stop in ends:
                        name = named(payload := data[size * start : size * stop])
                        names.append(name)
                        if name not in met:
                            if len(met) >= 1_000_000:  # what is met again is only sent again
                                met.clear()
                            met.add(name)
                            fresh.append(name)
                            payloads.append(bytes(payload))
                        start = stop
                    recipes.append(b"".join(names))
                n, m = len(recipes), len(fresh)
                spread = mix(np.arange(count, count + n, dtype=np.uint64)).view(np.int64)
                count += n
                roots = pa.array(map(recipe_root, recipes), pa.binary(), size=n)
                yield pa.record_batch([pa.array(["recipe"] * n), pa.array(spread), part.column("doc_id"), pa.array(np.diff(first)), pa.array(recipes, pa.binary()), roots, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], _COLUMNS)
                spread = np.frombuffer(b"".join(fresh), np.int64)[:: NAME // 8]
                yield pa.record_batch([pa.array(["chunk"] * m), pa.array(spread), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(fresh, pa.binary()), pa.array(payloads, pa.binary())], _COLUMNS)

        return step

    return map_batches(docs, make, _SPLIT)


def _once(split: DataFrame) -> DataFrame:
    """Each chunk once: equal names are neighbours in one partition, so a task holds one name."""

    def make():
        last = np.zeros((0, NAME), np.uint8)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal last
            held = batch.column("name")
            rows = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
            if len(rows):
                names = np.frombuffer(b"".join(held.take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, NAME)
                both = np.concatenate([last, names])
                same = np.zeros(len(both), bool)
                same[1:] = (both[1:] == both[:-1]).all(axis=1)
                keep = np.ones(batch.num_rows, bool)
                keep[rows[same[len(last) :]]] = False
                last = names[-1:].copy()
                batch = batch.filter(pa.array(keep))
            yield batch

        return step

    return map_batches(split.repartition("spread").sortWithinPartitions("kind", "name"), make, _SPLIT)


_ORDERED = f"part int, key long, before long, {_RECIPE}"


def _numbered(recipes: DataFrame) -> DataFrame:
    """Recipes in ascending doc_id order, numbered in each part, with the ids before them there."""
    ranged = recipes.withColumn("tie", F.monotonically_increasing_id())
    order = ("doc_id", "root", "tie")  # rows alike in all that is stored may lie in several parts
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")

    def make():
        part, key, before = TaskContext.get().partitionId(), 0, 0

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal key, before
            n, sizes = batch.num_rows, batch.column("n_tokens").to_numpy()
            at = before + np.cumsum(sizes) - sizes
            yield pa.record_batch([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(key, key + n)), pa.array(at), *batch.columns], [f.split()[0] for f in _ORDERED.split(", ")])
            key, before = key + n, before + int(sizes.sum())

        return step

    return map_batches(ranged, make, _ORDERED)


_MANIFEST = "part int, block long, documents long, tokens long, before long, root binary"


def _manifest(recipes: DataFrame) -> DataFrame:
    """The tree of each block of recipes: never more than ``BLOCK`` rows in one place."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        sizes = pdf["n_tokens"].to_numpy()
        if (pdf["before"].to_numpy() != pdf["before"].iloc[0] + np.cumsum(sizes) - sizes).any():
            raise StoreError("a recipe stands at another place than its part's counts say")
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "block": [pdf["block"].iloc[0]], "documents": [len(pdf)], "tokens": [int(sizes.sum())], "before": [pdf["before"].iloc[0]], "root": [merkle(pdf["root"].tolist())]})

    blocks = recipes.select("part", F.floor(F.col("key") / BLOCK).alias("block"), "key", "before", "n_tokens", "root")
    return blocks.groupBy("part", "block").applyInPandas(tree, _MANIFEST)


def write(docs: DataFrame, path: str, at: str | None = None, end_id: int = 1, vocabulary: int = 49_408, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs``, with ``end_id`` after each document, into a store; its path.

    A null or empty text is its end id alone; a text of any length is one recipe
    of chunks of bounded size.  Rows that repeat an id and text are as many
    recipes of the same chunks, in any order among themselves; null ids come
    first.  No rows give an empty store; other columns are not looked at.
    """
    spark = docs.sparkSession
    at = at or new_path(spark, "store")
    split = _split(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), path, end_id, vocabulary)
    _once(split).drop("spread").write.partitionBy("kind").option("compression", "zstd").parquet(f"{at}/chunks")
    recipes = spark.read.schema(f"{_RECIPE}, kind string").parquet(f"{at}/chunks").where("kind = 'recipe'").drop("kind")
    _numbered(recipes).write.parquet(f"{at}/recipes")
    _manifest(_recipes(spark, at)).write.parquet(f"{at}/manifest")
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/chunks/kind=recipe")
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return at


def _recipes(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(_ORDERED).parquet(f"{at}/recipes")


def _chunks(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(f"{_CHUNK}, kind string").parquet(f"{at}/chunks").where("kind = 'chunk'").drop("kind")


def _sums(spark: SparkSession, at: str, width: str) -> DataFrame:
    """``name, n, crc``: ids and crc32 (of 32-bit ids) of each chunk, as read and checked."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n, crc = [], []
            for name, payload in zip(batch.column("name").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if named(payload) != name:
                    raise StoreError(f"chunk {name.hex()} has other bytes than its name says")
                ids = np.frombuffer(payload, width).astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.record_batch([batch.column("name"), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["name", "n", "crc"])

        return step

    return map_batches(_chunks(spark, at), make, "name binary, n int, crc long")


def _uses(recipes: DataFrame) -> DataFrame:
    """One row for each chunk of each recipe, the recipe checked against its root."""
    keep = [c for c in recipes.columns if c not in ("names", "root")]

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            row, seq, name = [], [], []
            for i, (names, root) in enumerate(zip(batch.column("names").to_pylist(), batch.column("root").to_pylist(), strict=True)):
                if recipe_root(names) != root:
                    raise StoreError("a recipe has other chunks than its root says")
                k = len(names) // NAME
                row += [i] * k
                seq += range(k)
                name += [names[j : j + NAME] for j in range(0, len(names), NAME)]
            at = pa.array(row, pa.int32())
            yield pa.record_batch([*(batch.column(c).take(at) for c in keep), pa.array(seq, pa.int32()), pa.array(name, pa.binary())], [*keep, "seq", "name"])

        return step

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in recipes.select(keep).schema)
    return map_batches(recipes, make, f"{schema}, seq int, name binary")


@cache
def _shifts() -> list[np.ndarray]:
    """What 2 ** k zero bytes after it make of a crc32, as four tables by byte for each k."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if not v:
                return out
            if v & 1:
                out ^= row
            v >>= 1
        return out

    power = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        power = [times(power, row) for row in power]
    out = []
    for _ in range(40):
        out.append(np.array([[times(power, b << s) for b in range(256)] for s in (0, 8, 16, 24)], np.uint32))
        power = [times(power, row) for row in power]
    return out


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The crc32 of each run of parts, from the crc32 and the bytes of each part.

    Run i is the parts from ``first[i]`` to before ``first[i + 1]``, one at least.
    """
    upto = np.cumsum(sizes, dtype=np.int64)
    after = np.repeat(upto[first[1:] - 1], np.diff(first)) - upto
    out = crcs.astype(np.uint32)
    for k, tables in zip(range(int(after.max(initial=0)).bit_length()), _shifts(), strict=False):
        at = np.flatnonzero(after >> k & 1)
        x = out[at]
        out[at] = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]
    return np.bitwise_xor.reduceat(out, first[:-1]) if len(out) else out


def check_manifest(spark: SparkSession, at: str) -> None:
    """Fail unless the recipes have the roots and places that the manifest says."""
    said = spark.read.schema(_MANIFEST).parquet(f"{at}/manifest")
    names = ("documents", "tokens", "before", "root")
    found = _manifest(_recipes(spark, at)).withColumnsRenamed({n: f"{n}2" for n in names})
    sums = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    said = said.withColumn("upto", sums)
    wrong = said.join(found, ["part", "block"], "full").where("not (before <=> upto and " + " and ".join(f"{n} <=> {n}2" for n in names) + ")")
    if not wrong.isEmpty():
        raise StoreError("the recipes are not those of the manifest")


def _placed(spark: SparkSession, at: str) -> DataFrame:
    """Recipes with ``row``, a number of their own, and ``start``, the ids of all recipes before."""
    parts = spark.read.schema(_MANIFEST).parquet(f"{at}/manifest").groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").toPandas()  # a row for each part, as many as the write had partitions
    parts["ids_before"] = parts["n"].cumsum() - parts["n"]
    known = F.broadcast(spark.createDataFrame(parts[["part", "ids_before"]].astype("int64"), "part long, ids_before long").withColumn("part", F.col("part").cast("int")))
    row = F.shiftleft(F.col("part").cast("long"), 40) + F.col("key")
    return _recipes(spark, at).join(known, "part").withColumn("start", F.col("before") + F.col("ids_before")).withColumn("row", row)


def read_sums(spark: SparkSession, at: str, vocabulary: int = 49_408) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the stored chunks.

    Every stored payload is read, checked and summed once.  A document's crc32
    is then combined from those of its chunks, in order, so no ids move between
    machines; ``read_ids`` rebuilds the streams themselves.
    """
    check_manifest(spark, at)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    uses = _uses(_placed(spark, at).select("row", "doc_id", "start", "n_tokens", "names", "root"))
    known = uses.join(_sums(spark, at, width), "name", "left")
    each = known.groupBy("row", "doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "crc"))).alias("parts"))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            parts = batch.column("parts")
            values, first = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
            if values.field("n").null_count:
                raise StoreError("a recipe names a chunk that is not stored")
            n, crc = values.field("n").to_numpy(), values.field("crc").to_numpy()
            if (np.add.reduceat(n, first[:-1], dtype=np.int64) != batch.column("n_tokens").to_numpy()).any():
                raise StoreError("a document's chunks have more or fewer ids than its recipe says")
            out = joined_crcs(crc, 4 * n.astype(np.int64), first).astype(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return step

    return map_batches(each, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, at: str, vocabulary: int = 49_408) -> DataFrame:
    """``doc_id, start, ids``: the documents' ids put together again."""
    uses = _uses(_placed(spark, at).select("row", "doc_id", "start", "names", "root")).join(_chunks(spark, at), "name")
    each = uses.groupBy("row", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("parts"))
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = [np.frombuffer(b"".join(x["payload"] for x in parts), width).astype("<u4").tobytes() for parts in batch.column("parts").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

        return step

    return map_batches(each, make, "doc_id long, start long, ids binary")
