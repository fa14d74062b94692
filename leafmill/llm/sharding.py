"""A consistent-hash ring with virtual nodes and bounded loads.

A document lies on the ring at the hash of its id and belongs to the next
virtual node's shard; where that is full it continues clockwise to the next
shard that is not.  The ring has a fixed number of cells, so the walk is solved
on the driver from one count for each cell, whatever the input; a document then
needs only its rank within its cell.

The query uses loads counted in rows with no slack (the law ``rows``): the
shards' capacities are as equal as integers can be and add up to all rows, so
counts are at most one apart.  ``slack`` above 0 moves fewer rows when the
number of shards changes, for less equal counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.words import stream

CELLS = 1 << 16


class Ring:
    """``nodes`` virtual nodes for each shard, each at a cell of its own."""

    def __init__(self, shards: int, nodes: int = 128, seed: int = 31):
        at: dict[int, int] = {}
        for shard in range(shards):
            own = stream(seed + 1000003 * shard, 8 * nodes)
            placed = 0
            for cell in (own >> np.uint64(48)).tolist():
                if placed == nodes:
                    break
                if cell not in at:
                    at[cell] = shard
                    placed += 1
        self.shards = shards
        self.cells = np.array(sorted(at), np.int64)
        self.owner = np.array([at[c] for c in self.cells.tolist()], np.int64)
        self.walk = np.empty((len(self.cells), shards), np.int64)
        last: list[int] = list(dict.fromkeys(self.owner.tolist()))
        for i in range(len(self.cells) - 1, -1, -1):  # the shards in the order met clockwise from node i
            shard = int(self.owner[i])
            last = [shard, *(x for x in last if x != shard)]
            self.walk[i] = last

    def node(self, cells: np.ndarray) -> np.ndarray:
        """The first virtual node at each cell or after it, round the ring."""
        return np.searchsorted(self.cells, cells) % len(self.cells)


def capacities(total: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Rows that each shard may hold; without slack they add up to ``total``."""
    if slack > 0:
        return np.full(shards, int(np.ceil((1 + slack) * total / shards)), np.int64)
    return total // shards + (np.arange(shards) < total % shards).astype(np.int64)


def assign(ring: Ring, cells: np.ndarray, counts: np.ndarray, room: np.ndarray) -> pd.DataFrame:
    """Segments ``cell, low, high, shard, slot``: the rows of ranks low to before high.

    In each round every row that has no place tries the next shard clockwise;
    a shard takes rows in ring order while it has room.
    """
    order = np.argsort(cells)
    cells, left = cells[order], counts[order].astype(np.int64)
    walk = ring.walk[ring.node(cells)]
    room, held, low = room.copy(), np.zeros(ring.shards, np.int64), np.zeros(len(cells), np.int64)
    out = []
    for turn in range(ring.shards):
        for shard in range(ring.shards):
            mine = np.flatnonzero((walk[:, turn] == shard) & (left > 0))
            if not len(mine) or not room[shard]:
                continue
            upto = np.minimum(np.cumsum(left[mine]), room[shard])
            taken = np.diff(upto, prepend=0)
            some = taken > 0
            rows, taken, start = mine[some], taken[some], (upto - taken)[some]
            out.append(pd.DataFrame({"cell": cells[rows], "low": low[rows], "high": low[rows] + taken, "shard": shard, "slot": held[shard] + start}))
            low[rows] += taken
            left[rows] -= taken
            held[shard] += taken.sum()
            room[shard] -= taken.sum()
    columns = {"cell": "int64", "low": "int64", "high": "int64", "shard": "int32", "slot": "int64"}
    return pd.concat(out, ignore_index=True).astype(columns) if out else pd.DataFrame({k: pd.Series(dtype=v) for k, v in columns.items()})


def shard_documents(docs: DataFrame, shards: int = 16, nodes: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes plus one.  Slots run from 0 in each
    shard.  A null text has no bytes.  A row without an id lies at the hash of
    its text; rows that repeat an id lie in one cell, in the order of their
    size and crc.  ``grown_shard`` is null: under this law a row's shard depends
    on the other rows as well.  No rows give no rows; other columns are not
    looked at.
    """
    spark = docs.sparkSession
    ring = Ring(shards, nodes)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).alias("text_crc32"),
        F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(F.col(id_col).cast("long"))).alias("place"),
    ).withColumn("cell", F.shiftrightunsigned("place", 48))
    ids = docs.select(F.shiftrightunsigned(F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(F.col(id_col).cast("long"))), 48).alias("cell"))
    counted = ids.groupBy("cell").count().toPandas()
    counts = counted["count"].to_numpy(np.int64)
    segments = assign(ring, counted["cell"].to_numpy(np.int64), counts, capacities(int(counts.sum()), shards, slack))
    table = F.broadcast(spark.createDataFrame(segments, "cell long, low long, high long, shard int, slot long"))  # at most cells times shards rows
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32")) - 1
    ranked = rows.withColumn("rank", rank.cast("long"))
    placed = ranked.join(table, (ranked["cell"] == table["cell"]) & (ranked["rank"] >= table["low"]) & (ranked["rank"] < table["high"]))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
