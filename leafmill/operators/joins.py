"""Joins by nearness, overlap and recency.

Spark joins by equality; each of these adds an equality to join on, a cell of
fixed width on the axis, so that no side is compared with all of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_before(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """Adds to each row of ``left`` the values of the last row of ``right`` at or before it.

    Both sides lie in one sorted run, so it is one shuffle and one pass and
    neither side is repeated.  Rows of one place count as before.
    """
    names = [f"right_{v}" for v in values]
    a = left.withColumns({"_of": F.lit(1), "_right": F.lit(None).cast("struct<" + ",".join(f"{v}:{right.schema[v].dataType.simpleString()}" for v in values) + ">")})
    b = right.select(*by, F.col(at), F.lit(0).alias("_of"), F.struct(*values).alias("_right"))
    rows = a.unionByName(b, allowMissingColumns=True)
    last = F.last("_right", ignorenulls=True).over(Window.partitionBy(*by).orderBy(at, "_of").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_last", last).where("_of = 1").select(*left.columns, *[F.col("_last")[v].alias(n) for v, n in zip(values, names, strict=True)])


def overlaps(left: DataFrame, right: DataFrame, by: list[str], width: float) -> DataFrame:
    """Pairs of equal keys whose closed spans ``low`` to ``high`` meet.

    A span lies in each cell of ``width`` that it touches; a pair is taken in
    the first cell that both touch, so it comes once.
    """

    def cells(df: DataFrame, name: str) -> DataFrame:
        first, last = (F.floor(F.col(c) / width).cast("long") for c in ("low", "high"))
        own = df.select(*by, F.struct(*[c for c in df.columns if c not in by]).alias(name), first.alias(f"_{name}"), F.explode(F.sequence(first, last)).alias("_cell"))
        return own

    pairs = cells(left, "l").join(cells(right, "r"), [*by, "_cell"])
    return pairs.where("_cell = greatest(_l, _r) and l.low <= r.high and r.low <= l.high").select(*by, "l", "r")


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a maximum, so it is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in by and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("best")
    return rows.groupBy(*by).agg(best).select(*by, *[F.col("best")[c].alias(c) for c in [*order, *rest]])


def not_done(inputs: DataFrame, ledger: DataFrame, key: str, done: tuple[str, ...] = ("ok", "ok_chunked", "skipped_images", "skipped_size", "deduplicated")) -> DataFrame:
    """Inputs whose last ledger row says that they are still to do."""
    last = latest(ledger.select(key, "status", "timestamp"), [key], ["timestamp", "status"])
    return inputs.join(last.where(F.col("status").isin(*done)), key, "left_anti")


def sessions(rows: DataFrame, by: list[str], at: str, gap: Column) -> DataFrame:
    """Adds ``session``, numbered from 1: a new one opens after more than ``gap`` (in seconds)."""
    run = Window.partitionBy(*by).orderBy(at)
    apart = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(run).cast("timestamp"))
    opens = F.coalesce((apart > gap * 1_000_000).cast("int"), F.lit(1))
    return rows.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(run.rangeBetween(Window.unboundedPreceding, 0))).drop("_opens")


def top_of_each(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered from 1 as ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
