"""Cells with spans: checked, spread over a grid, headed, and as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells: table_id, row, col, rowspan, colspan, text.  Tables: table_id, slots, cells.
MOST_SLOTS = 200_000


def gathered(cells: DataFrame) -> DataFrame:
    """Each table's cells as one array, an empty one for a table of more than MOST_SLOTS places.

    Sizes are summed over a window, which spills, before anything is gathered
    or spread out, so a hostile span or table costs no memory.  Both steps are
    by table: cells are dealt once.
    """
    size = F.sum(F.col("rowspan").cast("long") * F.col("colspan")).over(Window.partitionBy("table_id"))
    cell = F.when((F.col("slots") <= MOST_SLOTS) & _whole(F.col), F.struct("row", "col", "rowspan", "colspan", "text"))
    return cells.withColumn("slots", size).groupBy("table_id").agg(F.first("slots").alias("slots"), F.collect_list(cell).alias("cells"))


def sized(tables: DataFrame) -> DataFrame:
    """Tables as ``gathered`` gives them, of rows that have their cells as one array already."""
    size = F.aggregate(F.transform("cells", lambda c: c["rowspan"].cast("long") * c["colspan"]), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x, F.lit(0)))
    told = tables.withColumn("slots", size)
    return told.withColumn("cells", F.when(F.col("slots") <= MOST_SLOTS, F.filter("cells", lambda c: _whole(lambda k: c[k]))).otherwise(F.slice("cells", 1, 0)))


def _whole(field: Callable[[str], Column]) -> Column:
    return field("row").isNotNull() & field("col").isNotNull() & field("rowspan").isNotNull() & field("colspan").isNotNull()


def _spread(make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(row, col, cell)`` of every place that the cells of a table cover."""

    def across(c: Column) -> Column:
        down, over = F.sequence(c["row"], c["row"] + c["rowspan"] - 1), F.sequence(c["col"], c["col"] + c["colspan"] - 1)
        many = F.flatten(F.transform(down, lambda r: F.transform(over, lambda k: make(r, k, c))))
        return F.when((c["rowspan"] == 1) & (c["colspan"] == 1), F.array(make(c["row"], c["col"], c))).otherwise(many)

    return F.flatten(F.transform("cells", across))


def statuses(tables: DataFrame) -> DataFrame:
    """``table_id, status``: ok, overlap where cells share a place, refused beyond MOST_SLOTS."""
    spread = tables.withColumn("places", _spread(lambda r, k, _: r.cast("long") * (1 << 32) + k))
    return spread.select("table_id", F.when(F.col("slots") > MOST_SLOTS, "refused").when(F.size(F.array_distinct("places")) < F.size("places"), "overlap").otherwise("ok").alias("status"))


def status(cells: DataFrame) -> DataFrame:
    return statuses(gathered(cells))


def grids(tables: DataFrame) -> DataFrame:
    """``table_id, rows``: every row's texts from left to right, a spanning cell's text in all its places.

    A table beyond MOST_SLOTS has no row.
    """
    place = _spread(lambda r, k, c: F.struct(r.alias("at_row"), k.alias("at_col"), c["text"].alias("text")))
    spread = tables.where("table_id is not null").select("table_id", F.sort_array(place).alias("places"))
    # A filter on places would be pushed below and make them twice; what makes rows keeps them as they are.
    each = spread.select("table_id", F.explode(F.when(F.size("places") > 0, F.array("places"))).alias("places"))
    # Rows follow one another in the sorted places, so each is a slice from its first place on.
    opens = F.transform("places", lambda p, i: F.when((i == 0) | (F.get("places", i - 1)["at_row"] != p["at_row"]), i))
    told = each.withColumn("firsts", F.array_compact(opens))
    rows = F.transform("firsts", lambda a, i: F.transform(F.slice("places", a + 1, F.coalesce(F.get("firsts", i + 1), F.size("places")) - a), lambda p: p["text"]))
    return told.select("table_id", rows.alias("rows"))


def grid(cells: DataFrame) -> DataFrame:
    return grids(gathered(cells))


def flat_header(rows: Column, depth: int) -> Column:
    """The first ``depth`` rows as one: each column's different texts, from above, joined by a dash."""
    heads = F.slice(rows, 1, depth)
    width = F.size(F.get(rows, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_join(F.filter(F.array_distinct(F.transform(heads, lambda r: F.get(r, i))), lambda t: t != ""), " — "))


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.when(F.contains(c, F.lit("\n")), F.regexp_replace(c, r"\s*\n\s*", " ")).otherwise(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def pipe_table(rows: Column, depth: int = 1) -> Column:
    """A Markdown table with one header row."""
    head = flat_header(rows, depth)
    columns = F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1)
    rule = F.concat(F.lit("|"), F.array_join(F.transform(columns, lambda _: F.lit(" --- ")), "|"), F.lit("|"))
    return F.concat_ws("\n", pipe_row(head), rule, F.array_join(F.transform(F.slice(rows, depth + 1, F.greatest(F.size(rows) - depth, F.lit(0))), pipe_row), "\n"))
