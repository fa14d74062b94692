"""Slides: titles that wrap, and builds that show one slide step by step.

``slides``: doc_id, page, title, body (an array of its lines).  A deck is small
and its rule looks at neighbours one after another, so it is folded in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import slide_key

_SLIDE = "struct<page:int,title:string,keys:array<string>,run:string>"


def says_all(outer: Column, inner: Column) -> Column:
    """Whether one slide has all that another says: its lines, or its text as a beginning."""
    return (F.size(F.array_except(inner["keys"], outer["keys"])) == 0) | outer["run"].startswith(inner["run"])


def build_steps(slides: DataFrame) -> DataFrame:
    """``doc_id, page``: slides that are only a step of the slide beside them.

    Neighbours of one title are compared; the one that the other already holds
    goes, whichever way round, and the first slide never.
    """
    keys = F.transform("body", slide_key)
    own = F.struct(F.col("page").cast("int").alias("page"), slide_key(F.col("title")).alias("title"), keys.alias("keys"), slide_key(F.array_join("body", " ")).alias("run"))
    decks = slides.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("slides"))
    start = F.struct(F.get("slides", F.lit(0)).cast(_SLIDE).alias("held"), F.array().cast("array<int>").alias("gone"))

    def step(acc: Column, now: Column) -> Column:
        held = acc["held"]
        same = held["title"] == now["title"]
        before = same & says_all(now, held) & (held["page"] != 0)
        after = same & ~before & says_all(held, now) & (now["page"] != 0)
        gone = F.when(before, F.array(held["page"])).when(after, F.array(now["page"])).otherwise(F.array().cast("array<int>"))
        return F.struct(F.when(after, held).otherwise(now).cast(_SLIDE).alias("held"), F.concat(acc["gone"], gone).alias("gone"))

    rest = F.slice("slides", 2, F.greatest(F.size("slides") - 1, F.lit(0)))
    return decks.select("doc_id", F.explode(F.aggregate(rest, start, step, lambda acc: acc["gone"])).alias("page"))


def without_steps(slides: DataFrame) -> DataFrame:
    """The slides that stay."""
    return slides.join(build_steps(slides), ["doc_id", "page"], "left_anti")


def wrapped_titles(lines: DataFrame) -> DataFrame:
    """``doc_id, page, title, n_lines``: a slide's top line with the lines its title runs on to.

    They have the title's size and left edge and follow at one pitch, no
    paragraph's gap; more than 120 characters, or nothing apart below, and the
    title stands alone.  ``lines``: doc_id, page, seq, text, size, x0, y0.
    """
    down = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "seq")
    top = {c: F.first(c).over(down) for c in ("size", "x0")}
    rows = lines.withColumn("n", F.row_number().over(down)).withColumn("gap", F.col("y0") - F.lag("y0").over(down))
    rows = rows.withColumns({"like": (F.abs(F.col("size") - top["size"]) <= 0.6) & (F.abs(F.col("x0") - top["x0"]) <= 2.5)})
    pitch = F.max(F.when(F.col("n") == 2, F.col("gap"))).over(Window.partitionBy("doc_id", "page"))
    rows = rows.withColumn("pitch", pitch)
    near = F.col("like") & (F.col("gap") > 0) & (F.col("gap") <= 1.55 * F.col("pitch")) & (F.col("pitch") <= 1.8 * top["size"])
    rows = rows.withColumn("near", (F.col("n") == 1) | near)
    rows = rows.withColumn("run", F.min(F.col("near").cast("int")).over(down) == 1)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("run"), F.struct("n", F.trim("text").alias("t"))))), lambda x: x["t"]), " ")
    page = rows.groupBy("doc_id", "page").agg(
        told.alias("whole"),
        F.max(F.when(F.col("n") == 1, F.trim("text"))).alias("first"),
        F.sum(F.col("run").cast("int")).alias("run"),
        F.count("*").alias("all"),
        F.min(F.when(~F.col("run"), F.col("gap"))).alias("any_gap"),
        F.min_by(F.col("gap"), F.when(~F.col("run"), F.col("n"))).alias("below"),
        F.max("pitch").alias("pitch"),
    )
    joined = (F.col("run") > 1) & (F.col("run") < F.col("all")) & (F.col("below") > 1.55 * F.col("pitch")) & (F.length("whole") <= 120)
    return page.select("doc_id", "page", F.when(joined, F.col("whole")).otherwise(F.col("first")).alias("title"), F.when(joined, F.col("run")).otherwise(1).cast("int").alias("n_lines"))
