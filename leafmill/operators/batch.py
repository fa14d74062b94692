"""A corpus of conversions: what to do next, which result to keep, how engines compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import repair
from leafmill.functions import text as T


def in_order(files: DataFrame) -> DataFrame:
    """Files by path, case aside."""
    return files.orderBy(F.lower("path"), "path")


def cleanest(results: DataFrame) -> DataFrame:
    """``stem, kept, n``: of results that share a stem the one with the least damage, then the longest.

    ``results``: stem, path, score, issues, bytes.
    """
    best = F.min_by(F.col("path"), F.struct("score", "issues", (-F.col("bytes")).alias("less"), F.lower("path").alias("low"), "path"))
    return results.groupBy("stem").agg(best.alias("kept"), F.count("*").alias("n"))


def deduplicated(results: DataFrame) -> DataFrame:
    """Ledger rows for the results that ``cleanest`` leaves out."""
    kept = cleanest(results).where("n > 1").select("stem", "kept")
    return results.join(kept, "stem").where("path <> kept").select("stem", "path", F.lit("deduplicated").alias("status"), "kept")


def first_of_each(rows: DataFrame, by: str, order: list[Column], most: int = 8) -> DataFrame:
    """The first ``most`` rows of each group: what a budget of calls allows."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def whole_documents(parts: DataFrame, rule: str = "\n\n---\n\n") -> DataFrame:
    """``doc_id, text``: page ranges converted apart, put together; front matter only from the first.

    ``parts``: doc_id, part, text.
    """
    first = F.col("part") == F.min("part").over(Window.partitionBy("doc_id"))
    bare = parts.withColumn("text", F.when(first, F.col("text")).otherwise(F.regexp_replace(T.strip_yaml(F.col("text")), r"^\s+", "")))
    return bare.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), rule).alias("text"))


def page_ranges(pages: DataFrame, size: int = 75) -> DataFrame:
    """``doc_id, first, last``: ranges of up to ``size`` pages, from 1; ``pages``: doc_id, n_pages."""
    starts = F.explode(F.sequence(F.lit(1), F.col("n_pages"), F.lit(size))).alias("first")
    return pages.where("n_pages > 0").select("doc_id", "n_pages", starts).select("doc_id", "first", F.least(F.col("first") + size - 1, F.col("n_pages")).alias("last"))


def case_status(checks: DataFrame, cases: DataFrame) -> DataFrame:
    """``case_id, status``: missing, error, unannotated, passed or failed.

    ``cases``: case_id, present, returncode, timed_out; ``checks``: case_id, passed.
    """
    told = checks.groupBy("case_id").agg(F.min(F.col("passed").cast("int")).alias("all"), F.count("*").alias("n"))
    status = (
        F.when(~F.col("present"), "missing")
        .when(F.col("timed_out"), "timeout")
        .when(F.col("returncode") != 0, "error")
        .when(F.coalesce("n", F.lit(0)) == 0, "unannotated")
        .when(F.col("all") == 1, "passed")
        .otherwise("failed")
    )
    return cases.join(told, "case_id", "left").select("case_id", status.alias("status"))


def engine_medians(runs: DataFrame) -> DataFrame:
    """``engine, n, seconds, bytes``: the medians of each engine's runs that ended well; ``runs``: engine, ok, seconds, bytes."""
    return runs.groupBy("engine").agg(F.count("*").alias("n"), F.percentile(F.when(F.col("ok"), F.col("seconds")), F.lit(0.5)).alias("seconds"), F.percentile(F.when(F.col("ok"), F.col("bytes")), F.lit(0.5)).alias("bytes"))


def side_by_side(runs: DataFrame, left: str, right: str) -> DataFrame:
    """``case_id`` and the seconds of two engines where both ran; ``runs``: case_id, engine, seconds."""
    a, b = (runs.where(F.col("engine") == e).select("case_id", F.col("seconds").alias(n)) for e, n in ((left, "left_seconds"), (right, "right_seconds")))
    return a.join(b, "case_id")


def new_names(files: DataFrame, with_author: bool = False) -> DataFrame:
    """``path, folder, name``: Markdown files named by their title, numbered where two share one.

    ``files``: path, text.  A file without a title of its own keeps its name.
    """
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    title, author = T.yaml_field(front, "title"), F.regexp_replace(F.regexp_extract(front, r"(?m)^authors:\n\s+-\s*(.+)$", 1), '^"|"$', "")
    old, stem = F.substring_index("path", "/", -1), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    plain = (title == "") | F.lower(title).isin(F.lower(old)) | F.lower(title).isin(F.lower(stem)) | (F.lower(title) == F.concat(F.lower(stem), F.lit(".pdf")))
    parts = F.array(*([repair.file_slug(F.substring_index(author, ",", 1))] if with_author else []), repair.file_slug(title))
    want = F.array_join(F.filter(parts, lambda p: p != ""), "--")
    rows = files.select("path", F.regexp_extract("path", "^(.*?)[^/]*$", 1).alias("folder"), F.when(plain | (want == ""), stem).otherwise(want).alias("want"))
    nth = F.row_number().over(Window.partitionBy("folder", "want").orderBy("path"))
    return rows.select("path", "folder", F.concat("want", F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""), F.lit(".md")).alias("name"))
