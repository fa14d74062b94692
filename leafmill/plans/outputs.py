"""Results as files: Markdown, chunks, blocks, coverage, audit and benchmark reports.

Every writer goes through Spark's committer, so a reader sees the whole result
of a run or the one before it, and a lost executor costs its tasks alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import audit, batch


def json_lines(df: DataFrame, path: str) -> None:
    """A JSON object a row: chunks, blocks, coverage, ledgers, manifests."""
    df.write.mode("overwrite").json(path)


def read_json_lines(spark, path: str, schema: str) -> DataFrame:
    """The rows of JSON lines; a broken line is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def markdown_files(documents: DataFrame, path: str) -> None:
    """``name, text``: one Markdown file for each row, in a folder of its name, LF line ends and one at the end."""
    text = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"\s+\z", "")
    documents.select("name", text.alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def audit_report(found: DataFrame, documents: int, most: int = 50) -> str:
    """The audit as Markdown: totals of each check, and the documents that look worst."""
    totals = {r["check"]: r for r in audit.totals(found).collect()}  # a row for each check
    worst = audit.worst(audit.scores(found), most).collect()
    rows = [f"| {k} | {p} | {totals[k].n if k in totals else 0} | {totals[k].n_docs if k in totals else 0} |" for k, p in audit.PRIORITY.items()]
    named = [f"| {r.doc_id} | {r.score} |" for r in worst]
    return "\n".join([f"# Audit of {documents} documents", "", "| check | priority | found | documents |", "| --- | --- | --- | --- |", *rows, "", "## Worst", "", "| document | score |", "| --- | --- |", *named, ""])


def benchmark_report(cases: DataFrame, checks: DataFrame, engine: str) -> dict:
    """``schema_version, engine, statuses`` of a benchmark run; a row for each status comes to the driver."""
    told = batch.case_status(checks, cases).groupBy("status").count().collect()
    return {"schema_version": 1, "engine": engine, "statuses": {r["status"]: r["count"] for r in sorted(told, key=lambda r: r["status"])}}


def transformations(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc_id, seq, before, after``: the lines whose text a conversion changed."""
    told = before.select("doc_id", "seq", F.col("text").alias("before")).join(after.select("doc_id", "seq", F.col("text").alias("after")), ["doc_id", "seq"])
    return told.where(~F.col("before").eqNullSafe(F.col("after")))
