"""What keeps large tables within bounds: how often plans shuffle, and what a step holds at once."""

import pyarrow as pa
from pyspark.sql.types import LongType

from leafmill.operators import audit, outline, tables
from leafmill.plans import render
from leafmill.plans.queries import QUERIES
from leafmill.sources import html


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "Reused" not in line for line in plan.splitlines())


def test_chunks_of_blocks_are_made_in_the_row(spark):
    md = "---\na: 1\n---\n# A\n\ntext\n\n```\ncode\n\n\nmore\n```\n\n## B\n\n| h | i |\n| - | - |\n" + "\n".join(f"| {k} | x |" for k in range(5)) + "\n\n### C\n\n## D\n\nlast\x85  ~~~\n\nin\n\n~~~\n\nout  "
    df = render.block_chunks(spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, text string"), 26)
    assert exchanges(df) == 0
    rows = sorted(df.collect())
    assert [(r.chunk, r.path, r.text) for r in rows if r.doc_id == 1] == [
        (0, "A", "# A"),
        (1, "A", "A\n\ntext"),
        (2, "A", "A\n\n```\ncode\n\nmore\n```"),
        (3, "A > B", "## B"),
        (4, "A > B", "A > B\n\n| h | i |\n| - | - |\n| 0 | x |\n| 1 | x |"),
        (5, "A > B", "A > B\n\n| h | i |\n| - | - |\n| 2 | x |\n| 3 | x |"),
        (6, "A > B", "A > B\n\n| h | i |\n| - | - |\n| 4 | x |"),
        (7, "A > B > C", "### C"),
        (8, "A > D", "## D"),
        (9, "A > D", "A > D\n\nlast\x85  ~~~\n\nin\n\n~~~"),
        (10, "A > D", "A > D\n\nout"),
    ]
    assert [(r.doc_id, r.text, r.tokens) for r in rows if r.doc_id != 1] == [(3, "", 0)]


def test_outlines_of_many_documents_are_one_batch(spark):
    titles = ["Chapter 1 A", "1.1 B", "2.9 Elsewhere", "1.2 C", "Glossary"]
    rows = [(d, k, t, 1 if k in (0, 4) else 2) for d in range(600) for k, t in enumerate(titles)]
    df = outline.outline(spark.createDataFrame(rows, "doc_id long, seq int, title string, rank int"))
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()  # no call for each document
    kinds = ["section", "section", "body", "section", "heading"]
    assert sorted((r.doc_id, r.seq, r.kind) for r in df.collect()) == [(d, k, kinds[k]) for d in range(600) for k in range(5)]


def test_tables_are_dealt_once(spark, sf_dir):
    assert exchanges(QUERIES["table_markdown"](spark, sf_dir)) == 1
    cells = [(1, 1, 0, 2, 1, "a"), (1, 1, 1, 1, 2, "b"), (1, 2, 1, 1, 1, "c"), (1, 2, 2, 1, 1, "d"), (2, 1, 0, 1_000_000, 1, "x"), (2, 1, 1, 1, 1, "y"), (3, 1, 0, 2, 1, "x"), (3, 2, 0, 1, 1, "y"), (4, 1, 0, None, 1, "x"), (None, 1, 0, 1, 1, "x")]
    df = spark.createDataFrame(cells, "table_id long, row int, col int, rowspan int, colspan int, text string")
    assert exchanges(tables.grid(df)) == 1
    assert sorted((r.table_id, r.rows) for r in tables.grid(df).collect()) == [(1, [["a", "b", "b"], ["a", "c", "d"]]), (3, [["x"], ["x", "y"]])]


def test_places_are_not_kept_by_task(spark, sf_dir):
    assert exchanges(QUERIES["table_status"](spark, sf_dir)) == 1
    cells = [(1, 1, 0, 2, 1, "a"), (1, 1, 1, 1, 2, "b"), (2, 1, 0, 1_000_000, 1, "x"), (3, 1, 0, 2, 1, "x"), (3, 2, 0, 1, 1, "y"), (4, 1, 0, None, 1, "x")]
    df = spark.createDataFrame(cells, "table_id long, row int, col int, rowspan int, colspan int, text string")
    assert exchanges(tables.status(df)) == 1
    assert sorted(map(tuple, tables.status(df).collect())) == [(1, "ok"), (2, "refused"), (3, "overlap"), (4, "ok")]


def test_pages_are_given_back_in_slices(spark):
    pages = [(k, "<h1>t</h1>" + "<p>" + "word " * 100 + "</p>") for k in range(50)]
    step = html.stepper(lambda page: html.rows_of(html.read(page).blocks), html.schema_of("page_id", LongType(), html.BLOCKS), 10_000)
    batch = pa.RecordBatch.from_pydict({"page_id": [k for k, _ in pages], "html": [h for _, h in pages]})
    out = list(step(iter([batch])))
    assert len(out) > 1 and max(b.nbytes for b in out) < 20_000
    assert sum(b.num_rows for b in out) == 100
    plan = html.blocks(spark.createDataFrame(pages, "page_id long, html string"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_an_audit_reads_each_text_once(spark):
    docs = spark.createDataFrame([(1, "![x](a.png) ![y](gone.png)\n```"), (2, None)], "doc_id long, text string")
    df = audit.exploded(docs, spark.createDataFrame([(1, "a.png")], "doc_id long, path string"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2  # texts and files
    assert sorted(map(tuple, df.collect())) == [(1, "broken_image_link", 1), (1, "unclosed_fence", 1)]
