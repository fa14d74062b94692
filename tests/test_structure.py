"""Slides, lists, statuses and outputs on small hand-made tables."""

import json

from pyspark.sql import functions as F

from leafmill.functions import shapes
from leafmill.operators import audit, batch, decks, joins, layout, outline, tables
from leafmill.operators import lines as L
from leafmill.plans import outputs, render


def deck(spark, *slides):
    return spark.createDataFrame([(1, k, t, list(b)) for k, (t, b) in enumerate(slides)], "doc_id long, page int, title string, body array<string>")


def gone(spark, *slides):
    return sorted(r.page for r in decks.build_steps(deck(spark, *slides)).collect())


def test_builds_fold_either_way_and_never_the_first(spark):
    assert gone(spark, ("T", []), ("A", ["x"]), ("a ", ["x", "y"]), ("A", ["x", "y", "z"]), ("B", ["x"])) == [1, 2]
    assert gone(spark, ("T", []), ("A", ["x", "y"]), ("A", ["x"])) == [2]  # an overlay goes again
    assert gone(spark, ("A", []), ("A", ["x"])) == []
    assert gone(spark, ("A", ["x"]), ("A", [])) == [1]
    assert gone(spark, ("T", []), ("A", ["one two"]), ("A", ["one", "two three"])) == [1]  # wrapped anew
    assert gone(spark, ("T", []), ("A", ["x"]), ("A", ["y"])) == []
    kept = decks.without_steps(deck(spark, ("T", []), ("A", ["x"]), ("A", ["x", "y"])))
    assert sorted(r.page for r in kept.collect()) == [0, 2]


def test_titles_that_wrap(spark):
    rows = [(1, 0, 0, "Specific: The", 24.0, 60.0, 60.0), (1, 0, 1, "Prioritization", 24.0, 60.0, 88.0), (1, 0, 2, "point", 24.0, 60.0, 160.0), (1, 1, 3, "Title", 24.0, 60.0, 60.0), (1, 1, 4, "all", 24.0, 60.0, 88.0), (1, 1, 5, "alike", 24.0, 60.0, 116.0)]
    got = decks.wrapped_titles(spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, size double, x0 double, y0 double"))
    assert sorted((r.page, r.title, r.n_lines) for r in got.collect()) == [(0, "Specific: The Prioritization", 2), (1, "Title", 1)]


def test_lists_end_with_a_paragraph(spark):
    kinds = [("list_item", 1), ("list_item", 2), ("list_item", 3), ("list_item", 2), ("para", 0), ("list_item", 2)]
    rows = spark.createDataFrame([(1, k, kind, level) for k, (kind, level) in enumerate(kinds)], "doc_id long, seq int, kind string, level int")
    got = {r.seq: r.parent for r in outline.list_parents(rows).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 0, 4: None, 5: None}


def test_continued_tables_need_all_the_evidence(spark):
    base = {"doc_id": 1, "x0": 50.0, "y0": 100.0, "x1": 300.0, "cols": 3, "header": "a|b"}
    cases = [("Table 2: x", {}), ("Table 2 (continued)", {}), ("Table 2 (continued)", {"cols": 4}), ("Table 3 (continued)", {}), ("Table 3 (continued)", {"x0": 70.0}), ("Table 3", {})]
    rows = [{**base, "table_id": k, "page": k, "context": c, **more} for k, (c, more) in enumerate(cases)]
    got = {r.table_id: r.root for r in layout.continued(spark.createDataFrame(rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_hostile_spans_are_not_spread(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, 1, "a"), (1, 0, 1, 1, 1, "b"), (2, 0, 0, 2_000_000_000, 1, "c")], "table_id int, row int, col int, rowspan int, colspan int, text string")
    assert [(r.table_id, r.rows) for r in tables.grid(cells).collect()] == [(1, [["a", "b"]])]
    assert {r.table_id: r.status for r in tables.status(cells).collect()} == {1: "ok", 2: "refused"}


def test_blank_runs_and_fences(spark):
    text = "a\n\n \n\nb\n```\nx\n\n\ny\n```\n\n\nc\n\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert L.collapse_blanks(docs).first().text == "a\n\nb\n```\nx\n\n\ny\n```\n\nc\n"


def found(spark, text, files=None):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r["check"]: r.n for r in audit.exploded(docs, files).collect()}


def test_audit_leaves_fences_alone_and_finds_lost_images(spark):
    fenced = "```\n# a\n#### b\n12\nx \n\n\n\n| a |\n| b | c |\n\n```\nend."
    assert found(spark, fenced) == {}
    assert found(spark, "# a\n### b\n12\nx \n\n\n\nend\n```") == {"heading_jump": 1, "standalone_page_number": 1, "trailing_whitespace": 1, "excess_blank_lines": 1, "unclosed_fence": 1}
    assert found(spark, "| a | b |\n| c |\n| d |\nend.") == {"malformed_table": 1}
    assert found(spark, "| a | b |\n| c |") == {}  # the text's end judges no table
    assert found(spark, "un-\nder\n" + "# t\n" * 4 + "# notes\n" * 4) == {"possible_broken_hyphen": 1, "duplicate_heading": 1}
    assert found(spark, '---\ntitle: "M E G A"\nsubtitle: w' + " w" * 40 + "\n---\nx.") == {"corrupt_title_spacing": 1, "implausible_subtitle_length": 1, "corrupt_subtitle_spacing": 1}
    files = spark.createDataFrame([(1, "a b.png")], "doc_id long, path string")
    assert found(spark, "![x](a%20b.png) ![y](gone.png) ![z](http://x/y.png)", files) == {"broken_image_link": 1}


def test_chunks_part_tables_between_rows(spark):
    md = "---\ntitle: x\n---\n# Top\n\ntext here\n\n```\na\n\nb\n```\n\n## Sub\n\n| h | i |\n| --- | --- |\n" + "\n".join(f"| {k} | x |" for k in range(5))
    rows = render.block_chunks(spark.createDataFrame([(1, md)], "doc_id long, text string"), 25).orderBy("chunk").collect()
    assert [r.text for r in rows[:4]] == ["# Top", "Top\n\ntext here", "Top\n\n```\na\n\nb\n```", "## Sub"]
    parts = [r.text for r in rows[4:]]
    assert all(p.startswith("Top > Sub\n\n| h | i |\n| --- | --- |\n") for p in parts) and len(parts) > 1
    assert [line for p in parts for line in p.split("\n")[4:]] == [f"| {k} | x |" for k in range(5)]
    assert not any(r.oversize for r in rows)


def test_outputs_come_back(spark, tmp_path):
    docs = spark.createDataFrame([("one", "a\r\nb  "), ("two", "c")], "name string, text string")
    outputs.markdown_files(docs, str(tmp_path / "md"))
    assert sorted(p.read_bytes() for p in (tmp_path / "md").glob("name=*/*.txt")) == [b"a\nb\n", b"c\n"]
    outputs.json_lines(docs, str(tmp_path / "json"))
    (tmp_path / "json" / "part-x.json").write_text("{broken\n")
    assert len(outputs.read_json_lines(spark, str(tmp_path / "json"), "name string, text string").collect()) == 2
    report = outputs.audit_report(audit.exploded(spark.createDataFrame([(1, "12\n\n\nx")], "doc_id long, text string")), 1)
    assert "| standalone_page_number | 2 | 1 | 1 |" in report and "| 1 | 3 |" in report
    cases = spark.createDataFrame([(1, True, 0, False), (2, False, 0, False), (3, True, 1, False), (4, True, 0, False)], "case_id int, present boolean, returncode int, timed_out boolean")
    checks = spark.createDataFrame([(1, True), (1, True), (4, False), (4, True)], "case_id int, passed boolean")
    assert outputs.benchmark_report(cases, checks, "ours") == json.loads('{"schema_version": 1, "engine": "ours", "statuses": {"error": 1, "failed": 1, "missing": 1, "passed": 1}}')


def test_order_and_ledger(spark):
    files = spark.createDataFrame([("b",), ("A",), ("a",)], "path string")
    assert [r.path for r in batch.in_order(files).collect()] == ["A", "a", "b"]
    ledger = spark.createDataFrame([("a", "failed", 1), ("a", "ok", 2), ("b", "ok", 1), ("b", "timeout", 3)], "path string, status string, timestamp int")
    assert [r.path for r in joins.not_done(files, ledger, "path").orderBy("path").collect()] == ["A", "b"]
    issues = audit.issues(spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "doc_id long, check string, n int")).first()
    assert issues.issues == {"x": 2, "y": 1}


def test_boxes(spark):
    row = spark.range(1).select(
        shapes.crop(F.array(*map(F.lit, (10.0, 20.0, 60.0, 70.0))), F.array(*map(F.lit, (0.0, 0.0, 70.0, 100.0)))).alias("crop"),
        shapes.within_crop(F.array(*map(F.lit, (10.0, 20.0, 60.0, 70.0))), F.array(*map(F.lit, (0.0, 0.0, 100.0, 200.0)))).alias("shares"),
        shapes.around(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), F.array(*map(F.lit, (5.0, 5.0, 6.0, 6.0)))).alias("both"),
    ).first()
    assert (row.crop, row.shares, row.both) == ([0.0, 2.0, 70.0, 88.0], [0.1, 0.1, 0.6, 0.35], [0.0, 0.0, 6.0, 6.0])
