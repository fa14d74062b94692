from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import audit, joins, layout, tables
from leafmill.operators import lines as L
from leafmill.plans import render


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").select("i", f(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def test_scalars(spark):
    assert each(spark, T.escape_markdown, ["# a", "2023. b", "- c", "plain", "  * d", "**bold**"]) == ["\\# a", "2023\\. b", "\\- c", "plain", "  \\* d", "**bold**"]
    assert each(spark, T.slugify, ["Über die Straße!", "a_b  c", "--x--"]) == ["über-die-straße", "a-b-c", "x"]
    assert each(spark, T.roman_value, ["XIV", "mcmxcix", "IIX", "", "word"]) == [14, 1999, 0, 0, 0]
    assert each(spark, T.size_bytes, ["20M", "1.5GiB", "12", "x", "3 kb"]) == [20_000_000, 1_610_612_736, 12, None, 3000]
    assert each(spark, T.yaml_quote, ["plain", "a: b", 'q"', ""]) == ["plain", '"a: b"', '"q\\""', '""']
    assert each(spark, T.mend_damaged, [" item", "a�b", "ok"]) == ["• item", "a b", "ok"]
    parts = each(spark, T.heading_parts, ["Chapter 3. The end", "2.4.1 Methods", "A good start", "Appendix B: Data", "Introduction"])
    assert [tuple(p) for p in parts] == [("chapter", "3", "The end"), ("", "2.4.1", "Methods"), ("", "", "A good start"), ("appendix", "B", "Data"), ("", "", "Introduction")]


def test_rejoin(spark):
    rows = spark.createDataFrame([(["inter-", "national law", "and  more"],), (["漢字", "仮名"],), (["self-", "Made"],), ([],)], "p array<string>")
    assert [r.x for r in rows.select(L.rejoin(F.col("p")).alias("x")).collect()] == ["international law and more", "漢字仮名", "self- Made", ""]


def test_chunks_keep_fences_and_budgets(spark):
    md = "---\ntitle: t\n---\n# A\n\none two three\n\nfour five\n\n```\ncode\n\nmore\n```\n## B\n\n" + "w " * 30
    docs = spark.createDataFrame([(1, md)], "doc_id long, text string")
    got = [(r.path, r.text.strip(), r.oversize) for r in render.chunks(docs, 5).orderBy("chunk").collect()]
    assert got[0] == ("A", "one two three\n\nfour five", False)
    assert got[1] == ("A", "```\ncode\n\nmore\n```", False)
    assert got[2] == ("A > B", ("w " * 30).strip(), True) and len(got) == 3


def test_audit(spark):
    md = "# a\n### b\n\n\n12\ntrail \nbro-\nken\n| a | b |\n| - | - |\n| 1 |\nend �\n```\nx\n"
    found = {r.check: r.n for r in audit.exploded(spark.createDataFrame([(1, md)], "doc_id long, text string")).collect()}
    assert found == {"heading_jump": 1, "excess_blank_lines": 1, "standalone_page_number": 1, "trailing_whitespace": 1, "possible_broken_hyphen": 1, "malformed_table": 1, "replacement_chars": 1, "unclosed_fence": 1}


def test_evaluate(spark):
    docs = spark.createDataFrame([(1, "# Title\nalpha beta alpha\n| a | b |")], "doc_id long, text string")
    checks = [("contains", ["beta"], None, None), ("absent", ["beta"], None, None), ("count", ["alpha"], None, 2), ("order", ["Alpha", "alpha"], None, None), ("order", ["beta", "beta"], None, None), ("heading", ["title"], 1, None), ("heading", ["title"], 2, None), ("table_row", ["a", "b"], None, None)]
    rows = spark.createDataFrame([(1, *c) for c in checks] + [(2, *checks[0])], "doc_id long, kind string, texts array<string>, level int, count int")
    got = [(r.doc_id, r.kind, r.passed) for r in audit.evaluate(docs, rows).collect()]
    assert sorted(got) == sorted([(1, "contains", True), (1, "absent", False), (1, "count", True), (1, "order", True), (1, "order", False), (1, "heading", True), (1, "heading", False), (1, "table_row", True), (2, "contains", False)])


def test_columns_are_read_down(spark):
    rows = [(1, i, 0, f"l{i}", 50.0 + 270 * (i % 2), 100.0 + 16 * (i // 2), 260.0 + 270 * (i % 2), 111.0 + 16 * (i // 2)) for i in range(16)]
    lines = spark.createDataFrame(rows, "doc_id long, seq int, page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = [r.seq for r in layout.reading_order(layout.columns(lines)).orderBy("place").collect()]
    assert got == [*range(0, 16, 2), *range(1, 16, 2)]


def test_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 1, "a"), (1, 0, 1, 1, 1, "b"), (1, 1, 1, 1, 1, "c|d"), (2, 0, 0, 1, 2, "x"), (2, 0, 1, 1, 1, "y")], "table_id long, row int, col int, rowspan int, colspan int, text string")
    assert {r.table_id: r.status for r in tables.status(cells).collect()} == {1: "ok", 2: "overlap"}
    md = tables.grid(cells.where("table_id = 1")).select(tables.pipe_table(F.col("rows")).alias("md")).first().md
    assert md == "| a | b |\n| --- | --- |\n| a | c\\|d |"


def test_overlaps_once(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 40.0), (1, 2, 5.0, 90.0), (1, 3, 91.0, 92.0), (2, 4, 0.0, 99.0)], "k long, id long, low double, high double")
    pairs = joins.overlaps(spans, spans, ["k"], 16.0).where("l.id < r.id").collect()
    assert [(r.l.id, r.r.id) for r in pairs] == [(1, 2)]
