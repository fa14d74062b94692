"""The registered queries: each runs one operator, or a few, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import aggregates as A
from leafmill.operators import audit, batch, decks, joins, layout, outline
from leafmill.operators import lines as L
from leafmill.operators import tables as TB
from leafmill.functions import fields, repair
from leafmill.plans import render
from leafmill.plans.cases import CASES, applied
from leafmill.sources import html
from leafmill.streaming import ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """Register a function of the named tables."""

    def keep(f: Callable[..., DataFrame]) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        return QUERIES[f.__name__]

    return keep


# ------------------------------------------------------------------ text functions


@query("documents")
def text_forms(docs):
    rows = L.lines_of(docs)
    c = F.col("text")
    return rows.select("doc_id", "seq", T.slugify(c).alias("slug"), T.title_key(c).alias("key"), T.yaml_quote(c).alias("yaml"), T.squeeze(c).alias("squeezed"), T.words(c).alias("n_words"))


@query("documents")
def markdown_escapes(docs):
    rows = L.lines_of(L.as_markdown(docs))
    return rows.select("doc_id", "seq", T.escape_markdown(F.col("text")).alias("escaped"))


@query("documents")
def heading_numbers(docs):
    """Lines given numbers of several kinds, and what the parser finds in them."""
    rows = L.lines_of(docs)
    kind = F.col("seq") % 4
    number = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), (F.col("seq") % 7 + 1).cast("string"))
    title = F.concat(F.when(kind == 0, F.concat(F.lit("Chapter "), F.col("seq") % 30 + 1, F.lit(". "))).when(kind == 1, F.concat(number, F.lit(" "))).when(kind == 2, F.concat(F.lit("Appendix B: "))).otherwise("- "), T.squeeze(F.col("text")))
    found = rows.select("doc_id", "seq", T.heading_parts(title).alias("h"))
    return found.select("doc_id", "seq", "h.label", "h.number", "h.title", T.number_depth(F.col("h.number")).alias("depth"))


@query("documents")
def roman_values(docs):
    n = F.pmod(F.col("doc_id"), F.lit(12)).cast("int")
    text = F.get(F.split(F.lit("I,II,IV,IX,XIV,XL,XC,CD,MCMXCIX,MMXXVI,IIX,word"), ","), n)
    return docs.select("doc_id", text.alias("roman"), T.roman_value(text).alias("value"))


@query("documents")
def damaged_text(docs):
    """Documents with a letter lost to the font: how much is damaged, and mended lines."""
    hurt = F.translate(F.col("text"), "qz", "\ufffd\ue000")
    rows = docs.where("text is not null").select("doc_id", T.damaged(hurt).alias("n_damaged"), T.damaged(T.mend_damaged(hurt)).alias("n_left"))
    return rows


@query("documents")
def broken_text_layers(docs):
    """Texts as they are, without vowels, and with spaces lost, by what the check says."""
    kind = F.pmod(F.col("doc_id"), F.lit(3))
    text = F.when(kind == 1, F.translate(F.col("text"), "aeiouyAEIOUY", "kkkkkkKKKKKK")).when(kind == 2, F.regexp_replace("text", "([a-z]) ([a-z])", "$1$2")).otherwise(F.col("text"))
    return docs.select("doc_id", F.coalesce(T.broken_text(text), F.lit("sound")).alias("verdict"))


@query("documents")
def front_matter(docs):
    md = F.concat(F.lit("---\ntitle: "), T.yaml_quote(F.get(L.split_lines(F.col("text")), F.lit(0))), F.lit("\nlang: "), F.col("lang"), F.lit("\nyear: "), (F.col("doc_id") % 100 + 1950).cast("string"), F.lit("\n---\n"), F.col("text"))
    return docs.select("doc_id", T.yaml_field(md, "lang").alias("lang"), T.first_year(T.yaml_field(md, "year")).alias("year"), (T.strip_yaml(md) == F.col("text")).alias("whole"))


# ---------------------------------------------------------------------- aggregates


@query("documents")
def line_census(docs):
    return L.census(docs)


@query("documents")
def running_lines(docs):
    return A.running_lines(L.lines_of(docs))


@query("documents")
def learned_acronyms(docs):
    return A.acronyms(L.lines_of(docs.select("doc_id", F.regexp_replace("text", "(^| )(the|la|der|le) ", "$1TLA ").alias("text"))))


@query("documents")
def word_forms(docs):
    return A.word_forms(docs)


@query("documents")
def glyph_report(docs):
    return A.glyphs(docs, above=0x7F)


@query("documents", "benchmark")
def token_precision_recall(docs, items):
    return A.token_overlap(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("id"), "text"), "id")


@query("lineitem")
def first_mode(items):
    return A.first_mode(items, ["l_orderkey"], "l_quantity", F.lit(1), "l_linenumber").select("l_orderkey", "l_quantity", "weight")


@query("lineitem")
def weighted_median(items):
    return A.weighted_median(items, ["l_suppkey"], "l_quantity", "l_linenumber")


# ----------------------------------------------------------------- neighbouring rows


@query("documents")
def paragraph_groups(docs):
    return L.paragraphs(L.lines_of(docs)).select("doc_id", "paragraph", "first", "n_lines", "text")


@query("documents")
def section_parents(docs):
    return L.section_parents(L.headings_of(L.as_markdown(docs))).select("doc_id", "seq", "level", "parent")


@query("documents")
def section_paths(docs):
    return L.section_paths(L.headings_of(L.as_markdown(docs))).select("doc_id", "seq", "path")


@query("documents")
def heading_anchors(docs):
    return L.anchors(L.headings_of(L.as_markdown(docs))).select("doc_id", "seq", "anchor")


@query("documents")
def blank_collapse(docs):
    gappy = docs.where("text is not null").select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n\n").alias("text"))
    out = L.collapse_blanks(gappy)
    return out.select("doc_id", F.size(L.split_lines(F.col("text"))).alias("n_lines"), F.length("text").alias("length"))


@query("documents")
def regime_fill(docs):
    rows = L.headings_of(L.as_markdown(docs))
    named = F.get(F.split(F.lit("References,Glossary,Notes,Introduction"), ","), (F.col("seq") % 4).cast("int"))
    titled = rows.withColumn("title", F.when(F.col("seq") % 5 < 2, named).otherwise(F.col("title")))
    return L.carry_forward(titled, L.regime_of(F.col("title")), "regime").select("doc_id", "seq", F.coalesce("regime", F.lit("body")).alias("regime"))


# ---------------------------------------------------------------------------- audit


def _audited(docs):
    """Documents with markup, damage and pictures by line number, and the files that are there."""
    marked = L.as_markdown(docs)
    line = F.transform(L.split_lines(F.col("text")), lambda x, i: F.when(i % 40 == 14, F.concat(x, F.lit(" "))).when(i % 40 == 26, F.concat(F.lit("![p](pic%20"), (i % 7).cast("string"), F.lit(".png)"))).when(i % 60 == 38, F.lit("12")).when(i % 60 == 44, F.concat(F.lit("| a | b |\n| c |\n"), x)).otherwise(x))
    files = docs.select("doc_id", F.explode(F.array(*[F.lit(f"pic {k}.png") for k in range(0, 7, 2)])).alias("path"))
    return audit.exploded(marked.select("doc_id", F.array_join(line, "\n").alias("text")), files)


@query("documents")
def audit_checks(docs):
    return _audited(docs)


@query("documents")
def audit_totals(docs):
    return audit.totals(_audited(docs))


@query("documents")
def audit_worst(docs):
    return audit.worst(audit.scores(_audited(docs)))


@query("documents", "benchmark")
def evaluate_checks(docs, items):
    """Each benchmark item looked for in the document of its number, in five ways."""
    words = F.split(F.col("text"), " ")
    base = items.select(F.col("item_id").alias("doc_id"), words.alias("w"), F.col("text").alias("item"))
    kinds = F.array(
        F.struct(F.lit("contains").alias("kind"), F.array("item").alias("texts"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("count")),
        F.struct(F.lit("absent").alias("kind"), F.array("item").alias("texts"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("count")),
        F.struct(F.lit("count").alias("kind"), F.array(F.get("w", F.lit(1))).alias("texts"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("int").alias("count")),
        F.struct(F.lit("order").alias("kind"), F.array(F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("texts"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("count")),
    )
    checks = base.select("doc_id", F.inline(kinds))
    return audit.evaluate(docs, checks).select("doc_id", "kind", "passed")


# ---------------------------------------------------------------------------- joins


@query("events")
def latest_events(events):
    return joins.latest(events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("events")
def event_sessions(events):
    rows = joins.sessions(events, ["user_id"], "ts", F.lit(1800))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("events")
def watermark_sessions(events):
    return ledger.sessions(events).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("lineitem", "orders")
def nearest_order(items, orders):
    """Of each line item the customer's last order placed at or before it was shipped."""
    o = orders.select("o_custkey", F.col("o_orderdate").alias("at"), "o_orderkey").groupBy("o_custkey", "at").agg(F.max("o_orderkey").alias("o_orderkey"))
    left = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey", F.col("l_shipdate").alias("at"))
    return joins.nearest_before(left, o, ["o_custkey"], "at", ["o_orderkey"]).select("l_orderkey", "l_linenumber", F.col("right_o_orderkey").alias("before"))


@query("orders", "customer")
def span_overlaps(orders, customers):
    """Pairs of one customer's orders whose ten-day spans meet."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01"))
    spans = orders.select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("id"), day.alias("low"), (day + 10).alias("high"))
    pairs = joins.overlaps(spans, spans, ["who"], 16).where("l.id < r.id")
    return pairs.select("who", F.col("l.id").alias("a"), F.col("r.id").alias("b"))


@query("lineitem")
def top_items(items):
    kept = joins.top_of_each(items, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return kept.select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


# --------------------------------------------------------------------------- layout


def _pages(docs):
    return layout.set_pages(docs.where("text is not null"))


@query("documents")
def body_styles(docs):
    rows = _pages(docs)
    body = layout.body_style(rows)
    return layout.body_margin(rows, body).join(body, "doc_id").select("doc_id", "font", "size", "chars", "margin")


@query("documents")
def furniture(docs):
    rows = _pages(docs)
    return layout.without_furniture(rows, layout.running_heads(rows)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("page").alias("last_page"))


@query("documents")
def column_order(docs):
    rows = layout.columns(_pages(docs))
    return layout.reading_order(rows).select("doc_id", "seq", "col", "place")


@query("documents")
def line_pitch(docs):
    return layout.line_pitch(layout.columns(_pages(docs)))


@query("documents")
def isolated_lines(docs):
    rows = layout.columns(_pages(docs))
    return layout.isolated(rows, layout.line_pitch(rows)).groupBy("doc_id").agg(F.sum(F.col("isolated").cast("int")).alias("n_isolated"))


@query("documents")
def heading_styles(docs):
    rows = _pages(docs)
    return layout.heading_styles(rows, layout.body_style(rows))


@query("documents")
def document_kinds(docs):
    rows = _pages(docs)
    return layout.kind_scores(rows, layout.body_style(rows)).select("doc_id", "kind", "confidence")


@query("documents")
def caption_boxes(docs):
    """Display lines against boxes of a fixed grid: the nearest box above, if near enough."""
    rows = _pages(docs)
    boxes = rows.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box_id")).withColumns({"x0": 40.0 + 135 * F.col("box_id"), "x1": 160.0 + 135 * F.col("box_id"), "y0": 40.0 + 10 * F.col("box_id"), "y1": 80.0 + 10 * F.col("box_id")})
    return layout.captions_to_boxes(rows.where("is_bold"), boxes, 48.0)


@query("documents")
def lines_in_boxes(docs):
    rows = _pages(docs)
    boxes = rows.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("box_id")).withColumns({"x0": F.lit(0.0), "x1": F.lit(300.0), "y0": 100.0 + 90 * F.col("box_id"), "y1": 220.0 + 90 * F.col("box_id")})
    return layout.inside(rows, boxes)


@query("documents")
def page_coverage(docs):
    """Which lines of each page are kept when numbers, junk and empty lines go."""
    rows = _pages(docs).withColumn("source", F.col("seq"))
    after = rows.where(F.col("seq") % 11 != 5).select("doc_id", "source", F.when((F.col("y1") < 80) | (F.trim("text") == ""), "furniture").otherwise("text").alias("role"))
    pages = rows.groupBy("doc_id", "page").agg((F.col("page") % 3 == 2).cast("int").alias("n_images"), F.sum(T.damaged(F.col("text"))).alias("damaged"))
    out = layout.coverage(rows.select("doc_id", "page", "source"), after, pages)
    return out.select("doc_id", "page", "retained", "suppressed", "unaccounted", F.array_join("reasons", ",").alias("reasons"), "blank_candidate")


# --------------------------------------------------------------------------- tables


def _cell(row, col, rowspan, colspan, text):
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in {"row": row, "col": col, "rowspan": rowspan, "colspan": colspan, "text": text}.items()])


def _tables(items):
    """An order's line items as a table of three columns, under a two-row header."""
    head = F.array(*[_cell(*c) for c in [(1, 0, 2, 1, "Part"), (1, 1, 1, 2, "Item"), (2, 1, 1, 1, "Quantity"), (2, 2, 1, 1, "Flag")]])
    made = lambda x: F.array(*[_cell(x["l_linenumber"].cast("int") + 2, k, 1, 1, v.cast("string")) for k, v in enumerate((x["l_partkey"], x["l_quantity"].cast("int"), x["l_returnflag"]))])
    each = items.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")).alias("items"))
    return each.select("table_id", F.concat(head, F.flatten(F.transform("items", made))).alias("cells"))


@query("lineitem")
def table_markdown(items):
    return TB.grids(TB.sized(_tables(items))).select("table_id", TB.pipe_table(F.col("rows"), 2).alias("md"))


@query("lineitem")
def table_status(items):
    t = F.col("table_id")
    hurt = lambda c: c.withField("rowspan", F.when((t % 5 == 0) & (c["row"] == 3), 2).when((t % 7 == 0) & (c["row"] == 1), 1_000_000).otherwise(c["rowspan"]))
    return TB.statuses(TB.sized(_tables(items).withColumn("cells", F.transform("cells", hurt))))


# ------------------------------------------------------------------ markup and chunks


@query("pages")
def html_titles(pages):
    return html.titles(pages)


@query("pages")
def html_blocks(pages):
    return html.blocks(pages).groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum((F.col("kind") == "heading").cast("int")).alias("n_headings"), F.sum((F.col("kind") == "para").cast("int")).alias("n_paras"))


@query("pages")
def html_links(pages):
    return html.links(pages).groupBy("page_id").agg(F.count("*").alias("n_links"), F.min("href").alias("first_href"))


@query("pages")
def html_markdown(pages):
    return render.markdown(html.blocks(pages), "page_id")


@query("conversations")
def conversation_chunks(turns):
    return render.chunks(render.conversation_documents(turns), 60)


@query("documents")
def document_chunks(docs):
    return render.chunks(L.as_markdown(docs), 200).select("doc_id", "chunk", "path", "tokens", "oversize")


@query("documents")
def markdown_chunks(docs):
    return render.block_chunks(L.as_markdown(docs), 40)


@query("lineitem")
def table_chunks(items):
    """Each order's items as a pipe table in a section, parted under its header."""
    row = lambda x: F.concat(F.lit("| "), x["l_partkey"].cast("string"), F.lit(" | "), x["l_quantity"].cast("int").cast("string"), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), row), "\n")
    tables = items.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("# Items\n\n| part | n |\n| --- | --- |\n"), body).alias("text"))
    return render.block_chunks(tables, 30)


# -------------------------------------------------------------- hand-made cases

QUERIES.update({name: (lambda f: lambda spark, sf_dir: f(table(spark, sf_dir, "documents")))(applied(name)) for name in CASES})


# ------------------------------------------------------------- slides and outlines


def _slides(docs):
    """Each document's lines five to a slide, every slide shown in three steps."""
    rows = L.lines_of(docs).groupBy("doc_id", F.floor(F.col("seq") / 5).cast("int").alias("slide")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("lines"))
    step = F.explode(F.array(*map(F.lit, range(3)))).alias("step")
    steps = rows.select("doc_id", "slide", "lines", step)
    upto = F.when(F.col("step") == 2, F.size("lines")).otherwise(F.col("step") + 1)
    return steps.select("doc_id", (F.col("slide") * 3 + F.col("step")).cast("int").alias("page"), F.concat(F.lit("Slide "), F.col("slide").cast("string")).alias("title"), F.slice("lines", 1, upto).alias("body"))


@query("documents")
def build_steps(docs):
    return decks.build_steps(_slides(docs))


@query("documents")
def outline_tree(docs):
    """A list of headings dealt to each document, as its tree says."""
    lists = [text.split("|") for text in OUTLINES]
    mine = F.get(F.array(*[F.array(*[F.lit(t) for t in titles]) for titles in lists]), F.pmod(F.col("doc_id"), F.lit(len(lists))).cast("int"))
    heads = docs.select("doc_id", F.posexplode(mine).alias("seq", "line")).select("doc_id", "seq", F.substr("line", F.lit(3)).alias("title"), F.left("line", F.lit(1)).cast("int").alias("rank"))
    return outline.outline(heads)


#: Headings with the prominence of their style before them, by document.
OUTLINES = (
    "1 Chapter 1 Start|2 1.1 First|2 1.2 Second|3 1.2.1 Deep|2 5.7 Elsewhere|1 Chapter 2 Next|2 2.1 Again|2 1.3 Back",
    "1 Introduction|2 Methods|2 Results|1 References",
    "1 Chapter 1 A|2 1.1 B|3 Exercise 1 Do|3 Exercise 2 Try|4 A small aside|1 Glossary",
    "1 Part II The end|1 Chapter 3 C|2 Appendix A Proofs|2 Example 1 Lone",
)


@query("documents")
def list_parents(docs):
    """Lines as blocks: items of three levels in runs that paragraphs part."""
    rows = L.lines_of(docs)
    kind = F.when(F.col("seq") % 7 == 6, "para").otherwise("list_item")
    return outline.list_parents(rows.select("doc_id", "seq", kind.alias("kind"), (F.col("seq") * 5 % 3 + 1).cast("int").alias("level"))).where("kind = 'list_item'").select("doc_id", "seq", "level", "parent")


@query("documents")
def contents_entries(docs):
    return outline.contents(L.anchors(L.headings_of(L.as_markdown(docs))))


@query("documents")
def heading_echoes(docs):
    """Headings, some given the title above them in small letters."""
    heads = L.headings_of(L.as_markdown(docs))
    above = F.lag("title").over(L.by_doc())
    return outline.without_echoes(heads.withColumn("title", F.when(F.col("seq") % 4 == 2, F.lower(F.coalesce(above, F.col("title")))).otherwise(F.col("title")))).select("doc_id", "seq")


@query("documents")
def note_places(docs):
    rows = L.lines_of(docs)
    kind = F.when(F.col("seq") % 9 == 0, "heading").when(F.col("seq") % 4 == 2, "footnote").otherwise("para")
    return outline.place_notes(rows.select("doc_id", "seq", kind.alias("kind")))


@query("documents")
def roman_sections(docs):
    """Lines of which some are numbered in roman, with gaps and repeats."""
    rows = L.lines_of(docs)
    number = F.get(F.split(F.lit("I,II,II,IV,III,IV,V,VII"), ","), (F.floor(F.col("seq") / 3) % 8).cast("int"))
    text = F.when(F.col("seq") % 3 == 1, F.concat(number, F.lit(". SECTION "), F.col("seq").cast("string"))).otherwise(F.col("text"))
    return outline.roman_sections(rows.select("doc_id", "seq", text.alias("text"), F.lit(False).alias("isolated")))


@query("documents")
def printed_contents(docs):
    """Lines as the entries of a contents page, a third of them wrapped."""
    rows = L.lines_of(docs).where("seq < 40")
    number = F.when(F.col("seq") % 4 == 0, "").when(F.col("seq") % 4 == 1, "2 ").otherwise("2.1 ")
    entry = F.concat(number, F.lit("Entry "), F.col("seq").cast("string"), F.when(F.col("seq") % 3 == 2, "").otherwise(F.concat(F.lit(" ..... "), F.col("seq").cast("string"))))
    return outline.printed_contents(rows.select("doc_id", F.floor(F.col("seq") / 20).cast("int").alias("page"), "seq", entry.alias("text")))


# ---------------------------------------------------------------- corpus of results


@query("documents")
def cleanest_results(docs):
    """Documents as results of files that share a stem, four to one."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select(F.concat(F.lit("s"), F.floor(F.col("doc_id") / 4).cast("string")).alias("stem"), F.concat(F.lit("Out/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (F.col("doc_id") * 7 % 3).alias("score"), (F.col("doc_id") % 2).alias("issues"), size.alias("bytes"))
    return batch.cleanest(rows)


@query("labels")
def case_statuses(labels):
    """Labels as checks of cases, some missing, broken off or without checks."""
    case = F.floor(F.col("doc_id") / 3).cast("long").alias("case_id")
    cases = labels.select(case).distinct().select("case_id", (F.col("case_id") % 11 != 0).alias("present"), F.when(F.col("case_id") % 7 == 3, 1).otherwise(0).alias("returncode"), (F.col("case_id") % 13 == 5).alias("timed_out"))
    checks = labels.where("doc_id % 5 <> 0").select(case, (F.col("quality") == 1).alias("passed"))
    return batch.case_status(checks, cases)


@query("lineitem")
def engine_medians(items):
    runs = items.select(F.col("l_returnflag").alias("engine"), (F.col("l_linestatus") == "F").alias("ok"), F.col("l_extendedprice").cast("double").alias("seconds"), F.col("l_quantity").cast("double").alias("bytes"))
    return batch.engine_medians(runs)


@query("documents")
def joined_parts(docs):
    """Documents in two parts, each with front matter, put together again."""
    head = F.concat(F.lit("---\ntitle: t"), F.col("doc_id").cast("string"), F.lit("\n---\n"))
    parts = docs.where("text is not null").select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("part"), F.concat(head, F.lit("first")).alias("text")), F.struct(F.lit(76).alias("part"), F.concat(head, F.lit("\n"), F.trim("text")).alias("text")))).alias("p")).select("doc_id", "p.part", "p.text")
    whole = batch.whole_documents(parts)
    return whole.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("length"))


@query("documents")
def page_ranges(docs):
    return batch.page_ranges(docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_pages")), 75)


@query("documents")
def new_names(docs):
    title = F.when(F.col("doc_id") % 4 == 0, "The Same: Title").otherwise(F.concat(F.lit("Title No. "), (F.col("doc_id") % 50).cast("string")))
    head = F.when(F.col("doc_id") % 5 == 1, "---\nlang: x\n---\n").otherwise(F.concat(F.lit('---\ntitle: "'), title, F.lit('"\n---\n')))
    files = docs.select(F.concat(F.lit("out/"), F.col("lang"), F.lit("/"), F.format_string("%08d", F.col("doc_id")), F.lit(".md")).alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return batch.new_names(files)


# ------------------------------------------------------------------ layout, continued


@query("documents")
def size_tiers(docs):
    rows = _pages(docs).withColumn("size", 9.0 + F.pmod(F.col("seq") * 7, F.lit(23)) * 0.3)
    return layout.size_tiers(rows)


@query("documents")
def text_families(docs):
    font = F.get(F.split(F.lit("AB+CMR10,CMBX12,Times-Italic,Garamond3"), ","), F.pmod(F.col("seq"), F.lit(4)).cast("int"))
    return layout.text_families(_pages(docs).withColumn("font", font))


@query("documents")
def kind_census(docs):
    return layout.census(_pages(docs).withColumn("kind", F.when(F.col("is_bold"), "heading").otherwise("body")), "kind").select("doc_id", F.element_at("counts", "heading").alias("headings"), F.element_at("counts", "body").alias("bodies"))


@query("documents")
def acronym_sets(docs):
    taught = docs.select("doc_id", F.regexp_replace("text", "(^| )(the|la|der|le) ", "$1TLA ").alias("text"))
    return A.acronym_sets(L.lines_of(taught)).select("doc_id", F.array_join("acronyms", " ").alias("acronyms"))


@query("documents")
def table_chains(docs):
    """A table for each page of a document, some of which say that they go on."""
    page = F.explode(F.sequence(F.lit(0), F.least(F.coalesce(F.length("text"), F.lit(0)) / 200, F.lit(12)).cast("int"))).alias("page")
    number = F.floor(F.col("page") / 4) + 1
    told = F.concat(F.lit("Table "), number.cast("string"), F.when(F.col("page") % 4 == 0, ": counts").otherwise(" (continued)"))
    rows = docs.select("doc_id", page).select("doc_id", F.col("page").alias("table_id"), "page", F.when(F.col("page") % 7 == 6, 70.0).otherwise(50.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(3).alias("cols"), told.alias("context"), F.when(F.col("page") == 2, "A|B").otherwise("a|b").alias("header"))
    return layout.continued(rows)


@query("lineitem")
def table_pages(items):
    """Each order's first items as an HTML table, the header a cell over two columns."""
    kept = batch.first_of_each(items, "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_returnflag")], 2)
    cell = lambda c, span: F.struct(c.cast("string").alias("text"), F.lit(1).alias("rowspan"), F.lit(span).alias("colspan"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.array(cell(F.col("l_partkey"), 1), cell(F.concat(F.col("l_returnflag"), F.lit(" & co")), 1)).alias("cells")))), lambda r: r["cells"])
    made = kept.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.concat(F.array(F.array(cell(F.lit("Items <2>"), 2))), rows).alias("grid"))
    return made.select("table_id", fields.table_html(F.col("grid"), F.lit(1)).alias("html"))


@query("documents")
def covered_pages(docs):
    """Pages with two images that overlap by a share that grows with the page."""
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.least(F.coalesce(F.length("text"), F.lit(0)) / 500, F.lit(9)).cast("int"))).alias("page")).withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    box = lambda x, w: F.array(x, F.lit(0.0), x + w, F.lit(400.0))
    boxes = pages.select("doc_id", "page", F.explode(F.array(box(F.lit(0.0), F.lit(400.0)), box(50.0 * F.col("page"), F.lit(500.0)))).alias("box"))
    return layout.dominant_pages(boxes, pages, 0.7).select("doc_id", F.round("share", 6).alias("share"))


@query("documents")
def numbered_titles(docs):
    """Lines in pairs on one baseline, the left one a section number at times."""
    rows = L.lines_of(docs).where("seq < 60")
    left = F.col("seq") % 2 == 0
    text = F.when(left & (F.col("seq") % 6 == 0), F.concat((F.col("seq") / 6 + 1).cast("int").cast("string"), F.lit(".2"))).otherwise(F.col("text"))
    y = F.floor(F.col("seq") / 2) * 14.0
    placed = rows.select("doc_id", F.lit(0).alias("page"), "seq", text.alias("text"), F.when(left, 50.0).otherwise(80.0).alias("x0"), F.when(left, 70.0).otherwise(300.0).alias("x1"), y.alias("y0"), (F.col("seq") % 4 == 1).alias("is_bold"))
    return layout.number_and_title(placed)


@query("documents")
def text_hashes(docs):
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("documents")
def wrapped_titles(docs):
    """Slides of six lines, the first two or three of them a title that runs on."""
    rows = L.lines_of(docs).where("seq < 60")
    slide, at = F.floor(F.col("seq") / 6).cast("int"), F.col("seq") % 6
    run = F.pmod(F.col("doc_id") + slide, F.lit(3)).cast("int")
    y = F.when(at <= run, 60.0 + 26 * at).otherwise(200.0 + 30 * at)
    placed = rows.select("doc_id", slide.alias("page"), "seq", F.left("text", F.lit(30)).alias("text"), F.when(at <= run, 24.0).otherwise(14.0).alias("size"), F.lit(60.0).alias("x0"), y.alias("y0"))
    return decks.wrapped_titles(placed)


@query("documents")
def duplicate_results(docs):
    rows = docs.select(F.concat(F.lit("s"), F.floor(F.col("doc_id") / 4).cast("string")).alias("stem"), F.concat(F.lit("Out/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (F.col("doc_id") % 3).alias("score"), F.lit(0).alias("issues"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    return batch.deduplicated(rows).select("stem", "path", "kept")


@query("lineitem")
def engine_pairs(items):
    """Orders' items as runs of two engines over one case."""
    runs = items.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") == 1, "ours").otherwise("theirs").alias("engine")).agg(F.max("l_extendedprice").cast("double").alias("seconds"))
    return batch.side_by_side(runs, "ours", "theirs")


@query("documents")
def table_contexts(docs):
    """Lines round a table in the middle of each page's left column."""
    rows = _pages(docs)
    tables = rows.select("doc_id", "page").distinct().withColumns({"table_id": F.col("page"), "x0": F.lit(50.0), "y0": F.lit(180.0), "x1": F.lit(200.0), "y1": F.lit(300.0)})
    return layout.near_context(tables, rows)


@query("documents")
def margin_terms(docs):
    """First words of lines set in the margin two lines on, where some only repeat the text."""
    rows = L.lines_of(docs).where("seq < 30").select("doc_id", F.lit(0).alias("page"), "seq", "text", (16.0 * F.col("seq")).alias("y0"), F.lit(False).alias("margin"))
    terms = rows.select("doc_id", "page", (F.col("seq") + 1000).alias("seq"), F.substring_index("text", " ", 1).alias("text"), (F.col("y0") + F.when(F.col("seq") % 2 == 0, 32.0).otherwise(160.0)).alias("y0"), F.lit(True).alias("margin"))
    return layout.repeated_margin_terms(rows.unionByName(terms), 16.0)


@query("documents")
def found_boxes(docs):
    """Recognised boxes that lie over no line."""
    rows = _pages(docs)
    box = F.array("x0", "y0", "x1", "y1")
    found = rows.where("seq >= 0").select("doc_id", "page", F.col("seq").alias("found_id"), F.array(F.col("x0"), F.col("y1") + 1.0, F.col("x1"), F.col("y1") + 1.0 + F.col("seq") % 8).alias("box"))
    return layout.apart_from(found, rows.select("doc_id", "page", box.alias("box"))).select("doc_id", "page", "found_id")


@query("documents")
def told_levels(docs):
    """Heading levels as a list of titles says, where it names them."""
    heads = L.headings_of(L.as_markdown(docs))
    told = heads.where("seq % 24 = 0").select("doc_id", T.title_key(F.col("title")).alias("title_key"), F.lit(4).alias("level")).distinct()
    return outline.override_levels(heads, told).select("doc_id", "seq", "level")


@query("documents")
def changed_lines(docs):
    """Lines, a third of them with wide blanks, that the repair of a page changes."""
    from leafmill.plans import outputs

    before = L.lines_of(docs).withColumn("text", F.when(F.col("seq") % 3 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text")))
    after = before.withColumn("text", repair.repair_line_parts(F.col("text")))
    return outputs.transformations(before, after)


@query("documents")
def dense_headings(docs):
    """Heading candidates too near to one another to be any."""
    rows = layout.columns(_pages(docs)).where("seq >= 0 and (seq % 20 < 6 or seq % 20 = 12)")
    return layout.dense_headings(rows, 3, 4).select("doc_id", "seq", "dense")
