"""The tree that heading numbers, lists and notes make of a document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.text import SPINE_LABELS, SPINE_ROMANS
from leafmill.operators.lines import by_doc, so_far

#: Headings without a number that stand at the top whatever is open.
TOP_TITLES = (
    r"(?i)^(Abstract|Preface|Foreword|Introduction|Prologue|Acknowledg(e)?ments|Summary of Notation|Notation|About the Authors?|Epilogue|Afterword|Conclusions?"
    r"|References|Bibliography|Glossary|Notes|Index|Subject Index|Author Index|Appendix|Appendices|Contents|List of Figures|List of Tables|Figures|Tables)\b"
)


def _key(number: str) -> tuple:
    roman = {r: i + 1 for i, r in enumerate(SPINE_ROMANS)}
    return tuple(int(p) if p.isdigit() else roman.get(p, p) for p in number.split("."))


def _tree(heads: list[tuple[str, str, int, bool]]) -> list[tuple[str, int, bool]]:
    """Kind, level and place in the contents of one document's headings (label, number, rank, top), in order.

    A numbered heading belongs to the spine if it goes on from the last of its
    parent and its parent is open or was seen; else it only refers to it.
    """
    last: dict[tuple, object] = {}
    open_: list[tuple] = []  # numbers of the open spine, outermost first
    rows, depths = [], set()
    for label, number, _, _ in heads:
        key = _key(number) if number else ()
        label = label.lower()
        under = len(open_[-1]) + 1 if open_ else 1
        if not key:
            rows.append(("unnumbered", under))
        elif label and label not in SPINE_LABELS:
            rows.append((f"series {label}", under))
        elif label == "part":
            rows.append(("section", 1))
        else:
            parent, now = key[:-1], key[-1]
            before = last.get(parent)
            onward = before is None or type(before) is not type(now) or now > before
            placed = not parent or parent in open_ or parent in last
            if onward and placed:
                last = {k: v for k, v in last.items() if len(k) <= len(key) or k[: len(key)] != key} | {parent: now}
                open_ = [k for k in open_ if len(k) < len(key) and key[: len(k)] == k] + [key]
                depths.add(len(key))
                rows.append(("section", len(key)))
            else:
                rows.append(("off_sequence", 0))
    many = Counter(kind for kind, _ in rows)
    sections = [r for (kind, d), (_, _, r, _) in zip(rows, heads, strict=True) if kind == "section" and d >= 2]
    floor, deep = max(sections, default=99), any(d >= 2 for d in depths)
    out = []
    for (kind, depth), (_, _, rank, top) in zip(rows, heads, strict=True):
        if kind.startswith("series") and many[kind] < 2:
            kind = "unnumbered"
        if kind == "section":
            out.append(("section", min(6, depth), depth <= 3))
        elif kind == "off_sequence":
            out.append(("body", 0, False))
        elif kind != "unnumbered":
            out.append(("runin", 0, False))
        else:
            depth = 1 if top else depth
            if deep and depth >= 2 and rank > floor:
                out.append(("runin", 0, False))
            else:
                out.append(("heading", min(6, depth), depth == 1 or (not deep and depth <= 3)))
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for read in batches:
        for i in range(0, read.num_rows, 256):
            few = read.slice(i, 256)
            rows = [(doc_id, h["seq"], *told) for doc_id, heads in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True) for h, told in zip(heads, _tree([(h["label"], h["number"], h["rank"], h["top"]) for h in heads]), strict=True)]
            columns = zip(*rows, strict=True)
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "seq", "kind", "level", "in_toc"])


def outline(headings: DataFrame) -> DataFrame:
    """``doc_id, seq, kind, level, in_toc`` of headings (``doc_id, seq, title, rank``).

    ``rank`` is the prominence of a heading's style, 1 the greatest.  The rule
    goes from heading to heading, so one document's headings are one row, and
    many documents one batch.
    """
    parts = T.heading_parts(F.col("title"))
    told = headings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("int").alias("seq"), F.col("rank").cast("int").alias("rank"), parts["label"].alias("label"), parts["number"].alias("number"), F.trim("title").rlike(TOP_TITLES).alias("top"))
    each = told.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "rank", "label", "number", "top"))).alias("heads"))
    return each.mapInArrow(_trees, "doc_id long, seq int, kind string, level int, in_toc boolean")


def list_parents(items: DataFrame, deepest: int = 6) -> DataFrame:
    """Adds ``parent`` to list items: the last item above, in the same run, of a lower level.

    ``items``: doc_id, seq, kind, level, all blocks in order; a block that is no
    item ends a run.
    """
    rows = items.withColumn("_run", F.sum((F.col("kind") != "list_item").cast("int")).over(so_far()))
    above = Window.partitionBy("doc_id", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    is_item = F.col("kind") == "list_item"
    last = [F.max(F.when(is_item & (F.col("level") == k), F.col("seq"))).over(above) for k in range(1, deepest)]
    lower = [F.when(is_item & (F.col("level") > k), last[k - 1]) for k in range(1, deepest)]
    return rows.withColumn("parent", F.greatest(*lower)).drop("_run")


def without_echoes(headings: DataFrame) -> DataFrame:
    """Headings less those that say the same as the one just above, case and blanks aside."""
    key = F.lower(T.squeeze(F.col("title")))
    return headings.withColumn("_same", F.lag(key).over(by_doc()).eqNullSafe(key)).where("not _same").drop("_same")


def contents(headings: DataFrame) -> DataFrame:
    """``doc_id, seq, entry``: the lines of a table of contents, indented by the levels that are used.

    ``headings``: doc_id, seq, level, title, anchor.
    """
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("level")) - 1
    return headings.withColumn("_rank", rank).select("doc_id", "seq", F.concat(F.repeat(F.lit("  "), F.col("_rank")), F.lit("- ["), F.col("title"), F.lit("](#"), F.col("anchor"), F.lit(")")).alias("entry"))


def place_notes(blocks: DataFrame) -> DataFrame:
    """Adds ``place``: notes stand at their section's end, before the next heading.

    ``blocks``: doc_id, seq, kind.
    """
    section = F.sum((F.col("kind") == "heading").cast("int")).over(so_far())
    note = (F.col("kind") == "footnote").cast("int")
    order = Window.partitionBy("doc_id").orderBy("_section", "_note", "seq")
    return blocks.withColumn("_section", section).withColumn("_note", note).withColumn("place", F.row_number().over(order) - 1).drop("_section", "_note")


def roman_sections(lines: DataFrame) -> DataFrame:
    """``doc_id, seq, value``: lines numbered I, II, III in order from the first, three at least.

    ``lines``: doc_id, seq, text, isolated.  A line counts if it stands apart or
    is set in capitals.  The run takes the first II after the I and so on: value
    k + 1 is the first of its kind behind value k, found by a fold over the few
    numbered lines of a document.
    """
    c = F.trim("text")
    number, title = F.regexp_extract(c, r"^([IVXLCDM]+)\.\s+(\S.{2,78})$", 1), F.regexp_extract(c, r"^([IVXLCDM]+)\.\s+(\S.{2,78})$", 2)
    found = lines.withColumn("value", T.roman_value(number)).where((F.col("value") > 0) & ~c.rlike("[.,;:]$") & (F.col("isolated") | (F.upper(title) == title)))
    each = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("found"))
    run = F.aggregate("found", F.array().cast("array<struct<seq:int,value:int>>"), lambda acc, x: F.when(x["value"] == F.size(acc) + 1, F.concat(acc, F.array(x.cast("struct<seq:int,value:int>")))).otherwise(acc))
    return each.select("doc_id", run.alias("run")).where(F.size("run") >= 3).select("doc_id", F.inline("run"))


def printed_contents(lines: DataFrame) -> DataFrame:
    """``doc_id, title_key, level``: what a printed table of contents says of a title.

    ``lines``: doc_id, page, seq, text.  Pages count on which leaders are dense;
    lines are joined up to the one with a leader.  The level is the depth of the
    number, and of equal titles the last counts.
    """
    leader = F.col("text").rlike(r"(?:\.\s?){4,}")
    page = Window.partitionBy("doc_id", "page")
    n, lead = F.count("*").over(page), F.sum(leader.cast("int")).over(page)
    rows = lines.withColumn("leader", leader).withColumn("n", n).withColumn("lead", lead)
    rows = rows.where((F.col("n") >= 8) & (F.col("lead") >= 3) & ((F.col("lead") >= 0.4 * F.col("n")) | (F.col("lead") >= 6)))
    ended = F.coalesce(F.sum(F.col("leader").cast("int")).over(by_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    entries = rows.withColumn("entry", ended).groupBy("doc_id", "entry").agg(F.min("seq").alias("seq"), joined.alias("text"), F.max("leader").alias("leader")).where("leader")
    pattern = r"^\s*(\d{1,2}(?:\.\d{1,2})*)?\s*(.*?)\s*(?:\.\s?){3,}\s*(\d{1,4})?\s*$"
    number, title = F.regexp_extract("text", pattern, 1), F.regexp_replace(T.squeeze(F.regexp_extract("text", pattern, 2)), r"^[ .]+|[ .]+$", "")
    told = entries.where(F.col("text").rlike(pattern)).select("doc_id", "seq", T.title_key(title).alias("title_key"), F.least(F.when(number == "", 1).otherwise(T.number_depth(number)), F.lit(6)).alias("level"), F.length(title).alias("size")).where("size >= 3")
    return told.groupBy("doc_id", "title_key").agg(F.max_by("level", "seq").alias("level"))


def override_levels(headings: DataFrame, told: DataFrame) -> DataFrame:
    """Heading levels as the printed contents say, where they name the title."""
    keyed = headings.withColumn("title_key", T.title_key(F.col("title")))
    return keyed.join(told.withColumnRenamed("level", "_said"), ["doc_id", "title_key"], "left").withColumn("level", F.coalesce("_said", "level")).drop("_said", "title_key")
