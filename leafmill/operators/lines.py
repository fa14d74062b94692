"""Texts as lines, and rules that look at a line's neighbours.

Rules that need one document alone run inside its row, over the array of its
lines, and shuffle nothing.  Where rows of lines are wanted, windows share one
partitioning, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.functions import text as T


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("seq")


def above() -> WindowSpec:
    return by_doc().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return by_doc().rowsBetween(Window.unboundedPreceding, 0)


def split_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, seq, text``: one row a line; a null text has none."""
    return docs.select("doc_id", F.posexplode(split_lines(F.col(text))).alias("seq", "text"))


def as_markdown(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: plain documents given Markdown structure by line number.

    Lines in turn open chapters, sections, list items and tables, and blank
    lines part them: what the Markdown operators are run on where a corpus has
    no markup of its own.
    """
    marked = F.transform(
        split_lines(F.col("text")),
        lambda x, i: F.when(i % 12 == 0, F.concat(F.lit("# "), x)).when(i % 12 == 6, F.concat(F.lit("### "), x)).when(i % 12 == 8, F.concat(F.lit("## "), x)).when(i % 6 == 1, F.lit("")).when(i % 12 == 3, F.concat(F.lit("- "), x)).otherwise(x),
    )
    return docs.select("doc_id", F.array_join(marked, "\n").alias("text"))


def census(docs: DataFrame) -> DataFrame:
    """Lines, blank lines, words, longest line and Asian lines of each document."""
    own = split_lines(F.col("text"))
    return docs.where("text is not null").select(
        "doc_id",
        F.size(own).alias("n_lines"),
        F.size(F.filter(own, lambda x: F.trim(x) == "")).alias("n_blank"),
        T.words(F.col("text")).alias("n_words"),
        F.array_max(F.transform(own, F.length)).alias("longest"),
        F.size(F.filter(own, T.is_cjk)).alias("n_cjk"),
    )


def headings_of(markdown: DataFrame) -> DataFrame:
    """``doc_id, seq, level, title`` of lines that are headings, outside code fences."""
    rows = lines_of(markdown).withColumn("fences", F.sum(F.col("text").startswith("```").cast("int")).over(so_far()))
    found = rows.where((F.col("fences") % 2 == 0) & F.col("text").rlike("^#{1,6} "))
    return found.select("doc_id", "seq", F.length(F.regexp_extract("text", "^(#+) ", 1)).alias("level"), F.trim(F.regexp_replace("text", "^#+ +", "")).alias("title"))


def section_parents(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """Adds ``parent``, the last heading before of a lower level; null at the top."""
    last = [F.max(F.when(F.col("level") == k, F.col("seq"))).over(above()) for k in range(1, deepest)]
    lower = [F.when(F.col("level") > k, last[k - 1]) for k in range(1, deepest)]
    return headings.withColumn("parent", F.greatest(*lower))


def section_paths(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """Adds ``path``: the titles that a heading lies under, and its own.

    A heading of a level ends all of that level and deeper.
    """
    own = headings
    for k in range(1, deepest + 1):
        latest = F.max(F.when(F.col("level") <= k, F.struct("seq", "level", "title"))).over(so_far())
        own = own.withColumn(f"_{k}", F.when((latest["level"] == k) & (F.col("level") >= k), latest["title"]))
    path = F.array_join(F.array(*[F.col(f"_{k}") for k in range(1, deepest + 1)]), " > ")
    return own.withColumn("path", path).drop(*[f"_{k}" for k in range(1, deepest + 1)])


def anchors(headings: DataFrame) -> DataFrame:
    """Adds ``anchor``: the title's slug, numbered from its second use on."""
    slugged = headings.withColumn("slug", T.slugify(F.col("title")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("seq")) - 1
    return slugged.withColumn("anchor", F.when(nth == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", nth.cast("string")))).drop("slug")


def paragraphs(lines: DataFrame) -> DataFrame:
    """``doc_id, paragraph, first, n_lines, text``: lines that read on, joined.

    A blank line, or a line that the one before does not run into, opens a new
    paragraph.  Hyphens at a line's end are mended.
    """
    before = F.lag("text").over(by_doc())
    opens = before.isNull() | ~T.continues(before, F.col("text"))
    rows = lines.withColumn("paragraph", F.sum(opens.cast("int")).over(so_far())).where(F.trim("text") != "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "paragraph").agg(F.min("seq").alias("first"), F.count("*").alias("n_lines"), parts.alias("parts")).select("doc_id", "paragraph", "first", "n_lines", rejoin(F.col("parts")).alias("text"))


def rejoin(parts: Column) -> Column:
    """Lines of one paragraph as one line: broken words whole, Asian text without spaces."""

    def add(done: Column, part: Column) -> Column:
        part = F.trim(part)
        broken = done.rlike(r"\p{L}-$") & part.rlike(r"^\p{Ll}")
        asian = T.is_cjk(F.right(done, F.lit(1))) & T.is_cjk(F.left(part, F.lit(1)))
        soft = done.endswith("­")
        return F.when(done == "", part).when(broken | soft, F.concat(F.left(done, F.length(done) - 1), part)).when(asian, F.concat(done, part)).otherwise(F.concat(done, F.lit(" "), part))

    return F.aggregate(parts, F.lit(""), add, T.squeeze)


def collapse_blanks(docs: DataFrame) -> DataFrame:
    """Of blank lines in a row the first stays; inside code fences all do.

    One pass of a pattern that takes a whole fence or a run of blank lines.
    """
    runs = r"(?m)(^```[^\n]*$(?s:.*?)(?:^```[^\n]*$|\z))|(^[ \t]*\n)[ \t\n]*\n"
    text = F.regexp_replace(F.concat("text", F.lit("\n")), runs, "$1$2")
    return docs.select("doc_id", F.left(text, F.length(text) - 1).alias("text"))


def carry_forward(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not null, here or above."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(so_far()))


#: Heading titles that change what follows them, and into what.
REGIMES = {
    "references": "references|bibliography|works cited",
    "glossary": "glossary|terminology",
    "notes": "notes|endnotes",
    "index": "index|subject index",
    "contents": "contents|table of contents",
    "front": "preface|foreword|acknowledge?ments?",
    "body": r"(?:chapter|part) .*|introduction|\d+(?:\.\d+)* .*",
}


def regime_of(title: Column) -> Column:
    """The regime that a heading opens; null if it opens none."""
    out, low = None, F.lower(T.squeeze(title))
    for name, pattern in REGIMES.items():
        hit = low.rlike(f"^(?:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
