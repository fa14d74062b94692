"""Checks of Markdown documents: what looks damaged, how badly, and where.

A document is one row and stays one: every check is a pattern counted over its
text, or over the text with code fences folded to one line, so nothing is
exploded or shuffled before the checks that fired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.lines import split_lines

#: How much each check weighs.
PRIORITY = {
    "replacement_chars": 5,
    "private_use_chars": 5,
    "broken_text_layer": 5,
    "unclosed_fence": 4,
    "broken_image_link": 4,
    "corrupt_title_spacing": 4,
    "implausible_title_length": 4,
    "corrupt_subtitle_spacing": 3,
    "implausible_subtitle_length": 3,
    "heading_jump": 2,
    "duplicate_heading": 2,
    "standalone_page_number": 2,
    "possible_broken_hyphen": 2,
    "malformed_table": 2,
    "excess_blank_lines": 1,
    "trailing_whitespace": 1,
    "short_prose_fragment": 1,
}
CELLS = r"\|"


#: A code fence from its first mark to its last, or to the text's end.
FENCE = r"(?dms)^[ \t]*```[^\n]*$.*?(?:^[ \t]*```[^\n]*$|\z)"
_HEADING = r"(?dm)^(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*$"


def folded(c: Column) -> Column:
    """The text with each code fence as one line of three backticks."""
    return F.when(c.contains("```"), F.regexp_replace(c, FENCE, "```")).otherwise(c)


def count_of(c: Column, pattern: str, *marks: str) -> Column:
    """How often a pattern occurs, looked for only in texts with one of ``marks``, which each match needs."""
    found = F.regexp_count(c, F.lit(pattern))
    if not marks:
        return found
    any_of = c.contains(marks[0])
    for mark in marks[1:]:
        any_of = any_of | c.contains(mark)
    return F.when(any_of, found).otherwise(F.when(c.isNotNull(), 0))


def jumps(levels: Column) -> Column:
    """Headings more than one level below the one before."""
    return F.size(F.filter(F.transform(levels, lambda x, i: (i > 0) & (x > F.get(levels, i - 1) + 1)), lambda x: x))


def often(titles: Column, least: int = 4) -> Column:
    """Different titles that occur ``least`` times or more; references and notes may."""
    told = F.array_sort(F.filter(titles, lambda t: ~t.isin("references", "notes")))
    first = F.transform(told, lambda t, i: ((i == 0) | (F.get(told, i - 1) != t)) & F.get(told, i + least - 1).eqNullSafe(t))
    return F.size(F.filter(first, lambda x: x))


def uneven_rows(plain: Column) -> Column:
    """Rows of pipe tables with another number of cells than most rows of their table.

    A table ends at a line that is no row; one that the text or a fence ends is not judged.
    """
    runs = F.regexp_extract_all(plain, F.lit(r"(?dm)^(\|(?:[^\n]*\|)?\n(?s:.*?))^(?!\|(?:[^\n]*\|)?$)(?!```)"), F.lit(1))

    def uneven(run: Column) -> Column:
        cells = F.array_sort(F.transform(F.filter(split_lines(run), lambda r: r != ""), lambda r: F.length(r) - F.length(F.replace(r, F.lit("|"), F.lit(""))) - 1))
        most = F.array_max(F.transform(F.array_distinct(cells), lambda n: F.size(F.filter(cells, lambda m: m == n))))
        return F.size(cells) - most

    return F.aggregate(F.transform(runs, uneven), F.lit(0), lambda x, y: x + y)


def image_targets(plain: Column) -> Column:
    """The local files that a text's images name, percent signs decoded."""
    found = F.regexp_extract_all(plain, F.lit(r"!\[[^\]\n]*\]\(([^)\n]+)\)"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)), lambda t: ~t.contains("://"))


def exploded(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``doc_id, check, n``: a row for each check that fires in a document, with how often.

    ``files`` has the paths (``doc_id, path``) that image links may name; without
    it links are not checked.  A null text has no row.  Checks and images come
    from one pass; what is shuffled is checks that fired and paths of images.
    """
    docs = docs.where("text is not null").select("doc_id", F.regexp_replace("text", r"\n\z", "").alias("text"))
    rows = docs.select("doc_id", "text", folded(F.col("text")).alias("plain"))
    c, plain = F.col("text"), F.col("plain")
    rows = rows.withColumn("levels", F.transform(F.regexp_extract_all(plain, F.lit(_HEADING), F.lit(1)), F.length))
    rows = rows.withColumn("titles", F.transform(F.regexp_extract_all(plain, F.lit(_HEADING), F.lit(2)), F.lower))
    body = folded(F.regexp_replace(c, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", ""))
    rows = rows.withColumn("prose", F.regexp_replace(body, r"(?dm)^```$\n?", ""))
    rows = rows.withColumn("told", F.filter(split_lines(plain), lambda x: (F.trim(x) != "") & ~x.rlike(r"^(#|>|[-*+] |\d+[.)] |\||```)") & x.rlike("[A-Za-z]")))
    rows = rows.withColumn("n_prose", F.size("told")).withColumn("short", F.size(F.filter("told", lambda x: (F.length(F.trim(x)) < 45) & ~F.rtrim(x).rlike("[.!?:;]$"))))
    prose, ascii_words = F.col("prose"), count_of(F.col("prose"), "[A-Za-z]{3,}")
    letters = F.length(F.regexp_replace(prose, "[^A-Za-z]+", ""))
    judged = (F.length(prose) >= 2000) & (letters >= 0.4 * F.length(prose)) & (ascii_words >= 200)
    broken = judged & ((prose.rlike("[A-Za-z]{25}") & (T.long_letters(prose) > 0.06 * T.word_letters(prose))) | ((ascii_words >= 300) & (T.mute_words(prose) > 0.15 * ascii_words)))
    checks = {
        "replacement_chars": count_of(c, r"(?dm)^.*\x{FFFD}.*$", "\ufffd"),
        "private_use_chars": F.when(c.rlike(r"[\x{E000}-\x{F8FF}]"), count_of(c, r"(?dm)^.*[\x{E000}-\x{F8FF}].*$")).otherwise(0),
        "unclosed_fence": count_of(c, r"(?dm)^[ \t]*```", "```") % 2,
        "heading_jump": jumps(F.col("levels")),
        "duplicate_heading": often(F.col("titles")),
        "standalone_page_number": count_of(plain, r"(?dm)^[ \t]*\d{1,4}[ \t]*$"),
        "broken_text_layer": broken.cast("int"),
        "possible_broken_hyphen": count_of(plain, r"(?dm)[A-Za-zÀ-ÖØ-öø-ÿ]-$(?=\n[a-zà-öø-ÿ])", "-\n"),
        "excess_blank_lines": count_of(plain, r"(?dm)^[ \t]*\n[ \t]*(?:\n|(?<=[ \t])\z)[ \t\n]*"),
        "trailing_whitespace": count_of(plain, r"(?dm)(?<! ) $|\t$"),
        "short_prose_fragment": ((F.col("n_prose") >= 20) & (F.col("short") > 0.22 * F.col("n_prose"))).cast("int"),
        "malformed_table": uneven_rows(plain),
    }
    for name, most in (("title", 240), ("subtitle", 300)):
        value = T.yaml_field(c, name)
        checks[f"corrupt_{name}_spacing"] = (T.spaced_glyphs(value) >= 4).cast("int")
        checks[f"implausible_{name}_length"] = ((F.length(value) > most) | (T.words(value) > 40)).cast("int")
    fired = F.array(*[F.struct(F.lit(k).alias("check"), v.cast("int").alias("n"), F.lit(None).cast("string").alias("path")) for k, v in checks.items()])
    if files is None:
        return rows.select("doc_id", F.inline(fired)).where("n > 0").select("doc_id", "check", "n")
    images = F.transform(image_targets(plain), lambda t: F.struct(F.lit("broken_image_link").alias("check"), F.lit(1).alias("n"), t.alias("path")))
    found = rows.select("doc_id", F.inline(F.concat(fired, images))).where("n > 0")
    # A check has no path, so it meets no file and stays.
    lost = found.join(files.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_anti")
    return lost.groupBy("doc_id", "check").agg(F.sum("n").cast("int").alias("n"))


def issues(found: DataFrame) -> DataFrame:
    """``doc_id, issues``: the checks of a document as one map."""
    pairs = F.array_sort(F.collect_list(F.struct("check", "n")))
    return found.groupBy("doc_id").agg(F.map_from_entries(pairs).alias("issues"))


def scores(found: DataFrame, most: int = 10) -> DataFrame:
    """``doc_id, score``: each check's priority times its count, of which ``most`` count."""
    weights = F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])
    return found.groupBy("doc_id").agg(F.sum(F.element_at(weights, F.col("check")) * F.least("n", F.lit(most))).cast("int").alias("score"))


def totals(found: DataFrame) -> DataFrame:
    """Over all documents: how often each check fires, and in how many."""
    return found.groupBy("check").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


def worst(scored: DataFrame, top: int = 50) -> DataFrame:
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(top).select("doc_id", "score")


def evaluate(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds ``passed`` to ``checks`` (``doc_id, kind, texts, level, count``).

    Kinds: contains, absent and count look for the first text; order for all in
    turn, none reused, case aside; heading for a title, of ``level`` if given;
    table_row for cells.  A check of no known document is not passed.
    """
    first, body = F.get("texts", F.lit(0)), F.coalesce("text", F.lit(""))
    times = (F.length(body) - F.length(F.replace(body, first, F.lit("")))) / F.length(first)
    order = F.expr("aggregate(texts, struct(1 as at, true as ok), (a, p) -> struct(cast(locate(lower(p), lower(coalesce(text, '')), a.at) + length(p) as int) as at, a.ok and locate(lower(p), lower(coalesce(text, '')), a.at) > 0 as ok), a -> a.ok)")
    lines = split_lines(body)
    heading = F.exists(lines, lambda x: x.rlike("^#{1,6} ") & (F.lower(F.trim(F.regexp_replace(x, "^#+ +", ""))) == F.lower(first)) & (F.col("level").isNull() | (F.length(F.regexp_extract(x, "^(#+)", 1)) == F.col("level"))))
    cells = F.exists(lines, lambda x: F.trim(x).startswith("|") & (F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), CELLS), lambda c: F.trim(c)) == F.col("texts")))
    passed = F.when(F.col("kind") == "contains", body.contains(first)).when(F.col("kind") == "absent", ~body.contains(first)).when(F.col("kind") == "count", times == F.col("count")).when(F.col("kind") == "order", order).when(F.col("kind") == "heading", heading).when(F.col("kind") == "table_row", cells)
    joined = checks.join(docs.select("doc_id", "text"), "doc_id", "left")
    return joined.select(*checks.columns, F.coalesce(passed & F.col("text").isNotNull(), F.lit(False)).alias("passed"))
