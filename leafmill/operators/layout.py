"""Pages of positioned lines: what a document's type and white space say.

``lines``: doc_id, seq, page, text, x0, y0, x1, y1, size, font, is_bold, is_mono.
Points, y growing downward.  Statistics of a document are aggregations joined
back to its lines; rules that look at the line above are windows by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.functions import shapes
from leafmill.functions import text as T
from leafmill.functions.repair import font_family
from leafmill.operators.aggregates import first_mode
from leafmill.operators.lines import split_lines


def in_page() -> WindowSpec:
    return Window.partitionBy("doc_id", "page", "col").orderBy("y0", "seq")


def set_pages(docs: DataFrame, rows: int = 20, height: float = 800.0) -> DataFrame:
    """Documents laid out on pages of two columns, with a running head and a number on each.

    Where a corpus has texts but no geometry, this gives the layout operators
    what they need, by rule.
    """
    body = docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("seq", "text"))
    slot = F.col("seq") % rows
    col = F.floor(F.col("seq") / rows).cast("int") % 2
    head = slot == 0
    placed = body.select(
        "doc_id",
        "seq",
        F.floor(F.col("seq") / (2 * rows)).cast("int").alias("page"),
        "text",
        (50.0 + 270 * col).alias("x0"),
        (100.0 + 16 * slot).alias("y0"),
        (260.0 + 270 * col).alias("x1"),
        (111.0 + 16 * slot).alias("y1"),
        F.when(head, 16.0).otherwise(11.0).alias("size"),
        F.when(head, "Display").otherwise("Text").alias("font"),
        head.alias("is_bold"),
        F.lit(False).alias("is_mono"),
    )
    pages = placed.groupBy("doc_id", "page").agg(F.max("seq").alias("last"))
    extra = {"x1": 260.0, "size": 9.0, "font": "Text", "is_bold": False, "is_mono": False, "x0": 50.0}
    marks = pages.select(
        "doc_id",
        "page",
        F.explode(F.array(F.struct((-1 - 2 * F.col("page")).alias("seq"), F.concat(F.lit("Report "), F.col("doc_id").cast("string")).alias("text"), F.lit(25.0).alias("y0"), F.lit(34.0).alias("y1")), F.struct((-2 - 2 * F.col("page")).alias("seq"), (F.col("page") + 1).cast("string").alias("text"), F.lit(height - 29).alias("y0"), F.lit(height - 20).alias("y1")))).alias("m"),
    ).select("doc_id", "page", "m.*", *[F.lit(v).alias(k) for k, v in extra.items()])
    return placed.unionByName(marks.select(*placed.columns))


def body_style(lines: DataFrame) -> DataFrame:
    """``doc_id, font, size, chars``: the style that most characters have."""
    styled = lines.withColumn("style", F.struct("font", F.bround("size", 1).alias("size")))
    return first_mode(styled, ["doc_id"], "style", F.length("text"), "seq").select("doc_id", "style.font", "style.size", F.col("weight").alias("chars"))


def body_margin(lines: DataFrame, body: DataFrame) -> DataFrame:
    """``doc_id, margin``: the left edge, in whole points, that most body lines have."""
    own = lines.withColumn("size", F.bround("size", 1)).join(body.select("doc_id", "font", "size"), ["doc_id", "font", "size"], "left_semi")
    return first_mode(own.withColumn("margin", F.bround("x0")), ["doc_id"], "margin", F.lit(1), "seq").select("doc_id", "margin")


def running_heads(lines: DataFrame, height: float = 800.0, least: int = 3, share: float = 0.02) -> DataFrame:
    """``doc_id, key``: texts, numbers aside, in the head or foot band of enough different pages."""
    pages = lines.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
    band = lines.where((F.col("y1") < 0.10 * height) | (F.col("y0") > 0.94 * height)).select("doc_id", "page", band_key().alias("key"))
    found = band.distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    return found.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("doc_id", "key")


def band_key() -> Column:
    return F.regexp_replace(T.squeeze(F.lower("text")), r"\d+", "#")


def without_furniture(lines: DataFrame, heads: DataFrame, height: float = 800.0) -> DataFrame:
    """Lines that are neither running heads nor page numbers alone in their band."""
    in_band = (F.col("y1") < 0.10 * height) | (F.col("y0") > 0.94 * height)
    keyed = lines.withColumn("key", band_key()).join(heads.withColumn("is_head", F.lit(True)), ["doc_id", "key"], "left")
    folio = F.col("text").rlike(r"^\s*(\d{1,4}|[ivxlc]{1,7})\s*$")
    return keyed.where(~(in_band & (F.coalesce("is_head", F.lit(False)) | folio))).drop("key", "is_head")


def columns(lines: DataFrame, width: float = 600.0) -> DataFrame:
    """Adds ``col``: 0 and 1 on pages set in two columns, -1 for full-width lines, 0 elsewhere.

    A page has two columns when it has twelve lines or more, half of them or
    more narrow, and either side of the middle has three or more that stay on it.
    """
    middle = width / 2
    narrow = F.col("x1") - F.col("x0") <= 0.55 * width
    page = Window.partitionBy("doc_id", "page")

    def share(test):
        return F.sum(test.cast("int")).over(page)

    left, right = narrow & (F.col("x1") <= middle), narrow & (F.col("x0") >= middle)
    n = F.count("*").over(page)
    split = (n >= 12) & (2 * share(narrow) >= n) & (share(left) >= F.greatest(F.lit(3.0), 0.12 * n)) & (share(right) >= F.greatest(F.lit(3.0), 0.12 * n))
    return lines.withColumn("col", F.when(~split, 0).when(left, 0).when(right, 1).otherwise(-1))


def reading_order(placed: DataFrame) -> DataFrame:
    """Adds ``place``: down each column of a band, bands parted by full-width lines."""
    down = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "seq")
    wide = (F.col("col") == -1).cast("int")
    band = F.sum(wide).over(down.rowsBetween(Window.unboundedPreceding, 0))
    order = Window.partitionBy("doc_id").orderBy("page", "_band", F.when(F.col("col") == -1, -1).otherwise(F.col("col")), F.bround(F.col("y0") / 3), "x0", "seq")
    return placed.withColumn("_band", band).withColumn("place", F.row_number().over(order) - 1).drop("_band")


def line_pitch(placed: DataFrame, height: float = 800.0) -> DataFrame:
    """``doc_id, pitch``: the median step from line to line in a column."""
    step = F.col("y0") - F.lag("y0").over(in_page())
    return placed.withColumn("step", step).where((F.col("step") > 0) & (F.col("step") < 0.2 * height)).groupBy("doc_id").agg(F.percentile("step", F.lit(0.5)).alias("pitch"))


def isolated(placed: DataFrame, pitch: DataFrame) -> DataFrame:
    """Adds ``isolated``: first in its column, or more than 1.35 pitches below the line above."""
    step = F.col("y0") - F.lag("y0").over(in_page())
    return placed.join(pitch, "doc_id", "left").withColumn("isolated", F.coalesce(step > 1.35 * F.coalesce("pitch", F.lit(12.0)), F.lit(True))).drop("pitch")


def heading_styles(lines: DataFrame, body: DataFrame, least: int = 3) -> DataFrame:
    """``doc_id, font, size, n, level``: styles larger or bolder than the body, in short lines, by size."""
    styles = lines.withColumn("size", F.bround("size", 1)).groupBy("doc_id", "font", "size").agg(F.count("*").alias("n"), F.avg(F.col("is_bold").cast("int")).alias("bold"), F.percentile(F.length("text"), F.lit(0.5)).alias("long"), F.countDistinct("page").alias("pages"))
    kept = styles.join(body.select("doc_id", F.col("size").alias("body"), F.col("font").alias("body_font")), "doc_id").where((F.col("n") >= least) & ((F.col("size") > F.col("body") + 0.6) | ((F.col("bold") > 0.5) & (F.col("font") != F.col("body_font")))) & (F.col("long") <= 90))
    return kept.withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).where("level <= 6").select("doc_id", "font", "size", "n", "level")


def dense_headings(heads: DataFrame, around: int = 15, most: int = 4) -> DataFrame:
    """Adds ``dense``: more than ``most`` candidates within ``around`` lines are no headings."""
    near = Window.partitionBy("doc_id", "page", "col").orderBy("seq").rangeBetween(-around, around)
    return heads.withColumn("dense", F.count("*").over(near) > most)


#: What a line says about the kind of document.
ABSTRACT = r"(?i)^\s*abstract\b"
ARXIV = r"(?i)arXiv:\s*\d{4}\.\d{4,5}"
KIND_MARKS = {
    "paper": r"(?i)^\s*(keywords|index terms)\s*[:—-]|^\s*related work\s*$|^\s*\d?\.?\s*references\s*$|^\s*acknowledg(e)?ments\s*$|proceedings of|conference on|journal of",
    "book": r"(?i)\bISBN\b|all rights reserved|library of congress|cataloging-in-publication|printed in (the )?[A-Z]|first published|\bedition\b",
    "document": (
        r"(?i)product requirements|\bPRD\b|requirements document|design doc|technical design|\bRFC\b|\bmemo(randum)?\b|specification|proposal|revision history"
        r"|status\s*:\s*(draft|final|review|approved)|^\s*version\s*:?\s*\d|^\s*author\s*:|^\s*reviewers?\s*:|last updated|^\s*owner\s*:|^\s*to\s*:\s+\S|^\s*from\s*:\s+\S"
    ),
    "deck": r"(?i)^\s*agenda\s*$|^\s*thank you!?\s*$|^\s*questions\??\s*$|^\s*q\s*&\s*a\s*$|^\s*confidential\b|^\s*slide\s+\d+|^\s*\d{1,3}\s*/\s*\d{1,3}\s*$",
}
CHAPTER = r"(?i)^\s*chapter\s+\d+"
LEADER = r"(?:\.\s?){4,}"
BULLET = r"^\s*[•▪●◦‣⁃∙·\-–*]\s+\S"
FORM = (
    r"(?i)\bForm\s+[0-9]{3,4}[A-Z\-]*\b|OMB No\.|Department of the Treasury|Internal Revenue Service|See (separate )?instructions|Attach to|Your (first|last) name"
    r"|Social security number|Signature of|Date signed|[\x{2610}\x{2611}\x{2612}\x{25A1}\x{25A0}]|Check (one|all that apply)|For Paperwork Reduction"
)
BOXES = r"[\x{2610}\x{2611}\x{2612}]"
#: Sizes of screens, and what programs make which kind.
SCREENS = ((960, 540), (720, 540), (1024, 768), (720, 405), (1920, 1080), (1280, 720), (1280, 800), (1440, 900))
PRODUCERS = (
    ("deck", 4, r"(?i)powerpoint|keynote|impress|beamer|google slides|slides"),
    ("document", 2, r"(?i)\bword\b|writer|google docs|pages\b|notion|confluence"),
    ("book", 2, r"(?i)indesign|quark|affinity|scribus|blurb|lightroom"),
    ("paper", 1, r"(?i)latex|pdftex|xetex|luatex|dvips"),
    ("book", 1, r"(?i)latex|pdftex|xetex|luatex|dvips"),
)


def kind_scores(lines: DataFrame, body: DataFrame, width: float = 600.0, height: float = 800.0, about: DataFrame | None = None) -> DataFrame:
    """``doc_id, kind, confidence, scores``: what kind of document its pages add up to.

    Points come from the page's shape, the number of pages, how dense they are,
    where their titles stand, marks in the text, two-column pages and the
    program that made the file (``about``: doc_id, producer).  Of equals
    document comes before paper, book and deck.
    """
    c = F.col
    down = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "seq")
    rows = lines.join(body.select("doc_id", c("size").alias("body")), "doc_id").withColumn("_n", F.row_number().over(down)).withColumn("_all", F.count("*").over(Window.partitionBy("doc_id")))
    text, front = c("text"), c("page") <= 2
    form = text.rlike(FORM) & text.rlike("[A-Za-z]{3,}") & ~text.rlike(rf"^\s*[\x{{2610}}\x{{2611}}\x{{2612}}\x{{25A1}}\x{{25A0}}]")
    flags = {
        "bullets": text.rlike(BULLET),
        "abstract": (c("page") == 0) & (c("_n") <= 60) & text.rlike(ABSTRACT),
        "arxiv": front & text.rlike(ARXIV),
        "paper": text.rlike(KIND_MARKS["paper"]),
        "book_front": front & text.rlike(KIND_MARKS["book"]),
        "book_end": (c("_n") > c("_all") - 200) & text.rlike(KIND_MARKS["book"]),
        "chapters": text.rlike(CHAPTER) & (c("size") >= 1.3 * c("body")),
        "document": front & text.rlike(KIND_MARKS["document"]),
        "forms": form,
        "boxes": text.rlike(BOXES),
        "deck": text.rlike(KIND_MARKS["deck"]),
        "cover": c("page") == 0,
    }
    by_line = rows.groupBy("doc_id").agg(*[F.sum(v.cast("int")).alias(k) for k, v in flags.items()], F.count("*").alias("lines"), F.max("body").alias("body"), F.max(F.when(c("page") == 0, c("size"))).alias("big"))
    first = F.max_by(F.struct("y0", "size"), F.struct(c("size"), (-c("_n")).alias("early"))).alias("top")
    pages = rows.groupBy("doc_id", "page").agg(
        first,
        F.max("body").alias("body"),
        F.sum(T.words(text)).alias("words"),
        F.count("*").alias("n"),
        F.sum(text.rlike(LEADER).cast("int")).alias("leaders"),
        F.sum((c("x1") - c("x0") < 0.5 * width).cast("int")).alias("narrow"),
        F.sum((c("x0") > width / 2 + 5).cast("int")).alias("right"),
    )
    split = (c("n") >= 12) & (c("narrow") >= 0.6 * c("n")) & (c("right") >= 0.25 * c("n"))
    by_page = pages.groupBy("doc_id").agg(F.count("*").alias("used"), (F.max("page") + 1).alias("pages"), F.percentile("words", F.lit(0.5)).alias("dense"), F.sum(split.cast("int")).alias("split"), F.sum((c("leaders") >= 4).cast("int")).alias("leaders"))
    places = pages.where("top.size >= 1.25 * body").groupBy("doc_id", F.bround(c("top.y0") / 15).alias("at"), F.bround(c("top.size")).alias("size")).agg(F.count("*").alias("k"))
    titles = places.groupBy("doc_id").agg(F.sum("k").alias("titled"), F.reverse(F.array_sort(F.collect_list("k"))).alias("ks"))
    doc = by_page.join(by_line, "doc_id").join(titles, "doc_id", "left")
    producer = F.lit("")
    if about is not None:
        doc, producer = doc.join(about.select("doc_id", "producer"), "doc_id", "left"), F.coalesce("producer", F.lit(""))
    screen = any(abs(width - w) <= 2 and abs(height - h) <= 2 for w, h in SCREENS)
    wide = width / height > 1.2 and not screen
    shape = 4 if screen else (2 if any(abs(width / height - r) < 0.03 for r in (16 / 9, 4 / 3, 1.6)) else 1) if wide else 0
    n, dense, used = c("pages"), c("dense"), c("used")
    enough = (c("titled") >= 4) & (c("titled") >= 0.5 * used)
    top1, top2 = F.get("ks", F.lit(0)), F.get("ks", F.lit(0)) + F.coalesce(F.get("ks", F.lit(1)), F.lit(0))
    forms = c("forms") + (c("boxes") > 0).cast("int")

    def points(test: Column, k: int) -> Column:
        return F.when(test, k).otherwise(0)

    made = {k: sum((points(producer.rlike(p), by) for kind, by, p in PRODUCERS if kind == k), F.lit(0)) for k in ("document", "paper", "book", "deck")}
    scores = {
        "document": points(n <= 3, 2) + points((n > 3) & (n <= 25), 1) + points((dense >= 100) & (dense < 250), 1) + points(c("bullets") > 0.25 * c("lines"), 1) + F.least(F.lit(5), 2 * c("document")) + points(forms >= 3, 1) * F.least(F.lit(5), forms),
        "paper": points((n > 3) & (n <= 60), 1) + points(dense >= 250, 1) + points(c("abstract") > 0, 4) + points(c("arxiv") > 0, 4) + points(c("paper") >= 2, 1) + points((c("split") >= 2) & (c("split") >= 0.4 * used), 2),
        "book": points(n > 60, 3) + points(n > 150, 1) + points(dense >= 250, 1) + points(c("book_front") + c("book_end") >= 2, 3) + points(c("chapters") >= 2, 4) + points(c("leaders") > 0, 2) + points((n >= 30) & (c("cover") > 0) & (c("cover") <= 14) & (c("big") >= 2.2 * c("body")), 2),
        "deck": F.lit(shape) + points((n > 3) & (n <= 60), 1) + points(dense < 100, 1) + points((dense < 100) & (n >= 3), 2) + points(c("bullets") > 0.25 * c("lines"), 2) + F.when(enough & (top1 >= 0.6 * used), 4).when(enough & (top2 >= 0.7 * used), 3).otherwise(0) + F.least(F.lit(4), c("deck")),
    }
    table = F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), (v + made[k]).cast("int"))])
    scored = doc.select("doc_id", table.alias("scores"))
    ordered = F.reverse(F.array_sort(F.map_values("scores")))
    top, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    kind = F.get(F.filter(F.map_keys("scores"), lambda k: F.element_at("scores", k) == top), F.lit(0))
    return scored.select("doc_id", kind.alias("kind"), F.when(top + second == 0, 0.5).otherwise(F.round(top / (top + second), 6)).alias("confidence"), "scores")


def captions_to_boxes(captions: DataFrame, boxes: DataFrame, most: float) -> DataFrame:
    """Each caption with the nearest box above it on its page: they share x, at most ``most`` apart.

    Both are bounded by a page, which is the join's key.
    """
    b = boxes.select("doc_id", "page", F.col("box_id"), *[F.col(k).alias(f"box_{k}") for k in ("x0", "y0", "x1", "y1")])
    pairs = captions.join(b, ["doc_id", "page"]).where((F.col("x0") < F.col("box_x1")) & (F.col("box_x0") < F.col("x1"))).withColumn("gap", F.col("y0") - F.col("box_y1")).where(F.col("gap").between(0.0, most))
    near = F.min(F.struct("gap", "box_id")).alias("near")
    return pairs.groupBy("doc_id", "page", "seq").agg(near).select("doc_id", "page", "seq", "near.box_id", "near.gap")


def inside(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each line whose middle lies in a box of its page, with the least such box."""
    b = boxes.select("doc_id", "page", "box_id", *[F.col(k).alias(f"box_{k}") for k in ("x0", "y0", "x1", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = lines.join(b, ["doc_id", "page"]).where(x.between(F.col("box_x0"), F.col("box_x1")) & y.between(F.col("box_y0"), F.col("box_y1")))
    return hit.groupBy("doc_id", "seq").agg(F.min("box_id").alias("box_id"))


def tables(lines: DataFrame, pitch: float = 16.0, least_rows: int = 3, least_columns: int = 3) -> DataFrame:
    """``doc_id, page, table, rows, columns``: runs of lines' rows with several cells under one another.

    A row is what shares a baseline; a run ends where rows are further apart
    than two and a half pitches or have one cell.
    """
    rows = lines.groupBy("doc_id", "page", F.bround(F.col("y0") / 3).alias("band")).agg(F.countDistinct(F.bround("x0")).alias("cells"), F.min("y0").alias("y0"))
    down = Window.partitionBy("doc_id", "page").orderBy("band")
    opens = F.coalesce((F.col("y0") - F.lag("y0").over(down) > 2.5 * pitch) | (F.lag("cells").over(down) < 2), F.lit(True))
    runs = rows.withColumn("run", F.sum(opens.cast("int")).over(down)).where("cells >= 2")
    found = runs.groupBy("doc_id", "page", "run").agg(F.count("*").alias("rows"), F.max("cells").alias("columns")).where((F.col("rows") >= least_rows) & (F.col("columns") >= least_columns))
    return found.withColumn("table", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("run"))).drop("run")


def coverage(before: DataFrame, after: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: source lines kept, left out or lost, and why it needs a look.

    ``before``: doc_id, page, source.  ``after``: doc_id, source, role.  ``pages``:
    doc_id, page, n_images, damaged.
    """
    known = before.join(after, ["doc_id", "source"], "left")
    each = known.groupBy("doc_id", "page", "source").agg(F.max((F.col("role") == "text").cast("int")).alias("kept"), F.count("role").alias("uses"))
    sums = each.groupBy("doc_id", "page").agg(F.sum((F.coalesce("kept", F.lit(0)) == 1).cast("int")).alias("retained"), F.sum(((F.coalesce("kept", F.lit(0)) == 0) & (F.col("uses") > 0)).cast("int")).alias("suppressed"), F.sum((F.col("uses") == 0).cast("int")).alias("unaccounted"))
    rows = pages.join(sums, ["doc_id", "page"], "left").fillna(0, ["retained", "suppressed", "unaccounted"])
    reasons = F.array_compact(
        F.array(
            F.when(F.col("unaccounted") > 0, "unaccounted_lines"),
            F.when((F.col("n_images") > 0) & (F.col("retained") == 0), "images_without_text"),
            F.when(F.col("damaged") > 0, "damaged_characters"),
            F.when((F.col("retained") == 0) & (F.col("suppressed") > 0), "nothing_retained"),
        )
    )
    empty = (F.col("retained") + F.col("suppressed") + F.col("unaccounted") + F.col("n_images")) == 0
    return rows.select("doc_id", "page", "retained", "suppressed", "unaccounted", reasons.alias("reasons"), empty.alias("blank_candidate"))


def census(lines: DataFrame, column: str) -> DataFrame:
    """``doc_id, counts``: how many lines of each kind (or level, or regime) a document has, as a map."""
    each = lines.groupBy("doc_id", column).agg(F.count("*").alias("n"))
    return each.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("kind"), "n")))).alias("counts"))


def image_share(blocks: DataFrame) -> DataFrame:
    """``doc_id, share``: images among the blocks that hold anything; 0 without a block.

    ``blocks``: doc_id, kind, text, n_rows.
    """
    image = F.col("kind") == "image"
    full = image | (F.trim(F.coalesce("text", F.lit(""))) != "") | (F.coalesce("n_rows", F.lit(0)) > 0)
    return blocks.groupBy("doc_id").agg(F.coalesce(F.sum((full & image).cast("int")) / F.nullif(F.sum(full.cast("int")), F.lit(0)), F.lit(0.0)).alias("share"))


def dominant_pages(boxes: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, share``: of a document's pages those that images cover by ``least`` or more.

    ``boxes``: doc_id, page, box; ``pages``: doc_id, page, width, height.  Images
    that lie over one another count once.
    """
    covered = boxes.groupBy("doc_id", "page").agg(shapes.union_area(F.collect_list("box")).alias("area"))
    told = pages.join(covered, ["doc_id", "page"], "left").withColumn("full", F.coalesce(F.col("area") >= least * F.col("width") * F.col("height"), F.lit(False)))
    return told.groupBy("doc_id").agg(F.avg(F.col("full").cast("int")).alias("share"))


def continued(tables: DataFrame) -> DataFrame:
    """``doc_id, table_id, root``: each table with the one it goes on from, itself if none.

    ``tables``: doc_id, table_id, page, x0, y0, x1, cols, context, header (its header
    rows as one text).  A table goes on from the one before, in order of page
    and height, if its context says ``Table N ... continued`` and the root's
    names Table N, on the next page, with equal columns and header and edges
    within 8 points.
    """
    down = Window.partitionBy("doc_id").orderBy("page", "y0", "table_id")
    number = F.regexp_extract("context", r"(?i)\bTable\s+(\d+)\b", 1)
    goes_on = F.col("context").rlike(r"(?i)\bTable\s+\d+\b.*\bcontinued\b")

    def before(name: str) -> Column:
        return F.lag(name).over(down)

    rows = tables.withColumn("number", number)
    links = (
        goes_on
        & (F.col("page") == before("page") + 1)
        & (F.col("cols") == before("cols"))
        & (F.col("number") == before("number"))
        & (F.abs(F.col("x0") - before("x0")) <= 8)
        & (F.abs(F.col("x1") - before("x1")) <= 8)
        & (F.col("header") == before("header"))
    )
    rows = rows.withColumn("linked", F.coalesce(links, F.lit(False)))
    root = F.last(F.when(~F.col("linked"), F.col("table_id")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "table_id", root.alias("root"))


def near_context(tables: DataFrame, lines: DataFrame, above: float = 55.0, below: float = 45.0) -> DataFrame:
    """``doc_id, table_id, context``: lines over or under a table that share its width, from above."""
    t = tables.select("doc_id", "table_id", "page", *[F.col(k).alias(f"t_{k}") for k in ("x0", "y0", "x1", "y1")])
    pairs = lines.join(t, ["doc_id", "page"]).where((F.col("x0") < F.col("t_x1")) & (F.col("t_x0") < F.col("x1")))
    near = pairs.where((F.col("t_y0") - F.col("y1")).between(0.0, above) | (F.col("y0") - F.col("t_y1")).between(0.0, below))
    return near.groupBy("doc_id", "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", "text"))), lambda r: r["text"]), " ").alias("context"))


def repeated_margin_terms(lines: DataFrame, pitch: float, reach: float = 2.5) -> DataFrame:
    """``doc_id, seq``: short lines beside the text that only repeat a word of the body near them."""
    body = lines.where("not margin").select("doc_id", "page", F.col("y0").alias("b_y0"), F.lower("text").alias("b_text"))
    terms = lines.where("margin").where((F.trim("text") != "") & (F.length("text") <= 40))
    hit = terms.join(body, ["doc_id", "page"]).where((F.abs(F.col("b_y0") - F.col("y0")) <= reach * pitch) & F.col("b_text").contains(F.lower(F.trim("text"))))
    return hit.select("doc_id", "seq").distinct()


def apart_from(found: DataFrame, native: DataFrame) -> DataFrame:
    """Recognised boxes (doc_id, page, found_id, box) that lie over no native line's box."""
    over = found.join(native.select("doc_id", "page", F.col("box").alias("n_box")), ["doc_id", "page"]).where(shapes.overlap(F.col("box"), F.col("n_box")))
    return found.join(over.select("doc_id", "page", "found_id").distinct(), ["doc_id", "page", "found_id"], "left_anti")


def paired_heads(bands: DataFrame, heads: DataFrame) -> DataFrame:
    """Running heads and the rows that share their line on a page: a head and its page number are one."""
    rows = bands.join(heads, ["doc_id", "key"], "left_semi").select("doc_id", "page", F.bround(F.col("y0") / 3).alias("at"))
    beside = bands.withColumn("at", F.bround(F.col("y0") / 3)).join(rows.distinct(), ["doc_id", "page", "at"], "left_semi")
    return heads.unionByName(beside.select("doc_id", "key")).distinct()


def number_and_title(lines: DataFrame) -> DataFrame:
    """``doc_id, seq, level, title``: a bare section number at the margin with a short bold title on its line."""
    nxt = {k: F.lead(k).over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "seq")) for k in ("text", "x0", "y0", "is_bold")}
    bare = F.trim("text").rlike(r"^\d{1,2}(?:\.\d{1,2}){0,2}\.?$")
    rows = lines.withColumns({f"n_{k}": v for k, v in nxt.items()})
    hit = rows.where(bare & (F.abs(F.col("n_y0") - F.col("y0")) < 3) & (F.col("n_x0") > F.col("x1") - 2) & (F.col("is_bold") | F.col("n_is_bold")) & (F.length(F.trim("n_text")) <= 90))
    number = F.regexp_replace(F.trim("text"), r"\.$", "")
    return hit.select("doc_id", "seq", T.number_depth(number).alias("level"), F.concat_ws(" ", F.trim("text"), F.trim("n_text")).alias("title"))


def text_families(lines: DataFrame) -> DataFrame:
    """``doc_id, family, share``: font families that set a tenth of a document's characters or more."""
    sums = lines.groupBy("doc_id", font_family(F.col("font")).alias("family")).agg(F.sum(F.length("text")).alias("chars"))
    share = F.col("chars") / F.sum("chars").over(Window.partitionBy("doc_id"))
    return sums.withColumn("share", F.round(share, 6)).where("share >= 0.1").select("doc_id", "family", "share")


def size_tiers(lines: DataFrame, apart: float = 0.4, most: int = 6) -> DataFrame:
    """``doc_id, size, tier``: sizes from the largest on, a new tier where one is more than ``apart`` below its tier's head.

    The head of a tier is the first size of it, so the sizes (a few dozen) are
    folded in order.
    """
    sizes = lines.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_set(F.bround("size", 1)))).alias("sizes"))
    start = F.struct(F.lit(None).cast("double").alias("head"), F.lit(0).alias("tier"), F.array().cast("array<struct<size:double,tier:int>>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        fresh = acc["head"].isNull() | (acc["head"] - size > apart)
        tier = F.when(fresh, acc["tier"] + 1).otherwise(acc["tier"])
        return F.struct(F.when(fresh, size).otherwise(acc["head"]).alias("head"), tier.alias("tier"), F.concat(acc["out"], F.array(F.struct(size.alias("size"), tier.alias("tier")))).alias("out"))

    return sizes.select("doc_id", F.inline(F.aggregate("sizes", start, step, lambda acc: acc["out"]))).where(F.col("tier") <= most)
