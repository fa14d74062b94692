"""What a line or a value says: names, places, headings, sizes, pages, JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import damaged, spaced_glyphs, squeeze

#: What an institution, a place and a venue are known by.
AFFILIATION = (
    r"\b(University|Institute|Department|Dept\.?|Laboratory|Lab\b|College|School of|Research|Center|Centre|Google|Microsoft|DeepMind|OpenAI|Meta AI|IBM|Inc\.|Ltd\.|Corporation)\b"
    r"|\b[A-Z][a-z]+,\s+[A-Z]{2}\s+\d{5}\b|\bUSA\b|\bUK\b"
)
PLACE = (
    r"\b(New York|Cambridge|London|Boston|Seattle|Berkeley|Stanford|Paris|Berlin|Tokyo|Beijing|Toronto|Montreal|Zurich|Oxford|Pittsburgh|Chicago|Los Angeles"
    r"|San Francisco|Washington|Amsterdam|Edinburgh|Vancouver|Sydney|Melbourne)\b"
)
NOT_PERSON = r"(?i)(Press|University|Inc\b|Ltd\b|LLC|Publish|Media|Books|Corporation|Edition|Cambridge|London|New York|Massachusetts|England|Oxford)"
#: Labels of a paper's front block that are no affiliation.
FRONT_LABEL = r"(?i)^\s*(?:(?:author |index )?keywords|acm classification|general terms|categories and subject descriptors|copyright is held|permission to make digital|[A-K]\d?\.\d)"
#: What a copyright page's line is kept, and dropped, for.
COPYRIGHT_KEEP = (
    r"(?i)(©|\(c\)\s*\d{4}|^copyright\b|\bISBN\b|^DOI:|\b(First|Second|Third|Fourth|Fifth)\s+(Edition|Printing|Release)\b"
    r"|^\s*97[89][\-\s]?\d[\d\-\s]{9,15}[\dX]\s*$|^(First|Second|Third|Fourth|Fifth|\d+(st|nd|rd|th))\s+(published|edition|paperback|printing)"
    r"|^(Published|Reprinted|Printed)\b|^\d{4}\s*©)"
)
COPYRIGHT_NOISE = (
    r"(?i)(\bfloor\b|\bplaza\b|\broad\b|\bstreet\b|\bhouse\b|www\.|https?://|\s\|\s|^\s*(names|title|description|identifiers|subjects|classification|lc)\s*:"
    r"|cataloging|catalogue record|permission|responsibility|accuracy|statutory|licensing|\bmission\b)"
)
#: Names of the fields of a standard document.
FIELD = (
    r"(?i)^\s*(Author|Authors|Owner|Status|Version|Date|Last updated|Updated|To|From|Subject|Re|CC|Reviewers?|Approvers?|Team|Stakeholders|Document type|Doc type"
    r"|Created|Due|Priority|Ticket|Project|Feature)\b\s*:?\s*(.*)$"
)
_KEY_VALUE = r"^\s*([A-Z][A-Za-z ]{1,20})\s*:\s*(\S.*)$"
_NAME = r"^(?:[A-Z][a-z'’\-]+|[A-Z]\.)(?:\s+(?:[A-Z][a-z'’\-]+|[A-Z]\.|(?:de|van|von|der|da|di|la|le))){1,3}$"
_AUTHOR = r"^\p{L}[\p{L}'’\-]+(\s+\p{L}\.)*(\s+(?:van|von|de|der|da|di|la|le))?\s+\p{L}[\p{L}'’\-]+$"
_EMAIL = r"[\p{L}\p{N}_.\-+]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+|\{[\p{L}\p{N}_., \-]+\}@[\p{L}\p{N}_.\-]+"
_MARKS = r"[\x{2020}\x{2021}\x{A7}\x{B6}*\x{2217}\x{2660}-\x{2667}\x{B9}\x{B2}\x{B3}\x{2070}-\x{2079}]+"


def _stripped(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")


def people(text: Column) -> Column:
    """The persons of a copyright or author line, in order, each once."""
    c = F.regexp_replace(text, r"^.*?©\s*(?:\d{4})?\s*", "")
    c = F.regexp_replace(c, r"\s*\b(19|20)\d{2}\b.*$", "")
    c = F.get(F.split(c, r"(?<=[a-z][a-z])\.\s+[A-Z]|(?<=[a-z][a-z])\.$"), F.lit(0))
    c = F.regexp_replace(c, r"(?i)\bAll rights reserved\b.*$", "")
    parts = F.transform(F.split(c, r"\s*,\s*(?:and\s+|&\s*)?|\s+(?:and|&)\s+"), lambda p: _stripped(p, r" ."))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(_NAME) & ~p.rlike(NOT_PERSON)))


def paper_authors(text: Column) -> Column:
    """The authors of a line of a paper's front block: no marks, numbers, addresses, places or institutions."""
    c = F.regexp_replace(F.regexp_replace(text, _EMAIL, ""), _MARKS, "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+\d+(,\d+)*\b", ""), r"(?<=[A-Za-z])\d+(,\d+)*", "")
    parts = F.transform(F.split(c, r"\s*,\s*(?:and\s+)?|\s+and\s+"), lambda p: _stripped(p, r" ,.;"))
    return F.filter(parts, lambda p: p.rlike(_AUTHOR) & p.rlike(r"^\p{Lu}") & ~p.rlike(AFFILIATION) & ~p.rlike(PLACE))


def is_affiliation(text: Column) -> Column:
    """Whether a line says where somebody works: it names an institution or place, or is short and no sentence."""
    c = F.trim(text)
    return (c != "") & ~c.rlike(FRONT_LABEL) & (c.rlike(AFFILIATION) | c.rlike(PLACE) | ((F.length(c) <= 45) & ~c.rlike("[.;]$")))


def heading_shape(text: Column) -> Column:
    """Whether a line's text may be a heading: real words, few of other signs, no sentence, no formula."""
    c = F.trim(text)
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    greek = c.rlike(r"\p{IsGreek}") & c.rlike(r"^[\p{L}\s\-:,'.()]+$") & F.forall(words, lambda w: F.length(w) >= 3)
    math = c.rlike(r"[=<>\x{2264}\x{2265}\x{B1}\x{B7}\x{D7}\x{2192}\x{21A6}\x{2208}\x{2211}\x{220F}\x{221A}\x{2202}\x{2207}\x{3C0}\x{3B8}\x{3B3}\x{3B1}\x{3B2}\x{3BB}\x{3BC}]|^_")
    allowed = F.regexp_count(c, F.lit(r"[\p{L}\p{N}\p{M} \-:,'.&/*?!()\[\]、，：（）「」]"))
    asian = r"[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{20000}-\x{3134F}]"
    real = F.filter(words, lambda w: F.regexp_count(w, F.lit(r"\p{L}")) >= F.when(w.rlike(asian), 2).otherwise(3))
    letters = F.regexp_replace(F.get(real, F.lit(0)), r"\P{L}", "")
    cased = F.lower(letters) == F.upper(letters)
    one = (F.size(words) > 1) | cased | (letters == F.upper(letters)) | letters.rlike(r"^\p{Lu}\p{Ll}+$")
    shape = (
        (F.length(c) >= 3)
        & ~c.rlike("(?i)^[ivxlcdm]+$")
        & ~c.rlike(r"^[\x{2022}\x{25AA}\x{25CF}\x{B7}\x{2023}\-\x{2013}\x{2014}]")
        & ~(c.rlike("[.,;]$") & (F.size(words) > 6))
        & (F.length(c) <= 80)
        & (~math | greek)
        & (allowed >= 0.9 * F.length(c))
        & (F.size(real) > 0)
        & (2 * F.size(real) >= F.size(words))
        & one
    )
    return c.rlike(r"^\d{1,2}(\.\d{1,2}){0,3}\.?$") | c.rlike(r"(?i)^(Chapter|Part|Appendix)\b") | F.coalesce(shape, F.lit(False))


def _numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1))


def repair_refusal(original: Column, candidate: Column, confidence: Column) -> Column:
    """Why a recognised text may not stand for a damaged one; null if it may.

    Only damage may change: intact words stay, in order, and so do numbers.
    """
    before = F.filter(F.split(original, r"\s+"), lambda t: t != "")
    after = F.filter(F.split(candidate, r"\s+"), lambda t: t != "")
    intact = F.filter(before, lambda t: damaged(t) == 0)
    # Each intact word is looked for behind the one before; -1 once one is missing.
    found = F.aggregate(
        intact,
        F.lit(0),
        lambda at, t: F.when(at < 0, at).otherwise(
            F.coalesce(F.get(F.filter(F.transform(after, lambda w, i: F.when((i >= at) & (w == t), i + 1)), lambda x: x.isNotNull()), F.lit(0)), F.lit(-1))
        ),
    )
    share = F.length(candidate) / F.greatest(F.length(original), F.lit(1))
    return (
        F.when((F.trim(candidate) == "") | (damaged(candidate) > 0), "empty or damaged")
        .when(confidence < 80, "low confidence")
        .when(F.trim(original) == "", F.lit(None))
        .when(damaged(original) == 0, "nothing damaged")
        .when(~share.between(0.5, 2), "length changed")
        .when(F.exists(before, lambda t: (damaged(t) > 0) & ~t.rlike(r"[\p{L}\p{N}]")), "a symbol alone")
        .when(found < 0, "intact words changed")
        .when(_numbers(original) != _numbers(candidate), "numbers changed")
    )


def page_spec(spec: Column, n: Column) -> Column:
    """Pages, from 0, that a spec such as 44-120 or 1,5,9 names, each once; null if it is malformed or names none."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    good = F.forall(parts, lambda p: p.rlike(r"^(\d+|(\d+)\s*-\s*(\d+))$"))
    spans = F.transform(
        parts,
        lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("low"), F.regexp_extract(p, r"(\d+)$", 1).try_cast("int").alias("high")),
    )
    forward = F.forall(spans, lambda s: s["low"] <= s["high"])
    within = F.filter(F.transform(spans, lambda s: F.struct(F.greatest(s["low"], F.lit(1)).alias("low"), F.least(s["high"], n).alias("high"))), lambda s: s["low"] <= s["high"])
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(within, lambda s: F.sequence(s["low"] - 1, s["high"] - 1)))))
    whole = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    return F.when(F.coalesce(F.trim(spec), F.lit("")) == "", whole).when(good & forward & (F.size(pages) > 0), pages)


def ratio(text: Column) -> Column:
    """A share from 0 to 1; null for anything else."""
    value = F.trim(text).try_cast("double")
    return F.when(value.between(0.0, 1.0), value)


def size_text(size: Column) -> Column:
    """Bytes in the largest binary unit that they fill."""
    out = None
    for unit, by in (("TiB", 1 << 40), ("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10)):
        told = F.concat(F.format_string("%.2f", size / by), F.lit(f" {unit}"))
        out = F.when(size >= by, told) if out is None else out.when(size >= by, told)
    return out.otherwise(F.concat(size.cast("string"), F.lit(" bytes")))


def name_convention(stem: Column) -> Column:
    """``author, title`` of a file named ``author#title`` or ``author#title#2``; null if it is not."""
    pattern = r"^([^#]+)#([^#]+?)(?:#\d+)?$"
    parts = [F.trim(F.replace(F.regexp_extract(stem, pattern, k), F.lit("_"), F.lit(" "))).alias(n) for k, n in ((1, "author"), (2, "title"))]
    return F.when(stem.rlike(pattern), F.struct(*parts))


def best_title(inferred: Column, metadata: Column, stem: Column) -> Column:
    """The inferred title, or where it is plainly damaged the metadata's, or the file's name."""
    n_words = F.size(F.filter(F.split(inferred, r"\s+"), lambda w: w != ""))
    bad = (F.coalesce(inferred, F.lit("")) == "") | (F.length(inferred) > 240) | (spaced_glyphs(inferred) >= 4) | (n_words > 35)
    usable = F.length(metadata).between(3, 180) & ~metadata.rlike(r"(?i)^(untitled|document|microsoft word)$")
    named = F.trim(F.translate(stem, "_-", "  "))
    return F.when(bad & usable, metadata).when(bad & (named != ""), named).otherwise(inferred)


def copyright_kept(text: Column) -> Column:
    """Whether a line of a copyright page is a bibliographic fact and not an address or legal text."""
    c = F.trim(text)
    return c.rlike(COPYRIGHT_KEEP) & ~c.rlike(COPYRIGHT_NOISE) & (F.length(c) < 140)


def isbns(text: Column) -> Column:
    """ISBN numbers, digits alone, sorted, each once."""
    found = F.regexp_extract_all(text, F.lit(r"(\b97[89][\-\s]?\d{1,5}[\-\s]?\d{1,7}[\-\s]?\d{1,7}[\-\s]?[\dX]\b)"), F.lit(1))
    bare = F.transform(found, lambda x: F.regexp_replace(x, "[^0-9X]", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: F.length(x).between(10, 13))))


def copyright_year(text: Column) -> Column:
    """The latest year after a copyright sign; null without."""
    found = F.regexp_extract_all(text, F.lit(r"©\s*(?:[^0-9]{0,60})?(\d{4})"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.cast("int")))


def field_line(text: Column) -> Column:
    """``key, value`` of a line such as ``Status: draft``; null if it is none, an empty value where the next cell has it."""
    c = F.trim(text)
    pair = c.rlike(_KEY_VALUE)
    key = F.when(pair, F.regexp_extract(c, _KEY_VALUE, 1)).otherwise(F.regexp_extract(c, FIELD, 1))
    value = F.when(pair, F.regexp_extract(c, _KEY_VALUE, 2)).otherwise(F.regexp_extract(c, FIELD, 2))
    return F.when(pair | c.rlike(FIELD), F.struct(F.initcap(F.lower(F.trim(key))).alias("key"), F.trim(value).alias("value")))


def number_tokens(c: Column) -> Column:
    """The numbers of a text, with sign and percent, sorted: a multiset to compare by equality."""
    return F.array_sort(F.regexp_extract_all(c, F.lit(r"([-+]?\d[\d,.]*(?:%|\b))"), F.lit(1)))


_TABLE = "headers array<string>, rows array<array<string>>, notes array<string>"


def table_json(raw: Column) -> Column:
    """The table of a model's answer: its last JSON object, prose before it left out; null unless it is whole.

    Headers are there, rows are as wide as they, and nothing follows.
    """
    c = F.regexp_replace(F.trim(raw), r"\s*```$", "")
    starts = F.filter(F.transform(F.split(c, ""), lambda ch, i: F.when(ch == "{", i + 1)), lambda x: x.isNotNull())
    tried = F.transform(starts, lambda s: F.from_json(F.substr(c, s), _TABLE, {"mode": "PERMISSIVE"}))
    whole = F.filter(tried, lambda t: t["headers"].isNotNull() & t["rows"].isNotNull())
    table = F.get(whole, F.lit(0))
    fair = (F.size(table["headers"]) > 0) & (F.size(table["rows"]) > 0) & F.forall(table["rows"], lambda r: F.size(r) == F.size(table["headers"]))
    return F.when(c.endswith("}") & fair, table)


_EVIDENCE = "summary string, visual_type string, elements array<struct<kind:string,label:string,observation:string,certainty:string,bbox:array<double>>>, uncertainties array<string>"


def figure_evidence(raw: Column) -> Column:
    """``visual_type, elements, uncertainties`` of a figure model's JSON answer, cleaned and bounded; null for prose.

    Eight elements and uncertainties at most; an element without an
    observation goes, and so does a box that is none within 0 to 1.
    """
    v = F.from_json(F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*|\s*```$", ""), _EVIDENCE)

    def clean(x: Column, most: int) -> Column:
        return F.left(squeeze(F.coalesce(x, F.lit(""))), F.lit(most))

    def element(e: Column) -> Column:
        box, sure = e["bbox"], F.lower(F.coalesce(e["certainty"], F.lit("uncertain")))
        inside = (F.size(box) == 4) & F.forall(box, lambda p: p.between(0.0, 1.0)) & (F.get(box, F.lit(0)) < F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) < F.get(box, F.lit(3)))
        return F.struct(
            clean(F.coalesce(e["kind"], F.lit("element")), 32).alias("kind"),
            clean(e["label"], 100).alias("label"),
            clean(e["observation"], 320).alias("observation"),
            F.when(inside, box).alias("bbox"),
            F.when(sure.isin("direct", "approximate", "uncertain"), sure).otherwise("uncertain").alias("certainty"),
        )

    elements = F.filter(F.transform(F.slice(F.coalesce(v["elements"], F.array().cast("array<struct<kind:string,label:string,observation:string,certainty:string,bbox:array<double>>>")), 1, 8), element), lambda e: e["observation"] != "")
    notes = F.slice(F.filter(F.transform(F.coalesce(v["uncertainties"], F.array().cast("array<string>")), lambda n: clean(n, 180)), lambda n: n != ""), 1, 8)
    said = v["summary"].isNotNull() | v["visual_type"].isNotNull() | v["elements"].isNotNull() | v["uncertainties"].isNotNull()
    return F.when(said, F.struct(clean(v["visual_type"], 100).alias("visual_type"), elements.alias("elements"), notes.alias("uncertainties")))


def page_box(box: Column, crop: Column) -> Column:
    """A box within a crop (0 to 1) in the page's points, to hundredths."""
    at = [F.get(crop, F.lit(k)) for k in range(4)]
    return F.transform(box, lambda p, i: F.round(F.when(i % 2 == 0, at[0] + p * (at[2] - at[0])).otherwise(at[1] + p * (at[3] - at[1])), 2))


def table_html(grid: Column, header_rows: Column) -> Column:
    """An HTML table of rows of ``struct<text, rowspan, colspan>``, header cells in the first rows."""

    def escaped(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def cell(x: Column, tag: Column) -> Column:
        return F.concat(F.lit("<"), tag, F.lit(' rowspan="'), x["rowspan"].cast("string"), F.lit('" colspan="'), x["colspan"].cast("string"), F.lit('">'), escaped(x["text"]), F.lit("</"), tag, F.lit(">"))

    def row(r: Column, i: Column) -> Column:
        tag = F.when(i < header_rows, "th").otherwise("td")
        return F.concat(F.lit("<tr>\n"), F.array_join(F.transform(r, lambda x: cell(x, tag)), "\n"), F.lit("\n</tr>"))

    return F.concat(F.lit("<table>\n"), F.array_join(F.transform(grid, row), "\n"), F.lit("\n</table>"))
