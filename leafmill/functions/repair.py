"""Repair of extracted text, and the case of titles, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ligature characters, and what stands in their slots by the font's class.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
TEXT_GLYPHS = {"↵": "ff", "⇤": "*", "⇥": "x"}
MATH_GLYPHS = {"⇡": "π", "✓": "θ", "⇤": "*", "⇥": "×", "⇝": "→", "↵": "α"}
#: Accents set before their letter, and the combining marks they mean.
ACCENTS = {"¯": "̄", "ˆ": "̂", "˜": "̃", "˙": "̇", "ˊ": "́", "ˋ": "̀"}
#: Fonts by class, and families known by name.
MATH_FONTS = "(?i)CM(MI|SY|EX|MIB|BSY)|MSAM|MSBM|EUSM|EUFM"
LAYOUT_FONTS = "(?i)CMEX"
SYMBOL_FONTS = ("Symbol", "SymbolMT")
FAMILIES = ("Helvetica", "Times", "Arial", "Courier", "Symbol", "GillSans", "MSAM", "MSBM", "EUSM")
#: Words that a title keeps small.
SMALL_WORDS = ("a", "an", "the", "and", "or", "but", "of", "for", "to", "in", "on", "at", "by", "with", "from", "as", "nor", "vs", "via")
_PRIVATE = r"[\x{E000}-\x{F8FF}]"
_WORD = r"[A-Za-z][A-Za-z'’\-]*"
_CAPS = r"^[A-Z][A-Z'’\-]*[A-Z]$"


def _each(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda out, kv: F.replace(out, F.lit(kv[0]), F.lit(kv[1])), table.items(), c)


def base_font(font: Column) -> Column:
    """The font's name without a subset's prefix."""
    return F.substring_index(font, "+", -1)


def font_class(font: Column) -> Column:
    """``math`` for fonts of symbols, else ``text``."""
    return F.when(base_font(font).rlike(MATH_FONTS), "math").otherwise("text")


def font_family(font: Column) -> Column:
    """The family of a font: CM for its many cuts, known names, else what stands before a dash, comma or digit."""
    base = base_font(font)
    out = F.when(F.upper(base).startswith("CM"), "CM")
    for name in FAMILIES:
        out = out.when(F.lower(base).startswith(name.lower()), name)
    head = F.regexp_extract(base, r"^([^\-,\d]*)", 1)
    return out.when(head != "", head).otherwise(base)


def repair_span(text: Column, font: Column, keep_private: bool = False) -> Column:
    """A span's text with its font's slots read right; delimiters of layout fonts are a space.

    A private-use character that leads is a bullet; others go, unless they are
    kept as evidence.
    """
    c = F.when(base_font(font).isin(*SYMBOL_FONTS), F.replace(text, F.lit(""), F.lit("•"))).otherwise(text)
    c = F.when(font_class(font) == "math", _each(c, LIGATURES | MATH_GLYPHS)).otherwise(_each(c, LIGATURES | TEXT_GLYPHS))
    c = F.regexp_replace(c, r"[\x{0}-\x{8}\x{B}\x{E}-\x{1F}\x{7F}-\x{9F}\x{200B}-\x{200D}\x{FEFF}]", "")
    c = F.regexp_replace(c, r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " ")
    if not keep_private:
        c = F.regexp_replace(F.regexp_replace(c, rf"^(\s*){_PRIVATE}", "$1•"), _PRIVATE, "")
    return F.when(font.rlike(LAYOUT_FONTS), " ").otherwise(c)


@F.pandas_udf(StringType())  # a type object: its name would need a session
def nfc(texts: pd.Series) -> pd.Series:
    """Spark has no Unicode normalisation of its own; batches of Arrow strings."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def repair_line_parts(text: Column) -> Column:
    """``repair_line`` before its characters are composed."""
    c = reduce(lambda out, kv: F.regexp_replace(out, rf"{kv[0]}\s*([A-Za-z])", f"$1{kv[1]}"), ACCENTS.items(), text)
    c = F.regexp_replace(c, r"c\x{20DD}|\(c\)(?=\s*\d{4})", "©")
    c = F.regexp_replace(F.replace(c, F.lit("7!"), F.lit("↦")), r"(?<=[\p{L}\p{N}_])\x{AD}\s*(?=[\p{L}\p{N}_])", "")
    c = F.regexp_replace(c, r"(?<=[^ \t])[ \t]+", " ")
    open_, shut = r"<latexit[^>]*>", "</latexit>"
    one = F.when(c.rlike(f"^{open_}"), F.regexp_replace(c, f"^{open_}", ""))
    one = one.when(c.contains(shut), F.regexp_replace(c, f"^.*?{shut}", "")).otherwise(F.regexp_replace(c, f"^(.*?){open_}", "$1"))
    c = F.when(c.contains("latexit"), F.trim(one)).otherwise(c)
    return F.when(F.trim(c).rlike(r"^[A-Za-z0-9+/]{40,}={0,2}$"), "").otherwise(c)


def repair_line(text: Column) -> Column:
    """A line after its spans are joined: accents on their letters, marks whole, blanks single, debris gone."""
    return nfc(repair_line_parts(text))


def _titled(word: Column, first: Column, acronyms: Column) -> Column:
    low, stem = F.lower(word), F.left(word, F.length(word) - 1)
    parts = F.transform(F.split(low, r"(?<=[\-'’])"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2))))
    return (
        F.when(F.array_contains(acronyms, word), word)
        .when((F.length(word) > 2) & F.lower(F.right(word, F.lit(1))).eqNullSafe("s") & F.array_contains(acronyms, stem), F.concat(stem, F.lit("s")))
        .when(word.rlike("^[IVXLCDM]+$"), word)
        .when(~first & low.isin(*SMALL_WORDS), low)
        .otherwise(F.array_join(parts, ""))
    )


def smart_case(text: Column, acronyms: Column) -> Column:
    """Shouted titles in title case; of a mixed line only a leading run of capital words.

    Acronyms (an array), their plurals, roman numbers and words with digits stay.
    """
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    letters, upper = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    tokens = F.split(text, " ")

    def word_of(t: Column) -> Column:
        return F.regexp_extract(t, f"({_WORD})", 1)

    def told(t: Column, i: Column) -> Column:
        lead, word = F.regexp_extract(t, "^([^A-Za-z]*)", 1), word_of(t)
        rest = F.substr(t, F.length(lead) + F.length(word) + 1)
        return F.when(word == "", t).otherwise(F.concat(lead, _titled(word, i == 0, acronyms), rest))

    shouted = F.transform(tokens, lambda t: word_of(t).rlike(_CAPS) | word_of(t).rlike("^[A-Z]$"))
    stop = F.array_position(shouted, F.lit(False))
    run = F.when(stop == 0, F.size(tokens)).otherwise(stop - 1).cast("int")
    head = F.slice(tokens, 1, run)
    mixed = (run >= 2) & F.exists(head, lambda t: F.length(word_of(t)) >= 3)
    partly = F.transform(tokens, lambda t, i: F.when(i < run, told(t, i)).otherwise(t))
    return (
        F.when(letters < 4, text)
        .when((upper >= 0.9 * letters) & (F.size(words) >= 2), F.array_join(F.transform(tokens, told), " "))
        .when(mixed, F.array_join(partly, " "))
        .otherwise(text)
    )


def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin blocks with a mark, and the same without, by decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def file_slug(text: Column, most: int = 90) -> Column:
    """A file's name for a title: letters without marks, ``and`` for &, dashes, at most ``most`` characters."""
    c = F.regexp_replace(F.translate(_each(text, LIGATURES), *_plain_letters()), r"\p{M}", "")
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_\s\-]", " ")
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"[\s_]+", "-"), "-{2,}", "-")
    return F.regexp_replace(F.left(F.regexp_replace(c, "^-+|-+$", ""), F.lit(most)), "-+$", "")


def note_label(page: Column, number: Column) -> Column:
    """A note's label, its own in the whole document: numbers begin anew on every page."""
    return F.concat(F.lit("p"), (page + 1).cast("string"), F.lit("-"), number)


def link_notes(text: Column, page: Column, notes: Column) -> Column:
    """Numbers glued to a word or its mark as anchors, where the page (``notes``, an array) has that note."""
    marked = F.regexp_replace(text, r"(?<=[A-Za-z.,;:)\]\"”’])(?<!\d[.,])(\d{1,2})(?=\s|$)", "\u0001$1\u0001")
    parts = F.split(marked, "\u0001")
    linked = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & F.array_contains(notes, x), F.concat(F.lit("[^"), note_label(page, x), F.lit("]"))).otherwise(x))
    return F.array_join(linked, "")
