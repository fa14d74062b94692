"""Text rules as native column expressions.

Patterns are Java regular expressions.  Letters and digits are ``\\p{L}`` and
``\\p{N}``, so a word has the same meaning in every language.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\x0B\f\r]"
WORD = r"[\p{L}\p{N}_]+"
#: Values of the roman digits.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: What a size suffix multiplies by.
SIZE_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES + "+", " "))


def words(c: Column) -> Column:
    """How many runs of other than white space; an empty text has none."""
    return F.regexp_count(c, F.lit(r"[^ \t\n\x0B\f\r]+"))


def escape_markdown(c: Column) -> Column:
    """A line that would open a Markdown construct, made plain text."""
    lead = F.regexp_replace(c, r"^( *)(\* |[#>\-+|=]|```)", r"$1\\$2")
    return F.regexp_replace(lead, r"^( *\d{1,9})([.)])( |$)", r"$1\\$2$3")


def slugify(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ \t\n\x0B\f\r\-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[_ \t\n\x0B\f\r]+", "-"), r"^-+|-+$", "")


def title_key(c: Column) -> Column:
    """Ascii letters and digits of the lowered text: what titles are matched by."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slide_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def yaml_quote(c: Column) -> Column:
    """A YAML scalar, quoted where it is empty or has a special character."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    special = c.rlike(r"[:#\[\]{}&*!|>'\"%@`,?\\]|^[-\s]|\s$") | (c == "")
    return F.when(special, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(c)


def strip_yaml(c: Column) -> Column:
    """The text without a leading front matter block."""
    return F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", "")


def yaml_field(c: Column, name: str) -> Column:
    """The first ``name: value`` line's value, without quotes; empty if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?m)^{name}:[ \t]*(.*)$", 1), '^"|"$', ""))


def escape_visual(c: Column) -> Column:
    """Squeezed, HTML special characters as entities, Markdown marks backslashed."""
    html = F.replace(F.replace(F.replace(squeeze(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(html, r"([\\`*_{}\[\]()#+.!|])", r"\\$1")


def damaged(c: Column) -> Column:
    """Characters that a broken font left: U+FFFD and private use."""
    return F.regexp_count(c, F.lit(r"[\x{FFFD}\p{Co}]"))


def mend_damaged(c: Column) -> Column:
    """Damaged characters as spaces, squeezed; a leading one is a bullet."""
    lead = F.regexp_replace(c, r"^([ \t]*)\p{Co}[ \t]*", "$1• ")
    return F.rtrim(F.regexp_replace(F.regexp_replace(lead, r"[\x{FFFD}\p{Co}]+", " "), r"([^ ])  +", "$1 "))


def is_cjk(c: Column) -> Column:
    """Holds a Chinese or Japanese character; Korean joins with spaces and is none."""
    return c.rlike(r"[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{20000}-\x{3134F}]")


def continues(before: Column, after: Column) -> Column:
    """Whether a line reads on in the next: hyphen yes, sentence end no, else by how the next begins."""
    end, start = F.rtrim(before), F.ltrim(after)
    return (
        F.when(end.rlike(r"[-\x{00AD}]$"), True)
        .when(end.rlike("[.!?:;…][\"')\\]”’]*$") | (end == "") | (start == ""), False)
        .otherwise(start.rlike(r"^(\p{Ll}|\p{N}|[^\p{L}\p{N}])"))
    )


def roman_value(c: Column) -> Column:
    """A roman number's value; 0 for any other text."""
    each = F.transform(F.split(F.upper(c), ""), lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in ROMAN.items() for v in kv]), x), F.lit(0)))
    total = F.aggregate(
        F.reverse(each),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), v.alias("last")),
        lambda acc: acc["sum"],
    )
    return F.when(F.upper(c).rlike("^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (c != ""), total).otherwise(F.lit(0))


#: Labels that a roman number may follow, and roman numbers that count as one.
SPINE_LABELS = ("chapter", "part", "appendix", "section")
SPINE_ROMANS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
_HEADING = r"^\s*(?:([A-Z][a-zA-Z]{2,})\s+)?(\d{1,2}(?:\.\d{1,2}){0,3}|[A-H](?:\.\d{1,2}){0,2}|[IVX]{1,4})(?![A-Za-z0-9])[.:)]?\s*(.*)$"


def heading_parts(c: Column) -> Column:
    """``label, number, title`` of a heading line; label and number are empty where it has none.

    A roman number counts only after a label of the spine, a lone letter only
    after ``Appendix``; digits that go on are no section number.
    """
    text = F.trim(c)
    label, number, title = (F.regexp_extract(text, _HEADING, k) for k in (1, 2, 3))
    low = F.lower(label)
    roman = number.isin(*SPINE_ROMANS) & ~low.isin(*SPINE_LABELS)
    letter = number.rlike("^[A-H]$") & (low != "appendix")
    told = text.rlike(_HEADING) & ~roman & ~letter
    return F.struct(F.when(told, label).otherwise("").alias("label"), F.when(told, number).otherwise("").alias("number"), F.when(told, F.trim(title)).otherwise(text).alias("title"))


def number_depth(number: Column) -> Column:
    """Parts of a section number: 3 for 2.4.1, 0 for none."""
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


def size_bytes(c: Column) -> Column:
    """Bytes of a size such as 20MB, 2 GiB or 512; null if it is none or 0."""
    pattern = r"(?i)^\s*(\d+)\s*([kmgt]?i?b)?\s*$"
    number, unit = F.regexp_extract(c, pattern, 1).try_cast("long"), F.lower(F.regexp_extract(c, pattern, 2))
    by = F.element_at(F.create_map(*[F.lit(v) for kv in SIZE_UNITS.items() for v in (kv[0], kv[1])]), unit)
    return F.when(number > 0, number * by.cast("long"))


def first_year(c: Column) -> Column:
    """The first four digits as a year; null without."""
    return F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")


def broken_text(c: Column, least: int = 2000, n_words: int = 300, n_long: int = 200) -> Column:
    """Why a text layer is unreadable, or null: too few letters, words without vowels, words run together.

    Words are ASCII ones of three letters or more and say something only of
    texts that are ASCII letters by two fifths.
    """
    size = F.length(c)
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    n = F.regexp_count(c, F.lit("[A-Za-z]{3,}"))
    return (
        F.when(size < least, F.lit(None).cast("string"))
        .when(letters < 0.3 * size, "few letters")
        .when((F.regexp_count(c, F.lit("[A-Za-z]")) < 0.4 * size) | (n < n_long), F.lit(None))
        .when((n >= n_words) & (mute_words(c) > 0.15 * n), "words without vowels")
        .when(long_letters(c) > 0.06 * word_letters(c), "words run together")
    )


def mute_words(c: Column) -> Column:
    """ASCII words of three letters or more without a vowel."""
    return F.regexp_count(c, F.lit("(?i)(?<![a-z])[b-df-hj-np-tv-xz]{3,}(?![a-z])"))


def word_letters(c: Column) -> Column:
    """Letters in ASCII words of three letters or more."""
    return F.length(F.array_join(F.regexp_extract_all(c, F.lit("([A-Za-z]{3,})"), F.lit(1)), ""))


def long_letters(c: Column) -> Column:
    """Letters in ASCII words of more than 24."""
    return F.length(F.array_join(F.regexp_extract_all(c, F.lit("([A-Za-z]{25,})"), F.lit(1)), ""))


def spaced_glyphs(c: Column) -> Column:
    """ASCII letters and digits that stand alone: four or more in a title mean lost spacing."""
    return F.regexp_count(c, F.lit(r"(?<![\p{L}\p{N}_])[A-Za-z0-9](?![\p{L}\p{N}_])"))
