"""Rules run over whole tables on hand-made cases, dealt to the rows by number.

Where a corpus has none of what a rule is for (broken glyphs, copyright lines,
model answers), each row of ``documents`` gets one case, and what the rule must
say of it was worked out by hand.  ``CASES`` holds, by query, the inputs of each
case and the outputs; the oracle knows the outputs only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import fields, repair, shapes
from leafmill.functions import text as T


class Cases(NamedTuple):
    rule: Callable[..., dict[str, Column]]
    outputs: dict[str, str]
    rows: list[tuple[tuple, tuple]]


_BROKEN = "A sen�ence with 12 words, of which one is damaged"
CASES: dict[str, Cases] = {
    "span_repairs": Cases(
        lambda text, font: {"repaired": repair.repair_span(text, font), "font_class": repair.font_class(font), "family": repair.font_family(font)},
        {"repaired": "varchar", "font_class": "varchar", "family": "varchar"},
        [
            (("di↵erent", "ABCDEF+CMR10"), ("different", "text", "CM")),
            (("↵ + ⇡", "CMMI10"), ("α + π", "math", "CM")),
            (("ﬁnd ﬄuent", "Times-Italic"), ("find ffluent", "text", "Times")),
            (("#(@", "CMEX10"), (" ", "math", "CM")),
            ((" item", "ABC+Symbol"), ("• item", "text", "Symbol")),
            (("   item ", "Minion-Regular"), ("  • item ", "text", "Minion")),
            (("a b​c\x01d", "Garamond3"), ("a bcd", "text", "Garamond")),
            (("⇤⇥", "Arial,Bold"), ("*x", "text", "Arial")),
        ],
    ),
    "line_repairs": Cases(
        lambda text: {"repaired": repair.repair_line(text)},
        {"repaired": "varchar"},
        [
            (("Josˊe and ¯R",), ("José and R̄",)),
            (("(c) 2019 by us",), ("© 2019 by us",)),
            (("How­ ever it is",), ("However it is",)),
            (("  3.2.\t Critical   Design",), ("  3.2. Critical Design",)),
            (("x 7! y",), ("x ↦ y",)),
            (('<latexit sha="AB">label',), ("label",)),
            (("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9w==",), ("",)),
            (("été",), ("été",)),
        ],
    ),
    "title_case": Cases(
        lambda text: {"cased": repair.smart_case(text, F.array(F.lit("EMA"), F.lit("RNN"), F.lit("PhD")))},
        {"cased": "varchar"},
        [
            (("THE COGNITIVE STRUCTURE OF EMOTIONS",), ("The Cognitive Structure of Emotions",)),
            (("GERALD L. CLORE is Professor",), ("Gerald L. Clore is Professor",)),
            (("A Quiet Heading stays",), ("A Quiet Heading stays",)),
            (("RNNS AND THE EMA IN PART IV",), ("RNNs and the EMA in Part IV",)),
            (("WELL-BEING AND O'BRIEN",), ("Well-Being and O'Brien",)),
            (("ABC",), ("ABC",)),
            (("NAMES: first",), ("NAMES: first",)),
        ],
    ),
    "file_slugs": Cases(
        lambda text: {"slug": repair.file_slug(text)},
        {"slug": "varchar"},
        [
            (("Résumé & Café: Part 2",), ("Resume-and-Cafe-Part-2",)),
            (("  a_b -- c  ",), ("a-b-c",)),
            (("x" * 95,), ("x" * 90,)),
            (("???",), ("",)),
        ],
    ),
    "note_links": Cases(
        lambda text, page, notes: {"linked": repair.link_notes(text, page.cast("int"), F.split(notes, ","))},
        {"linked": "varchar"},
        [
            (("methods.1 That is", "4", "1,2"), ("methods.[^p5-1] That is",)),
            (("methods.3 That is", "4", "1,2"), ("methods.3 That is",)),
            (("version 1.2 and word2", "0", "2"), ("version 1.2 and word[^p1-2]",)),
            (("(see there)2 and here1", "9", "1,2"), ("(see there)[^p10-2] and here[^p10-1]",)),
        ],
    ),
    "people_named": Cases(
        lambda text: {"names": F.array_join(fields.people(text), "|")},
        {"names": "varchar"},
        [
            (("Copyright © 2019 Jane Doe, John Q. Public and Anna de Vries",), ("Jane Doe|John Q. Public|Anna de Vries",)),
            (("Jane Doe & Oxford University Press",), ("Jane Doe",)),
            (("Jane Doe. All rights reserved",), ("Jane Doe",)),
            (("Ada Byron, Ada Byron 1999 London",), ("Ada Byron",)),
            (("no names here",), ("",)),
        ],
    ),
    "paper_authors": Cases(
        lambda text: {"authors": F.array_join(fields.paper_authors(text), "|"), "affiliation": fields.is_affiliation(text)},
        {"authors": "varchar", "affiliation": "boolean"},
        [
            (("Ada Byron†, Alan M. Turing1,2 and René van Dam",), ("Ada Byron|Alan M. Turing|René van Dam", False)),
            (("Department of Physics, University of X",), ("", True)),
            (("Keywords: birds, trees",), ("", False)),
            (("This is a sentence that drifted into the front block of the page.",), ("", False)),
            (("RWTH Aachen",), ("RWTH Aachen", True)),
        ],
    ),
    "heading_shapes": Cases(
        lambda text: {"shape": fields.heading_shape(text)},
        {"shape": "boolean"},
        [
            (("Methods",), (True,)),
            (("2.1",), (True,)),
            (("wDX",), (False,)),
            (("x = y + 1",), (False,)),
            (("Chapter 4",), (True,)),
            (("• a point",), (False,)),
            (("This one is a whole sentence, with a stop.",), (False,)),
            (("xii",), (False,)),
            (("Αρχή και τέλος",), (True,)),
            (("第一章 續論",), (True,)),
            (("a b c Word",), (False,)),
        ],
    ),
    "repair_gate": Cases(
        lambda before, after, sure: {"refusal": F.coalesce(fields.repair_refusal(before, after, sure.cast("double")), F.lit("accepted"))},
        {"refusal": "varchar"},
        [
            ((_BROKEN, _BROKEN.replace("�", "t"), "80"), ("accepted",)),
            ((_BROKEN, _BROKEN.replace("�", "t"), "79"), ("low confidence",)),
            ((_BROKEN, _BROKEN.replace("�", "t").replace("12", "13"), "90"), ("intact words changed",)),
            ((_BROKEN, "A sentence", "90"), ("length changed",)),
            (("a whole line", "a whole line", "90"), ("nothing damaged",)),
            (("a � line", "a b line", "90"), ("a symbol alone",)),
            (("", "found by eye", "95"), ("accepted",)),
            (("x", " ", "95"), ("empty or damaged",)),
            (("up 3.5� today", "up 3.6% today", "95"), ("numbers changed",)),
            (("one tw� two", "two one two", "95"), ("accepted",)),
        ],
    ),
    "page_specs": Cases(
        lambda spec, n: {"pages": F.coalesce(F.array_join(fields.page_spec(spec, n.cast("int")).cast("array<string>"), ","), F.lit("none"))},
        {"pages": "varchar"},
        [
            (("2-4", "10"), ("1,2,3",)),
            (("9-12,1,1", "10"), ("0,8,9",)),
            (("", "3"), ("0,1,2",)),
            (("4-2", "10"), ("none",)),
            (("x", "10"), ("none",)),
            (("11", "10"), ("none",)),
            ((" 3 , 5-5,", "10"), ("2,4",)),
        ],
    ),
    "size_texts": Cases(
        lambda text, n: {"bytes": T.size_bytes(text), "told": fields.size_text(n.cast("long")), "share": fields.ratio(text)},
        {"bytes": "bigint", "told": "varchar", "share": "double"},
        [
            (("20MB", "1023"), (20_000_000, "1023 bytes", None)),
            (("2 GiB", "1536"), (2 << 30, "1.50 KiB", None)),
            (("1", str(5 << 20)), (1, "5.00 MiB", 1.0)),
            (("0.6", str(3 << 40)), (None, "3.00 TiB", 0.6)),
            (("0", "0"), (None, "0 bytes", 0.0)),
            (("7kib", str(1 << 30)), (7168, "1.00 GiB", None)),
            (("-1", "1"), (None, "1 bytes", None)),
        ],
    ),
    "file_titles": Cases(
        lambda inferred, metadata, stem: {
            "title": fields.best_title(inferred, metadata, stem),
            "author": fields.name_convention(stem)["author"],
            "named": fields.name_convention(stem)["title"],
        },
        {"title": "varchar", "author": "varchar", "named": "varchar"},
        [
            (("A sound title", "Other", "file"), ("A sound title", None, None)),
            (("M E G A trends", "Mega Trends", "file"), ("Mega Trends", None, None)),
            (("", "Untitled", "my_file-name"), ("my file name", None, None)),
            (("word " * 36, "ab", "x_y"), ("x y", None, None)),
            (("", "", "Ada_Byron#On_Engines#2"), ("Ada Byron#On Engines#2", "Ada Byron", "On Engines")),
        ],
    ),
    "copyright_facts": Cases(
        lambda text: {"kept": fields.copyright_kept(text), "isbns": F.array_join(fields.isbns(text), "|"), "year": fields.copyright_year(text)},
        {"kept": "boolean", "isbns": "varchar", "year": "integer"},
        [
            (("© 2011, 2014 by Jane Doe",), (True, "", 2011)),
            (("ISBN 978-0-262-03924-6 (hardcover)",), (True, "9780262039246", None)),
            (("12 Main Street, © 1999",), (False, "", 1999)),
            (("Second Edition",), (True, "", None)),
            (("Title: Some words",), (False, "", None)),
            (("A plain sentence.",), (False, "", None)),
        ],
    ),
    "field_lines": Cases(
        lambda text: {"key": fields.field_line(text)["key"], "value": fields.field_line(text)["value"]},
        {"key": "varchar", "value": "varchar"},
        [
            (("Status: draft",), ("Status", "draft")),
            (("last updated 3 May",), ("Last Updated", "3 May")),
            (("Reviewers",), ("Reviewers", "")),
            (("Some Key : a value",), ("Some Key", "a value")),
            (("just a line of words",), (None, None)),
        ],
    ),
    "number_sets": Cases(
        lambda a, b: {"equal": fields.number_tokens(a) == fields.number_tokens(b)},
        {"equal": "boolean"},
        [
            (("1, 2.5 and -3%", "-3% then 2.5 and 1,"), (True,)),
            (("10 of 12", "12 of 12"), (False,)),
            (("no numbers", "none"), (True,)),
            (("7 7", "7"), (False,)),
        ],
    ),
    "model_tables": Cases(
        lambda raw: {"table": F.to_json(fields.table_json(raw))},
        {"table": "varchar"},
        [
            (('Here it is: {"headers": ["a", "b"], "rows": [["1", null]], "notes": []}',), ('{"headers":["a","b"],"rows":[["1",null]],"notes":[]}',)),
            (('```json\n{"headers": ["a"], "rows": [["1"], ["2"]]}\n```',), ('{"headers":["a"],"rows":[["1"],["2"]]}',)),
            (('{"headers": ["a", "b"], "rows": [["1"]]}',), (None,)),
            (('{"headers": ["a"], "rows": [["1"',), (None,)),
            (("no table",), (None,)),
        ],
    ),
    "figure_answers": Cases(
        lambda raw: {
            "kind": fields.figure_evidence(raw)["visual_type"],
            "seen": F.array_join(F.transform(fields.figure_evidence(raw)["elements"], lambda e: F.concat_ws("/", e["kind"], e["label"], e["observation"], e["certainty"], F.array_join(fields.page_box(e["bbox"], F.array(*map(F.lit, (10.0, 20.0, 110.0, 220.0)))).cast("array<string>"), " "))), "|"),
            "unclear": F.array_join(fields.figure_evidence(raw)["uncertainties"], "|"),
        },
        {"kind": "varchar", "seen": "varchar", "unclear": "varchar"},
        [
            (('{"summary": "s", "visual_type": " bar  chart ", "elements": [{"kind": "axis", "label": "x", "observation": "rises", "certainty": "Direct", "bbox": [0, 0, 0.5, 0.25]}], "uncertainties": ["small print"]}',), ("bar chart", "axis/x/rises/direct/10.0 20.0 60.0 70.0", "small print")),
            (('{"visual_type": "map", "elements": [{"observation": "a river", "bbox": [0.5, 0, 0.2, 1]}, {"kind": "k", "observation": " "}]}',), ("map", "element//a river/uncertain", "")),
            (("A plain caption.",), (None, None, None)),
        ],
    ),
    "visual_escapes": Cases(
        lambda text, page, number: {"escaped": T.escape_visual(text), "label": repair.note_label(page.cast("int"), number), "key": T.slide_key(text)},
        {"escaped": "varchar", "label": "varchar", "key": "varchar"},
        [
            (("a <b>  & *c*", "0", "3"), ("a &lt;b&gt; &amp; \\*c\\*", "p1-3", "a <b> & *c*")),
            ((" [x](y)_z ", "11", "12"), ("\\[x\\]\\(y\\)\\_z", "p12-12", "[x](y)_z")),
            (("Plain\tWords", "2", "*"), ("Plain Words", "p3-*", "plain words")),
            (("a-b.c", "2", "7"), ("a-b\\.c", "p3-7", "a-b.c")),
        ],
    ),
    "heading_tokens": Cases(
        lambda text: {"label": T.heading_parts(text)["label"], "number": T.heading_parts(text)["number"], "title": T.heading_parts(text)["title"]},
        {"label": "varchar", "number": "varchar", "title": "varchar"},
        [
            (("Chapter 3. Going Home",), ("Chapter", "3", "Going Home")),
            (("6.3.1 Results",), ("", "6.3.1", "Results")),
            (("Appendix A: Proofs",), ("Appendix", "A", "Proofs")),
            (("A simple algorithm",), ("", "", "A simple algorithm")),
            (("2019 Annual Review",), ("", "", "2019 Annual Review")),
            (("IV",), ("", "", "IV")),
            (("Part IV The End",), ("Part", "IV", "The End")),
            (("Note V said",), ("", "", "Note V said")),
            (("A.1 Details",), ("", "A.1", "Details")),
            (("Example 12: A bird",), ("Example", "12", "A bird")),
            (("Introduction",), ("", "", "Introduction")),
        ],
    ),
    "box_areas": Cases(
        lambda boxes: {"area": shapes.union_area(F.from_json(boxes, "array<array<double>>"))},
        {"area": "double"},
        [
            (("[[0,0,10,10]]",), (100.0,)),
            (("[[0,0,10,10],[5,5,15,15]]",), (175.0,)),
            (("[[0,0,10,10],[2,2,4,4],[0,0,10,10]]",), (100.0,)),
            (("[[0,0,1,1],[3,0,4,2],[3,1,5,2]]",), (4.0,)),
            (("[[0,0,4,0],[2,2,1,3]]",), (0.0,)),
            (("[]",), (0.0,)),
        ],
    ),
    "turned_boxes": Cases(
        lambda box, turn: {"box": F.array_join(shapes.turned(F.from_json(box, "array<double>"), turn.cast("int"), F.lit(600.0), F.lit(800.0)).cast("array<string>"), " ")},
        {"box": "varchar"},
        [
            (("[10,20,110,30]", "0"), ("10.0 20.0 110.0 30.0",)),
            (("[10,20,110,30]", "90"), ("770.0 10.0 780.0 110.0",)),
            (("[10,20,110,30]", "180"), ("490.0 770.0 590.0 780.0",)),
            (("[10,20,110,30]", "270"), ("20.0 490.0 30.0 590.0",)),
        ],
    ),
    "cell_spans": Cases(
        lambda xs, box: {"n": shapes.edges_within(F.from_json(xs, "array<double>"), F.from_json(box, "array<double>"))},
        {"n": "integer"},
        [
            (("[0,50,100,150]", "[0,100]"), (2,)),
            (("[0,50.4,50.2,100]", "[0,50]"), (1,)),
            (("[0,100]", "[0,100]"), (1,)),
            (("[]", "[0,1]"), (1,)),
        ],
    ),
}


def applied(name: str) -> Callable[[DataFrame], DataFrame]:
    """The query of one rule: ``doc_id`` and what the rule says of the row's case."""
    rule, outputs, rows = CASES[name]

    def run(docs: DataFrame) -> DataFrame:
        at = F.pmod(F.col("doc_id"), F.lit(len(rows))).cast("int")
        inputs = [F.get(F.array(*[F.lit(inputs[k]) for inputs, _ in rows]), at).alias(f"_{k}") for k in range(len(rows[0][0]))]
        told = docs.select("doc_id", *inputs)
        made = rule(*[F.col(f"_{k}") for k in range(len(inputs))])
        return told.select("doc_id", *[made[c].alias(c) for c in outputs])

    return run


def expected(name: str) -> str:
    """DuckDB SQL for what the rule must say."""
    _, outputs, rows = CASES[name]

    def literal(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v).lower() if isinstance(v, bool) else repr(v)

    values = ", ".join(f"({k}, {', '.join(map(literal, out))})" for k, (_, out) in enumerate(rows))
    columns = ", ".join(f'v."{c}"::{t} as "{c}"' for c, t in outputs.items())
    named = ", ".join(f'"{c}"' for c in outputs)
    return f"select doc_id, {columns} from documents join (values {values}) v(k, {named}) on doc_id % {len(rows)} = v.k"
