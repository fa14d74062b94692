import io
import zipfile

import pytest

from leafmill.sources import containers, html

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def docx(body, **more):
    return archive(word__document_dot_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>", **more)


def para(text, style=""):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={style!r}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


EPUB = {
    "mimetype": "application/epub+zip",
    "META-INF__container_dot_xml": '<container><rootfiles><rootfile full-path="in/book.opf"/></rootfiles></container>',
    "in__book_dot_opf": '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>A Book</dc:title></metadata><manifest><item id="a" href="one.xhtml"/><item id="b" href="two.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
    "in__one_dot_xhtml": "<html><body><h1>One</h1><p>First text.</p></body></html>",
    "in__two_dot_xhtml": "<html><body><h1>Two</h1><ul><li>item<ol><li>inner</li></ol></li></ul></body></html>",
}


def shown(found):
    return [(b.kind, b.parts[0] if b.parts else b.rows) for b in found]


def test_html_blocks():
    page = """<html><head><title> A  title</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/x">x</a></nav>
    <div>loose <b>bold<p>after an open mark</p><h2>Head</h2><ul><li>one</li><li>two <em>three</em></li></ul><pre>a
  b</pre><blockquote>said</blockquote><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2 &amp; 3</td></tr></table><img src="p.png" alt="pic"><hr>end"""
    read = html.read(page)
    assert "".join(read.title).split() == ["A", "title"] and read.links == [("/x", "x")]
    assert shown(read.blocks) == [("para", "loose **bold**"), ("para", "after an open mark"), ("heading", "Head"), ("list_item", "one"), ("list_item", "two *three*"), ("code", "a\n  b"), ("quote", "said"), ("table", [["h", "i"], ["1", "2 & 3"]]), ("image", "pic"), ("hr", []) if False else ("hr", None), ("para", "end")]


def test_epub_and_docx():
    title, found = containers.epub(archive(**EPUB))
    assert title == "A Book"
    assert shown(found) == [("heading", "Two"), ("list_item", "item"), ("list_item", "inner"), ("heading", "One"), ("para", "First text.")]
    styles = f'<w:styles {W}><w:style w:styleId="T2"><w:name w:val="heading 2"/></w:style></w:styles>'
    table = "<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr>" + para("side") + "</w:tc><w:tc>" + para("a") + "</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc>" + para("b") + "</w:tc></w:tr></w:tbl>"
    formula = "<w:p><m:oMath><m:f><m:num><m:r><m:t>x</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath></w:p>"
    _, found = containers.docx(docx(para("Top", "T2") + para("body text") + formula + table, word__styles_dot_xml=styles))
    assert shown(found) == [("heading", "Top"), ("para", "body text"), ("para", "$\\frac{x}{2}$"), ("table", [["side", "a"], ["side", "b"]])]


@pytest.mark.parametrize(
    "content, name, kind, status",
    [
        (b"%PDF-1.7 x", "a.docx", "pdf", "ok"),
        (b"\xd0\xcf\x11\xe0", "a.doc", "doc", "unsupported"),
        (docx(para("x")), "a.pdf", "docx", "ok"),
        (archive(**EPUB), "noname", "epub", "ok"),
        (b"PK\x03\x04broken", "b.epub", "epub", "refused"),
        (b"{\\rtf1}", "", "rtf", "ok"),
        (b"<!DOCTYPE html><p>x", "", "html", "ok"),
        (b"plain\n\ntext", "a.txt", "txt", "ok"),
        (b"\0\1", "a.bin", "", "unsupported"),
        (archive(word__document_dot_xml="<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"), "", "docx", "refused"),
        (archive(word__document_dot_xml="<a>" * 300 + "</a>" * 300), "", "docx", "refused"),
    ],
)
def test_detection_and_refusal(content, name, kind, status):
    got = containers.read_file(content, name)
    assert got[:2] == (kind, status), got


def test_decoding():
    assert containers.decode("é".encode("utf-16")) == "é"
    assert containers.decode('<?xml encoding="latin-1"?>é'.encode("latin-1"))[-1] == "é"
    assert containers.decode(b"\x93quoted\x94") == "“quoted”"


def test_files_to_blocks_once_each(spark, tmp_path):
    from leafmill.streaming import ledger

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.html").write_text("<h1>A</h1><p>text")
    (source / "b.epub").write_bytes(archive(**EPUB))

    def go():
        ledger.convert_new(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out/blocks")), spark.read.parquet(str(tmp_path / "out/ledger"))

    blocks, rows = go()
    assert blocks.count() == 7 and {r.status for r in rows.collect()} == {"ok"}
    (source / "c.doc").write_bytes(b"\xd0\xcf\x11\xe0")
    blocks, rows = go()
    assert sorted(r.status for r in rows.collect()) == ["ok", "ok", "unsupported"] and blocks.count() == 8
    left = ledger.pending(rows.select("source"), rows).collect()
    assert [r.source.rpartition("/")[2] for r in left] == ["c.doc"]


def book(*chapters, **extra):
    """An EPUB of the named chapters."""
    names = [n for n, _ in chapters]
    items = "".join(f'<item id="i{k}" href="{n}"/>' for k, n in enumerate(names))
    spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(names)))
    package = f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title></metadata><manifest>{items}{extra.pop("items", "")}</manifest><spine {extra.pop("spine", "")}>{spine}</spine></package>'
    parts = EPUB | {"in__book_dot_opf": package} | {f"in__{n.replace('.', '_dot_')}": b for n, b in chapters} | extra
    return containers.epub(archive(**{k: v for k, v in parts.items() if not k.startswith(("in__one", "in__two"))}))[1]


def test_a_note_in_a_div_ends_with_it():
    found = shown(book(("c1.xhtml", '<h1>One</h1><p>FIRST</p><div class="footnote" id="fn1"><p>1. The note.</p></div><p>SECOND</p><h2>Two</h2><p>THIRD</p>')))
    assert found == [("heading", "One"), ("para", "FIRST"), ("footnote", "1. The note."), ("para", "SECOND"), ("heading", "Two"), ("para", "THIRD")]


def test_inline_contents_and_open_marks_lose_nothing():
    found = shown(book(("c1.xhtml", '<h1>C</h1><p>before</p><section epub:type="toc"><ol><li>a</li></ol></section><p>TAIL</p>')))
    assert ("para", "TAIL") in found
    found = shown(book(("c1.xhtml", '<h1>C</h1><p>Claim<a epub:type="noteref" href="#fn1"><b>1</a></p><p>SURVIVOR one</p><p>SURVIVOR two</p>')))
    assert found[1:] == [("para", "Claim[^1-fn1]"), ("para", "SURVIVOR one"), ("para", "SURVIVOR two")]


def test_notes_in_a_part_of_their_own():
    found = book(("c1.xhtml", '<h1>C</h1><p>A claim<a epub:type="noteref" href="notes.xhtml#fn1">1</a>.</p>'), ("notes.xhtml", '<section epub:type="endnotes"><ol><li id="fn1">The note body.</li></ol></section>'))
    assert found[1].parts == ["A claim[^2-fn1]."]
    assert [(b.kind, b.src, b.parts) for b in found[2:]] == [("footnote", "2-fn1", ["The note body."])]


def test_nested_tables_keep_all_cells():
    found = book(("c1.xhtml", "<table><tr><td>OUTERA</td><td><table><tr><td>INNER</td></tr></table></td></tr><tr><td>OUTERB</td><td>OUTERC</td></tr></table>"))
    assert [b.rows for b in found] == [[["OUTERA", "INNER"], ["OUTERB", "OUTERC"]]]


@pytest.mark.parametrize("form", ["nav", "ncx"])
def test_contents_name_parts_without_a_heading(form):
    nav = '<nav epub:type="toc"><ol><li><a href="c1.xhtml">Opening</a><ol><li><a href="c2.xhtml#x">Deeper</a></li></ol></li><li><a href="c3.xhtml">Chapter 3</a></li></ol></nav>'
    point = '<navPoint><navLabel><text>{}</text></navLabel><content src="{}"/>{}</navPoint>'
    ncx = "<ncx><navMap>" + point.format("Opening", "c1.xhtml", point.format("Deeper", "c2.xhtml#x", "")) + point.format("Chapter 3", "c3.xhtml", "") + "</navMap></ncx>"
    extra = {"items": '<item id="n" href="nav.xhtml" properties="nav"/>', "in__nav_dot_xhtml": nav} if form == "nav" else {"items": '<item id="n" href="toc.ncx"/>', "spine": 'toc="n"', "in__toc_dot_ncx": ncx}
    found = book(*((f"c{k}.xhtml", f"<p>text {k}</p>") for k in (1, 2, 3)), **extra)
    assert [(b.kind, b.level, b.parts[0]) for b in found] == [("heading", 1, "Opening"), ("para", 0, "text 1"), ("heading", 2, "Deeper"), ("para", 0, "text 2"), ("para", 0, "text 3")]


def test_style_sheets():
    css = ".a, p.b {font-size: 24px; font-weight: bold} .x{font-size:1.2.3pt} .c{font-size:1.5em;font-weight:400}"
    assert html.style_map(css) == {"a": (18.0, True), "b": (18.0, True), "x": (None, None), "c": (18.0, False)}


def test_notes_of_a_docx():
    mark = '<w:p><w:r><w:t>Claim</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:endnoteReference w:id="2"/></w:r></w:p>'
    notes = f"<w:footnotes {W}><w:footnote w:id='2'>{para('at the foot')}</w:footnote><w:footnote w:id='3'>{para('not cited')}</w:footnote></w:footnotes>"
    ends = f"<w:endnotes {W}><w:endnote w:id='2'>{para('at the end')}</w:endnote></w:endnotes>"
    _, found = containers.docx(docx(mark, word__footnotes_dot_xml=notes, word__endnotes_dot_xml=ends))
    assert [(b.kind, b.src, b.parts[0]) for b in found] == [("para", None, "Claim[^2][^e2]"), ("footnote", "2", "at the foot"), ("footnote", "e2", "at the end")]


def test_rtf_and_odt():
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\f0 Caf\'e9 \u8364? {\b bold}\par Second\tab line\par}"
    assert containers.rtf(rtf) == ["Café € bold", "Second line"]
    body = '<office:document-content xmlns:office="o" xmlns:text="t" xmlns:table="b"><office:body><office:text><text:h text:outline-level="2">Head</text:h><text:p>One<text:s/>two</text:p><text:list><text:list-item><text:p>item</text:p></text:list-item></text:list><table:table><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell></table:table-row></table:table></office:text></office:body></office:document-content>'
    title, found = containers.odt(archive(content_dot_xml=body))
    assert shown(found) == [("heading", "Head"), ("para", "One two"), ("list_item", "item"), ("table", [["a"]])] and found[0].level == 2
