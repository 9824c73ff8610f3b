"""Readers, files, sinks and streams, on files made here."""

import io
import json
import zipfile
import zlib
from email.message import EmailMessage

import pytest

from textloom.errors import FileProcessingError, InvalidInputError, UnsupportedFileTypeError
from textloom.operators.documents import chunk_documents
from textloom.operators.registry import processors
from textloom.sources import files, readers, sinks
from textloom.sources.html import to_markdown
from textloom.sources.markup import latex_text, paper_text, rst_text, rtf_text
from textloom.streaming import stream_chunks, stream_file_chunks, write_chunks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>Of things</dc:title><dc:creator>Someone</dc:creator></cp:coreProperties>'


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    body = "".join(f"<w:p><w:pPr><w:pStyle w:val='{s}'/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in (("Heading1", "Head"), ("Normal", "x" * 3000), ("Normal", "y" * 2000)))
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v|w</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    image = "<w:p><w:r><w:drawing/></w:r></w:p>"
    return archive(**{"word/document.xml": f"<w:document {W}><w:body>{body}{table}{image}</w:body></w:document>", "docProps/core.xml": CORE})


def odt():
    return archive(**{"content.xml": '<o xmlns:text="t"><text:p>One <text:span>lost</text:span>kept</text:p><text:p> </text:p><text:p>Two</text:p></o>', "meta.xml": '<m xmlns:dc="d"><dc:title>T</dc:title><dc:creator>C</dc:creator></m>'})


def epub():
    package = '<package><metadata xmlns:dc="d"><dc:title>Book</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator></metadata><manifest><item id="1" href="one.html"/><item id="2" href="two.html"/></manifest><spine><itemref idref="2"/><itemref idref="1"/><itemref idref="9"/></spine></package>'
    return archive(**{"META-INF/container.xml": '<c><rootfile full-path="b/p.opf"/></c>', "b/p.opf": package, "b/one.html": "<html><body><p>One</p></body></html>", "b/two.html": "<h3>Two</h3>"})


def pptx():
    shape = lambda kind, text, level=0: f'<p:sp><p:nvPr><p:ph type="{kind}"/></p:nvPr><a:p><a:pPr lvl="{level}"/><a:r><a:t>{text}</a:t></a:r></a:p></p:sp>'
    series = "<c:ser><c:tx><c:pt idx='0'><c:v>Sales</c:v></c:pt></c:tx><c:cat><c:pt idx='0'><c:v>May</c:v></c:pt><c:pt idx='1'><c:v>June</c:v></c:pt></c:cat><c:val><c:pt idx='0'><c:v>3</c:v></c:pt></c:val></c:ser>"
    return archive(
        **{
            "ppt/presentation.xml": f'<p:presentation {P} {R}><p:sldId r:id="r1"/></p:presentation>',
            "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="slides/s1.xml"/></Relationships>',
            "ppt/slides/s1.xml": f'<p:sld {P} {A} {R}>{shape("title", "Plan")}{shape("body", "step", 1)}{shape("ftr", "foot")}<p:graphicFrame><c:chart xmlns:c="c" r:id="r2"/></p:graphicFrame></p:sld>',
            "ppt/slides/_rels/s1.xml.rels": f'<Relationships {REL}><Relationship Id="r2" Target="../charts/c1.xml"/><Relationship Id="r3" Target="../notesSlides/n1.xml"/></Relationships>',
            "ppt/charts/c1.xml": f'<c:chartSpace xmlns:c="c">{series}</c:chartSpace>',
            "ppt/notesSlides/n1.xml": f'<p:notes {P} {A}>{shape("body", "say it")}</p:notes>',
            "docProps/core.xml": CORE,
        }
    )


def xlsx():
    return archive(
        **{
            "xl/workbook.xml": f'<workbook {R}><workbookView activeTab="0"/><sheets><sheet name="s" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
            "xl/worksheets/sheet1.xml": '<worksheet><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="B2"><v>5</v></c></row></worksheet>',
        }
    )


def pdf(deflate=True):
    def stream(data):
        data = zlib.compress(data) if deflate else data
        return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if deflate else b"", data)

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 5 0 R] /Count 2 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", stream(rb"BT /F1 12 Tf 10 700 Td (Hello \(there\)) Tj 0 -14 Td [(sp) -10 (lit) -400 (up)] TJ ET"), b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>", stream(b"BT (Second) Tj 0 -9 Td (Page 2 of 2) Tj ET"), b"<< /Title (A title) >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R /Info 7 0 R >>"


def eml():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Hello", "a@example.org", "b@example.org"
    m.set_content("The body. It goes on.")
    m.add_attachment(b"\x00", maintype="image", subtype="png", filename="x.png")
    return m.as_bytes()


def test_archives():
    sections, meta = readers.read("a.docx", docx())
    assert [s[:6] for s in sections] == ["# Head", "y" * 6] and meta == {"title": "Of things", "author": "Someone"}
    assert "| k | v\\|w |" in sections[1] and "[Image - 1]" in sections[1]
    assert readers.read("a.odt", odt()) == (["One kept\nTwo"], {"title": "T", "author": "C"})
    assert readers.read("a.epub", epub()) == (["### Two", "One"], {"title": "Book", "creator": "A, B"})
    (slide,), meta = readers.read("a.pptx", pptx())
    assert slide.startswith("<!-- Slide number: 1 -->\n# Plan\n  - step\n") and "foot" not in slide and "| June |  |" in slide and slide.endswith("### Notes:\nsay it")
    assert readers.read("a.xlsx", xlsx())[0] == ["\n| name | n |\n| --- | --- |\n| None | 5 |\n"]


def test_pdf_and_mail():
    for deflate in (True, False):
        assert readers.read("a.pdf", pdf(deflate)) == (["Hello (there)\nsplit up", "Second\n"], {"page_count": "2", "title": "A title"})
    body, meta = readers.read("a.eml", eml())
    assert body == ["The body. It goes on."]
    assert {k: meta[k] for k in ("subject", "from", "to")} == {"subject": "Hello", "from": "a@example.org", "to": "b@example.org"}
    assert json.loads(meta["attachment_names"]) == ["x.png"]
    assert readers.read("a.eml", b"Subject: x\n\n")[0] == []


@pytest.mark.parametrize(
    "html, markdown",
    [
        ("<h1>Big</h1><p>Some <b>bold</b> and <i>thin</i></p>", "Big\n===\n\nSome **bold** and *thin*"),
        ("<h3>x</h3><ul><li>a<li>b<ul><li>c</ul></ul>", "### x\n\n* a\n* b\n  * c"),
        ("<a href='http://x.org/" + "y" * 200 + "'>z</a>", "[z](http://x.org/" + "y" * 134 + "...)"),
        ("<table><tr><th>a<th>b<tr><td>1<td>2|3</table>", "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"),
        ("<script>no</script>x &amp; y<br>z", "x & y  \nz"),
        ("<pre>a\n  b</pre>", "```\na\n  b\n```"),
        ("<p>unclosed <b>x", "unclosed **x**"),
        ("", ""),
        ("</p></div>", ""),
    ],
)
def test_html(html, markdown):
    assert to_markdown(html) == markdown


def test_markup():
    assert latex_text(r"\documentclass{a}\begin{document}\section{One} Text \emph{here} % gone" + "\n" + r"\begin{itemize}\item x\item y\end{itemize}\end{document}") == "# One\n\n Text here\n\n- x\n- y"
    assert rst_text("Title\n=====\n\nSome ``code`` and `a link <http://x.org>`_.\n\nPart\n----\n\n* one\n\n.. note:: Mind.\n") == "# Title\n\nSome `code` and [a link](http://x.org).\n\n## Part\n\n- one\n\nMind."
    euro = chr(92) + "u8364?"
    assert rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9 " + euro + r"\par}") == "Hello bold\ncafé €"
    assert paper_text("a\n\n\nb\n 12 \nc Page 1 of 9 x\n1.\nd") == "a\nbc \n1. d"
    assert readers.csv_table("a,b\n1,x|y\n") == "\n| a | b |\n| --- | --- |\n| 1 | x\\|y |\n"


def test_decoding():
    assert readers.decoded("é\r\n".encode()) == "é\n"
    assert readers.decoded("é".encode("cp1252")) == "é"
    assert readers.decoded("é".encode("utf-16")) == "é"
    with pytest.raises(FileProcessingError):
        readers.decoded(b"a\0b")


@pytest.mark.parametrize("name", sorted(readers.READERS))
def test_broken_files_are_errors_of_ours(name):
    for content in (b"", b"PK\x03\x04rest", b"%PDF-1.4 nothing", b"\xff\xfe\x00", b"{\\rtf1 \\u"):
        try:
            sections, _ = readers.read(f"x{name}", content)
            assert all(isinstance(s, str) for s in sections)
        except FileProcessingError:
            pass


def test_paths():
    with pytest.raises(UnsupportedFileTypeError):
        readers.read("x.zip", b"")
    with pytest.raises(FileProcessingError):
        readers.read("x", b"")


@pytest.fixture
def folder(tmp_path):
    for name, content in {"a.txt": b"The first one. The second one.", "sub/b.docx": docx(), "c.pdf": pdf(), "d.bin": b"\0"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_files(spark, folder, tmp_path):
    got = files.chunk_files(spark, str(folder), on_errors="skip", max_sentences=2).collect()
    assert {r.source.rsplit("/", 1)[1]: (r.error or "").split(":")[0] for r in got} == {"a.txt": "", "b.docx": "", "c.pdf": "", "d.bin": "UnsupportedFileTypeError"}
    assert {(r.section_num, r.section_count) for r in got if r.source.endswith("pdf")} == {(1, 2), (2, 2)}
    with pytest.raises(Exception, match="UnsupportedFileTypeError"):
        files.chunk_files(spark, str(folder), max_sentences=2).collect()
    before = files.chunk_files(spark, str(folder), on_errors="break", max_sentences=2).collect()
    assert {r.source.rsplit("/", 1)[1] for r in before} == {"a.txt", "c.pdf"}
    assert files.sentence_files(spark, str(folder / "a.txt")).count() == 2
    with pytest.raises(InvalidInputError):
        files.scan_files(spark)


def test_processors_of_users(spark, folder):
    processors.register(".bin", lambda path: (["one", "two"], {"n": 2}), name="bin")
    try:
        rows = files.read_sections(files.scan_files(spark, str(folder / "d.bin"))).orderBy("section_num").collect()
        assert [(r.text, r.metadata) for r in rows] == [("one", {"n": "2"}), ("two", {"n": "2"})]
    finally:
        processors.clear()
    with pytest.raises(InvalidInputError):
        processors.register("bin", lambda path: "", name="x")


def test_code_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return 1\n\ndef g():\n    return 2\n")
    rows = files.chunk_code_files(spark, str(tmp_path), max_functions=1).collect()
    assert len(rows) == 2 and all(r.source.endswith("a.py") for r in rows)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "It is one. And two."), (2, "It is three.")], "doc_id long, text string")
    chunks = chunk_documents(df, max_sentences=1, overlap_percent=0)
    assert sinks.write_json(chunks, str(tmp_path / "x.json"), metadata=True) == 3
    assert [c["content"] for c in json.loads((tmp_path / "x.json").read_text())] == ["It is one.", "And two.", "It is three."]
    assert sinks.write_folder(chunks, str(tmp_path / "f"), metadata=True) == 3
    assert (tmp_path / "f" / "stdin_chunk_2.txt").read_text() == "And two."
    out = io.StringIO()
    assert sinks.write_text(chunks, out) == 3 and "--- Chunk 3 ---\nIt is three." in out.getvalue()
    assert [json.loads(r.json)["content"] for r in sinks.chunk_json(chunks).collect()] == ["It is one.", "And two.", "It is three."]
    assert sinks.as_pages(chunks).columns == ["page_content", "metadata"] and sinks.as_pages(chunks).first().metadata["doc_id"] == "1"
    assert sinks.view("x", chunks)["stats"] == {"text_length": 1, "chunk_count": 3, "mode": "document"}


def test_streams(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    chunks = stream_file_chunks(spark, str(folder), max_sentences=1, overlap_percent=0)
    write_chunks(chunks, str(out / "t"), str(out / "c"), once=True).awaitTermination()
    assert {r.source.rsplit("/", 1)[1] for r in spark.read.parquet(str(out / "t")).collect()} == {"a.txt", "b.docx", "c.pdf"}
    spark.createDataFrame([(1, "It is one. And two.")], "doc_id long, text string").write.parquet(str(out / "in"))
    rows = stream_chunks(spark.readStream.schema("doc_id long, text string").parquet(str(out / "in")), max_sentences=1, overlap_percent=0)
    write_chunks(rows, str(out / "t2"), str(out / "c2"), once=True).awaitTermination()
    assert spark.read.parquet(str(out / "t2")).count() == 2
    with pytest.raises(InvalidInputError):
        stream_chunks(rows, max_sentences=1, on_errors="break")


def test_charsets():
    from textloom.sources.readers import decoded

    texts = {
        "cp1252": "Die Straße führt über die Brücke, und später wird es schön: déjà vu, señor.",
        "cp1251": "Это предложение написано по-русски, и в нём нет ничего особенного.",
        "koi8_r": "Это предложение написано по-русски, и в нём нет ничего особенного.",
        "cp1253": "Αυτή η πρόταση είναι γραμμένη στα ελληνικά και δεν λέει τίποτα.",
        "shift_jis": "これは日本語の文です。あまり意味はありませんが、読むことができます。",
        "gb18030": "这是一个中文的句子，我们不知道他在说什么，但是可以读。",
        "euc_kr": "이것은 한국어로 쓰인 문장이고 아무 의미가 없다.",
    }
    for name, text in texts.items():
        assert decoded(text.encode(name)) == text, name
    assert decoded("naïve “quotes” – dash".encode("cp1252")) == "naïve “quotes” – dash"


def test_entities_are_refused_wherever_they_stand():
    import io
    import zipfile

    import pytest

    from textloom.errors import FileProcessingError
    from textloom.sources.archives import Archive

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("far.xml", "<?xml version='1.0'?><!--" + "x" * 10_000 + '--><!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')
        z.writestr("plain.xml", "<a>the word &lt;!ENTITY is text here</a>")
        z.writestr("bad.xml", "<a>")
    a = Archive(out.getvalue())
    with pytest.raises(FileProcessingError, match="declares"):
        a.xml("far.xml")
    with pytest.raises(FileProcessingError, match="isn't XML"):
        a.xml("bad.xml")
    assert "ENTITY" in a.xml("plain.xml").text


def test_encrypted_pdf_and_nested_latex():
    import pytest

    from textloom.errors import FileProcessingError
    from textloom.sources.markup import latex_text
    from textloom.sources.pdf import pdf

    with pytest.raises(FileProcessingError, match="encrypted"):
        pdf(b"%PDF-1.4\n1 0 obj << >> endobj\ntrailer << /Encrypt 9 0 R >>\nstartxref\n5\n%%EOF" + b" " * 5000)
    assert latex_text(r"a \textbf{b \emph{c \textit{d \underline{e \textsc{f \texttt{g}}}}}} h") == "a b c d e f g h"


def test_sinks_of_executors_and_yaml(spark, tmp_path):
    import json

    import pytest

    df = spark.createDataFrame([("a", 1, "one: é"), ("a", 2, "two\nlines"), ("b c", 1, None)], "source string, chunk_num int, content string").repartition(2)
    sinks.save_json(df, str(tmp_path / "all"))
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "all")).collect()), key=lambda r: (r["metadata"]["source"], r["metadata"]["chunk_num"]))
    assert [r.get("content") for r in got] == ["one: é", "two\nlines", None]
    sinks.save_by_source(df, str(tmp_path / "by"))
    assert {(r.of, json.loads(r.value)["metadata"]["chunk_num"]) for r in spark.read.text(str(tmp_path / "by")).collect()} == {("a", 1), ("a", 2), ("b c", 1)}
    yaml = pytest.importorskip("yaml")
    assert sinks.write_yaml(df.orderBy("source", "chunk_num"), str(tmp_path / "x.yaml"), metadata=True) == 3
    assert [x["content"] for x in yaml.safe_load((tmp_path / "x.yaml").read_text())] == ["one: é", "two\nlines", None]
    assert sinks.write_yaml(df.limit(0), str(tmp_path / "none.yaml")) == 0


def test_pages_are_made_markdown_a_few_at_a_time(spark, monkeypatch):
    from pyspark.sql import functions as F

    from textloom.functions import gather
    from textloom.sources.readers import html_column

    pages = [None, "", "<p>a</p>", "<h3>b</h3>" * 3] * 20
    monkeypatch.setattr(gather, "MOST", 150)
    parts = gather.gathered([None if p is None else to_markdown(p) for p in pages], __import__("pyarrow").string(), lambda t: len(t or "")).to_pylist()
    df = spark.createDataFrame(list(enumerate(pages)), "k int, h string").repartition(1)
    assert [r.m for r in df.select("k", html_column(F.col("h")).alias("m")).orderBy("k").collect()] == parts == [None if p is None else to_markdown(p) for p in pages]
