import io
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.functions import chunking, text
from lattica.sources import files


def again(raw, size=600, overlap=100):
    """The chunk loop, written a second time over bytes."""
    out, at, n = [], 0, len(raw)
    space = b" \t\n\v\f\r"
    while at < n:
        end = next((k for k in range(min(n, at + size), n) if raw[k : k + 1] in [bytes([c]) for c in space]), n)
        if raw[at:end].strip(b" \t\n\r"):
            out.append(raw[at:end].strip(b" \t\n\r").decode())
        if end >= n:
            return out
        s = max(at + 1, end - overlap)
        while s < end and raw[s] not in space:
            s += 1
        while s < end and raw[s] in space:
            s += 1
        at = max(s, at + 1)
    return out


def test_chunks_of_random_text():
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choices(["é", "ab", "word ", "\n", " ", "ß\t", "x" * 40, "日本 "], k=r.randint(0, 400)))
        assert chunking.cut(t) == again(t.encode())
        assert all(len(c.encode()) <= 600 + 120 for c in chunking.cut("ab " * 1000))
    assert chunking.cut("") == [] and chunking.cut(" \n ") == []


def test_chunk_numbers_go_on_across_sections(spark):
    docs = spark.createDataFrame([(1, "# A\n" + "one " * 200 + "\n## B\ntwo"), (2, None), (3, "\n\nplain\r\r\n")], "doc_id long, text string")
    rows = chunking.chunks(chunking.sections(docs)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index) for r in rows] == [(1, 0), (1, 1), (1, 2), (3, 0)]
    assert rows[2].content == "two" and rows[3].content == "plain"


def test_section_tree(spark):
    t = "intro\n# A\na\n## B\nb\n# C\nc\n#no heading\n####### no\n### D\n"
    rows = chunking.sections(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.parent, r.heading, r.depth, r.heading_path, r.body) for r in rows] == [
        (0, None, "", 0, "", "intro"), (1, 0, "A", 1, "A", "a"), (2, 1, "B", 2, "A > B", "b"), (3, 0, "C", 1, "C", "c\n#no heading\n####### no"), (4, 3, "D", 3, "C > D", ""),
    ]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(1, "# A\nx\n# B\ny"), (1, "# C\nz"), (None, "# D\nq\n## E"), (None, "# F"), (1, "plain"), (1, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = chunking.sections(df).collect()
    of = {}
    for r in sorted(got, key=lambda r: r.ordinal):
        of.setdefault(r.row, []).append((r.doc_id, r.heading, r.heading_path, r.parent, r.body))
    want = [[(1, "A", "A", None, "x"), (1, "B", "B", None, "y")], [(1, "C", "C", None, "z")], [(None, "D", "D", None, "q"), (None, "E", "D > E", 0, "")], [(None, "F", "F", None, "")], [(1, "", "", None, "plain")], [(1, "", "", None, "")]] * 2
    assert sorted(of.values(), key=str) == sorted(want, key=str)
    indexes = sorted((r.content, r.chunk_index) for r in chunking.chunks(chunking.sections(df)).collect())
    assert indexes == sorted([(c, k) for c, k in (("x", 0), ("y", 1), ("z", 0), ("q", 0), ("plain", 0))] * 2)


def test_headings_of_random_levels(spark):
    """Parents and paths equal a stack of open headings."""
    r = random.Random(9)
    docs = [(k, "\n".join("#" * r.randint(1, 6) + f" h{n}" if r.random() < 0.7 else r.choice(["", "text"]) for n in range(r.randint(1, 60)))) for k in range(25)]
    got = {(x.doc_id, x.heading): (x.parent, x.heading_path) for x in chunking.sections(spark.createDataFrame(docs, "doc_id long, text string")).collect() if x.heading}
    for k, t in docs:
        stack, ordinal = [(0, 0, "")] if "#" in t and t.split("\n# ")[0] and not t.lstrip("\n").startswith("#") else [], 0
        ordinal = len(stack)
        for line in t.split("\n"):
            if line.startswith("#"):
                depth, name = len(line.split()[0]), line.split()[1]
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                stack.append((depth, ordinal, name))
                assert got[k, name] == (stack[-2][1] if len(stack) > 1 else None, " > ".join(s[2] for s in stack if s[2]))
                ordinal += 1


def test_uuid_and_text_functions(spark):
    names = ["", "a", "7:model", "é"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for space, want in ((text.URL_SPACE, uuid.NAMESPACE_URL), (text.DNS_SPACE, uuid.NAMESPACE_DNS)):
        assert [r[0] for r in df.select(text.uuid5(F.col("n"), space)).collect()] == [str(uuid.uuid5(want, n)) for n in names]
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(text.trim(F.lit(" \v\f a b \r\n"))) == "a b" and get(text.lower_ascii(F.lit("ÀB"))) == "Àb"
    assert get(text.extension(F.lit("x/y.tar.GZ"))) == ".gz" and get(text.extension(F.lit("x.d/y"))) == ""
    assert get(text.plain_spaces(F.lit("a b­c"))) == "a bc" and get(text.without_tags(F.lit("a\U000e0041b"))) == "ab"
    assert get(text.page_text(F.lit("a \r\n\r\n\r\n\r\nb  c\r"))) == "a\n\nb c"
    assert get(text.in_order(F.lit("xx AB yy CD"), "AB", "CD")) and not get(text.in_order(F.lit("CD AB"), "AB", "CD"))
    assert get(text.json_strings(F.lit('["a"]'))) == ["a"] and get(text.json_strings(F.lit("3"))) == []


W = 'xmlns:w="w"'


def docx(body):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return b.getvalue()


def test_html():
    page = b"""<html><head><title>t</title></head><body><p>intro</p><script>no()</script><h1>A &amp; B</h1><div style="display: none !important">no</div>
    <p hidden>no</p><table><tr><td>Col A</td><td>Col B</td></tr><tr><td>1</td><td>2</td></tr></table><h2>C</h2>text<br>more</body></html>"""
    assert files.html(page) == [("", 0, "intro"), ("A & B", 1, "Col A | Col B\n1 | 2"), ("C", 2, "text more")]
    with pytest.raises(files.ParseError):
        files.html(b"<html><script>x</script></html>")
    assert files.html(b"<p>open <b>never closed")[0][2] == "open never closed"


def test_office_formats():
    p = lambda t, style="": f'<w:p>{style and f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>"}<w:r><w:t>{t}</w:t></w:r></w:p>'
    assert files.docx(docx(p("One", "Heading1") + p("body") + "<w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>kept</w:t></w:r></w:ins></w:p>")) == [("One", 1, "body\nkept")]
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>')
    assert files.xlsx(b.getvalue()) == [("S", 1, "hello |  | 3\n | TRUE")]
    assert [files.column(r) for r in ("A1", "AA7", "XFD1", "XFE1", "7", "a1")] == [1, 27, 16384, 0, 0, 0]
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("ppt/slides/slide2.xml", "<s><sp><nvPr><ph type='title'/></nvPr><p><t>Only</t></p></sp></s>")
        z.writestr("ppt/slides/slide1.xml", "<s><sp><nvPr><ph type='title'/></nvPr><p><t>T</t></p></sp><sp><p><t>x</t></p></sp></s>")
    assert files.pptx(b.getvalue()) == [("T", 1, "x"), ("Only", 1, "Only")]
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("content.xml", '<d xmlns:t="t"><body><t:h t:outline-level="2">H</t:h><t:list><t:list-item><t:p>a<t:s t:c="3"/>b</t:p></t:list-item></t:list></body></d>')
    assert files.odt(b.getvalue()) == [("H", 2, "- a   b")]


def test_hostile_files_get_codes(spark):
    entity = io.BytesIO()
    with zipfile.ZipFile(entity, "w") as z:
        z.writestr("word/document.xml", "<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>")
    cases = {
        "empty.txt": (b"", "empty_file"), "a.md": (b"# A\nx", None), "nul.txt": (b"a\0b", "binary_content"), "x.exe": (b"MZ", "unsupported_type"), "p.pdf": (b"no", "magic_mismatch"),
        "z.docx": (b"PK\x03\x04broken", "corrupt_archive"), "fake.txt": (b"%PDF-1.4", "magic_mismatch"), "bad.txt": (b"\xc0\xaf", "invalid_utf8"), "e.docx": (entity.getvalue(), "forbidden_entity"),
        "none.html": (b"<script>a</script>", "no_text"), "v.txt": ("-".join(files.TEST_VIRUS).encode(), "malware_signature"), "q.pdf": (b"%PDF-1.4", "no_parser"),
    }
    rows = [(n, len(c), bytearray(c)) for n, (c, _) in cases.items()]
    got = {r.path: r.error for r in files.parse(spark.createDataFrame(rows, "path string, length long, content binary")).collect()}
    for name, (_, code) in cases.items():
        assert got[name] == code, (name, got[name])


def test_binary_files_are_read(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody")
    row = files.parse(files.read(spark, str(tmp_path))).first()
    assert row.mime == "text/markdown" and row.sections[0].heading == "T"


def test_html_in_markdown(spark):
    cases = {
        "a < b <b>bold</b> c": ("a < b bold c", None), "x<script>bad()</script>y<STYLE>z</STYLE>": ("xy", None), "<div style='display:none'>no <b>x</b></div>yes": ("yes", None),
        "<p hidden>no</p>ok <span data-hidden='1'>shown</span>": ("ok shown", None), "<input hidden>kept": ("kept", None), "<div hidden/>kept": ("kept", None), "<script>never": (None, "unclosed_hidden_tag"),
        # Elements of a hidden one's name inside it are counted.
        "<div hidden><div>a</div>secret</div>": ("", None), "a<DIV hidden>1<div>2<div/>3<p>4<Div>5</div></p>6</div>7</div >b<i>c</i>< d": ("abc< d", None), "x<p hidden>a<p>b</p>c": (None, "unclosed_hidden_tag"),
        "<div hidden><div>a</div></div>b<span hidden>c<span hidden>d</span>e</span>f<div>g</div><input hidden>h": ("bfgh", None), "<div><div hidden>a<div hidden>b</div></div>c</div>": ("c", None), "": ("", None), None: (None, None),
        "<div hidden><p>a</p></div>b": ("b", None), "<div hidden><script>'</div>'</script>x</div>y": ("y", None), "<style>a<div hidden></style>b</div>": ("b", None),
        "<div hidden>a</div><div>b</div>": ("b", None), "<p hidden>a<pre>b</pre></p>c": ("c", None), "1 <2> 3 <": ("1 <2> 3 <", None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.without_html(F.col("t")).alias("x"))
    assert {r.t: (r.x.text, r.x.error) for r in df.collect()} == cases


def test_hashed_embedding(spark):
    from lattica.functions import embedding

    def slow(t, n):
        h = embedding.FNV_START
        for b in t.encode():
            h = ((h ^ b) * embedding.FNV_PRIME) % 2**64
        out = []
        for _ in range(n):
            h = (h * embedding.STEP + embedding.ADD) % 2**64
            out.append((h - 2**64 if h >= 2**63 else h) / (2**63 - 1))
        s = sum(x * x for x in out) ** 0.5
        return [x / s for x in out]

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["", "a", "éé", None] * 20)], "id long, text string")
    got = embedding.embed(rows, embedding.hashed(8), 8).collect()
    assert len(got) == 80 and all(r.v == pytest.approx(slow(["", "a", "éé", ""][r.id % 4], 8), abs=1e-5) for r in got)
    with pytest.raises(Exception, match="dimensions"):
        embedding.embed(rows, embedding.hashed(7), 8).count()
