"""Documents from files: what a file is, and its text as sections.

Files come from Spark's ``binaryFile`` source. Each format has a small parser
on the standard library; malformed files give an error code, never a failure.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_ENTRY, MOST_SHEETS, MOST_COLUMNS, MOST_SLIDES = 32 << 20, 16 << 20, 500, 16_384, 2_000
#: Formats by extension, and the bytes that files begin with.
MIME = {
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".odt": "application/vnd.oasis.opendocument.text",
}
ZIPPED = (".docx", ".pptx", ".xlsx", ".odt")
#: The two parts of a harmless test virus, in the order in which they occur.
TEST_VIRUS = ("EICAR-STANDARD-ANTIVIRUS", "-TEST-FILE!")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files up to 32 MiB; larger ones have no content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content"))


def kind(content: Column, name: Column, length: Column) -> Column:
    """struct<mime, error> from content and extension, as column functions."""
    from lattica.functions.text import extension, in_order

    ext = extension(name)
    mime = F.lit(None).cast("string")
    for e, m in MIME.items():
        mime = F.when(ext == e, m).otherwise(mime)
    head = F.hex(F.substring(content, 1, 4))
    text = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    error = (
        F.when(length == 0, "empty_file").when(length > MOST_BYTES, "file_too_large").when(in_order(text, *TEST_VIRUS), "malware_signature")
        .when((ext == ".pdf") & (head != "25504446"), "magic_mismatch").when(ext.isin(*ZIPPED) & (head != "504B0304"), "magic_mismatch")
        .when(~ext.isin(".pdf", *ZIPPED) & head.isin("25504446", "504B0304"), "magic_mismatch")
        .when(~ext.isin(".pdf", *ZIPPED) & (F.instr(text, "\0") > 0), "binary_content").when(mime.isNull(), "unsupported_type")
    )
    return F.struct(F.when(error.isNull(), mime).alias("mime"), error.alias("error"))


class ParseError(ValueError):
    """Its text is the error code."""


Section = tuple[str, int, str]  # heading, depth, body


class _Html(HTMLParser):
    HIDDEN = {"script", "style", "head", "noscript", "svg", "math", "template"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    BLOCK = {"p", "div", "br", "li", "ul", "ol", "section", "article", "header", "footer", "tr", "table", "blockquote", "pre", "hr"}
    INVISIBLE = re.compile(r"(display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[Section] = []
        self.open: list[tuple[str, bool]] = []
        self.hidden = 0
        self.heading, self.depth, self.parts, self.title = "", 0, [], None

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(attrs)
        hides = tag in self.HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or bool(self.INVISIBLE.search(a.get("style") or ""))
        if tag not in self.VOID:
            self.open.append((tag, hides))
            self.hidden += hides
        if self.hidden:
            return
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.title = []
            self.depth = int(tag[1])
        elif tag in ("td", "th"):
            self.parts.append(" | " if self.parts and self.parts[-1] != "\n" else "")
        elif tag in self.BLOCK:
            self.parts.append("\n" if tag == "tr" else " ")

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, hides = self.open.pop()
            self.hidden -= hides
            if t == tag:
                break
        if re.fullmatch("h[1-6]", tag) and self.title is not None:
            self.heading, self.title = " ".join("".join(self.title).split()), None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.parts if self.title is None else self.title).append(data)

    def flush(self) -> None:
        lines = [" ".join(x.split()) for x in "".join(self.parts).replace("\n", "\x00").replace("\x00\x00", "\x00").split("\x00")]
        body = "\n".join(x for x in lines if x) if any(" | " in x for x in lines) else " ".join(x for x in lines if x)
        if self.heading or body:
            self.sections.append((self.heading, self.depth, body))
        self.heading, self.parts = "", []


def html(data: bytes) -> list[Section]:
    found = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_\-]+)", data[:2048])
    try:
        text = data.decode(found[1].decode() if found else "utf-8", errors="replace")
    except LookupError:
        text = data.decode("utf-8", errors="replace")
    p = _Html()
    p.feed(text)
    p.close()
    p.flush()
    if not any(b or h for h, _, b in p.sections):
        raise ParseError("no_text")
    return p.sections


def _entry(z: zipfile.ZipFile, name: str) -> bytes:
    try:
        if z.getinfo(name).file_size > MOST_ENTRY:
            raise ParseError("entry_too_large")
        return z.read(name)
    except KeyError:
        raise ParseError("missing_entry") from None
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
        raise ParseError("corrupt_archive") from e


def _xml(raw: bytes) -> ET.Element:
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ParseError("forbidden_entity")
    try:
        return ET.fromstring(raw)
    except ET.ParseError:
        raise ParseError("malformed_xml") from None


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _archive(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ParseError("corrupt_archive") from None


def _runs(e: ET.Element) -> str:
    """Text of a paragraph; deleted runs don't count."""
    out = []
    for x in e:
        name = _local(x)
        if name == "del":
            continue
        if name == "t":
            out.append(x.text or "")
        elif name in ("tab",):
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        else:
            out.append(_runs(x))
    return "".join(out)


def _sectioned(parts: Iterator[tuple[int, str]]) -> list[Section]:
    """(level, text) lines, level 0 being body text, as sections."""
    out: list[Section] = []
    heading, depth, body = "", 0, []
    for level, text in parts:
        if level:
            if heading or body:
                out.append((heading, depth, "\n".join(body)))
            heading, depth, body = text.strip(), level, []
        elif text.strip():
            body.append(text.strip())
    if heading or body:
        out.append((heading, depth, "\n".join(body)))
    return out


def docx(data: bytes) -> list[Section]:
    z = _archive(data)
    body = _xml(_entry(z, "word/document.xml")).find("{*}body")

    def level(p: ET.Element) -> int:
        style = p.find("{*}pPr/{*}pStyle")
        m = re.fullmatch(r"heading ?([1-9])", (_attr(style, "val") or "") if style is not None else "", re.I)
        return int(m[1]) if m else 0

    def parts() -> Iterator[tuple[int, str]]:
        for e in body if body is not None else []:
            if _local(e) == "p":
                yield level(e), _runs(e)
            elif _local(e) == "tbl":
                for row in e.findall("{*}tr"):
                    yield 0, " | ".join(" ".join(_runs(p) for p in c.iter() if _local(p) == "p") for c in row.findall("{*}tc"))

    out = _sectioned(parts())
    for name in ("word/footnotes.xml", "word/endnotes.xml"):
        if name in z.namelist():
            notes = [_runs(p) for p in _xml(_entry(z, name)).iter() if _local(p) == "p"]
            if text := "\n".join(n.strip() for n in notes if n.strip()):
                out.append(("Notes", 1, text))
    return out


def pptx(data: bytes) -> list[Section]:
    z = _archive(data)
    names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    if len(names) > MOST_SLIDES:
        raise ParseError("too_many_slides")
    out = []
    for _, name in names:
        title, body = "", []
        for shape in (s for s in _xml(_entry(z, name)).iter() if _local(s) == "sp"):
            text = "\n".join(t for p in shape.iter() if _local(p) == "p" and (t := _runs(p).strip()))
            place = next((x for x in shape.iter() if _local(x) == "ph"), None)
            if place is not None and _attr(place, "type") in ("title", "ctrTitle") and not title:
                title = " ".join(text.split())
            elif text:
                body.append(text)
        if title or body:
            out.append((title, 1, "\n".join(body) or title))
    return out


def column(ref: str) -> int:
    """A spreadsheet column, from 1; 0 if malformed or too far."""
    m = re.match(r"([A-Z]+)\d+$", ref)
    n = 0
    for c in m[1] if m else "":
        n = n * 26 + ord(c) - 64
    return n if n <= MOST_COLUMNS else 0


def xlsx(data: bytes) -> list[Section]:
    z = _archive(data)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _xml(_entry(z, "xl/sharedStrings.xml")) if _local(si) == "si"]
    sheets = [_attr(s, "name") or "" for s in _xml(_entry(z, "xl/workbook.xml")).iter() if _local(s) == "sheet"]
    if len(sheets) > MOST_SHEETS:
        raise ParseError("too_many_sheets")
    out, size = [], 0
    for k, title in enumerate(sheets, 1):
        lines = []
        for row in (r for r in _xml(_entry(z, f"xl/worksheets/sheet{k}.xml")).iter() if _local(r) == "row"):
            cells: dict[int, str] = {}
            for c in row:
                at, t = column(_attr(c, "r") or ""), _attr(c, "t")
                v = "".join(x.text or "" for x in c.iter() if _local(x) in ("v", "t"))
                if t == "s":
                    v = shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
                elif t == "b":
                    v = {"1": "TRUE", "0": "FALSE"}.get(v, v)
                if at and v:
                    cells[at] = v
            if cells:
                lines.append(" | ".join(cells.get(i, "") for i in range(1, max(cells) + 1)))
                size += len(lines[-1])
                if size > MOST_ENTRY:
                    raise ParseError("output_too_large")
        out.append((title, 1, "\n".join(lines)))
    return out


def odt(data: bytes) -> list[Section]:
    root = _xml(_entry(_archive(data), "content.xml"))

    def text(e: ET.Element) -> str:
        out = [e.text or ""]
        for x in e:
            name = _local(x)
            if name == "s":
                out.append(" " * min(256, int(_attr(x, "c") or 1)))
            elif name == "tab":
                out.append("\t")
            elif name == "line-break":
                out.append("\n")
            else:
                out.append(text(x))
            out.append(x.tail or "")
        return "".join(out)

    def parts(e: ET.Element, prefix: str = "") -> Iterator[tuple[int, str]]:
        for x in e:
            name = _local(x)
            if name == "h":
                yield max(1, min(6, int(_attr(x, "outline-level") or 1))), text(x)
            elif name == "p":
                yield 0, prefix + text(x)
            elif name == "list-item":
                yield from parts(x, "- ")
            elif name == "table-row":
                yield 0, " | ".join(" ".join(text(p) for p in c.iter() if _local(p) == "p") for c in x)
            else:
                yield from parts(x, prefix)

    body = root.find("{*}body")
    return _sectioned(parts(body if body is not None else root))


def plain(data: bytes) -> list[Section]:
    try:
        lines = data.decode("utf-8").split("\n")
    except UnicodeDecodeError:
        raise ParseError("invalid_utf8") from None

    def parts() -> Iterator[tuple[int, str]]:
        for line in lines:
            line = line.rstrip("\r")
            m = re.match("(#{1,6}) (.*)", line)
            yield (len(m[1]), m[2]) if m else (0, line)

    return _sectioned(parts()) or [("", 0, "")]


PARSERS = {"text/plain": plain, "text/markdown": plain, "text/html": html, MIME[".docx"]: docx, MIME[".pptx"]: pptx, MIME[".xlsx"]: xlsx, MIME[".odt"]: odt}
SECTIONS = "path string, mime string, error string, sections array<struct<heading:string,depth:int,body:string>>"


def parse(files: DataFrame) -> DataFrame:
    """(path, mime, error, sections) of (path, length, content)."""
    typed = files.withColumn("kind", kind(F.col("content"), F.col("path"), F.col("length")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, mime, error in zip(*(b[c].to_pylist() for c in ("path", "content", "mime", "error"))):
                found = None
                if error is None:
                    try:
                        found = [{"heading": h, "depth": d, "body": t} for h, d, t in PARSERS[mime](content)] if mime in PARSERS else None
                        error = None if found is not None else "no_parser"
                    except ParseError as e:
                        error = str(e)
                rows.append({"path": path, "mime": mime, "error": error, "sections": found})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("mime", pa.string()), ("error", pa.string()), ("sections", pa.list_(pa.struct([("heading", pa.string()), ("depth", pa.int32()), ("body", pa.string())])))]))

    return typed.select("path", "content", "kind.mime", "kind.error").mapInArrow(run, SECTIONS)


def full_text(sections: Column) -> Column:
    """Bodies that aren't empty, one below the other."""
    return F.array_join(F.filter(F.transform(sections, lambda s: s["body"]), lambda t: t != ""), "\n")
