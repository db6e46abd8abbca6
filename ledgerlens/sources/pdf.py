"""Text and properties of PDF files without a PDF library: objects, object streams, Flate streams, page tree, text
operators. Fonts with their own code tables are read through their ToUnicode maps; others as Latin letters.

Defined results: an encrypted file, or bytes that are no PDF, raise; a page without text gives an empty text;
streams that can't be decoded are left out; scanned pages go to ``ocr`` (bytes, page number -> text) if one is
given and no page has text, each then under a line ``Page n:``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A shift to the left in a text array that stands for a blank, in thousandths of the font's size.
BLANK_SHIFT = 180


def _stream(body: bytes) -> bytes:
    """The decoded stream of an object, or nothing."""
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    head, data = body[: m.start()], body[m.end() : body.rfind(b"endstream")]
    if b"/FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error:
            return b""
    return b"" if b"/Filter" in head else data


def objects(data: bytes) -> dict[int, bytes]:
    """Object bodies by number, those of object streams included; of repeated numbers the last counts."""
    starts = list(_OBJECT.finditer(data))
    out: dict[int, bytes] = {}
    for m, end in zip(starts, [*[x.start() for x in starts[1:]], len(data)]):
        out[int(m[1])] = data[m.end() : end].rsplit(b"endobj", 1)[0]
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm", body):
            inner = _stream(body)
            first = re.search(rb"/First\s+(\d+)", body)
            if inner and first:
                at = int(first[1])
                nums = [int(x) for x in inner[:at].split()]
                spots = [*[at + o for o in nums[1::2]], len(inner)]
                for k, n in enumerate(nums[::2]):
                    out.setdefault(n, inner[spots[k] : spots[k + 1]])
    return out


def _value(body: bytes, key: bytes) -> bytes:
    """What follows a key of a dictionary: an array, a reference, a string or a name."""
    m = re.search(rb"/" + key + rb"\s*(\[.*?\]|<<.*?>>|\d+\s+\d+\s+R|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|\d+)", body, re.S)
    return m[1] if m else b""


def _string(tok: bytes) -> bytes:
    if tok.startswith(b"<"):
        h = re.sub(rb"\s", b"", tok[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" and b"\n" in m[1] else _ESCAPES.get(m[1], m[1]), tok[1:-1], flags=re.S)


def decode_text(raw: bytes) -> str:
    """A text string: UTF-16 with its mark, else Latin letters."""
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def unicode_map(cmap: bytes) -> dict[bytes, str]:
    """Codes to text of a ToUnicode map: single characters and ranges."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[bytes.fromhex(a.decode())] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            width, low, target = len(a) // 2, int(a, 16), int(c, 16)
            for k in range(min(int(b, 16) - low + 1, 65_536)):
                out[(low + k).to_bytes(width, "big")] = chr(target + k)
    return out


def _read(raw: bytes, codes: dict[bytes, str] | None) -> str:
    if not codes:
        return raw.decode("cp1252", "replace")
    width = max(map(len, codes))
    return "".join(codes.get(raw[k : k + width], "") for k in range(0, len(raw), width))


def page_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """The text that a page's operators show, a line a vertical move."""
    out: list[str] = []
    args: list[bytes] = []
    codes: dict[bytes, str] | None = None
    depth: list[bytes] | None = None
    for m in _TOKEN.finditer(content):
        tok = m.group()
        if tok == b"[":
            depth = []
        elif tok == b"]":
            args, depth = [*args, b"["], depth
        elif depth is not None and tok[:1] in b"(<-+.0123456789":
            depth.append(tok)
        elif tok[:1] in b"(</-+.0123456789":
            args.append(tok)
        else:
            if tok == b"Tf" and len(args) > 1:
                codes = fonts.get(args[-2][1:])
            elif tok in (b"Tj", b"'", b'"') and args and args[-1][:1] in b"(<":
                out.append(("\n" if tok != b"Tj" else "") + _read(_string(args[-1]), codes))
            elif tok == b"TJ" and depth is not None:
                out += [_read(_string(x), codes) if x[:1] in b"(<" else " " if -float(x) > BLANK_SHIFT else "" for x in depth]
            elif tok == b"T*" or tok == b"Tm" or tok in (b"Td", b"TD") and args and args[-1].strip(b"+-0.") != b"":
                out.append("\n")
            elif tok in (b"Td", b"TD"):
                out.append(" ")
            args, depth = [], None
    return re.sub(r"[ \t]*\n[ \t\n]*", "\n", "".join(out)).strip()


def read_pages(data: bytes) -> tuple[list[str], dict[str, str]]:
    """(text of each page in order, properties title, author, creation_date)."""
    if not data.lstrip()[:5].startswith(b"%PDF"):
        raise ValueError("no PDF")
    if re.search(rb"/Encrypt\s", data):
        raise ValueError("encrypted PDF")
    objs = objects(data)
    pages: list[bytes] = []
    done: set[int] = set()

    def walk(n: int) -> None:
        body = objs.get(n, b"")
        if n in done:
            return
        done.add(n)
        if re.search(rb"/Type\s*/Pages\b", body):
            for k in _REF.findall(_value(body, b"Kids")):
                walk(int(k))
        elif re.search(rb"/Type\s*/Page\b", body):
            pages.append(body)

    for n, body in objs.items():
        if re.search(rb"/Type\s*/Catalog\b", body):
            for k in _REF.findall(_value(body, b"Pages")):
                walk(int(k))
    if not pages:
        pages = [b for b in objs.values() if re.search(rb"/Type\s*/Page\b", b)]

    def fonts(page: bytes) -> dict[bytes, dict[bytes, str]]:
        res = _value(page, b"Resources")
        own = objs.get(int(_REF.match(res)[1]), b"") if _REF.match(res) else page
        table = re.search(rb"/Font\s*(\d+\s+\d+\s+R|<<.*?>>)", own, re.S)
        named = (objs.get(int(_REF.match(table[1])[1]), b"") if _REF.match(table[1]) else table[1]) if table else b""
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", named):
            ref = _REF.match(_value(objs.get(int(n), b""), b"ToUnicode"))
            if ref:
                out[name] = unicode_map(_stream(objs.get(int(ref[1]), b"")))
        return out

    texts = [page_text(b"\n".join(_stream(objs.get(int(k), b"")) for k in _REF.findall(_value(p, b"Contents"))), fonts(p)) for p in pages]
    ref = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    info = objs.get(int(ref[-1]), b"") if ref else b""
    props = {name: decode_text(_string(v)) for name, key in (("title", b"Title"), ("author", b"Author"), ("creation_date", b"CreationDate")) if (v := _value(info, key))[:1] in (b"(", b"<")}
    return texts, props


def read_pdf(data: bytes, ocr: Callable[[bytes, int], str] | None = None) -> str:
    """Page texts joined by blank lines; see the module for scanned files."""
    texts, _ = read_pages(data)
    if ocr is not None and not any(t.strip() for t in texts):
        texts = [f"Page {k}:\n{ocr(data, k)}" for k in range(1, len(texts) + 1)]
    return "\n\n".join(texts)


def can_parse(path: Column) -> Column:
    """Whether the statement parser takes a file: by its suffix; a scan lists existing files only."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)) == ".pdf"


def load_pdfs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of the PDF files under a folder: doc_id, content, title, author, creation_date,
    page_count, source; a file that can't be read goes to the rejects with its error."""
    from ledgerlens.sources.files import document_id

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(can_parse(F.col("path"))).select("path", "modificationTime", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for path, at, data in zip(p["path"], p["modificationTime"], p["content"]):
                try:
                    texts, props = read_pages(bytes(data))
                    rows.append((path, at, "\n\n".join(texts), props.get("title"), props.get("author"), props.get("creation_date"), len(texts), None))
                except Exception as e:  # noqa: BLE001  a bad file must not stop the job
                    rows.append((path, at, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "modificationTime", "content", "title", "author", "creation_date", "page_count", "error"]).astype({"page_count": "Int32"})

    read = files.mapInPandas(run, "path string, modificationTime timestamp, content string, title string, author string, creation_date string, page_count int, error string")
    out = read.withColumn("doc_id", document_id(F.col("path"), F.col("modificationTime"))).withColumnRenamed("path", "source")
    return out.where("error is null").select("doc_id", "content", "title", "author", "creation_date", "page_count", "source"), out.where("error is not null").select("source", "error")
