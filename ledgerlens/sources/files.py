"""Files as document rows: a scan of binary files, then one extractor per suffix inside the tasks.

Defined results: unknown suffixes and unreadable files go to the rejects table with a message; empty files
are not listed, as Spark's file scan skips them; the id is stable for path and modification time.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.pdf import read_pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def read_text(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


def read_docx(data: bytes) -> str:
    """Paragraphs a line each; table rows as cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body:
        if e.tag == f"{_W}p":
            out.append(text(e))
        elif e.tag == f"{_W}tbl":
            out += [" | ".join(text(c) for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")] + [""]
    return "\n".join(out)


def read_xlsx(data: bytes) -> str:
    """Each sheet under a marker line, cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        out = []
        for k, title in enumerate(titles, 1):
            path = f"xl/worksheets/sheet{k}.xml"
            if path not in names:
                continue
            out.append(f"--- Sheet: {title} ---")
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    t = "".join(x.text or "" for x in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else "")
                    cells.append(shared[int(t)] if c.get("t") == "s" and t else t or "")
                out.append(" | ".join(cells))
    return "\n".join(out)


def read_pptx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        return "\n\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for n in slides for p in ElementTree.fromstring(z.read(n)).iter(f"{_A}p"))


def read_table(sep: str) -> Callable[[bytes], str]:
    return lambda data: "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(read_text(data)), delimiter=sep))


def read_html(data: bytes) -> str:
    t = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", read_text(data))
    t = re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr|h\d|li)>", "\n", t)
    return re.sub(r"[ \t]+", " ", html.unescape(re.sub(r"<[^>]+>", " ", t))).strip()


def read_json(data: bytes) -> str:
    return json.dumps(json.loads(read_text(data)), ensure_ascii=False, indent=1)


#: Extractors by suffix; a plug-in adds or replaces entries.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {".txt": read_text, ".md": read_text, ".xml": read_html, ".docx": read_docx, ".xlsx": read_xlsx, ".pptx": read_pptx, ".csv": read_table(","), ".tsv": read_table("\t"), ".html": read_html, ".htm": read_html, ".json": read_json, ".pdf": read_pdf}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def document_id(path: Column, modified: Column) -> Column:
    return F.md5(F.concat_ws("_", path, modified.cast("string")))


def load_documents(spark: SparkSession, folder: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of all files under a folder; files are spread over tasks by size."""
    known = dict(EXTRACTORS | (extractors or {}))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    src = files.select("path", "modificationTime", "content", suffix(F.col("path")).alias("file_type"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            texts, errors = [], []
            for s, data in zip(p["file_type"], p["content"]):
                try:
                    if s not in known:
                        raise ValueError(f"unsupported file type {s or 'none'}")
                    texts.append(known[s](bytes(data)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a bad file must not stop the job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": p["path"], "modificationTime": p["modificationTime"], "file_type": p["file_type"], "content": texts, "error": errors})

    read = src.mapInPandas(run, "path string, modificationTime timestamp, file_type string, content string, error string")
    out = read.select(document_id(F.col("path"), F.col("modificationTime")).alias("doc_id"), "content", F.col("path").alias("source"), F.element_at(F.split("path", "/"), -1).alias("filename"), "file_type", F.col("modificationTime").alias("extraction_date"), "error")
    return out.where("error is null").drop("error"), out.where("error is not null").select("source", "file_type", "error")
