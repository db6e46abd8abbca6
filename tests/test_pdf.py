"""PDF files made by hand: plain and compressed streams, object streams, code maps, faults."""

import zlib

import pytest

from ledgerlens.operators import parsing as P
from ledgerlens.sources import files, pdf


def stream(data: bytes, packed: bool) -> bytes:
    body = zlib.compress(data) if packed else data
    return b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if packed else b"") + body + b"\nendstream"


def made(pages: list[bytes], packed: bool = True, inner: bool = False, more: bytes = b"") -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    objs = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % len(pages), 3: b"<< /Title (Annual \\(draft\\) report) /Author <FEFF00C50073> /CreationDate (D:20230131) >>", 4: b"<< /Type /Font /ToUnicode 5 0 R >>", 5: stream(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0062> endbfrange", packed)}
    for k, p in enumerate(pages):
        objs[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F2 4 0 R >> >> >>" % (11 + 2 * k)
        objs[11 + 2 * k] = stream(p, packed)
    out = b"%PDF-1.5\n"
    if inner:
        small = {n: objs.pop(n) for n in (1, 2, 3)}
        head, body = b"", b""
        for n, x in small.items():
            head += b"%d %d " % (n, len(body))
            body += x + b" "
        data = zlib.compress(head + body)
        objs[90] = b"<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(head), len(data)) + data + b"\nendstream"
    for n, x in objs.items():
        out += b"%d 0 obj\n" % n + x + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R /Info 3 0 R " + more + b">>\n%%EOF"


PAGE = b"BT /F1 12 Tf 72 700 Td (Tonwer Group plc, fiscal year ended 2022. Balance sheet with total assets) Tj 0 -14 Td [(Item | 20) -20 (22)] TJ T* (Total assets | $1,250.50) Tj T* (Net loss | \\(30.25\\)) Tj ET"


@pytest.mark.parametrize("packed,inner", [(False, False), (True, False), (True, True)])
def test_pages_text_and_properties(packed, inner):
    texts, props = pdf.read_pages(made([PAGE, b"BT /F2 9 Tf <010204> Tj [(\\003) -400 (\\001)] TJ ET", b""], packed, inner))
    assert texts == ["Tonwer Group plc, fiscal year ended 2022. Balance sheet with total assets\nItem | 2022\nTotal assets | $1,250.50\nNet loss | (30.25)", "Abdc A", ""]
    assert props == {"title": "Annual (draft) report", "author": "Ås", "creation_date": "D:20230131"}


def test_scanned_and_bad_files():
    assert pdf.read_pdf(made([b"", b""]), lambda data, n: f"scan {n}") == "Page 1:\nscan 1\n\nPage 2:\nscan 2"
    for bad in (b"", b"hello", made([PAGE], more=b"/Encrypt 7 0 R ")):
        with pytest.raises(ValueError):
            pdf.read_pages(bad)


def test_files_to_line_items(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made([PAGE]))
    (tmp_path / "b.PDF").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("plain")
    docs, rejects = pdf.load_pdfs(spark, str(tmp_path))
    d = docs.collect()
    assert len(d) == 1 and d[0]["page_count"] == 1 and d[0]["title"] == "Annual (draft) report" and rejects.count() == 1
    st, items, _ = P.parse_statements(docs)
    assert {r["name"]: r["value"] for r in items.collect()} == {"Total assets": 1250.5, "Net loss": -30.25} and st.first()["statement_type"] == "balance_sheet"
    every, bad = files.load_documents(spark, str(tmp_path))
    assert every.count() == 2 and bad.count() == 1
