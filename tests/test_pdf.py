"""PDF files made by hand and by the writer, whole and broken."""

import random
import zlib

from quillsift.plans import registry
from quillsift.sources import pdf

SF = "/root/testdata/sf0.001"


def lines_of(data):
    file = pdf.File(data)
    return [pdf.page_lines(file, p) for p in file.pages]


def by_hand(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"):
    """Without cross-references, so its objects are searched for."""
    return b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] /Count 1 >> endobj 3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >> endobj\n4 0 obj << /Length %d >> stream\n%s\nendstream endobj 5 0 obj %s endobj" % (len(content), content, font)


def test_text_operators():
    content = rb"""BT /F 12 Tf 1 0 0 1 50 700 Tm (second) Tj ET BT /F 12 Tf 50 720 Td (fi\162st \(line\)) Tj 100 0 Td (right) Tj ET
    BT /F 9 Tf 50 600 Td [(ke) 20 (rn) -300 (ed)] TJ 14 TL (next) ' T* <e9> Tj 0 -20 TD (a) Tj T* (b \
c) Tj ET"""
    assert lines_of(by_hand(content)) == [["first (line) right", "second", "kern ed", "next", "é", "a", "b c"]]


def test_maps_to_unicode_and_object_streams():
    cmap = b"1 beginbfchar <01> <00660069> endbfchar 1 beginbfrange <02> <04> [<0061> <0062> <0063>] endbfrange"
    font = b"<< /Subtype /Type1 /ToUnicode 6 0 R >> endobj 6 0 obj << /Length %d >> stream\n%s\nendstream" % (len(cmap), cmap)
    assert lines_of(by_hand(b"BT /F 1 Tf <0102030409> Tj ET", font)) == [["fiabc\ufffd"]]
    # A catalog and pages in an object stream, found by a cross-reference stream.
    inner = b"1 0 2 36 3 80 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(36) + b"<< /Kids [3 0 R] /Count 1 >>".ljust(44) + b"<< /Type /Page /Contents 5 0 R >>"
    packed = zlib.compress(inner)
    head = b"%PDF-1.5\n"
    four = b"4 0 obj << /Type /ObjStm /N 3 /First 14 /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(packed), packed)
    five = b"5 0 obj << /Length 11 >> stream\nBT (x) Tj ET\nendstream endobj\n"
    at4, at5 = len(head), len(head) + len(four)
    at6 = at5 + len(five)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)]
    raw = [bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows]
    table = zlib.compress(b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before)) for r, before in zip(raw, [bytes(4), *raw])))
    six = b"6 0 obj << /Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >> stream\n%s\nendstream endobj\nstartxref\n%d\n%%%%EOF" % (len(table), table, at6)
    file = pdf.File(head + four + five + six)
    assert file.places[5] == at5 and file.packed[3] == (4, 2) and len(file.pages) == 1 and pdf.page_lines(file, file.pages[0]) == []  # no font, no text


def test_written_files_read_back():
    r = random.Random(1)
    lines = ["".join(r.choices("ab ()\\<>é漢😀%[]{}/~", k=r.randrange(1, 30))).strip() or "x" for _ in range(230)]
    data = pdf.made_of(lines)
    assert [t for page in lines_of(data) for t in page] == lines and len(lines_of(data)) == 5
    assert [t for page in lines_of(data.replace(b"startxref\n", b"startxref\n9")) for t in page] == lines  # wrong place of the table
    assert lines_of(pdf.made_of([])) == [[]]


def test_broken_files_give_a_row_with_the_error(spark, tmp_path):
    good = pdf.made_of(["one", "two"])
    given = {1: good, 3: b"not a pdf", 4: good[: len(good) // 2], 5: good.replace(b"/FlateDecode", b"/DCTDecode  "), 6: b"%PDF" + b"(" * 100_000 + b"<" * 100_000, 7: by_hand(b"BT (a Tj ET")}
    for number, data in given.items():
        (tmp_path / f"f{number}.pdf").write_bytes(data)
    got = {}
    for r in pdf.read_pdf(spark, str(tmp_path / "*.pdf")).collect():
        got.setdefault(r["doc_id"], []).append((r["page"], r["line_no"], r["line"], r["error"]))
    assert got[1] == [(0, 0, "one", None), (0, 1, "two", None)]
    assert all(len(got[n]) == 1 and got[n][0][3] for n in (3, 5, 6, 7))
    assert pdf.parsed(spark.createDataFrame([(2, b""), (8, None)], "doc_id int, content binary")).collect()[0]["error"]
    rng = random.Random(2)
    for _ in range(200):  # damaged anywhere: lines or an error, never an endless loop
        data = bytearray(good)
        for _ in range(4):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            lines_of(bytes(data))
        except Exception as e:
            assert not isinstance(e, (MemoryError, RecursionError))


def test_pages_through_pdf(spark):
    found, blocks = registry.pdf_blocks(spark, SF), registry.page_blocks(spark, SF)
    assert found.count() > 100 and sorted(map(tuple, found.collect())) == sorted(map(tuple, blocks.select(*found.columns).collect()))
