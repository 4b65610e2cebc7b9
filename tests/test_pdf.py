"""Pages of files: round trips, hand-made files and odd ones."""

import zlib

from plinth.operators import extraction
from plinth.sources import pdf

PAGES = [["Item 1: (rezone) \\ é", "naïve 日本 \U0001f600"], ["", "  "], [], ["last"]]


def hand_made():
    """Plain text operators, octal and nested strings, an object stream, an array of contents and inherited resources."""
    shown = rb"BT /F1 9 Tf 14 TL 1 0 0 1 50 700 Tm (One \(two\) (three) \351\r\n) Tj [(W) -300 (ide) 20 (r)] TJ (next) ' 0 0 (more) " + b'" ET'
    tree = [(2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>"), (3, b"<< /Type /Page /Contents [4 0 R 6 0 R] >>"), (5, b"<< /Type /Font /Subtype /Type1 >>")]
    at, heads, bodies = 0, [], b""
    for n, body in tree:
        heads.append(b"%d %d" % (n, at))
        bodies += body + b" "
        at = len(bodies)
    head = b" ".join(heads) + b" "
    packed = zlib.compress(head + bodies)
    objects = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"7 0 obj << /Type /ObjStm /N 3 /First %d /Length %d /Filter /FlateDecode >> stream\r\n%s\nendstream endobj" % (len(head), len(packed), packed)]
    objects += [b"4 0 obj << /Length 8 0 R >> stream\n%s\nendstream endobj" % shown, b"8 0 obj %d endobj" % len(shown), b"6 0 obj << >> stream\nBT 0 -30 Td (end % no comment) Tj ET % comment\nendstream endobj"]
    return b"%PDF-1.5\n" + b"\n".join(objects)


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.write(PAGES))
    (tmp_path / "b.pdf").write_bytes(hand_made())
    (tmp_path / "c.pdf").write_bytes(b"no file of this kind")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 cut 1 0 obj << /Type /Catalog /Pages 9 0 R")
    found = pdf.files(spark, str(tmp_path))
    got = sorted((r.path[-5:], r.page_number, r.page_text) for r in pdf.pages(found).collect())
    assert got == [("a.pdf", 1, "\n".join(PAGES[0])), ("a.pdf", 4, "last"), ("b.pdf", 1, "One (two) (three) é\r\nW ider\nnext\nmore\nend % no comment")]
    assert [r.page_number for r in pdf.pages(found, 2, 4).collect()] == [4]
    placed = extraction.page_offsets(pdf.pages(found).withColumnRenamed("path", "document_id"))
    assert [r.page_start for r in placed.where("document_id LIKE '%a.pdf'").orderBy("page_number").collect()] == [0, len("\n".join(PAGES[0])) + 1]
