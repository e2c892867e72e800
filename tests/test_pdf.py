"""PDF files made by hand, and odd bytes."""

from __future__ import annotations

import pdf_maker
import pytest

from leafspan.operators import outline
from leafspan.sources import files, pdf

PAGES = [["1.1 First (one)", "back\\slash  and é"], ["page two"], []]


@pytest.mark.parametrize("objects", [False, True])
@pytest.mark.parametrize("wide", [False, True])
def test_texts(wide, objects):
    pages = [["中文 ü 😀", "x"], *PAGES] if wide else PAGES
    got = [text for text, _, _ in pdf.pdf_pages(pdf_maker.made(pages, wide=wide, objects=objects))]
    assert got == ["\n".join(lines) for lines in pages]


def test_operators():
    shown = pdf.Pdf(b"%PDF-1.4\n")
    lines = [[]]
    shown._show(b"BT (a) Tj [(b) -300 (c) -20 (d)] TJ T* (e\\051\\\nf) ' 1 0 0 1 5 600 Tm (g) Tj 1 0 0 1 9 600 Tm (h) Tj 1 0 0 1 9 580 Tm <69 6> Tj ET % (no)\n BI /W 1 ID (zz) EI", {}, lines, 0)
    assert ["".join(x) for x in lines if x] == ["ab cd", "e)f", "gh", "i`"]


def test_bookmarks_titles_and_images(spark, tmp_path):
    marks = [("Top", 1, 1, 3), ("Inner", 2, None, 2), ("Inner 2", 2, None, None), ("2. Last", 3, None, None)]
    (tmp_path / "a.pdf").write_bytes(pdf_maker.made(PAGES, "Ein Tütel", marks, [b"\xff\xd8jpeg", b"raw"]))
    (tmp_path / "b.pdf").write_bytes(pdf_maker.made([["only"]], objects=True))
    (tmp_path / "c.pdf").write_bytes(b"nothing of the kind")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\ntrailer << /Encrypt 1 0 R >>")
    path = f"file://{tmp_path}"
    got = {(r["doc_name"], r["page"]): (r["text"], r["error"]) for r in files.parsed_files(spark, path, pdf.pdf_pages, "*.pdf").collect()}
    assert got["a.pdf", 1][0] == "1.1 First (one)\nback\\slash  and é" and got["a.pdf", 3][0] == "" and got["b.pdf", 1] == ("only", None)
    assert got["c.pdf", None][1] == "ValueError: not a PDF file" and "encrypted" in got["d.pdf", None][1]
    titles = {r["doc_name"]: (r["title"], r["total_pages"]) for r in files.pdf_titles(spark, path).collect() if not r["error"]}
    assert titles == {"a.pdf": ("Ein Tütel", 3), "b.pdf": ("Untitled", 1)}
    found = files.pdf_bookmarks(spark, path)
    rows = [tuple(r)[1:5] for r in found.filter("doc_name = 'a.pdf'").orderBy("ord").collect()]
    assert rows == [(1, 1, "Top", 1), (2, 2, "Inner", 2), (3, 2, "Inner 2", 2), (4, 1, "2. Last", 3)]
    made = outline.from_bookmarks(found.filter("error IS NULL").withColumnRenamed("doc_name", "doc")).filter("doc = 'a.pdf'").orderBy("ord")
    assert [(r["structure"], r["title"]) for r in made.collect()] == [(None, "Top"), (None, "Inner"), (None, "Inner 2"), ("2", "Last")]
    images = {(r["doc_name"], r["page"], r["image"]): bytes(r["content"]) for r in files.file_images(spark, path, pdf.pdf_pages, "a.pdf").collect()}
    assert images["a.pdf", 1, "page_1_img_1"] == b"\xff\xd8jpeg" and images["a.pdf", 1, "page_1_img_2"] == b"raw"


def test_damaged_files():
    whole = pdf_maker.made(PAGES, "t", [("A", 1, None, None)], objects=True)
    for cut in range(0, len(whole), 97):
        try:
            list(pdf.pdf_pages(whole[:cut]))
            list(pdf.Pdf(whole[:cut]).bookmarks())
        except Exception as error:  # noqa: BLE001
            assert not isinstance(error, (RecursionError, MemoryError))


def test_row_filters():
    rows = [bytes([0, 1, 2, 3, 4]), bytes([1, 1, 1, 1, 1]), bytes([2, 1, 1, 1, 1]), bytes([3, 2, 2, 2, 2]), bytes([4, 1, 1, 1, 1])]
    got = pdf._unfiltered(b"".join(rows), {"Predictor": 15, "Columns": 4})
    assert got[:12] == bytes([1, 2, 3, 4, 1, 2, 3, 4, 2, 3, 4, 5]) and len(got) == 20
