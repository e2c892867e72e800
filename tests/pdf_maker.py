"""Small PDF files made by hand: plain, packed in object streams, or with a Unicode map."""

from __future__ import annotations

import zlib

CMAP = b"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange end"


def _stream(data: bytes, about: str = "", packed: bool = True) -> bytes:
    body = zlib.compress(data) if packed else data
    return f"<< /Length {len(body)} {'/Filter /FlateDecode' if packed else ''} {about} >>\nstream\n".encode() + body + b"\nendstream"


def _shown(line: str, wide: bool) -> bytes:
    if wide:
        return b"<" + line.encode("utf-16-be").hex().encode() + b"> Tj"
    return b"(" + line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj"


def made(pages: list[list[str]], title: str | None = None, marks=(), images=(), wide: bool = False, objects: bool = False) -> bytes:
    """marks: (title, page, first child or None, next or None) by place; images: bytes on the first page."""
    found: dict[int, bytes] = {}
    n = len(pages)
    page_number = lambda i: 10 + 2 * i
    font = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R >>" if wide else b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"
    found[4], found[5] = font, _stream(CMAP)
    found[2] = f"<< /Type /Pages /Count {n} /Kids [{' '.join(f'{page_number(i)} 0 R' for i in range(n))}] /Resources << /Font << /F1 4 0 R >> /XObject << {' '.join(f'/I{k} {500 + k} 0 R' for k in range(len(images)))} >> >> >>".encode()
    for k, image in enumerate(images):
        found[500 + k] = _stream(image, "/Type /XObject /Subtype /Image /Width 1 /Height 1", packed=False)
    for i, lines in enumerate(pages):
        shown = b"\n".join(_shown(x, wide) + b" 0 -14 Td" for x in lines)
        found[page_number(i)] = f"<< /Type /Page /Parent 2 0 R /Contents {page_number(i) + 1} 0 R >>".encode()
        found[page_number(i) + 1] = _stream(b"BT /F1 12 Tf 50 700 Td " + shown + b" ET")
    for k, (name, page, child, after) in enumerate(marks):
        more = (f"/First {900 + child} 0 R" if child is not None else "") + (f" /Next {900 + after} 0 R" if after is not None else "")
        found[900 + k] = f"<< /Title ({name}) /Dest [{page_number(page - 1)} 0 R /Fit] {more} >>".encode()
    found[3] = b"<< /First 900 0 R >>" if marks else b"<< >>"
    found[1] = b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>"
    if title:
        found[6] = b"<< /Title <FEFF" + title.encode("utf-16-be").hex().encode() + b"> >>"
    top = b"/Root 1 0 R" + (b" /Info 6 0 R" if title else b"")
    packed = {k: v for k, v in found.items() if objects and b"stream" not in v}
    out = b"%PDF-1.5\n" + b"".join(f"{k} 0 obj\n".encode() + v + b"\nendobj\n" for k, v in found.items() if k not in packed)
    if packed:
        places, body = [], b""
        for k, v in packed.items():
            places.append(f"{k} {len(body)}")
            body += v + b" "
        head = " ".join(places).encode() + b" "
        out += b"990 0 obj\n" + _stream(head + body, f"/Type /ObjStm /N {len(packed)} /First {len(head)}") + b"\nendobj\n"
        return out + b"991 0 obj\n" + _stream(b"", "/Type /XRef " + top.decode()) + b"\nendobj\n%%EOF"
    return out + b"trailer\n<< " + top + b" >>\n%%EOF"
