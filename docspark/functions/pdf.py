"""Searchable PDF files: page images under invisible words, with the standard library."""

from __future__ import annotations

import io
import struct
import sys
import zlib
from typing import NamedTuple

from pyspark import cloudpickle

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format: the font of invisible text (part of every reader's Japanese support), and the mode that hides it.
FONT, HIDDEN = "HeiseiKakuGo-W5", 3


class Page(NamedTuple):
    """width and height in points; jpeg may be None; words are (x, y, font size, text), y from below."""

    width: float
    height: float
    jpeg: bytes | None
    words: list[tuple[float, float, float, str]]


def jpeg_shape(data: bytes) -> tuple[int, int, int]:
    """Width, height and number of colours of a JPEG file."""
    at = 2
    while at + 9 < len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, colours = struct.unpack_from(">HHB", data, at + 5)
            return width, height, colours
        at += 2 + size
    raise ValueError("no JPEG image")


def _stream(data: bytes, more: str = "") -> bytes:
    return f"<< /Length {len(data)} {more}>>\nstream\n".encode() + data + b"\nendstream"


def document(pages: list[Page]) -> bytes:
    """The file's bytes; equal input gives equal bytes."""
    objects: list[bytes] = [b""] * 5  # catalog, pages, font and its two parts

    def add(data: bytes) -> int:
        objects.append(data)
        return len(objects)

    kids = []
    for page in pages:
        draw, images = [], ""
        if page.jpeg:
            width, height, colours = jpeg_shape(page.jpeg)
            space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[colours]
            image = add(_stream(page.jpeg, f"/Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /{space} /BitsPerComponent 8 /Filter /DCTDecode "))
            images = f"/XObject << /I {image} 0 R >> "
            draw.append(f"q {page.width:.4f} 0 0 {page.height:.4f} 0 0 cm /I Do Q")
        if page.words:
            lines = [f"/F {size:.4f} Tf 1 0 0 1 {x:.4f} {y:.4f} Tm <{text.encode('utf-16-be').hex()}> Tj" for x, y, size, text in page.words]
            draw.append("\n".join(["q BT", f"{HIDDEN} Tr", *lines, "ET Q"]))
        content = add(_stream(zlib.compress("\n".join(draw).encode(), 6), "/Filter /FlateDecode "))
        kids.append(add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {page.width:.4f} {page.height:.4f}] /Contents {content} 0 R /Resources << {images}/Font << /F 3 0 R >> >> >>".encode()))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    objects[2] = f"<< /Type /Font /Subtype /Type0 /BaseFont /{FONT}-UniJIS-UTF16-H /Encoding /UniJIS-UTF16-H /DescendantFonts [4 0 R] >>".encode()
    objects[3] = f"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /{FONT} /CIDSystemInfo << /Registry (Adobe) /Ordering (Japan1) /Supplement 5 >> /FontDescriptor 5 0 R /DW 1000 >>".encode()
    objects[4] = f"<< /Type /FontDescriptor /FontName /{FONT} /Flags 4 /FontBBox [-92 -250 1010 922] /ItalicAngle 0 /Ascent 752 /Descent -221 /CapHeight 737 /StemV 114 >>".encode()
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    for number, data in enumerate(objects, 1):
        places.append(out.tell())
        out.write(f"{number} 0 obj\n".encode() + data + b"\nendobj\n")
    start = out.tell()
    out.write(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
    return out.getvalue()
