"""EPUB 3 files from Markdown, with the standard library."""

from __future__ import annotations

import html
import io
import re
import sys
import uuid
import zipfile

import pyarrow.fs
from pyspark import cloudpickle

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format: media types by ending.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml"}
_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_INLINE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)|\[([^\]]+)\]\(([^)]+)\)|<img [^>]*src=\"([^\"]+)\"[^>]*>|\*\*(.+?)\*\*|`(.+?)`")


def _inline(text: str) -> str:
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(html.escape(text[at : m.start()], quote=False))
        alt, path, shown, link, src, strong, code = m.groups()
        if path or src:
            out.append(f'<img src="{html.escape(path or src)}" alt="{html.escape(alt or "")}"/>')
        elif link:
            out.append(f'<a href="{html.escape(link)}">{html.escape(shown, quote=False)}</a>')
        elif strong:
            out.append(f"<strong>{html.escape(strong, quote=False)}</strong>")
        else:
            out.append(f"<code>{html.escape(code, quote=False)}</code>")
        at = m.end()
    return "".join(out) + html.escape(text[at:], quote=False)


def xhtml(markdown: str) -> tuple[str, list[tuple[int, str, str]]]:
    """The body of a text, and its headings (level, id, title): headings, paragraphs, images, links, strong and code; all else stays as it is written."""
    body, headings = [], []
    for block in re.split(r"\n\s*\n", markdown):
        lines: list[str] = []
        for line in block.split("\n"):
            m = re.match(r"(#{1,6})\s+(.*\S)", line)
            if not m:
                if line.strip():
                    lines.append(line)
                continue
            if lines:
                body.append(f"<p>{'<br/>'.join(map(_inline, lines))}</p>")
                lines = []
            headings.append((len(m[1]), f"h{len(headings)}", m[2]))
            body.append(f'<h{len(m[1])} id="{headings[-1][1]}">{_inline(m[2])}</h{len(m[1])}>')
        if lines:
            body.append(f"<p>{'<br/>'.join(map(_inline, lines))}</p>")
    return "\n".join(body), headings


def _page(title: str, body: str) -> str:
    # XML has no control characters but tab and line ends
    text = f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{html.escape(title)}</title></head><body>{body}</body></html>'
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", text)


def book(title: str, identifier: str, markdown: str, images: list[tuple[str, str]]) -> bytes:
    """The file's bytes; images are (name, path).  Equal input gives equal bytes."""
    body, headings = xhtml(markdown)
    links = "".join(f'<li><a href="text.xhtml#{i}">{_inline(t)}</a></li>' for _, i, t in headings) or '<li><a href="text.xhtml">' + html.escape(title) + "</a></li>"
    items = "".join(f'<item id="i{k}" href="{html.escape(name)}" media-type="{MEDIA.get(name.rpartition(".")[2].lower(), "application/octet-stream")}"/>' for k, (name, _) in enumerate(images))
    package = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identifier)}</dc:identifier><dc:title>{html.escape(title)}</dc:title><dc:language>ja</dc:language><meta property="dcterms:modified">1980-01-01T00:00:00Z</meta></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="text" href="text.xhtml" media-type="application/xhtml+xml"/>{items}</manifest><spine><itemref idref="text"/></spine></package>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:

        def put(name: str, data: str | bytes, kind: int = zipfile.ZIP_DEFLATED) -> None:
            z.writestr(zipfile.ZipInfo(name), data, kind)

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", _CONTAINER)
        put("EPUB/package.opf", package)
        put("EPUB/nav.xhtml", _page(title, f'<nav epub:type="toc"><ol>{links}</ol></nav>'))
        put("EPUB/text.xhtml", _page(title, body))
        for name, path in images:
            fs, place = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            with fs.open_input_file(place) as f:
                put(f"EPUB/{name}", f.read())
    return out.getvalue()
