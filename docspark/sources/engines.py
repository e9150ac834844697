"""Hooks for recognition engines: plain objects made once per partition, fed with Arrow batches.

No model is part of this package: NoOp and fakes serve tests, HttpFormulas asks a service, TextOnly wraps any function.
"""

from __future__ import annotations

import json
import struct
import sys
import urllib.error
import urllib.request
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from . import schemas

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class EngineError(RuntimeError):
    """An engine couldn't read an image."""


class PageAnalyzer(Protocol):
    def analyze(self, image: bytes) -> dict:
        """raw_markdown, figure_paths, paragraphs, words of a page image."""


class FormulaDetector(Protocol):
    def detect(self, image: bytes) -> list[dict]:
        """box (x1, y1, x2, y2), type, latex, score of each formula."""


class FormulaRecognizer(Protocol):
    def recognize(self, image: bytes, box: tuple[int, int, int, int]) -> str:
        """LaTeX of the formula in a box; raises EngineError."""


class NoOp:
    """Recognises nothing."""

    def analyze(self, image: bytes) -> dict:
        return {"raw_markdown": "", "figure_paths": [], "paragraphs": [], "words": []}

    def detect(self, image: bytes) -> list[dict]:
        return []

    def recognize(self, image: bytes, box: tuple[int, int, int, int]) -> str:
        return ""


class TextOnly:
    """An analyzer from a function that reads an image as Markdown, as language models do: no boxes, None is empty text."""

    def __init__(self, read: Callable[[bytes], str | None]):
        self.read = read

    def analyze(self, image: bytes) -> dict:
        try:
            text = self.read(image)
        except Exception as error:
            raise EngineError(f"the page can't be read: {error}") from error
        return NoOp().analyze(image) | {"raw_markdown": text or ""}


class HttpFormulas:
    """Detector and recognizer behind a service: images posted to <url>/detect and, cut to a box, to <url>/recognize.

    cut: makes the image (as the service takes it) of a box of an image; without it nothing can be read again.
    Refused and lost connections, timeouts, answers of 300 and above and answers that can't be read are EngineErrors.
    """

    def __init__(self, url: str, seconds: float = 60.0, cut: Callable[[bytes, tuple[int, int, int, int]], bytes] | None = None):
        self.url, self.seconds, self.cut = url.rstrip("/"), seconds, cut

    def _post(self, place: str, image: bytes):
        mark = uuid.uuid4().hex
        body = b"".join((f'--{mark}\r\nContent-Disposition: form-data; name="image"; filename="page.png"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode(), image, f"\r\n--{mark}--\r\n".encode()))
        request = urllib.request.Request(f"{self.url}/{place}", body, {"Content-Type": f"multipart/form-data; boundary={mark}"})
        try:
            with urllib.request.urlopen(request, timeout=self.seconds) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            raise EngineError(f"{request.full_url} answers {error.code}") from error
        except OSError as error:  # refused, lost, too late
            raise EngineError(f"{request.full_url} can't be reached: {error}") from error
        except ValueError as error:
            raise EngineError(f"{request.full_url} doesn't answer in JSON") from error

    def detect(self, image: bytes) -> list[dict]:
        try:
            return [{"box": tuple(map(int, d["box"][:4])), "type": str(d["type"]), "latex": str(d["latex"]).strip(), "score": float(d["score"])} for d in self._post("detect", image)]
        except (TypeError, KeyError, ValueError, IndexError) as error:
            raise EngineError(f"the answer lacks something: {error!r}") from error

    def recognize(self, image: bytes, box: tuple[int, int, int, int]) -> str:
        if self.cut is None:
            raise EngineError("boxes can't be cut out")
        try:
            return str(self._post("recognize", self.cut(image, box))["latex"]).strip()
        except (TypeError, KeyError) as error:
            raise EngineError(f"the answer lacks something: {error!r}") from error


def crop(pixels: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The part of an image (rows, columns, colours) that lies in a box; an EngineError if none does."""
    height, width = pixels.shape[:2]
    x1, x2 = (min(max(v, 0), width) for v in (box[0], box[2]))
    y1, y2 = (min(max(v, 0), height) for v in (box[1], box[3]))
    if x2 <= x1 or y2 <= y1:
        raise EngineError(f"no part of {width} x {height} lies in {box}")
    return pixels[y1:y2, x1:x2]


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of an image (rows, columns, three colours of 8 bits)."""
    rows = np.ascontiguousarray(rgb, dtype=np.uint8)
    lines = np.concatenate([np.zeros((rows.shape[0], 1), np.uint8), rows.reshape(rows.shape[0], -1)], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def analyze_pages(images: DataFrame, make: Callable[[], PageAnalyzer]) -> DataFrame:
    """Page analyses of book_id, page_index, img; filter pages before, for each image is read here."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for frame in frames:
            rows = [engine.analyze(img) for img in frame["img"]]
            yield pd.DataFrame({"book_id": frame["book_id"], "page_index": frame["page_index"]} | {c: [r.get(c) for r in rows] for c in ("raw_markdown", "figure_paths", "paragraphs", "words")})

    return images.select("book_id", "page_index", "img").mapInPandas(run, schemas.PAGE_ANALYSIS)


def detect_formulas(images: DataFrame, make: Callable[[], FormulaDetector]) -> DataFrame:
    """Detections of book_id, page_index, img, numbered by page."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for frame in frames:
            rows = [(b, p, i, dict(zip(("x1", "y1", "x2", "y2"), map(int, d["box"]))), d["type"], d["latex"].strip(), float(d["score"])) for b, p, img in zip(frame["book_id"], frame["page_index"], frame["img"]) for i, d in enumerate(engine.detect(img))]
            yield pd.DataFrame(rows, columns=["book_id", "page_index", "det_idx", "box", "type", "latex", "score"])

    return images.select("book_id", "page_index", "img").mapInPandas(run, schemas.DETECTIONS)


def recognizer(images: DataFrame, make: Callable[[], FormulaRecognizer]) -> Callable[[DataFrame], DataFrame]:
    """For overlay.replacements(): reads changed boxes again; a failure gives null, which keeps the old formula."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()

        def one(img, box):
            try:
                return engine.recognize(img, (box["x1"], box["y1"], box["x2"], box["y2"]))
            except (EngineError, ValueError, OSError):
                return None

        for frame in frames:
            yield frame[["book_id", "page_index", "det_idx"]].assign(new_latex=[one(i, b) for i, b in zip(frame["img"], frame["trimmed"])])

    def again(changed: DataFrame) -> DataFrame:
        rows = changed.select("book_id", "page_index", "det_idx", "trimmed").join(images.select("book_id", "page_index", "img"), ["book_id", "page_index"])
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return rows.mapInPandas(run, f"book_id {kinds['book_id']}, page_index {kinds['page_index']}, det_idx {kinds['det_idx']}, new_latex string")

    return again
