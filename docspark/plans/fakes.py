"""Engines that read nothing but the bytes of test images, which are texts."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from ..sources.engines import EngineError

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: the paragraph that the analyzer finds on each page.
PARAGRAPH = "sigma"


class Reader:
    """A page says "read", the paragraph, and its own text; a word lies over the paragraph's left half."""

    def analyze(self, image: bytes) -> dict:
        paragraph = {"box": [0, 0, 100, 40], "contents": PARAGRAPH, "role": None, "direction": "horizontal", "order": 0}
        return {"raw_markdown": f"read {PARAGRAPH} {image.decode()}", "figure_paths": [], "paragraphs": [paragraph], "words": [{"points": [[0, 0], [50, 0], [50, 40], [0, 40]], "content": "漢字語"}, {"points": [[60, 0], [90, 0], [90, 40], [60, 40]], "content": PARAGRAPH}]}


class Finder:
    """A formula over the whole paragraph; long pages' formulas can't be read again."""

    def detect(self, image: bytes) -> list[dict]:
        return [{"box": (0, 0, 100, 40), "type": "isolated", "latex": f"n_{len(image)}", "score": 0.5}]

    def recognize(self, image: bytes, box: tuple[int, int, int, int]) -> str:
        if len(image) % 2:
            raise EngineError("odd")
        return f"m_{len(image)}^{box[0]}"
