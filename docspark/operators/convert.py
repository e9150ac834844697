"""From page images to files: selection, cache, recognition, formulas and export as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import engines, readers
from ..sources.shared import scratch_table
from . import chapters, export, matching, overlay, pages

FORMATS = ("markdown", "plaintext", "epub")


def run_pages(
    images: DataFrame,
    analyzer: Callable[[], engines.PageAnalyzer],
    wanted: DataFrame | None = None,
    cache: DataFrame | None = None,
    use_cache: bool = True,
    detector: Callable[[], engines.FormulaDetector] | None = None,
    recognizer: Callable[[], engines.FormulaRecognizer] | None = None,
) -> DataFrame:
    """book_id, page_index, markdown, raw_markdown, assets of the wanted pages of `images` (book_id, page_index, img).

    wanted: book_id, page_index; without it all pages.  With a `cache` (which `images` then has sha8 and settings for)
    pages found there aren't read again, unless `use_cache` says no.  With a `detector` formulas are put into the text, and boxes that
    shrink to their formula go to the `recognizer`.  Analyses are written to the shared folder before they are used, so
    that each image is read once.
    """
    images = images.withColumns({"book_id": F.col("book_id").cast("string"), "page_index": F.col("page_index").cast("int")})
    chosen = images if wanted is None else pages.select_pages(images, wanted.select(F.col("book_id").cast("string").alias("book_id"), F.col("page_index").cast("int").alias("page_index")))
    columns = ["book_id", "page_index", "raw_markdown", "assets", "paragraphs", "words"]
    known, unread = None, chosen
    if cache is not None:
        hits, unread = pages.split_cached(chosen, cache, use_cache)
        known = readers.parse_analysis(hits).withColumnRenamed("figures", "assets").select(*columns)
    read = engines.analyze_pages(unread, analyzer).withColumnRenamed("figure_paths", "assets").select(*columns)
    read = scratch_table(read, "analyses")
    rows = read if known is None else known.unionByName(read)
    if detector is None:
        return rows.select("book_id", "page_index", F.col("raw_markdown").alias("markdown"), "raw_markdown", "assets")
    found = scratch_table(engines.detect_formulas(chosen, detector), "detections")
    paragraphs, words = matching.explode_analysis(rows)
    again = engines.recognizer(chosen, recognizer) if recognizer is not None else None
    replaced = overlay.replacements(found, paragraphs, words, again)
    out = overlay.apply(rows.select("book_id", "page_index", "raw_markdown", "assets"), replaced)
    return out.select("book_id", "page_index", "markdown", "raw_markdown", "assets")


def files(converted: DataFrame, form: str = "markdown", combine: bool = True, by_chapter: bool = False, toc: DataFrame | None = None, cells: DataFrame | None = None, stem: str = "book") -> DataFrame:
    """book_id, name, content for writers.write_files(), of pages as run_pages() gives them.

    form: one of FORMATS.  combine: a file per book, else per page.  by_chapter: a Markdown file per chapter instead, found by
    chapters.detect() from syllabus cells, bookmarks and the text; books without chapters give no file (chapters.detection_errors() tells why).
    """
    if form not in FORMATS:
        raise ValueError(f"{form!r} is none of {', '.join(FORMATS)}")
    if by_chapter:
        if form != "markdown":
            raise ValueError("chapters are written as Markdown only")
        return export.by_chapter(converted, chapters.detect(converted, toc, cells)).select("book_id", "name", "content")
    if form == "epub":
        return export.epub(converted, stem=stem)
    return getattr(export, form)(converted, combine, stem)
