"""Registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import headings as H
from ..functions import text as T
from ..operators import chapters, convert, export, matching, overlay, pages
from ..sources import readers
from . import adapters as A
from . import fakes, oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = oracles.ORACLES


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _flat(rows: DataFrame, *names: str) -> DataFrame:
    """Struct boxes as columns of their own."""
    for n in names:
        rows = rows.withColumns({f"{n}_{s}": F.col(f"{n}.{s}") for s in G.SIDES}).drop(n)
    return rows


# pages ------------------------------------------------------------------------------------------------------


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("total"))
    return rows.select(F.col("conv_id").alias("book_id"), F.expr(A.SPEC).alias("spec"), "total")


@query
def page_range_filter(spark, sf_dir):
    rows = A.book_pages(spark, sf_dir)
    return pages.select_pages(rows, pages.parse_ranges(_specs(spark, sf_dir))).select("book_id", "page_index")


@query
def page_range_errors(spark, sf_dir):
    return pages.range_errors(_specs(spark, sf_dir))


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = A.table(spark, sf_dir, "conversations").select(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8).alias("sha8"), F.lit("s").alias("settings"), F.col("turn").alias("page_index"), F.col("conv_id").alias("book_id"), "text")
    cache = rows.where("page_index % 2 = 0").select("sha8", "settings", "page_index", F.when(F.col("book_id") % 3 > 0, F.lit("{}")).alias("analysis"), F.when(F.col("book_id") % 4 > 0, F.col("text")).alias("raw_markdown"))
    return rows.drop("text"), cache


@query
def cache_hits(spark, sf_dir):
    return pages.split_cached(*_cache(spark, sf_dir))[0].select("book_id", "page_index", F.md5("raw_markdown").alias("raw_md5"))


@query
def cache_misses(spark, sf_dir):
    return pages.split_cached(*_cache(spark, sf_dir))[1].select("book_id", "page_index")


@query
def existing_assets(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_index"), F.expr("array('/a/' || conv_id || '.png', '/a/x' || turn || '.png')").alias("assets"))
    files = A.table(spark, sf_dir, "pages").select(F.expr("'/a/' || page_id || '.png'").alias("path")).unionByName(spark.createDataFrame([("/a/x3.png",)], "path string"))
    return readers.existing(rows, files).select("book_id", "page_index", F.array_join("assets", "|").alias("assets"))


@query
def analysis_json(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("page_index"), F.expr(f"""CASE WHEN l_linenumber = 3 THEN '{{}}' WHEN l_linenumber = 4 THEN 'no json' ELSE '{{"paragraphs":[{{"box":[' || {A.BOX[0]} || ',' || {A.BOX[1]} || ',' || {A.BOX[2]} || ',' || {A.BOX[3]} || '],"contents":"c' || l_linenumber || '","role":null}},{{"box":[1,2,3,4],"contents":null}}],"words":[{{"points":[[5,9],[7,1],[2,3],[4,8]],"content":"w"}},{{"points":[],"content":"v"}}]}}' END""").alias("analysis"))
    return _flat(matching.analysis_rows(readers.parse_analysis(rows)).select("book_id", "page_index", "what", "idx", "box", "contents"), "box")


# text -------------------------------------------------------------------------------------------------------


@query
def escape_markdown(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.escape_markdown(F.col("text"))).alias("escaped_md5"))


@query
def plaintext(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.plaintext(F.col("text"))).alias("plain_md5"))


@query
def slug_filename(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").withColumn("title", F.expr("'　a/b: ' || text"))
    return docs.select("doc_id", T.chapter_filename((F.col("doc_id") % 130).cast("int"), F.lit("chapter"), F.col("title")).alias("name"))


@query
def page_filename(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.page_filename((F.col("conv_id") * 10 + F.col("turn")).cast("int"), ".md").alias("name"))


@query
def chapter_number(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").withColumn("raw", F.expr(A.NUMBER_TEXT))
    return rows.select("conv_id", "turn", H.number(F.col("raw")).alias("number"))


@query
def first_h1(spark, sf_dir):
    return A.book_pages(spark, sf_dir).select("book_id", "page_index", H.first_h1(F.col("markdown")).alias("heading"))


@query
def classify_heading(spark, sf_dir):
    rows = A.book_pages(spark, sf_dir).select("book_id", "page_index", H.first_h1(F.col("markdown")).alias("heading")).where("heading is not null")
    rows = rows.withColumn("c", H.classify(F.col("heading")))
    return rows.select("book_id", "page_index", "c.kind", "c.chapter_number", F.when(F.col("c.kind").isNotNull(), H.clean_title(F.col("heading"), F.col("c.kind"))).alias("title"))


@query
def multi_heading_pages(spark, sf_dir):
    rows = A.book_pages(spark, sf_dir)
    return rows.select("book_id", "page_index", H.heading_count(F.col("markdown")).cast("int").alias("headings")).where("headings > 1")


@query
def is_japanese(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(A.WORD_TEXT).alias("content"))
    return rows.select("l_orderkey", "l_linenumber", T.is_japanese(F.col("content")).alias("japanese"))


@query
def content_hash(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), T.sha8(F.col("text")).alias("sha8"))


# chapters ---------------------------------------------------------------------------------------------------


@query
def body_headings(spark, sf_dir):
    return chapters.body_headings(A.book_pages(spark, sf_dir))


@query
def ocr_toc(spark, sf_dir):
    return chapters.printed_contents(A.book_pages(spark, sf_dir))


def _toc(spark: SparkSession, sf_dir: str, titled: str = "true") -> DataFrame:
    """Bookmarks of all pages; those of books that aren't `titled` have no title."""
    rows = A.book_pages(spark, sf_dir)
    title = F.when(F.expr(titled), H.first_h1(F.col("markdown")))
    return rows.select("book_id", F.col("page_index").alias("pos"), title.alias("title"), F.expr("CASE WHEN page_index % 4 = 0 THEN NULL WHEN page_index = 5 THEN 0 ELSE page_index + 1 END").cast("int").alias("page_no"))


@query
def pdf_toc(spark, sf_dir):
    return chapters.bookmarks(_toc(spark, sf_dir), A.book_pages(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str, named: str = "true") -> DataFrame:
    """The cells of a syllabus page made of all turns; those of books that aren't `named` name no chapter."""
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.expr(A.syllabus_row(named)).alias("html")).alias("row"))
    html = rows.groupBy(F.col("conv_id").alias("book_id")).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return chapters.cells_of(html.select("book_id", F.concat(F.lit("<table>"), F.array_join(F.col("rows.html"), "\n"), F.lit("</table>")).alias("html")))


@query
def syllabus_titles(spark, sf_dir):
    return chapters.syllabus_titles(_cells(spark, sf_dir)).select("book_id", F.col("k").cast("int").alias("k"), "title")


@query
def syllabus(spark, sf_dir):
    return chapters.syllabus(_cells(spark, sf_dir), A.book_pages(spark, sf_dir))


@query
def chapter_fallback(spark, sf_dir):
    return chapters.detect(A.book_pages(spark, sf_dir), _toc(spark, sf_dir, "book_id % 3 = 0"), _cells(spark, sf_dir, "conv_id % 7 = 0"))


def _bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every tenth book without what most of its headings and contents are on."""
    return A.book_pages(spark, sf_dir).withColumn("markdown", F.expr("CASE WHEN book_id % 10 = 0 AND page_index NOT IN (2, 4) THEN '' ELSE markdown END"))


@query
def undetected_books(spark, sf_dir):
    rows = _bare(spark, sf_dir)
    toc, cells = _toc(spark, sf_dir, "book_id % 20 = 5"), _cells(spark, sf_dir, "conv_id % 4 = 0")
    return chapters.detection_errors(rows, chapters.detect(rows, toc, cells), toc, cells)


# geometry and matching --------------------------------------------------------------------------------------


@query
def word_bbox(spark, sf_dir):
    x1, y1, x2, y2 = A.WORD_BOX
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(f"array(array({x2}, {y1}), array({x1}, {y2}), array({x1}, {y1}))").alias("points"))
    return _flat(rows.select("l_orderkey", "l_linenumber", G.from_points(F.col("points")).alias("box")), "box")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.paragraphs(spark, sf_dir).select("book_id", "para_idx", F.col("box").alias("p"))
    return A.detections(spark, sf_dir).select("book_id", "det_idx", "box").join(p, "book_id")


@query
def iou(spark, sf_dir):
    return _pairs(spark, sf_dir).select("book_id", "det_idx", "para_idx", G.iou(F.col("box"), F.col("p")).alias("iou"), G.ioa(F.col("box"), F.col("p")).alias("ioa"))


@query
def clamp_box(spark, sf_dir):
    rows = A.words(spark, sf_dir)
    return _flat(rows.select("book_id", "word_idx", G.clamp(F.col("box"), F.lit(100), F.lit(25)).alias("box")), "box")


@query
def ioa_match(spark, sf_dir):
    out = matching.match_paragraphs(A.detections(spark, sf_dir), A.paragraphs(spark, sf_dir))
    return out.select("book_id", "det_idx", F.col("p.para_idx").alias("para_idx"))


@query
def words_in_paragraph(spark, sf_dir):
    return matching.words_in_paragraphs(A.words(spark, sf_dir), A.paragraphs(spark, sf_dir)).select("book_id", "para_idx", "word_idx")


@query
def trim_bbox(spark, sf_dir):
    out = matching.trim_japanese(A.detections(spark, sf_dir), A.words(spark, sf_dir))
    return _flat(out.select("book_id", "det_idx", "trimmed"), "trimmed")


@query
def reading_order(spark, sf_dir):
    rows = matching.reading_order(A.words(spark, sf_dir), F.when(F.col("book_id") % 2 == 0, "vertical").otherwise("horizontal"))
    return rows.select("book_id", "word_idx", F.col("place").cast("int").alias("place"))


@query
def nth_occurrence_match(spark, sf_dir):
    out = matching.lines_to_words(A.paragraphs(spark, sf_dir), A.words(spark, sf_dir))
    return _flat(out.select("book_id", "para_idx", "line", "content", "box"), "box")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matching.match_paragraphs(A.detections(spark, sf_dir), A.paragraphs(spark, sf_dir), 0.1)
    return matching.spans(matching.lines_to_words(A.paragraphs(spark, sf_dir), A.words(spark, sf_dir), 0.1), matched, 0.1)


@query
def contiguous_span(spark, sf_dir):
    return _spans(spark, sf_dir).select("book_id", "para_idx", "det_idx", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@query
def span_collect(spark, sf_dir):
    runs = overlay.inline_spans(_spans(spark, sf_dir))
    return runs.select("book_id", "para_idx", F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["first"], r["last"], r["latex"])), "|").alias("runs"))


@query
def inline_rebuild(spark, sf_dir):
    runs = overlay.inline_spans(_spans(spark, sf_dir))
    parts = F.array(*map(F.lit, ("x", "漢字語", "y\\*", "x", "z_1")))
    return runs.select("book_id", "para_idx", overlay.rebuild(parts, F.col("runs")).alias("text"))


@query
def display_first(spark, sf_dir):
    out = overlay.first_display(matching.match_paragraphs(A.detections(spark, sf_dir), A.paragraphs(spark, sf_dir)))
    return out.select("book_id", "det_idx", F.col("p.para_idx").alias("para_idx"))


@query
def overlay_fold(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_index"), F.col("text").alias("raw_markdown"))
    # needles of all kinds: found, found once replaced, empty, lacking
    steps = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("phase", "ord", "needle", "replacement"), step))) for step in ((0, 0, "a", "[e]"), (0, 1, "e", "<a>"), (0, 2, "", "^"), (1, 0, "zzzz", "!"), (1, 1, "a", "$x$"))))
    replaced = rows.select("book_id", "page_index", F.inline(steps))
    return overlay.apply(rows, replaced).select("book_id", "page_index", F.md5("markdown").alias("markdown_md5"))


@query
def formula_replacements(spark, sf_dir):
    out = overlay.replacements(A.detections(spark, sf_dir), A.paragraphs(spark, sf_dir), A.words(spark, sf_dir))
    return out.select("book_id", "phase", "ord", "needle", "replacement")


@query
def formula_rerecognition(spark, sf_dir):
    # an engine that can't read every fifth box
    again = lambda changed: changed.select("book_id", "page_index", "det_idx", F.when(F.col("det_idx") % 5 > 0, F.concat(F.lit("n"), F.col("trimmed.x2") - F.col("trimmed.x1"))).alias("new_latex"))
    out = overlay.replacements(A.detections(spark, sf_dir), A.paragraphs(spark, sf_dir), A.words(spark, sf_dir), again)
    return out.select("book_id", "phase", "ord", "needle", "replacement")


@query
def run_pages(spark, sf_dir):
    """Selection, cache, analysis, detection and re-recognition together, with engines that read texts."""
    _, cache = _cache(spark, sf_dir)
    rows = A.table(spark, sf_dir, "conversations").where("text is not null")
    images = rows.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_index"), F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8).alias("sha8"), F.lit("s").alias("settings"), F.encode("text", "UTF-8").alias("img"))
    cache = cache.withColumns({"page_index": F.col("page_index").cast("int"), "figures": F.array().cast("array<string>")})
    out = convert.run_pages(images, fakes.Reader, pages.parse_ranges(_specs(spark, sf_dir)), cache, detector=fakes.Finder, recognizer=fakes.Finder)
    return out.select("book_id", "page_index", F.md5("raw_markdown").alias("raw_md5"), F.md5("markdown").alias("markdown_md5"))


@query
def markdown_assets(spark, sf_dir):
    return export.assets_by_name(_asset_pages(spark, sf_dir))


# export -----------------------------------------------------------------------------------------------------


@query
def chapter_export(spark, sf_dir):
    rows = A.book_pages(spark, sf_dir)
    return export.by_chapter(rows, chapters.body_headings(rows)).select("book_id", "ord", "name", F.md5("content").alias("content_md5"))


@query
def combine_markdown(spark, sf_dir):
    return export.markdown(A.book_pages(spark, sf_dir)).select("book_id", "name", F.md5("content").alias("content_md5"))


@query
def combine_plaintext(spark, sf_dir):
    return export.plaintext(A.book_pages(spark, sf_dir)).select("book_id", "name", F.md5("content").alias("content_md5"))


@query
def page_files(spark, sf_dir):
    return export.markdown(A.book_pages(spark, sf_dir), combine=False).select("book_id", "name", F.md5("content").alias("content_md5"))


def _asset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_index"), F.expr(A.PAGE_IMAGES).alias("markdown"), F.expr(f"CASE WHEN turn % 3 = 0 THEN array({', '.join(A.PAGE_ASSETS)}) ELSE cast(array() as array<string>) END").alias("assets"))


@query
def asset_rewrite(spark, sf_dir):
    return export.page_text(_asset_pages(spark, sf_dir)).select("book_id", "page_index", "text")


@query
def asset_dedup(spark, sf_dir):
    return export.asset_names(_asset_pages(spark, sf_dir)).select("book_id", "page_index", "pos", "name")


@query
def image_sources(spark, sf_dir):
    rows = _asset_pages(spark, sf_dir)
    return export.rewrite_images(rows, export.asset_names(rows)).select("book_id", "page_index", "markdown")


@query
def pdf_word_layer(spark, sf_dir):
    return export.word_layer(A.words(spark, sf_dir), 842.0, 200).select("book_id", "word_idx", "content", "x", "y", "font")
