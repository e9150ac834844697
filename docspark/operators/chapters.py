"""Chapter boundaries from a syllabus, bookmarks, a printed table of contents, or headings in the text.

pages: book_id, page_index, markdown, raw_markdown (null: markdown counts).  Results: book_id, ord, kind,
chapter_number, title, start_page, end_page, source.  A detector gives no rows for books it can't read.
All keys start with book_id, so books spread over the cluster; one book's pages meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import headings as H
from ..functions import patterns as P
from ..functions.text import lines, strip
from ..sources.shared import scratch_table

COLUMNS = ("book_id", "ord", "kind", "chapter_number", "title", "start_page", "end_page", "source")


def source_text() -> Column:
    """What detectors read: the text before formulas were put in."""
    return F.coalesce("raw_markdown", "markdown")


def build(starts: DataFrame, source: str) -> DataFrame:
    """Chapters from book_id, kind, chapter_number, title, start_page, pos, total_pages.

    In order of start, kind, pos; each ends before the next starts, so of two on a page the first is empty.
    """
    rank = F.array_position(F.array(*map(F.lit, P.KINDS)), F.col("kind"))
    order = W.partitionBy("book_id").orderBy("start_page", rank, "pos")
    end = F.coalesce(F.lead("start_page").over(order), F.col("total_pages")) - 1
    out = starts.withColumns({"ord": (F.row_number().over(order) - 1).cast("int"), "end_page": end.cast("int"), "source": F.lit(source)})
    return out.withColumn("start_page", F.col("start_page").cast("int")).select(*COLUMNS)


def _totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg(F.count(F.lit(1)).cast("int").alias("total_pages"))


def body_headings(pages: DataFrame) -> DataFrame:
    """From pages that open with a chapter heading and hold one chapter heading only."""
    text = source_text()
    found = pages.select("book_id", "page_index", H.first_h1(text).alias("heading"), H.heading_count(text).alias("n"))
    found = found.withColumn("total_pages", F.count(F.lit(1)).over(W.partitionBy("book_id")).cast("int"))
    found = found.where("heading is not null and n <= 1").withColumn("c", H.classify(F.col("heading"))).where("c.kind is not null")
    starts = found.select("book_id", "c.kind", "c.chapter_number", H.clean_title(F.col("heading"), F.col("c.kind")).alias("title"), F.col("page_index").alias("start_page"), F.col("page_index").alias("pos"), "total_pages")
    return build(starts, "body_headings")


def bookmarks(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """From bookmarks: book_id, pos, title, page_no (from 1; null or 0 count as the first page)."""
    title = F.coalesce("title", F.lit(""))
    found = toc.withColumn("c", H.classify(title)).where("c.kind is not null").join(_totals(pages), "book_id", "left")
    start = F.coalesce(F.nullif("page_no", F.lit(0)), F.lit(1)) - 1
    starts = found.select("book_id", "c.kind", "c.chapter_number", H.clean_title(title, F.col("c.kind")).alias("title"), start.alias("start_page"), "pos", F.coalesce("total_pages", F.lit(0)).alias("total_pages"))
    return build(starts, "pdf_toc")


def syllabus_titles(cells: DataFrame) -> DataFrame:
    """book_id, k (from 1), title of the cells (book_id, pos, cell) that name a chapter."""
    title = strip(F.regexp_extract(strip(F.col("cell")), P.SYLLABUS, 2))
    found = cells.where(F.regexp_like(strip(F.col("cell")), F.lit(P.SYLLABUS))).select("book_id", "pos", title.alias("title"))
    return found.select("book_id", F.row_number().over(W.partitionBy("book_id").orderBy("pos")).alias("k"), "title")


def cells_of(html: DataFrame) -> DataFrame:
    """book_id, pos, cell: the text of each table cell of a book's syllabus page."""
    inner = F.regexp_extract_all("html", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    return html.select("book_id", F.posexplode(inner).alias("pos", "cell")).withColumn("cell", strip(F.regexp_replace("cell", "(?s)<[^>]*>", "")))


def syllabus(cells: DataFrame, pages: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """Body headings of books with a syllabus; its titles in their place where it has as many chapters.

    body: body_headings(pages), if it is at hand.
    """
    titles = syllabus_titles(cells)
    counts = titles.groupBy("book_id").agg(F.count(F.lit(1)).alias("listed"))
    of_kind = W.partitionBy("book_id", "kind").orderBy("ord")
    body = (body_headings(pages) if body is None else body).join(counts, "book_id").withColumns({"k": F.row_number().over(of_kind), "in_body": F.sum((F.col("kind") == "chapter").cast("int")).over(W.partitionBy("book_id"))})
    named = body.join(titles.withColumnRenamed("title", "given"), ["book_id", "k"], "left")
    title = F.when((F.col("kind") == "chapter") & (F.col("in_body") == F.col("listed")), F.col("given")).otherwise(F.col("title"))
    return named.withColumns({"title": title, "source": F.lit("syllabus")}).select(*COLUMNS)


def _numbered(pages: DataFrame) -> DataFrame:
    """The pages that are searched for a table of contents, with text and total_pages."""
    book = W.partitionBy("book_id")
    ranked = pages.select("book_id", "page_index", source_text().alias("text"), F.row_number().over(book.orderBy("page_index")).alias("rn"), F.count(F.lit(1)).over(book).cast("int").alias("total_pages"))
    return ranked.where(F.col("rn") <= P.TOC_WINDOW)


def _placed(entries: DataFrame, body: DataFrame) -> DataFrame:
    """Printed page numbers turned to page indexes, those within the book.

    entries: book_id, kind, chapter_number, title, printed, pos, toc_index, total_pages.  The first chapter of
    the body tells how far the lowest printed number is off; without it the text starts after the contents.
    """
    first = body.where("kind = 'chapter' and chapter_number = 1").groupBy("book_id").agg(F.min_by("start_page", "ord").alias("one"))
    book = W.partitionBy("book_id")
    lowest = F.min(F.when(F.col("kind") == "chapter", F.col("printed"))).over(book)
    off = F.coalesce(F.col("one") - (lowest - 1), F.col("toc_index") + 1)
    placed = entries.join(first, "book_id", "left").withColumn("start_page", F.greatest(F.lit(0), F.col("printed") - 1 + off))
    return placed.where("start_page < total_pages")


def _contents_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per book, its first page headed 目次 (page_index, text, total_pages); of other books, the pages near the start that list chapter headings (rn, text)."""
    near = _numbered(pages)
    headed = near.where(F.regexp_like("text", F.lit(P.TOC_PAGE)))
    headed = headed.groupBy("book_id").agg(F.min_by(F.struct("page_index", "text", "total_pages"), "rn").alias("p")).select("book_id", "p.*")
    listed = near.join(headed.select("book_id"), "book_id", "left_anti").where(H.heading_count(F.col("text")) > 1)
    return headed, listed


def printed_entries(pages: DataFrame) -> DataFrame:
    """book_id, kind, chapter_number, title, printed, pos, toc_index, total_pages: what the contents pages list."""
    headed, listed = _contents_pages(pages)
    group = lambda i: F.regexp_extract_all("text", F.lit(P.TOC_ENTRY), F.lit(i))
    zipped = F.arrays_zip(group(1).alias("num"), group(2).alias("title"), group(3).alias("printed"))
    entries = headed.select("book_id", F.col("page_index").alias("toc_index"), "total_pages", F.posexplode(zipped).alias("at", "e"))
    entries = entries.select("book_id", F.lit("chapter").alias("kind"), H.number(F.col("e.num")).alias("chapter_number"), strip(F.col("e.title")).alias("title"), F.translate("e.printed", P.FULL_WIDTH, P.ASCII).try_cast("long").alias("printed"), "at", "toc_index", "total_pages")
    entries = entries.where("chapter_number is not null and printed is not null")
    entries = entries.withColumn("pos", F.row_number().over(W.partitionBy("book_id").orderBy("chapter_number", "at"))).drop("at")
    listed = listed.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("texts"), F.min("page_index").alias("toc_index"), F.first("total_pages").alias("total_pages"))
    joined = F.array_join(F.transform("texts", lambda t: t["text"]), "\n")
    each = listed.select("book_id", "toc_index", "total_pages", F.posexplode(lines(joined)).alias("pos", "line"))
    up_to = W.partitionBy("book_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("heading", F.regexp_like("line", F.lit(P.HEADING_LINE)))
    each = each.withColumn("part", F.sum(F.col("heading").cast("int")).over(up_to))
    page = lambda c: F.translate(c, P.FULL_WIDTH, P.ASCII).try_cast("long")
    section = F.when(~F.col("heading"), page(F.regexp_extract("line", P.TOC_SECTION, 1)))
    each = each.withColumn("section", F.first(section, ignorenulls=True).over(W.partitionBy("book_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    front, body = F.regexp_like("line", F.lit(P.TOC_PREFACE)), F.regexp_like("line", F.lit(P.TOC_NUMBERED))
    kind = F.when(front, "preface").when(body, "chapter")
    title = F.when(front, F.regexp_extract("line", P.TOC_PREFACE, 1)).otherwise(strip(F.regexp_extract("line", P.TOC_NUMBERED, 2)))
    printed = F.when(front, page(F.regexp_extract("line", P.TOC_PREFACE, 2))).otherwise(F.coalesce(page(F.regexp_extract("line", P.TOC_NUMBERED, 3)), F.col("section")))
    # the last group is empty, not null, where the line has no page
    found = each.where(front | body).select("book_id", kind.alias("kind"), F.when(~front, H.number(F.regexp_extract("line", P.TOC_NUMBERED, 1))).alias("chapter_number"), title.alias("title"), printed.alias("printed"), "pos", "toc_index", "total_pages")
    found = found.where("printed is not null")
    return entries.select(*found.columns).unionByName(found)


def printed_contents(pages: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """From a page headed 目次, or else pages near the start that list chapter headings.  body: as in syllabus()."""
    return build(_placed(printed_entries(pages), body_headings(pages) if body is None else body), "ocr_toc")


DETECTORS = ("syllabus", "pdf_toc", "ocr_toc", "body_headings")


def detect(pages: DataFrame, toc: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Each book's chapters by the first detector that finds any, in order of DETECTORS.

    The headings of the text, which three detectors use, are written to the shared folder once.
    """
    body = scratch_table(body_headings(pages), "body_headings")
    tries = [syllabus(cells, pages, body) if cells is not None else None, bookmarks(toc, pages) if toc is not None else None, printed_contents(pages, body), body]
    found = None
    for rank, one in enumerate(tries):
        if one is not None:
            one = one.withColumn("rank", F.lit(rank))
            found = one if found is None else found.unionByName(one)
    best = F.min("rank").over(W.partitionBy("book_id"))
    return found.withColumn("best", best).where("rank = best").drop("rank", "best")


def detection_errors(pages: DataFrame, detected: DataFrame, toc: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """book_id, error for books without chapters: on a line each, in order of DETECTORS, why each of them found none.

    Without `cells` the syllabus wasn't asked; without `toc` there are no bookmarks.
    """
    left = pages.select("book_id").distinct().join(detected.select("book_id"), "book_id", "left_anti")
    text = source_text()

    def marked(rows: DataFrame, name: str) -> None:
        nonlocal left
        left = left.join(rows.select("book_id").distinct().withColumn(name, F.lit(True)), "book_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    if cells is not None:
        marked(syllabus_titles(cells), "titles")
    if toc is not None:
        marked(toc, "marks")
    headed, listed = _contents_pages(pages)
    marked(headed.select("book_id").unionByName(listed.select("book_id")), "contents")
    marked(printed_entries(pages), "entries")
    marked(pages.where(H.classify(H.first_h1(text))["kind"].isNotNull()), "headings")
    no_heading = F.when(F.col("headings"), "chapter headings only beside others").otherwise("no chapter heading")
    reasons = [F.concat(F.lit("syllabus: "), F.when(F.col("titles"), no_heading).otherwise("no chapter titles"))] if cells is not None else []
    reasons.append(F.concat(F.lit("pdf_toc: "), F.when(F.col("marks"), "no chapter among the bookmarks").otherwise("no bookmarks") if toc is not None else F.lit("no bookmarks")))
    reasons.append(F.concat(F.lit("ocr_toc: "), F.when(~F.col("contents"), "no contents page").when(~F.col("entries"), "no entries on it").otherwise("no entry within the book")))
    reasons.append(F.concat(F.lit("body_headings: "), no_heading))
    return left.select("book_id", F.array_join(F.array(*reasons), "\n").alias("error"))
