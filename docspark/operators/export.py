"""Books as Markdown, plain text, chapter files, asset maps and a word layer for PDF."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..functions import epub as E
from ..functions import patterns as P
from ..functions import pdf as D
from ..functions import text as T

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points per inch, smallest font.
POINTS, LEAST_FONT = 72.0, 4.0
BETWEEN = "\n\n"
#: The last component of a path.
BASE = r"([^/]+)/*$"


def _ordered(rows: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Texts of each group joined in page order."""
    pages = F.array_sort(F.collect_list(F.when(F.col("page_index").isNotNull(), F.struct("page_index", F.col(text).alias("t")))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(pages, lambda p: p["t"]), BETWEEN).alias("content"))


def page_text(pages: DataFrame) -> DataFrame:
    """Pages with text as exported: image paths cut to names where the page has assets."""
    return pages.withColumn("text", T.image_basenames(F.coalesce("markdown", F.lit("")), F.size(F.coalesce("assets", F.array().cast("array<string>"))) > 0) if "assets" in pages.columns else F.coalesce("markdown", F.lit("")))


def markdown(pages: DataFrame, combine: bool = True, stem: str = "book") -> DataFrame:
    """book_id, name, content: a file per book, or per page."""
    rows = page_text(pages)
    if combine:
        return _ordered(rows, ["book_id"]).select("book_id", F.lit(f"{stem}.md").alias("name"), "content")
    return rows.select("book_id", T.page_filename(F.col("page_index"), ".md").alias("name"), F.col("text").alias("content"))


def plaintext(pages: DataFrame, combine: bool = True, stem: str = "book") -> DataFrame:
    """As markdown(), with marks taken out."""
    rows = pages.withColumn("text", T.plaintext(F.coalesce("markdown", F.lit(""))))
    if combine:
        return _ordered(rows, ["book_id"]).select("book_id", F.lit(f"{stem}.txt").alias("name"), "content")
    return rows.select("book_id", T.page_filename(F.col("page_index"), ".txt").alias("name"), F.col("text").alias("content"))


def by_chapter(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, ord, name, content: a file per chapter; missing pages are passed over, a chapter without pages is empty."""
    rows = page_text(pages).select("book_id", "page_index", "text").alias("p")
    c = chapters.alias("c")
    within = (F.col("c.book_id") == F.col("p.book_id")) & F.col("p.page_index").between(F.col("c.start_page"), F.col("c.end_page"))
    held = c.join(rows, within, "left").select("c.book_id", "c.ord", "c.kind", "c.title", "p.page_index", "p.text")
    return _ordered(held, ["book_id", "ord", "kind", "title"]).select("book_id", "ord", T.chapter_filename(F.col("ord"), F.col("kind"), F.col("title")).alias("name"), "content")


def asset_names(pages: DataFrame) -> DataFrame:
    """book_id, page_index, pos, path, name: a file name of its own for each asset of a book.

    Assets take their names in order of page and place.  A name that is taken by then, as it is or as one made so, gets the
    lowest number from 1 before its ending that makes a free one.  So a book's assets, only their paths, meet in one task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page_index", "pos"], kind="stable")
        used: set[str] = set()
        least: dict[str, int] = {}  # by name: numbers below are taken
        names = []
        for base in rows.pop("base"):
            name = base
            if name in used:
                cut = base.rfind(".")
                stem, ending = (base[:cut], base[cut:]) if 0 < cut < len(base) - 1 else (base, "")
                i = least.get(base, 1)
                while (name := f"{stem}_{i}{ending}") in used:
                    i += 1
                least[base] = i
            used.add(name)
            names.append(name)
        return rows.assign(name=names)

    each = pages.select("book_id", "page_index", F.posexplode("assets").alias("pos", "path")).withColumn("base", F.regexp_extract("path", BASE, 1))
    schema = StructType([*each.schema.fields[:4], StructField("name", StringType())])
    return each.groupBy("book_id").applyInPandas(run, schema)


def rewrite_images(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Pages with markdown whose images, in Markdown or as <img src>, have the assets' new names; links stay.

    An image means an asset by its path or as figures/<base name>: one of its own page, else the last such of the book.  Each image is looked up
    once, so a new name that is another's old one isn't changed again; images that mean no asset stay.
    """
    both = names.select("book_id", "page_index", "pos", "name", F.explode(F.array("path", F.concat(F.lit("figures/"), F.regexp_extract("path", BASE, 1)))).alias("was"))
    pick = F.max_by("name", F.struct("page_index", "pos")).alias("name")
    table = F.map_from_entries(F.collect_list(F.struct("was", "name")))
    of_page = both.groupBy("book_id", "page_index", "was").agg(pick).groupBy("book_id", "page_index").agg(table.alias("of_page"))
    of_book = both.groupBy("book_id", "was").agg(pick).groupBy("book_id").agg(table.alias("of_book"))
    rows = pages.join(of_page, ["book_id", "page_index"], "left").join(of_book, "book_id", "left")
    new = lambda was: F.coalesce(F.col("of_page")[was], F.col("of_book")[was], was)
    text = T.replace_found(F.col("markdown"), P.IMAGE, 2, lambda g: F.concat(F.lit("!["), g[0], F.lit("]("), new(g[1]), F.lit(")")))
    text = T.replace_found(text, P.IMG_TAG, 3, lambda g: F.concat(F.lit("<img "), g[0], F.lit('src="'), new(g[1]), F.lit('"'), g[2], F.lit(">")))
    return rows.withColumn("markdown", text).select(*pages.columns)


def assets_by_name(pages: DataFrame) -> DataFrame:
    """book_id, name, path for writers.copy_files(): assets under their own names, the last of a name in the book."""
    each = pages.select("book_id", "page_index", F.posexplode("assets").alias("pos", "path")).withColumn("name", F.regexp_extract("path", BASE, 1))
    return each.groupBy("book_id", "name").agg(F.max_by("path", F.struct("page_index", "pos")).alias("path"))


def epub(pages: DataFrame, stem: str = "book", title: str = "Document") -> DataFrame:
    """book_id, name, content (bytes): an EPUB of each book, with its images, which executors read from their paths.

    A book is one file, so one task makes it.  Without pages there is no book.
    """
    names = asset_names(pages)
    texts = _ordered(rewrite_images(pages, names).withColumn("text", F.coalesce("markdown", F.lit(""))), ["book_id"])
    images = names.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("name", "path"))).alias("images"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # books may be large
                book, text, held = (batch[c][i].as_py() for c in ("book_id", "content", "images"))
                data = E.book(title, str(book), text, [(x["name"], x["path"]) for x in held or []])
                yield pa.RecordBatch.from_arrays([batch["book_id"].slice(i, 1), pa.array([f"{stem}.epub"]), pa.array([data], pa.binary())], names=["book_id", "name", "content"])

    rows = texts.join(images, "book_id", "left")
    return rows.mapInArrow(run, StructType([rows.schema["book_id"], StructField("name", StringType()), StructField("content", BinaryType())]))


def with_source_page(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages (book_id, page_index) with source_index: their page of the book's `sources` (book_id, page_index), the last where it lacks theirs."""
    last = sources.groupBy("book_id").agg((F.count_distinct("page_index") - 1).cast("int").alias("last"))
    return pages.join(last, "book_id").withColumn("source_index", F.least("page_index", "last").cast("int")).drop("last")


def searchable_pdf(pages: DataFrame, sources: DataFrame, words: DataFrame, dpi: int = 200, stem: str = "book") -> DataFrame:
    """book_id, name, content (bytes): a PDF of each book's `pages` (book_id, page_index), its images under invisible words.

    sources: book_id, page_index, width, height (points) and jpeg (null: an empty background); a page that the book lacks shows its
    last.  words: book_id, page_index, word_idx, content, box (pixels at `dpi`); pages without words show their image alone.
    A book is one file, so one task makes it.
    """
    if dpi < 1:
        raise ValueError("dpi starts at 1")
    rows = with_source_page(pages.select("book_id", "page_index").distinct(), sources)
    shown = sources.select("book_id", F.col("page_index").cast("int").alias("source_index"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "jpeg")
    rows = rows.join(shown, ["book_id", "source_index"])
    scale = POINTS / dpi
    placed = words.where("content <> '' and box is not null").select("book_id", "page_index", F.struct("word_idx", (F.col("box.x1") * scale).alias("x"), (F.col("box.y2") * scale).alias("down"), F.greatest(F.lit(LEAST_FONT), (F.col("box.y2") - F.col("box.y1")) * scale).alias("font"), "content").alias("w"))
    rows = rows.join(placed.groupBy("book_id", "page_index").agg(F.array_sort(F.collect_list("w")).alias("words")), ["book_id", "page_index"], "left")

    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by("page_index")
        made = [D.Page(r["width"], r["height"], r["jpeg"], [(w["x"], r["height"] - w["down"], w["font"], w["content"]) for w in r["words"] or []]) for r in held.to_pylist()]
        return pa.table([held["book_id"].slice(0, 1), pa.array([f"{stem}.pdf"]), pa.array([D.document(made)], pa.binary())], names=["book_id", "name", "content"])

    schema = StructType([rows.schema["book_id"], StructField("name", StringType()), StructField("content", BinaryType())])
    return rows.select("book_id", "page_index", "width", "height", "jpeg", "words").groupBy("book_id").applyInArrow(run, schema)


def word_layer(words: DataFrame, page_height: float, dpi: int) -> DataFrame:
    """Words with x, y, font in points: the invisible text of a searchable page; words without content or box go."""
    scale = POINTS / dpi
    shown = words.where("content <> '' and box is not null")
    return shown.select(
        "book_id",
        "page_index",
        "word_idx",
        "content",
        (F.col("box.x1") * F.lit(scale)).alias("x"),
        (F.lit(float(page_height)) - F.col("box.y2") * F.lit(scale)).alias("y"),
        F.greatest(F.lit(LEAST_FONT), (F.col("box.y2") - F.col("box.y1")) * F.lit(scale)).alias("font"),
    )


