"""Books and page caches as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha8
from . import schemas


def books(spark: SparkSession, path: str, settings: str = "") -> DataFrame:
    """book_id (file stem), path, sha8, settings, content of PDF files; the key of the page cache is (sha8, settings)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    return rows.select(stem.alias("book_id"), "path", sha8(F.col("content")).alias("sha8"), F.substring(F.sha2(F.lit(settings), 256), 1, 8).alias("settings"), "content")


def page_cache(spark: SparkSession, path: str) -> DataFrame:
    """sha8, page_index, analysis (JSON text), raw_markdown, figures of <path>/<sha8>/page_NNNN/...; nulls where a file lacks.

    Page folders count from 1.
    """
    place = r"/([0-9a-f]{8})/page_(\d+)/(.+)$"
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{analysis.json,raw.md}")
    keyed = lambda rows, col: rows.select(F.regexp_extract(col, place, 1).alias("sha8"), F.regexp_extract(col, place, 2).try_cast("int").alias("n"), F.regexp_extract(col, place, 3).alias("file"), "*")
    files = keyed(texts.withColumn("path", F.input_file_name()), "path").where("n is not null")
    per = files.groupBy("sha8", "n").agg(F.max(F.when(F.col("file") == "analysis.json", F.col("value"))).alias("analysis"), F.max(F.when(F.col("file") == "raw.md", F.col("value"))).alias("raw_markdown"))
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path).select("path")
    images = keyed(images, "path").where("n is not null and file like 'figures/%'").groupBy("sha8", "n").agg(F.sort_array(F.collect_list("path")).alias("figures"))
    out = per.join(images, ["sha8", "n"], "left")
    return out.select("sha8", (F.col("n") - 1).alias("page_index"), "analysis", "raw_markdown", F.coalesce("figures", F.array().cast("array<string>")).alias("figures"))


def parse_analysis(rows: DataFrame, column: str = "analysis") -> DataFrame:
    """Adds paragraphs and words from analysis JSON; lacking lists are empty, unreadable JSON gives empty lists."""
    parsed = F.from_json(column, schemas.ANALYSIS_JSON)
    out = rows.withColumn("_a", parsed)
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return out.withColumns({"paragraphs": F.coalesce("_a.paragraphs", empty(schemas.PARAGRAPH)), "words": F.coalesce("_a.words", empty(schemas.WORD))}).drop("_a")


def existing(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages with assets cut to those in `files` (path), in order."""
    each = pages.select("book_id", "page_index", F.posexplode("assets").alias("pos", "path")).join(files.select("path").distinct(), "path", "left_semi")
    kept = each.groupBy("book_id", "page_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("assets"))
    return pages.drop("assets").join(kept, ["book_id", "page_index"], "left").withColumn("assets", F.coalesce("assets", F.array().cast("array<string>")))
