"""A folder of page analyses watched as a stream: an extension, with the same column functions as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plaintext
from ..sources import schemas


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of PAGES_MD rows from Parquet files that arrive in `folder`."""
    return spark.readStream.schema(schemas.PAGES_MD).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def plaintext_pages(pages: DataFrame) -> DataFrame:
    """book_id, page_index, text; stateless, so it runs on streams and batches alike."""
    return pages.select("book_id", "page_index", plaintext(F.coalesce("markdown", F.lit(""))).alias("text"))
