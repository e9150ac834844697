"""Page selection and the page cache."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PageRangeError(ValueError):
    """A page range that can't be read, runs backwards or leaves the book."""


def page_numbers(spec: str | None, total: int) -> list[int]:
    """The pages, from 1, that a range like "1,3-5,10" names, each once in order; None names all."""
    if spec is None:
        return list(range(1, total + 1))
    named: set[int] = set()
    for part in spec.split(","):
        found = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not found:
            raise PageRangeError(f"no page range: {part!r} in {spec!r}")
        first, last = int(found[1]), int(found[2] or found[1])
        if not 1 <= first <= last <= total:
            raise PageRangeError(f"{part.strip()} isn't within 1 to {total}")
        named.update(range(first, last + 1))
    return sorted(named)


def parse_ranges(specs: DataFrame) -> DataFrame:
    """book_id, page_index for every page that a book's `spec` names; `total` bounds it, a null spec names all.

    Books whose spec is no good give no rows; range_errors() tells them.
    """
    part = F.explode(F.split(F.coalesce("spec", F.concat(F.lit("1-"), F.col("total").cast("string"))), ","))
    ranges = specs.join(range_errors(specs).select("book_id"), "book_id", "left_anti").where("total > 0").select("book_id", part.alias("part"))
    first, last = F.regexp_extract("part", r"^\s*(\d+)", 1).cast("int"), F.regexp_extract("part", r"(\d+)\s*$", 1).cast("int")
    return ranges.select("book_id", F.explode(F.sequence(first - 1, last - 1)).alias("page_index")).distinct()


def range_errors(specs: DataFrame) -> DataFrame:
    """book_id, error for specs that are empty, unreadable, backwards, below 1 or beyond total."""
    number = r"\s*\d{1,9}\s*"
    readable = F.regexp_like("spec", F.lit(rf"^{number}(-{number})?(,{number}(-{number})?)*$"))
    parts = F.split("spec", ",")
    ends = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*(\d+)", 1).try_cast("int").alias("a"), F.regexp_extract(p, r"(\d+)\s*$", 1).try_cast("int").alias("b")))
    error = (
        F.when(F.trim("spec") == "", "empty")
        .when(~readable, "unreadable")
        .when(F.exists(ends, lambda e: e["a"] > e["b"]), "backwards")
        .when(F.exists(ends, lambda e: e["a"] < 1), "below 1")
        .when(F.exists(ends, lambda e: e["b"] > F.col("total")), "beyond total")
    )
    return specs.where("spec is not null").select("book_id", error.alias("error")).where("error is not null")


def select_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages whose (book_id, page_index) are wanted."""
    return pages.join(wanted, ["book_id", "page_index"], "left_semi")


def split_cached(pages: DataFrame, cache: DataFrame, use_cache: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses); a hit has both analysis and raw Markdown in the cache.

    The key holds the settings that change a page's analysis: book hash, settings hash, page.
    """
    key = ["sha8", "settings", "page_index"]
    whole = cache.where("analysis is not null and raw_markdown is not null")
    if not use_cache:
        return pages.join(whole, key).limit(0), pages
    return pages.join(whole, key), pages.join(whole.select(*key), key, "left_anti")
