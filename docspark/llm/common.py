"""Shared helpers: word expressions, SQL `let`, joins with few ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch_dir, scratch_table  # noqa: F401

#: Fixed value: what separates words (space and the ASCII control blanks).
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch that goes to a Python worker at most, as texts may be long; a smaller setting of the session stays.
ARROW_ROWS = 2_500


def small_batches(spark: SparkSession) -> None:
    """Have the session send texts to Python in batches of ARROW_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def words_sql(text: str) -> str:
    """SQL for the array of words of a text; null and blank texts have none."""
    return rf"array_remove(split(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), '')"


def n_words(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.size(F.array_remove(F.split(F.coalesce(col, F.lit("")), BLANKS), "")).cast("long")


def let(value: str, name: str, body: str) -> str:
    """SQL that computes `value` once and binds it to `name` in `body`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def count_bits(n: int, per_bucket: int, base: int) -> int:
    """How many base-`base` digits split n rows into buckets of about per_bucket rows."""
    digits, buckets = 1, base
    while n / buckets > per_bucket:
        digits, buckets = digits + 1, buckets * base
    return digits


#: Rows of ids up to which a side is broadcast (about 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def narrow(rows: DataFrame, wanted: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """`rows` joined with the ids in `wanted`, which are broadcast if they are counted to be few."""
    wanted = scratch_table(wanted, "wanted")
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, on, how)


def without(rows: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """Rows of `rows` that match none of `gone`, which is broadcast if it is counted to be small."""
    return narrow(rows, gone, on, "left_anti")


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that `rows` doesn't have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name
