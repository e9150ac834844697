"""Exact length histogram: documents per encoded length, with suffix sums that answer every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import scratch_table

#: Lengths per block: suffix sums run inside blocks and over blocks.
BLOCK = 128


def histogram(lengths: DataFrame) -> DataFrame:
    """From n_tokens per document: a row per distinct length with

    n_docs, docs_from (documents of this length or more), tokens_from (their tokens), tokens_total,
    truncated_total (tokens if every document were cut to this length), docs_to (documents of this length
    or less), share_to (their share, so the q-quantile is the first length with share_to >= q).
    Null lengths are left out; an empty table gives no rows.  The counts, a row per length, are written before they are
    used, so what makes the lengths runs once.
    """
    counts = lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = scratch_table(counts, "lengths").withColumns({"tokens": F.col("n_docs") * F.col("n_tokens"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(every).alias("docs_total"),
        F.sum("block_tokens").over(every).alias("tokens_total"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = counts.join(blocks, "block").withColumns(
        {"docs_from": F.sum("n_docs").over(inside) + F.col("docs_above"), "tokens_from": F.sum("tokens").over(inside) + F.col("tokens_above")}
    )
    shorter = F.col("docs_total") - F.col("docs_from")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        (shorter + F.col("n_docs")).alias("docs_to"),
        ((shorter + F.col("n_docs")) / F.col("docs_total")).alias("share_to"),
    )


def answers(hist: DataFrame, limits: list[int], quantiles: list[float] = ()) -> DataFrame:
    """kind (limit or quantile), at, value: truncated totals at any limits, and length quantiles, from the histogram.

    A limit between two lengths takes the suffix sums of the next length above it.
    """
    parts = []
    for limit in limits:
        over = F.col("n_tokens") > limit
        cut = F.coalesce(F.sum(F.when(~over, F.col("n_tokens") * F.col("n_docs"))), F.lit(0)) + limit * F.coalesce(F.max(F.when(over, F.col("docs_from"))), F.lit(0))
        parts.append(hist.agg(F.lit("limit").alias("kind"), F.lit(float(limit)).alias("at"), cut.cast("long").alias("value")))
    for q in quantiles:
        parts.append(hist.where(F.col("share_to") >= q).agg(F.lit("quantile").alias("kind"), F.lit(float(q)).alias("at"), F.min("n_tokens").cast("long").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
