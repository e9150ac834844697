"""Mix sources to target weights.

Every document gets a hash-random key.  Within each source the documents are range-split by that key and word counts
are summed per range; prefix sums, first over wide ranges, then over the narrow ranges of one wide range, then over
the keys of one narrow range, find the key at which each source's exact budget cuts, whole epochs first.
What a document gives then follows from its key and its source's cut, so no document moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_IDS, count_bits, n_words, scratch_table

#: Rows that one range of one source should hold at most, about.
ROWS_PER_RANGE = 2_000


def targets(sizes: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: source, no_source, source_size, weight, target, budget.

    `sizes` has source and size.  Sources in code point order, null last, take the weights in turn.  Targets
    share the total by weight; a source above `cap` times its size is held there and the excess goes to the
    others by weight.  With sources in ascending order of cap per weight, the common level is the largest of
    (total - caps before) / (weights from here on).
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").isNull(), "source")
    every = W.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumns({"weight": weight, "total": F.sum("source_size").over(every), "most": F.col("source_size") * cap})
    filling = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("most").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("level", (F.col("total") - before) / onward)
    by = by.withColumn("level", F.max("level").over(every))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return by.select("source", F.col("source").isNull().alias("no_source"), "source_size", "weight", target.alias("target"), F.floor(target).cast("long").alias("budget"))


def _size_and_key(seed: str) -> tuple[Column, Column]:
    """Words of the text, and the key: of id and text, so that only rows that repeat both share one."""
    return n_words("text"), F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")))))


def _cuts(sized: DataFrame, weights, cap: int, rows_per_range: int) -> DataFrame:
    """Per source of `sized` (source, size, key): name, no_source, source_size, target, epochs, cut (key), share.

    A source gives `epochs` times all its words, and once more those before its cut; each row at the cut gives `share` words.
    """
    digits = count_bits(sized.count(), rows_per_range, 16)
    by = ["name", "no_source"]
    named = sized.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_source"), "size", "key")
    goal = targets(sized, weights, cap).withColumn("name", F.coalesce("source", F.lit(""))).drop("source")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = scratch_table(goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "goal")

    def reached(rows: DataFrame, part: str) -> DataFrame:
        """The part of each source (with its rest) in which the rest ends, and the rest from there on."""
        before = F.coalesce(F.sum("words").over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("left", F.col("rest") - before)
        return rows.where("left >= 0 and left < words").drop("rest", "words").withColumnRenamed("left", "rest")

    ranges = named.groupBy(*by, F.substring("key", 1, digits).alias("range")).agg(F.sum("size").alias("words"))
    ranges = scratch_table(ranges.withColumn("wide", F.substring("range", 1, (digits + 1) // 2)), "ranges")
    wide = ranges.groupBy(*by, "wide").agg(F.sum("words").alias("words")).join(goal.select(*by, "rest"), by)
    narrow = ranges.join(reached(wide, "wide"), [*by, "wide"]).drop("wide")
    at = scratch_table(reached(narrow, "range"), "cut_ranges")
    of_key = named.withColumn("range", F.substring("key", 1, digits)).join(F.broadcast(at) if at.count() <= BROADCAST_IDS else at, [*by, "range"])
    of_key = of_key.groupBy(*by, "key", "rest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    cut = reached(of_key, "key").select(*by, F.col("key").alias("cut"), F.floor(F.col("rest") / F.col("rows")).cast("long").alias("share"))
    return scratch_table(goal.join(cut, by, "left").select(*by, "source_size", "target", "epochs", "cut", "share"), "cuts")


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """source_size, target, taken beside the columns of `rows` (source, size, key)."""
    few = F.broadcast(cuts) if cuts.count() <= BROADCAST_IDS else cuts
    rows = rows.join(few, (F.coalesce("source", F.lit("")) == F.col("name")) & (F.col("source").isNull() == F.col("no_source")))
    more = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.col("share")).otherwise(0)
    return rows.withColumn("taken", (F.col("epochs") * F.col("size") + more).cast("long")).drop("name", "no_source", "epochs", "cut", "share")


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of `docs` (doc_id, text, source).

    size: words of the text (null or blank: 0).  taken: words that the mix takes, repeats counted; a source's
    taken words add up to floor(target).  The document at the cut gives only the words up to the cut; rows that
    repeat id and text have one place, and if the cut falls on them share it evenly, rounded down.  So the result is the same
    for any order and partitioning of the rows.  A null doc_id counts as an empty one.  An empty table gives an empty result.
    Other columns of `docs` are ignored.
    """
    size, key = _size_and_key(seed)
    sized = scratch_table(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "sizes")
    return _taken(sized, _cuts(sized, weights, cap, rows_per_range)).drop("key")


def apply_mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The mixed documents: each row of `docs` as often as the mix takes it whole, and the one at its source's
    cut once more with its words up to the cut.  Rows of which nothing is taken go.  Columns stay as they are, whatever their
    names; n_chars, if there, follows a cut text.
    """
    size, key = _size_and_key(seed)
    cuts = _cuts(scratch_table(docs.select("source", size.alias("size"), key.alias("key")), "sizes"), weights, cap, rows_per_range)
    rows = _taken(docs.select(F.struct(*docs.columns).alias("row"), "source", size.alias("size"), key.alias("key")), cuts)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.filter(F.array(part), lambda x: x > 0))
    rows = rows.select("row", F.explode(copies).alias("part"))
    # pieces of blanks and a word; the first of them are the text up to the cut
    pieces = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("part") > 0, F.array_join(F.slice(pieces, 1, F.greatest("part", F.lit(1))), "")).otherwise(F.col("row.text"))
    out = rows.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("part") > 0, F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        out = out.withColumn("row", F.col("row").withField("n_chars", chars))
    return out.select("row.*")
