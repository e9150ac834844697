"""Formulas put into page text.

replacements: book_id, page_index, phase (0 display, 1 inline), ord, needle, replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import escape_markdown, replace_first
from ..sources.shared import scratch_table
from . import matching as M

#: Type of a detection to its role; other types are inline.
DISPLAY_TYPE = "isolated"


def role(kind: Column) -> Column:
    return F.when(kind == DISPLAY_TYPE, "display_formula").otherwise("inline_formula")


def rendered(latex: Column, of_role: Column) -> Column:
    return F.when(of_role == "inline_formula", F.concat(F.lit("$"), latex, F.lit("$"))).when(of_role == "display_formula", F.concat(F.lit("\n$$"), latex, F.lit("$$\n"))).otherwise(latex)


def rebuild(parts: Column, runs: Column) -> Column:
    """Parts with runs (struct first, last, latex, by first) replaced; overlapping runs are all written."""
    step = lambda a, s: F.struct(
        s["last"].alias("at"),
        F.concat(a["text"], F.array_join(F.slice(parts, a["at"] + 1, F.greatest(F.lit(0), s["first"] - a["at"])), ""), F.lit("$"), s["latex"], F.lit("$")).alias("text"),
    )
    end = lambda a: F.concat(a["text"], F.array_join(F.slice(parts, a["at"] + 1, F.greatest(F.lit(0), F.size(parts) - a["at"])), ""))
    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step, end)


def first_display(matched: DataFrame) -> DataFrame:
    """Of display detections that match one paragraph, the first."""
    rank = F.row_number().over(W.partitionBy(*M.PAGE, "p.para_idx").orderBy("det_idx"))
    return matched.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def inline_spans(spans: DataFrame) -> DataFrame:
    """book_id, page_index, para_idx, runs (by first, then detection)."""
    run = F.struct("first", "det_idx", "last", "latex")
    return spans.groupBy(*M.PAGE, "para_idx").agg(F.array_sort(F.collect_list(run)).alias("runs"))


def replacements(detections: DataFrame, paragraphs: DataFrame, words: DataFrame, recognize=None) -> DataFrame:
    """What detections put in place of what.

    recognize: optional function from detections with another trimmed box to (book_id, page_index, det_idx, new_latex);
    null or lacking results keep the old box and formula.  Without it every changed box counts as failed.
    """
    placed = M.place(detections, paragraphs, words, lambda kind: role(kind) == "inline_formula", both=recognize is not None)
    if recognize is None:
        rows = placed.select(*M.PAGE, "d.det_idx", "d.type", "d.latex", F.col("old").alias("p"))
    else:
        placed = scratch_table(placed, "placed")  # for the engine, and to be joined with what it reads
        own = [F.col(c) if c in M.PAGE else F.col(f"d.{c}") for c in detections.columns]
        again = recognize(placed.where("changed").select(*own, "trimmed")).select(*M.PAGE, "det_idx", "new_latex")
        rows = placed.withColumn("det_idx", F.col("d.det_idx")).join(again, [*M.PAGE, "det_idx"], "left")
        new = F.col("changed") & F.col("new_latex").isNotNull()
        rows = rows.select(*M.PAGE, "det_idx", "d.type", F.when(new, F.col("new_latex")).otherwise(F.col("d.latex")).alias("latex"), F.when(new, F.col("new")).otherwise(F.col("old")).alias("p")).where("p is not null")
    is_display = role(F.col("type")) == "display_formula"
    run = F.struct("p.run.first", "det_idx", "p.run.last", "latex")
    shown = F.when(is_display, F.struct("det_idx", "latex"))
    rows = rows.select(*M.PAGE, "p.para_idx", "p.contents", shown.alias("shown"), F.when(~is_display & F.col("p.run").isNotNull(), run).alias("run"))
    per = rows.groupBy(*M.PAGE, "para_idx").agg(F.first("contents").alias("contents"), F.min("shown").alias("shown"), F.sort_array(F.collect_list("run")).alias("runs"))
    parts = F.transform(M.text_lines(F.col("contents")), escape_markdown)
    row = lambda phase, ord, needle, by: F.struct(F.lit(phase).alias("phase"), ord.cast("long").alias("ord"), needle.alias("needle"), by.alias("replacement"))
    display = F.when(F.col("shown.latex") != "", row(0, F.col("shown.det_idx"), escape_markdown(F.col("contents")), rendered(F.col("shown.latex"), F.lit("display_formula"))))
    inline = F.when(F.size("runs") > 0, row(1, F.col("para_idx"), F.array_join("parts", ""), rebuild(F.col("parts"), F.col("runs"))))
    both = F.filter(F.array(display, inline), lambda r: r.isNotNull())
    return per.withColumn("parts", parts).select(*M.PAGE, F.inline(both))


def apply(pages: DataFrame, replaced: DataFrame) -> DataFrame:
    """Pages (raw_markdown) with markdown: the first finding of each needle replaced, one after the other.

    Display formulas come first, by detection, then paragraphs by index; a needle that isn't there changes nothing.
    """
    steps = replaced.groupBy(*M.PAGE).agg(F.array_sort(F.collect_list(F.struct("phase", "ord", "needle", "replacement"))).alias("steps"))
    rows = pages.drop("markdown").join(steps, M.PAGE, "left")
    done = F.aggregate("steps", F.col("raw_markdown"), lambda t, s: replace_first(t, s["needle"], s["replacement"]))
    return rows.withColumn("markdown", F.coalesce(done, "raw_markdown")).drop("steps")
