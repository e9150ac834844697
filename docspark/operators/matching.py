"""Formulas to paragraphs and words, by shared area.

detections: book_id, page_index, det_idx, box, type, latex (and more); paragraphs: book_id, page_index,
para_idx, box, contents (and role, direction, ord); words: book_id, page_index, word_idx, box, content.
Joins are on (book_id, page_index) with the area as a residual, so a page's boxes meet in one task and no
page's boxes meet another's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions.text import is_japanese

PAGE = ["book_id", "page_index"]
THRESHOLD = 0.5


def analysis_rows(analysis: DataFrame) -> DataFrame:
    """book_id, page_index, what (p or w), idx, box, contents, role, direction, ord: paragraphs and words of page analyses, in one pass.

    Null lists are empty, words without points stay without a box.
    """
    kind = "array<struct<what:string,idx:int,box:struct<x1:int,y1:int,x2:int,y2:int>,contents:string,role:string,direction:string,ord:int>>"
    none = F.lit(None).cast("string")
    row = lambda what, i, box, *rest: F.struct(F.lit(what).alias("what"), i.alias("idx"), box.alias("box"), *rest)
    paragraphs = F.transform("paragraphs", lambda p, i: row("p", i, G.box(*(p["box"][k] for k in range(4))), p["contents"].alias("contents"), p["role"].alias("role"), p["direction"].alias("direction"), p["order"].alias("ord")))
    words = F.transform("words", lambda w, i: row("w", i, G.from_points(w["points"]), F.coalesce(w["content"], F.lit("")).alias("contents"), none.alias("role"), none.alias("direction"), F.lit(None).cast("int").alias("ord")))
    empty = F.array().cast(kind)
    both = F.concat(F.coalesce(paragraphs.cast(kind), empty), F.coalesce(words.cast(kind), empty))
    return analysis.select(*PAGE, F.explode(both).alias("r")).select(*PAGE, "r.*")


def explode_analysis(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, words) of page analyses, as analysis_rows() has them."""
    rows = analysis_rows(analysis)
    paragraphs = rows.where("what = 'p'").select(*PAGE, F.col("idx").alias("para_idx"), "box", "contents", "role", "direction", "ord")
    return paragraphs, rows.where("what = 'w'").select(*PAGE, F.col("idx").alias("word_idx"), "box", F.col("contents").alias("content"))


def _inside(words: DataFrame, boxes: DataFrame, threshold: float, how: str = "inner") -> DataFrame:
    """Rows of `boxes` (box) with the words (word_box) whose area lies in the box by `threshold` or more."""
    w = words.where(G.area(F.col("box")) > 0).withColumnRenamed("box", "word_box")
    b, w = boxes.alias("b"), w.alias("w")
    fits = (F.col("b.book_id") == F.col("w.book_id")) & (F.col("b.page_index") == F.col("w.page_index")) & (G.ioa(F.col("word_box"), F.col("b.box")) >= threshold)
    return b.join(w, fits, how).select("b.*", "w.word_idx", "w.word_box", "w.content")


def match_paragraphs(detections: DataFrame, paragraphs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Detections with the paragraph (p: para_idx, box, contents) that holds the largest part of them, the last of equals.

    Parts below the threshold and paragraphs without contents don't count; unmatched detections go.
    """
    p = paragraphs.where("contents is not null").select(*PAGE, F.struct("para_idx", "box", "contents").alias("p"))
    part = G.ioa(F.col("box"), F.col("p.box"))
    scored = detections.join(p, PAGE).withColumn("part", part).where(F.col("part") >= threshold)
    best = scored.groupBy(*PAGE, "det_idx").agg(F.max_by(F.struct(*(F.col(c) for c in detections.columns), "p"), F.struct("part", "p.para_idx")).alias("m"))
    return best.select("m.*")


def words_in_paragraphs(words: DataFrame, paragraphs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Paragraph rows, one for each word that lies in them."""
    return _inside(words, paragraphs, threshold)


def trim_japanese(detections: DataFrame, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Detections with trimmed: the box cut to its words without Japanese.

    Pages without words and boxes without Japanese words keep the box; a box of no area, of Japanese words
    alone, or with nothing left gets null.
    """
    pages = words.select(*PAGE).distinct().withColumn("has_words", F.lit(True))
    inside = _inside(words, detections.select(*PAGE, "det_idx", "box"), threshold)
    ja = is_japanese(F.col("content"))
    side = lambda f, s: f(F.when(~ja, F.col(f"word_box.{s}"))).alias(s)
    per = inside.groupBy(*PAGE, "det_idx").agg(F.bool_or(ja).alias("ja"), side(F.min, "x1"), side(F.min, "y1"), side(F.max, "x2"), side(F.max, "y2"))
    rows = detections.join(per, [*PAGE, "det_idx"], "left").join(pages, PAGE, "left")
    cut = G.box(F.greatest("x1", "box.x1"), F.greatest("y1", "box.y1"), F.least("x2", "box.x2"), F.least("y2", "box.y2"))
    trimmed = (
        F.when(F.col("has_words").isNull(), F.col("box"))
        .when(G.area(F.col("box")) == 0, F.lit(None))
        .when(~F.coalesce("ja", F.lit(False)), F.col("box"))
        .when(F.col("x1").isNull(), F.lit(None))
        .when((cut["x2"] > cut["x1"]) & (cut["y2"] > cut["y1"]), cut)
    )
    return rows.withColumn("trimmed", trimmed).select(*detections.columns, "trimmed")


def reading_order(words: DataFrame, direction: Column) -> DataFrame:
    """Words with place (from 0) in their page: across by centre height, else by columns from the right."""
    xc = F.coalesce((F.col("box.x1") + F.col("box.x2")) / 2, F.lit(0.0))
    yc = F.coalesce((F.col("box.y1") + F.col("box.y2")) / 2, F.lit(0.0))
    down = direction == "vertical"
    order = W.partitionBy(*PAGE).orderBy(F.when(down, -xc).otherwise(yc), F.when(down, yc).otherwise(xc), "word_idx")
    return words.withColumn("place", F.row_number().over(order) - 1)


def lines_to_words(paragraphs: DataFrame, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """book_id, page_index, para_idx, line, content, box: each line of a paragraph with the box of its word.

    The n-th line of a content takes the n-th of the paragraph's words with that content; others have no box.
    """
    per = [*PAGE, "para_idx"]
    each = paragraphs.where("contents is not null").select(*per, F.posexplode(text_lines(F.col("contents"))).alias("line", "content"))
    each = each.withColumn("nth", F.row_number().over(W.partitionBy(*per, "content").orderBy("line")))
    inside = words_in_paragraphs(words, paragraphs.select(*per, "box"), threshold).drop("box")
    inside = inside.withColumn("nth", F.row_number().over(W.partitionBy(*per, "content").orderBy("word_idx")))
    return each.join(inside.select(*per, "content", "nth", F.col("word_box").alias("box")), [*per, "content", "nth"], "left").select(*per, "line", "content", "box")


def spans(lined: DataFrame, matched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """det rows of `matched` with first and last (end exclusive): the run of lines in the detection's box.

    Runs with a hole, and boxes without area or lines, give no row.
    """
    per = [*PAGE, "para_idx"]
    m = matched.select(*PAGE, "det_idx", F.col("p.para_idx").alias("para_idx"), F.col("box").alias("det_box"), "latex")
    rows = m.where(G.area(F.col("det_box")) > 0).join(lined.where(G.area(F.col("box")) > 0), per)
    rows = rows.where(G.ioa(F.col("box"), F.col("det_box")) >= threshold)
    run = rows.groupBy(*per, "det_idx").agg(F.min("line").alias("first"), (F.max("line") + 1).alias("last"), F.count(F.lit(1)).alias("n"), F.first("latex").alias("latex"))
    return run.where("last - first = n").drop("n")


def same_paragraph(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with one_idx: the first index of a paragraph of the page equal in all but its index, by a 64-bit hash."""
    rest = [c for c in paragraphs.columns if c not in ("para_idx", *PAGE)]
    return paragraphs.withColumn("one_idx", F.min("para_idx").over(W.partitionBy(*PAGE, F.xxhash64(*rest))))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with `value` computed once; a plain expression would be computed wherever f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _best(fits: Column) -> Column:
    """As match_paragraphs(): of `fits` (structs that begin with part, para_idx) the best; `first` is its para_idx as same_paragraph() has it."""
    first = lambda m: F.array_min(F.transform(F.filter(fits, lambda q: q["same"] == m["same"]), lambda q: q["para_idx"]))
    best = lambda m, i: F.struct(m["para_idx"].alias("para_idx"), m["box"].alias("box"), m["contents"].alias("contents"), i.alias("first"))
    only = F.get(fits, F.lit(0))
    return F.when(F.size(fits) == 1, best(only, only["para_idx"])).when(F.size(fits) > 1, _let(F.array_max(fits), lambda m: best(m, first(m))))


def _run(box: Column, lines: Column, inside: Column, threshold: float) -> Column:
    """As lines_to_words() and spans(): first and last of the run of `lines` whose words (`inside` has them in order) lie in the box, or null."""
    # from the words in the box, of which there are few, to their lines
    nth = lambda x, i: F.size(F.filter(F.slice(inside, 1, i), lambda y: y["content"] == x))
    at = lambda x, i: F.get(F.filter(F.transform(lines, lambda y, k: F.when(y == x, k)), lambda k: k.isNotNull()), nth(x, i))
    hit = F.filter(F.transform(inside, lambda w, i: F.when(G.ioa(w["box"], box) >= threshold, at(w["content"], i))), lambda k: k.isNotNull())
    ends = lambda h: F.struct(F.array_min(h).alias("first"), (F.array_max(h) + 1).alias("last"), F.size(h).alias("n"))
    return _let(hit, lambda h: _let(ends(h), lambda e: F.when(e["last"] - e["first"] == e["n"], F.struct(e["first"].alias("first"), e["last"].alias("last")))))


def text_lines(contents: Column) -> Column:
    return F.filter(F.split(contents, "\n", -1), lambda x: x != "")


def place(detections: DataFrame, paragraphs: DataFrame, words: DataFrame, inline: Callable[[Column], Column], both: bool, threshold: float = THRESHOLD) -> DataFrame:
    """book_id, page_index, d, trimmed, changed, old, new: detections with the paragraph of their box and (if `both`) that of their trimmed box.

    d: the detection's other columns; old, new: para_idx (of the first such paragraph, as same_paragraph() has it), contents and, of
    types that are `inline`, run.  All that trim_japanese(), match_paragraphs(), lines_to_words() and spans() say: each table is dealt
    out by page once, and boxes meet in joins, whose compiled conditions leave little to go on.  Detections without both, and boxes
    that trim to nothing, go.
    """
    rest = [c for c in paragraphs.columns if c not in ("para_idx", *PAGE)]
    # what has no area or contents takes part in nothing
    d = detections.where(G.area(F.col("box")) > 0).select(*PAGE, F.struct(*(c for c in detections.columns if c not in PAGE)).alias("d"), G.area(F.col("box")).alias("d_area"), F.monotonically_increasing_id().alias("id"))  # id tells equal rows apart
    p = paragraphs.where("contents is not null").select(*PAGE, F.struct("para_idx", "box", "contents", F.xxhash64(*rest).alias("same")).alias("p"))
    w = words.where(G.area(F.col("box")) > 0).select(*PAGE, F.struct("word_idx", "box", "content").alias("w"), G.area(F.col("box")).alias("w_area"), is_japanese(F.col("content")).alias("is_ja"))
    box, per = F.col("d.box"), [*PAGE, "id"]

    def meet(a: DataFrame, b: DataFrame, fits: Column, how: str) -> DataFrame:
        # merged: a page's rows needn't fit into memory, and broadcasts would have the others dealt out again
        on = (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.page_index") == F.col("b.page_index")) & fits
        return a.alias("a").join(b.hint("merge").alias("b"), on, how).drop(*(F.col(f"b.{c}") for c in PAGE))

    # areas come with the rows, so that the conditions are small enough to be compiled
    part = G.intersection(box, F.col("p.box")) / F.col("d_area")
    # a trimmed box is a part of the box: its paragraphs share area with the box
    shares = (part >= threshold) | (G.intersection(box, F.col("p.box")) > 0) if both else part >= threshold
    found = F.struct(part.alias("part"), *(F.col(f"p.{c}").alias(c) for c in ("para_idx", "box", "contents", "same")))
    # what lists are made of is computed before they are: only there it is compiled
    rows = meet(d, p, shares, "inner").select(*per, "d", found.alias("p")).groupBy(*per).agg(F.first("d").alias("d"), F.collect_list("p").alias("p"))
    if not both:
        rows = rows.select(*per, "d", _best(F.col("p")).alias("old"))
    is_inline = inline(F.col("d.type"))
    holds = lambda b: G.intersection(F.col("w.box"), b) / F.col("w_area") >= threshold
    in_box = holds(box)
    in_paragraph = is_inline & (F.exists("p", lambda p: holds(p["box"])) if both else holds(F.col("old.box")))
    side = lambda s: F.when(in_box & ~F.col("is_ja"), F.col(f"w.box.{s}")).alias(s)
    own = [c for c in rows.columns if c not in per]
    rows = meet(rows, w, in_box | in_paragraph, "left").select(*per, *own, (in_box & F.col("is_ja")).alias("ja"), *map(side, G.SIDES), F.when(in_paragraph, F.col("w")).alias("w"))
    rows = rows.groupBy(*per).agg(
        *(F.first(c).alias(c) for c in own),
        F.coalesce(F.bool_or("ja"), F.lit(False)).alias("ja"),
        *(f(s).alias(s) for f, s in zip((F.min, F.min, F.max, F.max), G.SIDES)),
        F.collect_list("w").alias("near"),
    )
    cut = G.box(F.greatest("x1", box["x1"]), F.greatest("y1", box["y1"]), F.least("x2", box["x2"]), F.least("y2", box["y2"]))
    left = F.col("x1").isNotNull() & (cut["x2"] > cut["x1"]) & (cut["y2"] > cut["y1"])
    trimmed = F.when(~F.col("ja"), box).when(left, cut)
    rows = rows.select(*PAGE, *own, F.sort_array("near").alias("near"), trimmed.alias("trimmed")).where("trimmed is not null")
    rows = rows.withColumn("changed", ~F.col("trimmed").eqNullSafe(box))
    boxes = {"old": box}
    if both:
        boxes["new"] = F.col("trimmed")
        again = lambda q: F.struct(G.ioa(F.col("trimmed"), q["box"]).alias("part"), *(q[c].alias(c) for c in ("para_idx", "box", "contents", "same")))
        fit = lambda ps: _let(F.filter(ps, lambda q: q["part"] >= threshold), _best)
        fitting = F.struct(fit(F.col("p")).alias("old"), F.when(F.col("changed"), fit(F.transform("p", again))).alias("new"))
        some = F.filter(F.array(fitting), lambda m: m["old"].isNotNull() | m["new"].isNotNull())
        rows = rows.select(*PAGE, "d", "trimmed", "changed", "near", F.explode(some).alias("m")).select("*", "m.old", "m.new")

    def placed(k: str) -> Column:
        m = F.col(k)
        inside = F.filter("near", lambda w: G.ioa(w["box"], m["box"]) >= threshold) if both else F.col("near")
        run = _let(F.struct(text_lines(m["contents"]).alias("lines"), inside.alias("inside")), lambda at: _run(boxes[k], at["lines"], at["inside"], threshold))
        return F.when(m.isNotNull(), F.struct(m["first"].alias("para_idx"), m["contents"].alias("contents"), F.when(is_inline, run).alias("run"))).alias(k)

    return rows.select(*PAGE, "d", "trimmed", "changed", *map(placed, boxes))
