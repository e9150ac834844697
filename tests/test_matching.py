import re

from pyspark.sql import functions as F

from docspark.functions import geometry as G
from docspark.operators import matching as M
from docspark.operators import overlay as O

WORDS = "book_id string, page_index int, word_idx int, box struct<x1:int,y1:int,x2:int,y2:int>, content string"
DETS = "book_id string, page_index int, det_idx int, box struct<x1:int,y1:int,x2:int,y2:int>, type string, latex string"
PARAS = "book_id string, page_index int, para_idx int, box struct<x1:int,y1:int,x2:int,y2:int>, contents string"


def words(spark, *rows):
    return spark.createDataFrame([("b", 0, i, box, t) for i, (t, box) in enumerate(rows)], WORDS)


def dets(spark, *rows):
    return spark.createDataFrame([("b", 0, i, box, k, tex) for i, (box, k, tex) in enumerate(rows)], DETS)


def paras(spark, *rows):
    return spark.createDataFrame([("b", 0, i, box, c) for i, (box, c) in enumerate(rows)], PARAS)


def lit_box(*v):
    return G.box(*map(F.lit, v))


def test_shares(spark):
    a, b = lit_box(0, 0, 40, 20), lit_box(30, 0, 70, 20)
    row = spark.range(1).select(G.iou(a, b), G.ioa(lit_box(0, 0, 10, 10), lit_box(6, 0, 30, 10)), G.ioa(lit_box(5, 5, 5, 9), a), G.clamp(lit_box(-5, -5, 500, 9), F.lit(100), F.lit(50)), G.clamp(lit_box(200, 0, 300, 9), F.lit(100), F.lit(50))).first()
    assert (row[0], row[1], row[2], tuple(row[3]), row[4]) == (200 / 1400, 0.4, 0.0, (0, 0, 100, 9), None)


def test_polygon(spark):
    rows = spark.createDataFrame([([[8, 3], [12, 9], [6, 15], [2, 7]],), ([],)], "p array<array<int>>").select(G.from_points(F.col("p"))).collect()
    assert tuple(rows[0][0]) == (2, 3, 12, 15) and rows[1][0] is None


def test_trim(spark):
    d = dets(spark, ((10, 10, 310, 120), "embedding", "z"), ((0, 0, 0, 9), "embedding", "z"), ((500, 0, 600, 10), "embedding", "z"))
    trimmed = lambda *w: [r.trimmed and tuple(r.trimmed) for r in M.trim_japanese(d, words(spark, *w)).orderBy("det_idx").collect()]
    assert trimmed(("漢字語", (10, 10, 90, 50)), ("q = r_2", (120, 60, 300, 110))) == [(120, 60, 300, 110), None, (500, 0, 600, 10)]
    assert trimmed(("漢字語", (10, 10, 90, 50)), ("仮名文", (20, 60, 90, 110)))[0] is None
    assert trimmed(("x", (10, 10, 90, 50)))[0] == (10, 10, 310, 120)
    assert trimmed() == [(10, 10, 310, 120), (0, 0, 0, 9), (500, 0, 600, 10)]


def test_match_takes_the_last_of_equals(spark):
    p = paras(spark, ((0, 0, 100, 100), "a"), ((0, 0, 100, 100), None), ((0, 0, 100, 100), "段の末"), ((90, 0, 300, 100), "b"))
    got = M.match_paragraphs(dets(spark, ((0, 0, 50, 50), "isolated", "x"), ((400, 0, 500, 50), "isolated", "x")), p).collect()
    assert [(r.det_idx, r.p.contents) for r in got] == [(0, "段の末")]


def test_lines_take_words_by_occurrence(spark):
    p = paras(spark, ((0, 0, 100, 20), "x\ny\n\nx\nq"))
    w = words(spark, ("x", (0, 0, 10, 10)), ("y", (20, 0, 30, 10)), ("x", (40, 0, 50, 10)), ("x", (500, 0, 510, 10)))
    got = [(r.line, r.content, r.box and r.box.x1) for r in M.lines_to_words(p, w).orderBy("line").collect()]
    assert got == [(0, "x", 0), (1, "y", 20), (2, "x", 40), (3, "q", None)]


def test_reading_order(spark):
    w = words(spark, ("r", (80, 0, 90, 10)), ("l", (0, 0, 10, 10)), ("d", (0, 50, 10, 60)))
    order = lambda d: [r.content for r in M.reading_order(w, F.lit(d)).orderBy("place").collect()]
    assert order("horizontal") == ["l", "r", "d"] and order("vertical") == ["r", "l", "d"]


def replaced(spark, p, w, d, raw, **more):
    pages = spark.createDataFrame([("b", 0, raw)], "book_id string, page_index int, raw_markdown string")
    return O.apply(pages, O.replacements(d, p, w, **more)).first().markdown


def test_inline_formulas(spark):
    p = paras(spark, ((0, 0, 100, 20), "u\nか\nv\nが整数"))
    w = words(spark, ("u", (0, 0, 12, 9)), ("か", (12, 0, 25, 9)), ("v", (25, 0, 37, 9)), ("が整数", (37, 0, 70, 9)))
    d = dets(spark, ((25, 0, 37, 9), "embedding", "v"), ((0, 0, 12, 9), "embedding", "u"))
    assert replaced(spark, p, w, d, "先uかvが整数末") == "先$u$か$v$が整数末"
    assert replaced(spark, p, w, d, "なし") == "なし"


def test_display_first_of_a_paragraph_and_empty_latex(spark):
    p = paras(spark, ((0, 0, 100, 20), "a-b"), ((0, 50, 100, 70), "c"))
    w = words(spark, ("a-b", (0, 0, 90, 20)))
    d = dets(spark, ((0, 0, 90, 20), "isolated", "A"), ((0, 0, 80, 20), "isolated", "B"), ((0, 50, 90, 70), "isolated", ""))
    assert replaced(spark, p, w, d, "a\\-b c a\\-b") == "\n$$A$$\n c a\\-b"


def test_holes_give_no_span(spark):
    p = paras(spark, ((0, 0, 100, 20), "A\nB\nC"))
    w = words(spark, ("A", (0, 0, 10, 10)), ("B", (200, 0, 210, 10)), ("C", (20, 0, 30, 10)))
    assert replaced(spark, p, w, dets(spark, ((0, 0, 40, 10), "embedding", "x")), "ABC") == "ABC"


def test_recognised_again(spark):
    p = paras(spark, ((0, 0, 200, 100), "漢字語\nq"))
    w = words(spark, ("漢字語", (0, 0, 80, 100)), ("q", (90, 0, 200, 100)))
    d = dets(spark, ((0, 0, 200, 100), "embedding", "old"))
    again = lambda rows: rows.select("book_id", "page_index", "det_idx", F.lit("new").alias("new_latex"))
    failed = lambda rows: rows.select("book_id", "page_index", "det_idx", F.lit(None).cast("string").alias("new_latex"))
    assert replaced(spark, p, w, d, "漢字語q", recognize=again) == "漢字語$new$"
    assert replaced(spark, p, w, d, "漢字語q", recognize=failed) == "$old$"
    assert replaced(spark, p, w, d, "漢字語q") == "$old$"


def test_overlapping_runs(spark):
    runs = F.array(F.struct(F.lit(0).alias("first"), F.lit(1).alias("d"), F.lit(2).alias("last"), F.lit("p").alias("latex")), F.struct(F.lit(1).alias("first"), F.lit(2).alias("d"), F.lit(3).alias("last"), F.lit("q").alias("latex")))
    got = spark.range(1).select(O.rebuild(F.array(*map(F.lit, "abcd")), runs)).first()[0]
    assert got == "$p$$q$d"


def test_a_page_is_dealt_out_once(spark):
    """The pages' rows are shuffled once, not once for each step."""
    from docspark.plans import registry

    plan = registry.QUERIES["formula_replacements"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    spark_plan = spark._jsparkSession.sessionState().executePlan(plan, spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()).executedPlan().toString()
    assert 1 <= spark_plan.count("Exchange ") <= 3
    assert spark_plan.count("FileScan") <= 3


def test_boxes_meet_in_compiled_joins(spark):
    """Boxes are compared in joins, not by functions over lists, in methods that the JVM compiles (up to 8,000 bytes)."""
    from docspark.plans import registry

    plan = registry.QUERIES["formula_replacements"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Join ") == 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = registry.QUERIES["formula_replacements"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(executed)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert len(sizes) > 2 and max(sizes) <= 8000


def test_equal_detections_and_paragraphs(spark):
    """Equal detections all count; of equal paragraphs the first is named."""
    p = paras(spark, ((0, 0, 100, 20), "u\nv"), ((0, 0, 100, 20), "u\nv"))
    w = words(spark, ("u", (0, 0, 12, 9)), ("v", (25, 0, 37, 9)))
    d = dets(spark, ((25, 0, 37, 9), "embedding", "x"))
    got = O.replacements(d.union(d), p, w).collect()
    assert [(r.phase, r.ord, r.needle, r.replacement) for r in got] == [(1, 0, "uv", "u$x$$x$")]


def test_changed_boxes_of_any_paragraph_are_read_again(spark):
    """A box that lies in no paragraph may trim to one that does; columns of its own come to the engine."""
    p = paras(spark, ((100, 0, 200, 100), "q"))
    w = words(spark, ("漢字語", (0, 0, 90, 100)), ("q", (120, 0, 200, 100)))
    d = dets(spark, ((-90, 0, 200, 100), "embedding", "old")).withColumn("score", F.lit(0.5))
    again = lambda rows: rows.select("book_id", "page_index", "det_idx", F.concat(F.lit("n"), F.col("score"), F.col("trimmed.x1")).alias("new_latex"))
    assert replaced(spark, p, w, d, "q", recognize=again) == "$n0.5120$"
    assert replaced(spark, p, w, d, "q") == "q"
