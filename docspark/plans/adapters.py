"""Inputs made from the test tables: expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"

#: A page of a book from a turn of a conversation: headings of all kinds, two forms of contents, plain pages.
PAGE_MD = f"""CASE
 WHEN turn = 0 AND conv_id % 5 = 0 THEN '# 目次' || {NL} || '第 1 章 星の見かた ...... 2' || {NL} || '第２章 応用 ・・・ 4' || {NL} || '第二十章 なし 9' || {NL} || '第 3 章 先 900' || {NL}
 WHEN turn = 0 AND conv_id % 5 = 1 THEN '# まえがき1' || {NL} || '# 1Kの使いかた' || {NL} || '本文' || {NL} || '1. K と道具2' || {NL} || '2. 次 3' || {NL} || '# 2応用 4' || {NL} || '# 3なし' || {NL}
 WHEN turn = 0 AND conv_id % 5 = 2 THEN {NL} || '  # はじめに 12' || {NL}
 WHEN turn = 0 THEN '# 前書き' || {NL}
 WHEN turn = 1 THEN '# 第' || CASE conv_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '１' ELSE '一' END || '章 ' || text || {NL}
 WHEN turn = 2 THEN ''
 WHEN turn = 3 AND conv_id % 4 = 0 THEN '# 2鳥/分けかた' || {NL}
 WHEN turn = 3 THEN '# 第 二 章' || {NL}
 WHEN turn = 4 THEN '# 3. 節' || {NL}
 WHEN turn = 5 THEN '# 第二十章 まとめ' || {NL}
 WHEN turn = 6 THEN '# あとがき 3' || {NL}
 ELSE '# 索引' || {NL} END || text"""
#: Every third page has assets; images with and without folders, and links to what images show.
PAGE_IMAGES = f"' ![a](/x/y/fig' || turn || '.png)' || {NL} || '![b](c.png) <img src=\"figures/fig' || turn || '.png\"> [l](/u/v) [see](/x/y/fig' || turn || '.png) ![d](/x/z/all.png) ![e](/x/y/fig0.png)<img alt=\"f\" src=\"figures/all.png\" />'"
#: Of these, names clash: with one another, and with names made where others clash.
PAGE_ASSETS = ("'/x/y/fig' || turn || '.png'", "'/x/z/all.png'", "'/x/z/all_' || CASE turn WHEN 0 THEN '1' WHEN 3 THEN '2' ELSE '1_1' END || '.png'", "'/x/w/all'")
NUMBER_TEXT = "CASE (conv_id + turn) % 7 WHEN 0 THEN '３' WHEN 1 THEN '十二' WHEN 2 THEN '7' WHEN 3 THEN '二十' WHEN 4 THEN ' 1２ ' WHEN 5 THEN 'x1' ELSE '' END"
SPEC = "CASE conv_id % 6 WHEN 0 THEN '1,3-4' WHEN 1 THEN NULL WHEN 2 THEN ' 2 - 2 ,1' WHEN 3 THEN '3-2' WHEN 4 THEN '0' ELSE 'a-1' END"


def syllabus_row(named: str) -> str:
    """A row of a syllabus table from a turn: the second and fourth turn of a book that is `named` name a chapter each."""
    cell = "CASE turn WHEN 1 THEN '<td class=\"t\"> 第 ' || (conv_id % 9 + 1) || ' 章 <b>題名</b>' || conv_id || '</td>' WHEN 3 THEN '<td>第二章 応用' || turn || '</td>' ELSE '<td>第x章</td>' END"
    return f"'<tr><td>その他</td>' || CASE WHEN {named} THEN {cell} ELSE '<td>別</td>' END || '</tr>'"


#: Boxes from line items: page is the order; even lines are paragraphs, odd ones detections, all are words too.
BOX = ("CAST(l_partkey % 120 AS INT)", "CAST(l_suppkey % 40 AS INT)", "CAST(l_partkey % 120 + l_quantity * 4 AS INT)", "CAST(l_suppkey % 40 + 10 + l_linenumber * 12 AS INT)")
WORD_BOX = ("CAST(l_suppkey % 150 AS INT)", "CAST(l_partkey % 30 AS INT)", "CAST(l_suppkey % 150 + l_quantity AS INT)", "CAST(l_partkey % 30 + 5 + l_linenumber AS INT)")
WORD_TEXT = "CASE l_partkey % 5 WHEN 0 THEN '漢字語' WHEN 1 THEN 'x' WHEN 2 THEN 'y*' WHEN 3 THEN '' ELSE 'z_1' END"
PARA_TEXT = f"CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'x' || {NL} || '漢字語' || {NL} || 'y*' || {NL} || {NL} || 'x' || {NL} || 'z_1' END"
#: Line numbers repeat within an order: a number that doesn't.
IDX = "l_linenumber + 8 * (l_partkey + 40000 * l_suppkey)"
KIND = "CASE WHEN l_suppkey % 2 = 0 THEN 'isolated' ELSE 'embedding' END"
LATEX = "CASE WHEN l_partkey % 11 = 0 THEN '' ELSE chr(92) || 'alpha_' || l_linenumber END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_index"), F.expr(PAGE_MD).alias("markdown"), F.lit(None).cast("string").alias("raw_markdown"))


def _box(parts: tuple[str, ...]):
    return F.struct(*(F.expr(p).alias(n) for n, p in zip(("x1", "y1", "x2", "y2"), parts)))


def _page(rows: DataFrame, *more) -> DataFrame:
    return rows.select(F.col("l_orderkey").alias("book_id"), F.lit(0).alias("page_index"), *more)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0")
    return _page(rows, F.expr(IDX).alias("para_idx"), _box(BOX).alias("box"), F.expr(PARA_TEXT).alias("contents"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 1")
    return _page(rows, F.expr(IDX).alias("det_idx"), _box(BOX).alias("box"), F.expr(KIND).alias("type"), F.expr(LATEX).alias("latex"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(table(spark, sf_dir, "lineitem"), F.expr(IDX).alias("word_idx"), _box(WORD_BOX).alias("box"), F.expr(WORD_TEXT).alias("content"))
