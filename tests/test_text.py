import random
import re

import pytest
from pyspark.sql import functions as F

from docspark.functions import headings as H
from docspark.functions import text as T


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("out", column)
    return [r["out"] for r in rows.orderBy("i").collect()]


PLAIN = {
    "**青い鳥**が飛ぶ": "青い鳥が飛ぶ",
    "_静かな_夜": "静かな夜",
    "`tree -L`命令": "tree -L命令",
    "![川の地図](/maps/river.png)": "[図: 川の地図]",
    "[市の年表](https://city.test/a)": "市の年表",
    "---": "",
    "***": "*",
    "snake_case_name": "snakecasename",
    "x_1 + y_2": "x1 + y2",
    "[![a](b)](c)": "[[図: a]](c)",
    "# 冬の空": "冬の空",
    "": "",
}


def test_plaintext(spark):
    assert values(spark, list(PLAIN), T.plaintext(F.col("t"))) == list(PLAIN.values())


def test_plaintext_and_escape_against_re(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("*_`#[]()!- \n\ra1\u0085　|") for _ in range(rnd.randint(0, 30))) for _ in range(800)]

    def plain(s):
        s = re.sub(r"^#{1,6}\s+", "", s, flags=re.M)
        s = re.sub(r"\*\*(.+?)\*\*|__(.+?)__", lambda m: m[1] or m[2], s)
        s = re.sub(r"\*(.+?)\*|_(.+?)_", lambda m: m[1] or m[2], s)
        s = re.sub(r"`(.+?)`", r"\1", s)
        s = re.sub(r"!\[([^\]]*)\]\([^)]+\)", lambda m: f"[図: {m[1]}]", s)
        s = re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", s)
        return re.sub(r"^[-*_]{3,}\s*$", "", s, flags=re.M)

    assert values(spark, texts, T.plaintext(F.col("t"))) == list(map(plain, texts))
    escaped = [re.sub(r"([`*{}[\]()#+!~|-])", r"\\\1", s.replace("\n", "")) for s in texts]
    assert values(spark, texts, T.escape_markdown(F.col("t"))) == escaped
    assert values(spark, texts, F.array_join(T.lines(F.col("t")), "¦")) == ["¦".join(s.splitlines()) for s in texts]


@pytest.mark.parametrize(
    "title, slug",
    [("山/川:地図", "山_川_地図"), ("山　川", "山_川"), ("山//川", "山_川"), (" a ", "a"), ("x" * 90, "x" * 80)],
)
def test_slug(spark, title, slug):
    assert values(spark, [title], T.slug(F.col("t"))) == [slug]


def test_filenames(spark):
    row = spark.range(1).select(T.chapter_filename(F.lit(100), F.lit("chapter"), F.lit("a b")).alias("c"), T.page_filename(F.lit(0), ".md").alias("p")).first()
    assert tuple(row) == ("100_chapter_a_b.md", "page_0001.md")


def test_numbers(spark):
    given = {"１２": 12, "十五": 15, "十六": None, " 3 ": 3, "x": None, "": None, "99999999999": None}
    assert values(spark, list(given), H.number(F.col("t"))) == list(given.values())


HEADINGS = {
    "第1章 星の見かた": ("chapter", 1, "星の見かた"),
    "第１章 星の見かた": ("chapter", 1, "星の見かた"),
    "第一章": ("chapter", 1, "第一章"),
    "第二十章 x": ("chapter", None, "x"),
    "15鳥の分けかた": ("chapter", 15, "鳥の分けかた"),
    "1Kと 道具 の手入れ": ("chapter", 1, "Kと 道具 の手入れ"),
    "まえがき3": ("preface", None, "まえがき"),
    "まえがき３": ("preface", None, "まえがき"),
    "あとがき": ("afterword", None, "あとがき"),
    "おわりに": ("afterword", None, "おわりに"),
    "索引": ("index", None, "索引"),
    "1. 夜の観察": (None, None, None),
    "4\\) 望遠鏡の図": (None, None, None),
    "その他": (None, None, None),
}


def test_classify(spark):
    c = H.classify(F.col("t"))
    got = values(spark, list(HEADINGS), F.struct(c["kind"], c["chapter_number"], F.when(c["kind"].isNotNull(), H.clean_title(F.col("t"), c["kind"]))))
    assert [tuple(g) for g in got] == list(HEADINGS.values())


def test_first_h1(spark):
    given = {"\n  \n# a b \nx": "a b", "x\n# a": None, "## a": None, "": None, "\u0085# z": "z", "#a": None}
    assert values(spark, list(given), H.first_h1(F.col("t"))) == list(given.values())


def test_image_basenames(spark):
    given = {"![a](/x/y/fig.png) ![b](c.png) [l](/u/v)": "![a](fig.png) ![b](c.png) [l](/u/v)", "![](http://h/p.png)": "![](p.png)"}
    assert values(spark, list(given), T.image_basenames(F.col("t"), F.lit(True))) == list(given.values())
    assert values(spark, list(given), T.image_basenames(F.col("t"), F.lit(False))) == list(given)


def test_hashes(spark):
    assert len(values(spark, ["a"], T.sha8(F.col("t")))[0]) == 8


def test_found_parts_are_replaced_once(spark):
    given = ["a1b22c", "", "x", "12", None]
    got = values(spark, given, T.replace_found(F.col("t"), "([0-9])([0-9]?)", 2, lambda g: F.concat(F.lit("<"), g[1], g[0], F.lit(">"))))
    assert got == ["a<1>b<22>c", "", "x", "<21>", None]
