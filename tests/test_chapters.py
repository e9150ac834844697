import pytest

from docspark.operators import chapters as C

PAGES = "book_id string, page_index int, markdown string, raw_markdown string"


def pages(spark, texts, start=0, raw=None):
    return spark.createDataFrame([("b", start + i, t, (raw or {}).get(i)) for i, t in enumerate(texts)], PAGES)


def found(df):
    return [(r.kind, r.chapter_number, r.title, r.start_page, r.end_page) for r in df.orderBy("ord").collect()]


def test_body_ranges(spark):
    p = pages(spark, ["# はしがき\nこの本のねらい", "ねらいの残り", "# 第1章 星の見かた\n夜に出る", "# 第2章 星図の作りかた\n紙を折る", "線を引く", "色をぬる"])
    assert found(C.body_headings(p)) == [("preface", None, "はしがき", 0, 1), ("chapter", 1, "星の見かた", 2, 2), ("chapter", 2, "星図の作りかた", 3, 5)]


def test_body_not_at_top_and_lists(spark):
    p = pages(spark, ["# 序論\nここでは第3章にふれる。\n\n## 第3章 月の形", "# 7ひ\n# 8ふ", "みちかけ", "# 7月と潮"])
    assert found(C.body_headings(p)) == [("preface", None, "序論", 0, 2), ("chapter", 7, "月と潮", 3, 3)]


@pytest.mark.parametrize("text", ["# 2. 観察の記録", "# 6\\) 望遠鏡\\(部品\\)", "## 道具", ""])
def test_body_rejects(spark, text):
    p = pages(spark, [text])
    assert found(C.body_headings(p)) == []
    assert [(r.book_id, r.error) for r in C.detection_errors(p, C.body_headings(p)).collect()] == [("b", "pdf_toc: no bookmarks\nocr_toc: no contents page\nbody_headings: no chapter heading")]


def test_errors_name_each_detectors_reason(spark):
    toc = spark.createDataFrame([("b", 0, "奥", 1)], "book_id string, pos int, title string, page_no int")
    cells = spark.createDataFrame([("b", 0, "第1章 月")], "book_id string, pos int, cell string")
    why = lambda texts, cells: C.detection_errors(p := pages(spark, texts), C.detect(p, toc, cells), toc, cells).first().error.split("\n")
    assert why(["# 目次\n汚れた紙面"], cells) == ["syllabus: no chapter heading", "pdf_toc: no chapter among the bookmarks", "ocr_toc: no entries on it", "body_headings: no chapter heading"]
    # two headings on the page make it a list, whose printed numbers lie beyond the book
    assert why(["# 1月の海 900\n# 2日の山 950"], cells.limit(0)) == ["syllabus: no chapter titles", "pdf_toc: no chapter among the bookmarks", "ocr_toc: no entry within the book", "body_headings: chapter headings only beside others"]


def test_one_page_two_starts(spark):
    toc = spark.createDataFrame([("b", 0, "第1章 x", 3), ("b", 1, "まえがき", 3), ("b", 2, None, None)], "book_id string, pos int, title string, page_no int")
    assert found(C.bookmarks(toc, pages(spark, ["a"] * 4))) == [("preface", None, "まえがき", 2, 1), ("chapter", 1, "x", 2, 3)]


def test_bookmarks(spark):
    schema = "book_id string, pos int, title string, page_no int"
    toc = spark.createDataFrame([("b", 0, "第1章 春", 2), ("b", 1, "第2章 秋", 5)], schema)
    assert [x[3:] for x in found(C.bookmarks(toc, pages(spark, ["a"] * 10)))] == [(1, 3), (4, 9)]
    assert found(C.bookmarks(spark.createDataFrame([("b", 0, "とびら", 1)], schema), pages(spark, ["a"]))) == []
    assert found(C.bookmarks(spark.createDataFrame([], schema), pages(spark, ["a"]))) == []


def test_printed_contents(spark):
    toc = "# 目次\n第 1 章 星の見かた ...... 12\n第 2 章 星図 ・・ 31\n第 5 章 暦 77"
    texts = ["x"] * 100
    texts[2], texts[13] = toc, "# 第1章 星の見かた"
    assert found(C.printed_contents(pages(spark, texts))) == [("chapter", 1, "星の見かた", 13, 31), ("chapter", 2, "星図", 32, 77), ("chapter", 5, "暦", 78, 99)]
    assert found(C.printed_contents(pages(spark, ["x"] * 15 + [toc] + ["x"] * 90))) == []
    assert found(C.printed_contents(pages(spark, ["# 目次\n汚れて読めない紙面"]))) == []


def test_numbered_contents_read_the_raw_text(spark):
    toc = "# 前書き2\n# 1Kと 道具 の手入れ\n1. K と 油7\n# 4地図の折りかた 41"
    texts = ["x"] * 60
    texts[1] = toc.replace("# 4地", "$4$地").replace("# 1K", "$1K$")
    got = found(C.printed_contents(pages(spark, texts, raw={1: toc})))
    # no chapter 1 in the text: it starts after the contents, so printed page n is index n - 1 + 2
    assert got == [("preface", None, "前書き", 3, 7), ("chapter", 1, "Kと 道具 の手入れ", 8, 41), ("chapter", 4, "地図の折りかた", 42, 59)]


def test_syllabus_and_fallback(spark):
    p = pages(spark, ["# 第1章 a", "x", "# 第2章 b", "# 第3章 c", "x"])
    html = "<table><tr>" + "".join(f"<td>第 {i} 章 題{i}</td>" for i in (1, 2, 3)) + "<td>その他</td></tr></table>"
    cells = C.cells_of(spark.createDataFrame([("b", html)], "book_id string, html string"))
    assert [x[2] for x in found(C.syllabus(cells, p))] == ["題1", "題2", "題3"]
    toc = spark.createDataFrame([("b", 0, "第9章 z", 1)], "book_id string, pos int, title string, page_no int")
    assert {r.source for r in C.detect(p, toc, cells).collect()} == {"syllabus"}
    assert {r.source for r in C.detect(p, toc, cells.where("false")).collect()} == {"pdf_toc"}
    assert {r.source for r in C.detect(p).collect()} == {"body_headings"}
    fewer = cells.where("pos < 2")
    assert [(x[2]) for x in found(C.syllabus(fewer, p))] == ["a", "b", "c"]
