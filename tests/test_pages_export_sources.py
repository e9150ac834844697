import http.server
import io
import json
import os
import re
import threading
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions import pdf
from docspark.operators import convert, export, pages
from docspark.plans import fakes
from docspark.sources import engines, readers, schemas, settings, shared, writers
from docspark.streaming import drop_folder

MD = "book_id string, page_index int, markdown string, assets array<string>"


def test_page_numbers():
    assert pages.page_numbers("1,3-5,10", 10) == [1, 3, 4, 5, 10]
    assert pages.page_numbers(None, 3) == [1, 2, 3] and pages.page_numbers("2,2, 1 ", 3) == [1, 2]
    for bad in ("", " ", "a", "3-2", "0", "11", "1-11", "1,,2"):
        with pytest.raises(pages.PageRangeError):
            pages.page_numbers(bad, 10)


def test_ranges_as_table_equal_the_parser(spark):
    specs = ["1,3-5,10", "", " 2 - 3 ", "3-2", "0", "11", None, "1,,2", "x"]
    df = spark.createDataFrame([(str(i), s, 10) for i, s in enumerate(specs)], "book_id string, spec string, total int")
    got = {}
    for r in pages.parse_ranges(df).collect():
        got.setdefault(r.book_id, []).append(r.page_index + 1)
    errors = {r.book_id for r in pages.range_errors(df).collect()}
    for i, s in enumerate(specs):
        try:
            wanted = pages.page_numbers(s, 10)
        except pages.PageRangeError:
            assert str(i) in errors and str(i) not in got
        else:
            assert sorted(got[str(i)]) == wanted
    assert pages.parse_ranges(df.limit(0)).count() == 0


def test_cache_split(spark):
    p = spark.createDataFrame([("h", "s", i) for i in range(3)], "sha8 string, settings string, page_index int")
    cache = spark.createDataFrame([("h", "s", 0, "{}", "m"), ("h", "s", 1, None, "m"), ("h", "t", 2, "{}", "m")], "sha8 string, settings string, page_index int, analysis string, raw_markdown string")
    hits, misses = pages.split_cached(p, cache)
    assert [r.page_index for r in hits.collect()] == [0] and sorted(r.page_index for r in misses.collect()) == [1, 2]
    hits, misses = pages.split_cached(p, cache, use_cache=False)
    assert hits.count() == 0 and misses.count() == 3


def test_export(spark):
    rows = spark.createDataFrame([("b", 2, "c", []), ("b", 0, "# a ![i](/x/f.png)", ["/x/f.png"]), ("b", 1, None, None)], MD)
    assert export.markdown(rows).first().content == "# a ![i](f.png)\n\n\n\nc"
    assert export.plaintext(rows).first().content == "a [図: i]\n\n\n\nc"
    chapters = spark.createDataFrame([("b", 0, "preface", "前 書", 0, 1), ("b", 1, "chapter", "x", 2, 9), ("b", 2, "index", "y", 50, 60)], "book_id string, ord int, kind string, title string, start_page int, end_page int")
    got = {r.name: r.content for r in export.by_chapter(rows, chapters).collect()}
    assert got == {"00_preface_前_書.md": "# a ![i](f.png)\n\n", "01_chapter_x.md": "c", "02_index_y.md": ""}


def test_asset_names_clash(spark):
    rows = spark.createDataFrame([("b", 1, "", ["/p/x_1.png", "/r/x.png", "/r/noend", "/s/x_1.png"]), ("b", 0, "", ["/p/x.png", "/q/x.png", "/q/noend"]), ("c", 0, "", ["/p/x.png"])], MD)
    names = {(r.book_id, r.path): r.name for r in export.asset_names(rows).collect()}
    assert names == {("b", "/p/x.png"): "x.png", ("b", "/q/x.png"): "x_1.png", ("b", "/q/noend"): "noend", ("b", "/p/x_1.png"): "x_1_1.png", ("b", "/r/x.png"): "x_2.png", ("b", "/r/noend"): "noend_1", ("b", "/s/x_1.png"): "x_1_2.png", ("c", "/p/x.png"): "x.png"}
    last = {(r.book_id, r.name): r.path for r in export.assets_by_name(rows).collect()}
    assert last == {("b", "x.png"): "/r/x.png", ("b", "x_1.png"): "/s/x_1.png", ("b", "noend"): "/r/noend", ("c", "x.png"): "/p/x.png"}


def test_images_are_renamed_once_and_links_stay(spark):
    text = 'see [x](/q/x.png) ![a](/q/x.png)![b](x_1.png) <img alt="c" src="figures/x.png" width="3"> <a src="/q/x.png"> ![d](/elsewhere.png)'
    rows = spark.createDataFrame([("b", 0, text, ["/p/x.png", "/q/x.png"]), ("b", 1, "![o](/p/x.png) ![p](figures/x.png)", ["/r/x.png"]), ("c", 0, "![o](/p/x.png)", []), ("b", 2, None, [])], MD)
    got = {(r.book_id, r.page_index): r.markdown for r in export.rewrite_images(rows, export.asset_names(rows)).collect()}
    # /p/x.png is x.png, /q/x.png x_1.png, /r/x.png x_2.png; figures/x.png is the page's last of the name
    assert got == {
        ("b", 0): 'see [x](/q/x.png) ![a](x_1.png)![b](x_1.png) <img alt="c" src="x_1.png" width="3"> <a src="/q/x.png"> ![d](/elsewhere.png)',
        ("b", 1): "![o](x.png) ![p](x_2.png)",
        ("b", 2): None,
        ("c", 0): "![o](/p/x.png)",
    }


def test_epub(spark, tmp_path):
    for name in ("p", "q"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.png").write_bytes(name.encode())
    rows = spark.createDataFrame([("b", 1, "two & <three> **four** `f`\n\x01", [f"{tmp_path}/q/x.png"]), ("b", 0, f"# One\ntext ![i]({tmp_path}/p/x.png) <img src=\"figures/x.png\">", [f"{tmp_path}/p/x.png"])], MD)
    out = export.epub(rows, title="T & U").collect()
    assert [(r.book_id, r.name) for r in out] == [("b", "book.epub")]
    z = zipfile.ZipFile(io.BytesIO(out[0].content))
    assert z.namelist()[0] == "mimetype" and z.read("mimetype") == b"application/epub+zip" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert (z.read("EPUB/x.png"), z.read("EPUB/x_1.png")) == (b"p", b"q")
    for name in z.namelist():
        if name.endswith(("xml", "opf", "xhtml")):
            ElementTree.fromstring(z.read(name))
    text = z.read("EPUB/text.xhtml").decode()
    assert '<h1 id="h0">One</h1>' in text and text.count('src="x.png"') == 2 and "two &amp; &lt;three&gt; <strong>four</strong> <code>f</code>" in text
    assert export.epub(rows).first().content == export.epub(rows.repartition(3)).first().content and export.epub(rows.limit(0)).count() == 0


def test_pages_from_images(spark):
    images = spark.createDataFrame([("b", i, b"x" * (i + 1), "h", "s") for i in range(5)], "book_id string, page_index int, img binary, sha8 string, settings string")
    cache = spark.createDataFrame([("h", "s", 2, "{}", "kept", ["/f.png"])], "sha8 string, settings string, page_index int, analysis string, raw_markdown string, figures array<string>")
    wanted = spark.createDataFrame([("b", 0), ("b", 2)], "book_id string, page_index int")
    pages_of = lambda **more: {r.page_index: (r.markdown, r.raw_markdown, r.assets) for r in convert.run_pages(images, fakes.Reader, **more).collect()}
    assert pages_of(wanted=wanted, cache=cache) == {0: ("read sigma x", "read sigma x", []), 2: ("kept", "kept", ["/f.png"])}
    assert pages_of(wanted=wanted, cache=cache, use_cache=False)[2][0] == "read sigma xxx"
    assert len(pages_of()) == 5
    # the box shrinks to its word that isn't Japanese, and is read again where the engine can
    assert pages_of(wanted=wanted, detector=fakes.Finder)[2][0] == "read \n$$n_3$$\n xxx"
    both = pages_of(detector=fakes.Finder, recognizer=fakes.Finder)
    assert (both[0][0], both[1][0]) == ("read \n$$n_1$$\n x", "read \n$$m_2^60$$\n xx")


def test_files_of_all_forms(spark):
    rows = spark.createDataFrame([("b", 0, "# 第1章 海", []), ("b", 1, "波", [])], MD).withColumn("raw_markdown", F.lit(None).cast("string"))
    names = lambda **more: sorted(r.name for r in convert.files(rows, **more).collect())
    assert names() == ["book.md"] and names(form="plaintext", combine=False) == ["page_0001.txt", "page_0002.txt"] and names(form="epub") == ["book.epub"] and names(by_chapter=True) == ["00_chapter_海.md"]
    for bad in ({"form": "pdf"}, {"form": "epub", "by_chapter": True}):
        with pytest.raises(ValueError):
            convert.files(rows, **bad)


def test_files_and_cache(spark, tmp_path):
    for page, files in {1: {"analysis.json": json.dumps({"words": [{"points": [[1, 2], [3, 4]], "content": "w"}]}), "raw.md": "r"}, 2: {"raw.md": "only"}}.items():
        d = tmp_path / "cache" / "0123abcd" / f"page_{page:04d}"
        (d / "figures").mkdir(parents=True)
        for name, text in files.items():
            (d / name).write_text(text)
        (d / "figures" / "b.png").write_bytes(b"x")
    got = {r.page_index: r for r in readers.parse_analysis(readers.page_cache(spark, str(tmp_path / "cache"))).collect()}
    assert got[0].raw_markdown == "r" and got[0].words[0].content == "w" and got[0].paragraphs == [] and got[1].analysis is None and len(got[1].figures) == 1
    files = spark.createDataFrame([("b", "x.md", "text"), ("c", "y.md", None)], "book_id string, name string, content string")
    assert writers.write_files(files, str(tmp_path / "out")) == 2
    assert (tmp_path / "out/b/x.md").read_text() == "text" and os.listdir(tmp_path / "out/c") == ["y.md"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.png").write_bytes(b"image")
    assert writers.copy_files(spark.createDataFrame([("b", "y.png", f"{tmp_path}/a/x.png")], "book_id string, name string, path string"), str(tmp_path / "out")) == 1
    assert (tmp_path / "out/b/y.png").read_bytes() == b"image"
    with pytest.raises(writers.EmptyExport):
        writers.write_files(files.limit(0), str(tmp_path / "out"))
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/b.pdf").write_bytes(b"%PDF")
    book = readers.books(spark, str(tmp_path / "pdf"), "dpi=200").first()
    assert book.book_id == "b" and len(book.sha8) == 8


def test_engines(spark):
    class Fake(engines.NoOp):
        def detect(self, image):
            return [{"box": (1, 2, 3, 4), "type": "isolated", "latex": " x ", "score": 1}]

        def recognize(self, image, box):
            if box[0] == 0:
                raise engines.EngineError("no")
            return "new"

    images = spark.createDataFrame([("b", 0, b"i")], "book_id string, page_index int, img binary")
    assert engines.analyze_pages(images, engines.NoOp).first().raw_markdown == ""
    d = engines.detect_formulas(images, Fake)
    assert (d.first().latex, d.first().box.x2) == ("x", 3)
    again = engines.recognizer(images, Fake)
    assert again(d.withColumn("trimmed", F.col("box"))).first().new_latex == "new"
    assert again(d.withColumn("trimmed", F.col("box").withField("x1", F.lit(0)))).first().new_latex is None


def test_formulas_over_http(spark):
    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            image = body.split(b"\r\n\r\n", 1)[1].rsplit(b"\r\n--", 1)[0]
            if image == b"bad":
                self.send_error(500)
                return
            found = {"latex": f" L{len(image)} ", "score": 1} if self.path == "/recognize" else [{"box": [1, 2, 3, 4], "type": "isolated", "latex": " x ", "score": "0.5"}]
            data = b"no json" if image == b"odd" else json.dumps([{"box": [1]}] if image == b"lacks" else found).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    engine = engines.HttpFormulas(url, cut=lambda image, box: image[: box[2]])
    assert engine.detect(b"page") == [{"box": (1, 2, 3, 4), "type": "isolated", "latex": "x", "score": 0.5}]
    assert engine.recognize(b"pages", (0, 0, 3, 9)) == "L3"
    images = spark.createDataFrame([("b", 0, b"i")], "book_id string, page_index int, img binary")
    assert engines.detect_formulas(images, lambda: engines.HttpFormulas(url)).first().latex == "x"
    for image in (b"bad", b"odd", b"lacks"):
        with pytest.raises(engines.EngineError):
            engine.detect(image)
    with pytest.raises(engines.EngineError):
        engines.HttpFormulas(url).recognize(b"p", (0, 0, 1, 1))
    server.shutdown()
    server.server_close()
    with pytest.raises(engines.EngineError):
        engine.detect(b"page")


def test_text_only_crops_and_png():
    assert engines.TextOnly(lambda image: None).analyze(b"")["raw_markdown"] == "" and engines.TextOnly(lambda image: "# a").analyze(b"")["words"] == []
    with pytest.raises(engines.EngineError):
        engines.TextOnly(lambda image: 1 / 0).analyze(b"")
    pixels = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    part = engines.crop(pixels, (-3, 1, 2, 99))
    assert part.shape == (3, 2, 3) and (part == pixels[1:, :2]).all()
    with pytest.raises(engines.EngineError):
        engines.crop(pixels, (5, 0, 9, 9))
    data = engines.png(part)
    assert data.startswith(b"\x89PNG") and data[16:24] == b"\x00\x00\x00\x02\x00\x00\x00\x03"
    lines = zlib.decompress(data[41 : 41 + int.from_bytes(data[33:37], "big")])
    assert lines == b"".join(b"\0" + row.tobytes() for row in part)


def test_searchable_pdf(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01" + b"\0" * 9
    assert pdf.jpeg_shape(jpeg) == (9, 7, 1)
    sources = spark.createDataFrame([("b", 0, 100.0, 200.0, None), ("b", 1, 300.0, 400.0, bytearray(jpeg))], "book_id string, page_index int, width double, height double, jpeg binary")
    wanted = spark.createDataFrame([("b", 5), ("b", 0)], "book_id string, page_index int")
    words = spark.createDataFrame([("b", 0, 0, (10, 20, 30, 60), "語"), ("b", 0, 1, (0, 0, 5, 1), "x"), ("b", 0, 2, None, "y"), ("b", 0, 3, (0, 0, 1, 1), "")], "book_id string, page_index int, word_idx int, box struct<x1:int,y1:int,x2:int,y2:int>, content string")
    assert [(r.page_index, r.source_index) for r in export.with_source_page(wanted, sources).orderBy("page_index").collect()] == [(0, 0), (5, 1)]
    row = export.searchable_pdf(wanted, sources, words, dpi=144).first()
    data = bytes(row.content)
    assert row.name == "book.pdf" and data.startswith(b"%PDF-") and b"/Count 2" in data and b"/Width 9 /Height 7 /ColorSpace /DeviceGray" in data
    for i, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(place) :].startswith(b"%d 0 obj" % i)
    drawn = [zlib.decompress(x).decode() for x in re.findall(rb"/FlateDecode >>\nstream\n(.*?)\nendstream", data, re.S)]
    assert "3 Tr" in drawn[0] and "/F 20.0000 Tf 1 0 0 1 5.0000 170.0000 Tm <8a9e> Tj" in drawn[0] and "/F 4.0000 Tf 1 0 0 1 0.0000 199.5000 Tm <0078> Tj" in drawn[0]
    assert drawn[1] == "q 300.0000 0 0 400.0000 0 0 cm /I Do Q"
    with pytest.raises(ValueError):
        export.searchable_pdf(wanted, sources, words, dpi=0)


def test_written_cache_is_read_again(spark, tmp_path):
    rows = spark.createDataFrame([("0123abcd", 4, [([0, 0, 9, 9], "p", None, None, 1)], [([[1, 2], [3, 4]], "w")], "raw")], f"sha8 string, page_index int, paragraphs array<{schemas.PARAGRAPH}>, words array<{schemas.WORD}>, raw_markdown string")
    assert writers.write_files(writers.cache_files(rows), str(tmp_path / "cache")) == 2
    got = readers.parse_analysis(readers.page_cache(spark, str(tmp_path / "cache"))).first()
    assert (got.sha8, got.page_index, got.raw_markdown, got.words[0].content, got.paragraphs[0].box) == ("0123abcd", 4, "raw", "w", [0, 0, 9, 9])


def test_settings(spark, tmp_path, monkeypatch):
    path = tmp_path / "env"
    path.write_text("# SERVICE_KEY=no\nexport Service_Key = \"in file\"\n")
    get = lambda **more: settings.setting("service_key", path=str(path), **more)
    assert get() == "in file" and settings.setting("other", path=str(path)) is None and settings.setting("other", path=str(tmp_path / "none")) is None
    monkeypatch.setenv("SERVICE_KEY", "in environment")
    assert get(spark=spark) == "in environment" and get(given="given") == "given"
    spark.conf.set("docspark.service_key", "of the session")
    assert get(spark=spark) == "of the session"
    spark.conf.unset("docspark.service_key")


def test_stream(spark, tmp_path):
    spark.createDataFrame([("b", 0, "# t", None, [])], "book_id string, page_index int, markdown string, raw_markdown string, assets array<string>").write.parquet(str(tmp_path / "in"))
    q = drop_folder.plaintext_pages(drop_folder.read_pages(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("pages_out").start()
    q.processAllAvailable()
    q.stop()
    assert [r.text for r in spark.table("pages_out").collect()] == ["t"]


def test_shared_folder(spark):
    assert shared.scratch_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
    table = shared.scratch_table(spark.range(3), "three")
    assert table.count() == 3
    shared.drop_scratch(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        table.count()

    class Session:  # one whose configuration names no folder
        conf, master = {}, "local[2]"

        @property
        def sparkContext(self):
            return self

        def getConf(self):
            return {}

    session = Session()
    own = shared.scratch_dir(session)
    assert own == shared.scratch_dir(session) and os.path.isdir(own.removeprefix("file://"))
    for cluster in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn", "k8s://host"):
        session.master = cluster
        with pytest.raises(ValueError):
            shared.scratch_dir(session)
