import base64
import hashlib
import struct

import zstandard

from docspark.llm import oracles
from docspark.llm import queries as Q
from docspark.llm import warc as X
from oracle import same


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for k, v in pages.items():
        last[v] = max(k, last.get(v, k))
    rows = Q.op10_warc(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        p = pages[r.page_id]
        first = last[p] == r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), b32(p), "response" if first else "revisit", None if first else last[p])


def test_query_equals_sql(spark):
    assert same(spark, Q.op10_warc, oracles.ORACLES["op10_warc"], "/root/testdata/sf0.01") == 250


def test_archive_layout():
    records = [X.record(i, f"http://h/{i}?é\r\nx", f"<p>page {i}</p>" * 50, "00" * 20, 0, None) for i in range(400)]
    archive = X.pack(records)
    magic, size = struct.unpack_from("<II", archive)
    assert magic == X.DICT_MAGIC and len(archive) < 0.5 * sum(map(len, records))
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size]))
    # a frame of its own for each record
    first = zstandard.ZstdDecompressor(dict_data=trained).decompressobj().decompress(archive[8 + size :])
    assert first == records[0]
    got = [*X.unpack(archive)]
    assert [h["WARC-Record-ID"] for h, _ in got] == [f"<urn:page:{i}>" for i in range(400)] and "\r" not in got[0][0]["WARC-Target-URI"]
    for few in (records[:1], records[:3]):  # too few to train on: their beginnings are the dictionary
        archive = X.pack(few)
        assert struct.unpack_from("<I", archive)[0] == X.DICT_MAGIC and len([*X.unpack(archive)]) == len(few)


def test_odd_pages(spark):
    big = "x" * 300_000
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (None, "u", "null id"), (6, "u", big), (7, "u", big), (7, "u", big), (8, "u", "é\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(i, u, h, "e") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)

    def run(df, **more):
        folder = X.new_folder(spark)
        return sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in X.read(spark, X.write(df, folder, archive_bytes=1000, **more), folder).collect()), key=str)

    assert run(df) == sorted(
        [(1, "revisit", 3, 4), (2, "revisit", 3, 4), (3, "response", None, 4), (4, "revisit", 5, 0), (5, "response", None, 0), (None, "response", None, 7), (6, "revisit", 7, 300_000), (7, "response", None, 300_000), (7, "response", None, 300_000), (8, "response", None, 14)],
        key=str,
    )
    assert {r[:2] for r in run(df, min_bytes=5)} >= {(1, "response"), (4, "response"), (6, "revisit")}
    assert run(df.limit(0)) == []
