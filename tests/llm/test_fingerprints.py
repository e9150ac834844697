import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from docspark.llm import fingerprints as X
from docspark.llm import queries as Q


def word_hash(w):
    return xxhash.xxh64_intdigest(w.encode(), seed=42)


def pieces(t):
    """The paragraphs of a text as tuples of words."""
    lines = [[w for w in line.split(" ") if w] for line in (t or "").split("\n")]
    n = sum(map(len, lines))
    zeros = 2 if n < 64 else 3 if n < 128 else 4 if n < 256 else 5
    out = set()
    for words in lines:
        held = []
        for w in words:
            held.append(w)
            if word_hash(w) % 2**zeros == 0:
                out.add(tuple(held))
                held = []
        if held:
            out.add(tuple(held))
    return out


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, docs):
    docs = sorted((i, t or "") for i, t in docs)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for k, (i, t) in enumerate(docs):
        n, q = docs[(k + 1) % len(docs)][1], len(t) // 4
        e = t[: len(t) - q] + n[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r.near_edited - like(pieces(t), pieces(e))) < 1e-9 and abs(r.near_next - like(pieces(t), pieces(n))) < 1e-9
    by_text = {}
    for i, t in docs:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(Q.op1_fingerprints(spark, sf).collect(), docs)


def test_odd_texts_and_long_ones(spark):
    rnd = random.Random(1)
    long = "\n".join(" ".join(str(rnd.randrange(10**6)) for _ in range(9)) for _ in range(900))
    docs = [(3, None), (-5, ""), (10**15, long), (7, long[: len(long) // 2]), (8, "é" * 3), (9, " \n "), (11, "a\n" * 40), (12, "a\n" * 40)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, digests string, cells int")
    rows = X.edited_likeness(df).collect()
    check(rows, docs)
    assert all(r.edited_tries > 0 and r.next_tries > 0 for r in rows)


def test_very_long_texts_in_time_that_grows_with_their_digests(spark):
    a = [f"line {i} of the first" for i in range(100_000)]
    b = a[:99_000] + [f"line {i} of the second" for i in range(99_000, 130_000)]
    df = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string")
    rows = df.select(F.expr(X.digests_sql("a")).alias("da"), F.expr(X.digests_sql("b")).alias("db"))
    rows = rows.withColumns({"ca": F.expr(X.sketch_sql("da")), "cb": F.expr(X.sketch_sql("db"))})
    r = X.with_difference(rows, "d", "da", "db", "ca", "cb").selectExpr("size(da) as a", "size(db) as b", "size(d.only_a) as only_a", "size(d.only_b) as only_b", "d.tries", "size(array_intersect(da, db)) as both").first()
    assert (r.a - r.only_a, r.b - r.only_b) == (r.both, r.both) and r.tries > 2


def test_short_and_shifted_copies_share_paragraphs(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(n)) for n in (30, 40, 60, 300, 900)]
    rows = [(t, " ".join(t.split()[: len(t.split()) * 3 // 4]) + " x" * (len(t.split()) // 4)) for t in texts] + [(t, "new " + t) for t in texts]
    got = spark.createDataFrame(rows, "a string, b string").select(F.expr(f"size(array_intersect({X.digests_sql('a')}, {X.digests_sql('b')}))").alias("n")).collect()
    assert all(r.n > 0 for r in got)


def test_empty_single_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert X.edited_likeness(df.limit(0)).count() == 0
    one = X.edited_likeness(df).first()
    assert one.near_next == 1.0
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (2, "c"), (2, "c")], "doc_id long, text string")
    assert X.edited_likeness(nulls).count() == 4
    assert X.edited_likeness(nulls.where("doc_id is null")).count() == 2


def test_difference_names_the_digests(spark):
    df = spark.createDataFrame([("\n".join(map(str, range(0, 60))), "\n".join(map(str, range(20, 90))))], "a string, b string")
    rows = df.select(F.expr(X.digests_sql("a")).alias("da"), F.expr(X.digests_sql("b")).alias("db"))
    rows = rows.withColumns({"ca": F.expr(X.sketch_sql("da")), "cb": F.expr(X.sketch_sql("db"))})
    r = X.with_difference(rows, "d", "da", "db", "ca", "cb").first()
    assert set(r.d.only_a) == set(r.da) - set(r.db) and set(r.d.only_b) == set(r.db) - set(r.da) and r.d.tries > 1
