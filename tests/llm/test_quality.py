import random

import pytest
from pyspark.sql import functions as F

from docspark.llm import oracles
from docspark.llm import quality as X
from docspark.llm import queries as Q
from oracle import same


def test_query_equals_sql(spark):
    assert same(spark, Q.op2_quality_rules, oracles.ORACLES["op2_quality_rules"], "/root/testdata/sf0.01") == 1000
    # the method rejects documents of every language beyond the base rules, and hardly a good one
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    beyond = Q.op2_quality_rules(spark, sf).where("not kept and not base_failed").join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id", "left")
    assert {r.lang for r in beyond.select("lang").distinct().collect()} == {"de", "en", "es", "fr"}
    assert beyond.where("quality = 1").count() == 0 < beyond.where("quality = 0").count()


def test_thin_strata_are_pooled_and_strict_cutoffs_need_bad_documents(spark):
    words = lambda i, j, junk: " ".join(f"w{i}x{k}" + "#" * junk for k in range(25))
    docs, labels = [], []
    for i in range(400):  # ten strata of 40 documents each, a quarter of which is junk, and one large one without any
        docs.append((i, f"thin{i % 10}", words(i, 0, 4 * (i % 4 == 0))))
        labels.append((i, int(i % 4 != 0)))
    docs += [(1000 + i, "large", words(i, 1, 4 * (i >= 390))) for i in range(400)]
    labels += [(1000 + i, 1) for i in range(390)]
    got = {r.doc_id: r.kept for r in X.quality(spark.createDataFrame(docs, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(400))
    assert all(got[1000 + i] for i in range(400))  # nothing there says what is bad


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)})


def test_repeated_windows(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(150)] + ["a " * 5000, "", None]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.n_repeat_words for r in X.base_features(df).collect()}
    assert got == {i: brute_repeats((t or "").split()) for i, t in enumerate(texts)}


def test_binomial_against_plain_sums():
    from math import comb

    for n, k, p in ((50, 2, 0.1), (200, 0, 0.012), (30, 5, 0.4)):
        assert X.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    assert X.certified(0, 1000, 0.012, 0.001) and not X.certified(0, 100, 0.012, 0.001) and not X.certified(0, 0, 0.5, 0.5)
    assert not X.certified(12, 1000, 0.012, 0.9)


def test_binomial_in_sql_is_that_in_python(spark):
    cases = [(k, n, p) for n in (1, 12, 50, 3000, 10**7) for p in (0.002, 0.012, 0.4) for k in {0, int(n * p * 0.5), int(n * p * 0.97), max(0, int(n * p) - 1), n}]
    for p in {p for _, _, p in cases}:
        some = [(k, n) for k, n, q in cases if q == p]
        got = spark.createDataFrame(some, "k long, m long").select("k", "m", F.expr(X.chance_sql("k", "m", p)).alias("p")).collect()
        for r in got:
            assert r.p == pytest.approx(X.binomial_cdf(r.k, r.m, p), rel=1e-6, abs=1e-300)


def test_every_stratum_gets_cutoffs(spark):
    # 1,100 strata of 14 good documents and one of junk
    rows = spark.range(1100 * 15).selectExpr("id as doc_id", "concat('l', id % 1100) as lang", "id >= 1100 * 14 as junk")
    docs = rows.selectExpr("doc_id", "lang", "array_join(transform(sequence(1, 25), x -> concat('w', x, 'x', doc_id, if(junk, '####', ''))), ' ') as text")
    labels = rows.selectExpr("doc_id", "if(junk, 0, 1) as quality")
    got = X.quality(docs, labels, risk=0.99, delta=0.9).groupBy(F.expr("doc_id >= 1100 * 14").alias("junk")).agg(F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r.junk: r.kept for r in got} == {True: 0, False: 1100 * 14}


def test_thresholds_hold_the_promise_and_catch_junk(spark):
    good = [(i, "good", "word " * 5 + " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(900)]
    junk = [(1000 + i, "bad", " ".join(f"v{i}x{j}###" for j in range(30)), "en") for i in range(50)]
    other = [(2000, "few", " ".join(f"q{j}###" for j in range(30)), None), (2001, "none", None, "en"), (None, "x", " ".join(f"n{j}" for j in range(30)), "en")]
    docs = spark.createDataFrame(good + junk + other, "doc_id long, kept string, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)] + [(1000 + i, 0, 0) for i in range(50)] + [(None, 1, None), (5, None, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in X.quality(docs, labels).collect()}
    assert len(got) == 953 and all(got[i] for i in range(900)) and not any(got[1000 + i] for i in range(50))
    assert got[2000] and not got[2001] and got[None]
    kept = X.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 902
    clash = docs.withColumnsRenamed({"kept": "hash"}).withColumns({"id": F.lit(1), "_id": F.lit(1), "_hash": F.lit(2), "good": F.lit(3), "_stratum": F.lit(4)})
    assert X.keep_good(clash, labels).columns == clash.columns and X.keep_good(clash, labels).count() == 902
    none = X.quality(docs, labels.limit(0)).where("kept <> (not base_failed)")
    assert none.count() == 0 and X.quality(docs.limit(0), labels).count() == 0
    twice = X.quality(docs.union(docs), labels)
    assert twice.count() == 2 * 953 and twice.where("kept").count() == 2 * 902


def test_native(spark):
    plan = X.base_features(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, lang string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
