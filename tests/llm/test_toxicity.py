import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import queries as Q
from docspark.llm import toxicity as X


def test_risk_estimator_recovers_a_separable_class():
    rnd = np.random.default_rng(0)
    n, prior = 3000, 0.2
    truth = rnd.random(n) < prior
    p = truth & (rnd.random(n) < 0.5)
    rows, cols = [], []
    for i in range(n):
        for c in range(5):
            if rnd.random() < (0.6 if truth[i] else 0.01):
                rows.append(i), cols.append(c)
    w, b = X.fit_nnpu(p, np.ones(n, bool), np.array(rows), np.array(cols), np.ones(len(rows)), 5, prior)
    g = np.bincount(rows, w[cols], minlength=n) + b
    # a lone feature is likelier of a negative here, so the truth is what to compare with
    assert (w > 0).all() and b < 0 and ((g > 0) == truth).mean() > 0.97


def test_weights_are_a_minimum_of_the_risk():
    """The risk, written out term by term, is no lower near the fitted weights."""
    rnd = np.random.default_rng(1)
    n, prior, lasso = 400, 0.3, 2e-4
    x = (rnd.random((n, 3)) < [0.5, 0.3, 0.4]).astype(float)
    p = (x[:, 0] + 0.5 * x[:, 1] + rnd.normal(0, 0.3, n) > 0.9) & (rnd.random(n) < 0.6)
    rows, cols = np.nonzero(x)

    def risk(w, b):
        g = x @ w + b
        loss = lambda z: np.log1p(np.exp(-z))
        return prior * loss(g[p]).mean() + max(0.0, loss(-g).mean() - prior * loss(-g[p]).mean()) + lasso * np.abs(w).sum()

    w, b = X.fit_nnpu(p, np.ones(n, bool), rows, cols, np.ones(len(rows)), 3, prior, steps=3000, lasso=lasso)
    least = risk(w, b)
    for _ in range(200):
        step = rnd.normal(0, 0.05, 4)
        assert risk(w + step[:3], b + step[3]) > least - 2e-3
    assert risk(np.zeros(3), 0.0) > least + 0.05


def test_scores_are_sums_of_the_weights_of_words(spark):
    weights, bias = {"vile": 1.5, "vile-": 0.25, "rott-": 0.75, "calm": -2.0}, -1.0
    texts = ["Vile VILE words", "vilely rotten, calm", "rotten-rotted 4vile4", "", None, "calm " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in X.score(df, weights, bias).collect():
        words = {w for w in re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())}
        total = bias
        for w in words:
            total += weights.get(w, 0) + sum(weights.get(w[:k] + "-", 0) for k in (4, 5, 6) if len(w) > k)
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-12 and r.predicted == (r.score >= 0.5)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op3_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    for r in rows[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    s, y = np.array([h[0] for h in held]), np.array([h[2] for h in held]) == 1
    rank = np.empty(len(s))
    rank[np.argsort(s, kind="stable")] = np.arange(len(s))
    assert (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum()) > 0.95
    flagged = np.array([h[1] for h in held]) == 1
    assert flagged[~y].mean() < 0.01 and flagged[y].mean() > 0.9


def test_rates_in_unlabelled_texts_are_of_all_of_them(spark, monkeypatch):
    # `lotus` is as common in toxic texts as `vile`, and in a few clean ones too, of which the sample sees next to none
    text = lambda i: f"words {i} " + ("vile lotus" if i % 100 == 0 else "lotus" if i % 20 == 1 else "calm")
    docs = spark.createDataFrame([(i, text(i)) for i in range(6000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(6000)], "doc_id long, toxic int")
    monkeypatch.setattr(X, "MOST_UNLABELLED", 20)
    assert X._sample(docs, labels)[0].where("u").count() < 50
    weights, _ = X.fit(docs, labels)
    assert "vile" in weights and "lotus" not in weights and "lotu-" not in weights


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"nice words here {i}" + (" vile" if i % 4 == 0 else ""), "s", 9.0) for i in range(200)] + [(None, None, None, None), (500, "", "s", 1.0), (501, "vile " * 30000, "s", 1.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.toxicity(docs, labels).collect()}
    assert len(got) == 203 and got[8].predicted == 1 and got[9].predicted == 0 and got[500].predicted == 0 and got[501].predicted == 1 and got[None].held_out
    kept = X.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 203 - 51
    clash = docs.withColumns({c: F.lit(1) for c in ("id", "hash", "h", "_row", "held_out", "predicted")})
    assert X.keep_clean(clash, labels).columns == clash.columns and X.keep_clean(clash, labels).count() == 203 - 51
    assert {r.score for r in X.toxicity(docs, labels.limit(0)).collect()} != {None} and X.toxicity(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i} vile" if i % 3 == 0 else f"text {i}") for i in range(300)], "doc_id long, text string")
    rows = [(i, int(i % 3 == 0)) for i in range(300)]
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in rows]
    fit = lambda r: X.fit(docs, spark.createDataFrame(r, "doc_id long, toxic int"))
    assert fit(rows) == fit(flipped)
