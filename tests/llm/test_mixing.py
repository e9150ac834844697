from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docspark.llm import mixing as X
from docspark.llm import oracles
from docspark.llm import queries as Q
from oracle import same


def test_query_equals_sql(spark):
    assert same(spark, Q.op9_mixing, oracles.ORACLES["op9_mixing"], "/root/testdata/sf0.01") == 1000


def water(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    rest = float(sum(sizes.values()))
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in [*open_]:
            if target[s] >= cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.discard(s)
    return target


def docs(spark, rows):
    return spark.createDataFrame([(i, " ".join(["w"] * n) if n is not None else None, s, 0) for i, n, s in rows], "doc_id long, text string, source string, size int")


ROWS = [(i, i % 7 + 1, "a") for i in range(40)] + [(100 + i, 3, "b") for i in range(3)] + [(200, 1, None), (201, None, "c"), (None, 5, "d"), (300, 50, "e"), (301, 0, "e"), (302, 4, "é"), (302, 4, "é")]


def test_targets_and_exact_budgets(spark):
    got = X.mix(docs(spark, ROWS)).collect()
    sizes = defaultdict(int)
    for _, n, s in ROWS:
        sizes[s] += n or 0
    want = water(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(ROWS) and all(abs(taken[s] - want[s]) < 1 + 1e-6 for s in sizes)
    fine = lambda n: sorted(map(str, X.mix(docs(spark, ROWS).repartition(n), rows_per_range=1).collect()))
    assert fine(1) == fine(5) == sorted(map(str, got))


def test_applied(spark):
    df = docs(spark, ROWS).withColumnRenamed("size", "n_chars")
    kept = X.apply_mix(df).collect()
    taken = defaultdict(int)
    for r in X.mix(df).collect():
        taken[r.doc_id] += r.taken
    words = defaultdict(int)
    for r in kept:
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {k: v for k, v in taken.items() if v} and X.apply_mix(df).columns == df.columns


def test_ties_and_null_ids_are_taken_alike_for_any_partitioning(spark):
    rows = [(1, f"a{i} b c d e", "s") for i in range(6)] + [(None, f"n{i} o p", "s") for i in range(50)] + [(7, "same words here", "s")] * 40 + [(i + 10, "x y z", "t") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {n: sorted(map(str, X.apply_mix(df.repartition(n), rows_per_range=2).collect())) for n in (1, 3, 7)}
    assert kept[1] == kept[3] == kept[7]
    odd = df.withColumns({c: F.lit(1) for c in ("key", "size", "row", "name", "cut", "taken", "range", "words")})
    out = X.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == len(kept[1])


def test_documents_do_not_move(spark):
    """Only keys and sums are shuffled: the plan over the documents has no exchange but those of small sides."""
    plan = X.apply_mix(docs(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_nothing(spark):
    df = docs(spark, ROWS)
    assert X.mix(df.limit(0)).count() == 0
    assert [(r.target, r.taken) for r in X.mix(df.where("doc_id = 201")).collect()] == [(0.0, 0)]
