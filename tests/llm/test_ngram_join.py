import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import ngram_join as X
from docspark.llm import oracles
from docspark.llm import queries as Q
from oracle import same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    part = list(range(len(rows)))

    def root(a):
        while part[a] != a:
            part[a] = part[part[a]]
            a = part[a]
        return a

    having = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in having[x]:
                common[j] += 1
            having[x].append(i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def texts(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for size, copies in ((25, 12), (140, 40), (600, 25), (60, 90)):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            b = list(base)
            for _ in range(rnd.randint(0, max(1, size // 20))):
                b[rnd.randrange(size)] = rnd.choice(vocabulary)
            out.append(" ".join(b[: int(size * rnd.choice([1, 1, 0.9, 0.8, 0.75]))]))
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(50)) for _ in range(3)]
    out += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))) + " " + rnd.choice(passages) for _ in range(80)]
    out += [" ".join(rnd.sample(passages, rnd.randint(1, 3))) for _ in range(20)]
    return out + ["", None, " \n", "A b", "a B", "a b c d e", "É x", "é x"]


def test_lists_leave_no_linked_set_alone(spark):
    """lone() for all sizes that can link, with the least that the lists of a linked pair must share."""
    worst = []
    for n in range(1, 3000):
        m = np.arange((3 * n + 3) // 4, 4 * n // 3 + 1)
        o = -(-3 * (n + m) // 7)
        m, o = m[o <= np.minimum(n, m)], o[o <= np.minimum(n, m)]
        if not len(m):
            continue
        if n == 1:
            assert list(m) == [1] and list(o) == [1]  # then the sets are equal
        # the list of m ends first; what is shared of it is listed by both
        shared = X.prefix_size(m) - (m - o)
        worst += [(int(n), int(shared.min())), *((int(a), int(b)) for a, b in zip(m, shared))]
    least = {}
    for n, c in worst:
        least[n] = min(c, least.get(n, c))
    rows = spark.createDataFrame(list(least.items()), "n long, others long")
    assert rows.where(X.lone(F.col("n"), F.col("others"))).where("n > 1").count() == 0


def brute_links(rows):
    """Per row its number of links, and the linked pairs of rows with different sets, as pairs of row numbers."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    number, pairs = [0] * len(rows), []
    for i, s in enumerate(sets):
        for j in range(i):
            c = len(s & sets[j])
            if s and 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                number[i] += 1
                number[j] += 1
                if s != sets[j]:
                    pairs.append((j, i))
    return number, pairs


@pytest.mark.parametrize("seed, block", [(1, 256), (3, 8)])
def test_links_and_components_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(X, "BLOCK", block)
    some = texts(seed)
    rows = list(enumerate(some + random.Random(seed).sample(some, 60)))
    random.Random(seed).shuffle(rows)
    number, pairs = brute_links(rows)
    j = X.join(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3))
    got = {r.doc_id: r for r in j.documents.collect()}
    assert [got[i].n_links for i, _ in rows] == number
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.values()), key=str) == brute(rows)
    links = [(r.x, r.y) for r in j.links.collect()]
    assert len(links) == len(set(links)) and all(x < y for x, y in links)
    assert set(links) == {tuple(sorted((got[rows[i][0]].node, got[rows[k][0]].node))) for i, k in pairs}


def test_three_texts_that_all_link_have_three_links(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(3)] + [(3, " ".join([*base, "end0"])), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    j = X.join(df)
    assert j.links.count() == 3
    assert sorted((r.doc_id, r.n_links) for r in j.documents.collect()) == [(0, 3), (1, 3), (2, 3), (3, 3), (4, 0)]


def test_query_equals_sql(spark):
    assert same(spark, Q.op5_ngram_join, oracles.ORACLES["op5_ngram_join"], "/root/testdata/sf0.001") == 200


def test_odd_ids_and_one_per_component(spark):
    long = " ".join(f"k{i}" for i in range(40))
    rows = [(5, long), (5, long), (None, long + " z"), (7, "solo text that is its own thing"), (8, ""), (9, None), (9, "other words stand here alone now"), (3, long.upper())]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, component_id string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in X.join(df).documents.collect()), key=str) == brute(rows)
    kept = X.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) + (r.text or "-")[:4] for r in kept.collect()) == ["3K0 K", "7solo", "8-", "9-", "9othe"]
    clash = df.withColumnsRenamed({"component_id": "h"}).withColumns({"id": F.lit(1), "node": F.lit(2), "want": F.lit(3), "row": F.lit(4), "first": F.lit(5)})
    kept = X.keep_one(clash)
    assert kept.columns == clash.columns and kept.count() == 5
    assert X.keep_one(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    edited = [w if i % 150 else "new" for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base[:44_000])), (4, " ".join(base[10_000:59_000])), (5, "one " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in X.join(df).documents.collect()), key=str) == brute(rows)


def test_many_rows_without_id_and_with_one_id(spark):
    """Each text is read for its node alone, however many rows have its id."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, f"{passage} e{i}") for i in range(150)] + [(4, f"{passage} f{i} g{i} h{i}") for i in range(150)] + [(None, f"{passage} e0")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in X.join(df).documents.collect()), key=str) == brute(rows)
    hashes = dict(df.select("text", F.xxhash64("text")).collect())
    assert X.keep_one(df).collect() == [(4, min((t for i, t in rows if i == 4), key=lambda t: hashes[t]))]
