import random

from pyspark.sql import functions as F

from docspark.llm import queries as Q
from docspark.llm import url_filter as X


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    if path[:1] != "/":
        path = ""
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


def rule_of(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in X.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = Q.op6_url_filters(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        verdict, rule = rule_of(*brute(urls[r.page_id]))
        assert (r.host, r.path) == brute(urls[r.page_id]) and r.rule == rule and r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == verdict
        else:
            assert (r.verdict == "block") == (r.score >= 0.5)


ODD = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.Com/en/7x?a=/b#c", "http://a?b/c", "x://h#f/p", "http://notexample.com/en/7", "http://com/en/", "http://É.ORG/es/1", "http://h/" + "p/" * 5000, "http://a/b://c"]


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(ODD)] * 2, "page_id long, url string, host string, params int")
    rows = X.judge(df).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        assert (r.host, r.path) == brute(r.url) and r.rule == rule_of(r.host, r.path)[1]
    assert X.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in X.judge(df.where("url = 'no scheme'")).collect()} == {"allow"}


def test_verdicts_of_the_contract(spark):
    """Each rule's own word, and the longest where two fit."""
    want = {
        "http://a.com/en/6": ("com/en/", "block"),
        "http://a.example.com/en/77": ("example.com/en/7", "allow"),
        "http://example.com/en/6": ("com/en/", "block"),
        "http://a.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://b.example.net/de/81?q": ("example.net/de/8", "block"),
        "http://a.org/es/": ("org/es/", "block"),
    }
    rows = X.judge(spark.createDataFrame([(u,) for u in want], "url string")).collect()
    assert {r.url: (r.rule, r.verdict) for r in rows} == want


def test_suffix_statistics_cover_all_labelled_rows(spark):
    rnd = random.Random(9)
    ends = [f"{a}{b}x" for a in "abcdefghijklmno" for b in "abcdefghijklmno"]
    bad = {e: rnd.randrange(2) for e in ends}
    url = lambda e: f"http://site{rnd.randrange(1000, 10000)}.{e}/p/{rnd.randrange(1000, 10000)}"
    labelled = spark.createDataFrame([(url(e), bad[e]) for e in ends for _ in range(20)], "url string, label int")
    new = spark.createDataFrame([(url(e), bad[e]) for e in ends for _ in range(2)], "url string, truth int")
    got = X.judge(new, labelled, rules=(), most=300, trees=5)
    assert got.where("(verdict = 'block') <> (truth = 1)").count() == 0


def test_a_frequent_url_is_sampled_in_part(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 'http://one.com/', concat('http://', id, '.org/')) as url", "cast(id % 2 as double) as label")
    some = X._sample(rows, 30_000, 3_000, 7).groupBy(F.expr("url = 'http://one.com/'").alias("one")).count().collect()
    assert all(abs(r["count"] - (1000 if r["one"] else 2000)) < 300 for r in some) and len(some) == 2
    assert X._sample(rows, 30_000, 30_000, 7).count() == 30_000


def test_trees_learn_lexical_labels(spark):
    rnd = random.Random(6)
    bad = lambda i: f"http://x{rnd.randrange(10**9)}.spam{i % 5}.biz/{rnd.randrange(10**9)}?a={i}&b=2&c=3"
    good = lambda i: f"https://site{'abcdefghij'[i % 10]}.org/about/page"
    labelled = spark.createDataFrame([(bad(i), 1) for i in range(200)] + [(good(i), 0) for i in range(200)], "url string, label int")
    new = spark.createDataFrame([(bad(i + 7), 1) for i in range(50)] + [(good(i + 3), 0) for i in range(50)], "url string, truth int")
    got = X.judge(new, labelled, rules=(), trees=5)
    assert got.where("(verdict = 'block') <> (truth = 1)").count() == 0


def auc(rows):
    ordered = sorted(rows)
    ones = sum(y for _, y in ordered)
    below, wins, i = 0, 0.0, 0
    while i < len(ordered):
        j = i
        while j < len(ordered) and ordered[j][0] == ordered[i][0]:
            j += 1
        n1 = sum(y for _, y in ordered[i:j])
        wins += n1 * (below + (j - i - n1) / 2)
        below += j - i - n1
        i = j
    return wins / (ones * (len(ordered) - ones))


def test_held_out_urls(spark):
    """Labels that depend on lengths and digits, and in part on the host's ending, are found again for URLs that weren't learned from."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").where("url like '%://%'")
    label = "cast(length(url) + 3 * length(regexp_replace(url, '[^0-9]', '')) + if(url like '%.org/%', 12, 0) > 50 as int)"
    marked = pages.select("url", F.expr(label).alias("truth"))
    shares = marked.agg(F.avg("truth")).first()[0]
    assert 0.05 < shares < 0.95
    held = "pmod(xxhash64(url, 'held'), 5) = 0"
    got = X.judge(marked.where(held), marked.where(f"not ({held})").withColumnRenamed("truth", "label"), rules=()).select("score", "truth").collect()
    assert len(got) > 300 and auc([(r.score, r.truth) for r in got]) > 0.97


def test_labels_weigh_the_same(spark):
    """Most URLs that a rule judges are blocked; that alone doesn't block the others."""
    shares = {r.verdict: r["count"] for r in Q.op6_url_filters(spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count().collect()}
    assert min(shares["allow"], shares["block"]) > 0.1 * sum(shares.values())


def test_suffixes_of_other_urls_only(spark):
    """A labelled URL's statistics leave its own fold out, or its own suffix."""
    rows = spark.createDataFrame([(f"http://h{i}.org/p{i % 3}/x", float(i % 2)) for i in range(200)], "url string, label double")
    counts = X._suffix_counts(rows)
    out = X._with_stats(X.lexical(X.split_url(rows)), counts, own=True).collect()
    for r in out:
        others = [o for o in out if (o.pair != r.pair if r.apart else o.fold != r.fold)]
        assert r.last_seen == len(others)
        mine = [o for o in others if o.pair == r.pair]
        assert r.pair_seen == len(mine) and abs(r.pair_rate - (sum(o.label for o in mine) + 0.5) / (len(mine) + 1)) < 1e-9
