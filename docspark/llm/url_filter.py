"""URL filters: block and allow rules by host and path, gradient-boosted trees where no rule fits.

The trees learn from labelled URLs (by default those that a rule judges) on lexical features alone: lengths,
depths, digit ratio, entropy, parameters and what the labels say of the host's suffixes.  A labelled URL never counts in its own
suffix statistics: they come from the other folds of hosts, and for half of the URLs from other suffixes alone,
as URLs to be judged often have suffixes that no label names.  Both labels weigh the same in the fit.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, scratch_table

#: Verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The trees are fitted on about this many labelled rows at most; suffix statistics count all of them.
MOST_LABELLED = 50_000
FOLDS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_chars", "host_chars", "path_chars", "host_depth", "path_depth", "digit_ratio", "entropy", "params", "param_chars", "fragment", "marks", "last_rate", "last_seen", "pair_rate", "pair_seen")


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both are empty for null URLs and those without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    out = pages.withColumn("_rest", rest)
    host = F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return out.withColumns({"host": host, "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)}).drop("_rest")


def match_rules(split: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (host and path of the longest that fits, or null) and rule_verdict.

    A rule fits its host and all hosts below it if the path starts with its path.  Of equally long rules that
    fit, block wins.  The rules travel in the plan: meant for lists of some thousands.
    """
    if not rules:
        return split.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    listed = F.array(*(F.struct(F.lit(len(h + p)).alias("n"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules))
    fits = F.filter(listed, lambda r: ((F.col("host") == r["host"]) | F.endswith("host", F.concat(F.lit("."), r["host"]))) & F.startswith("path", r["path"]))
    best = F.array_max(fits)
    out = split.withColumn("_best", best)
    return out.withColumns({"rule": F.concat("_best.host", "_best.path"), "rule_verdict": F.col("_best.verdict")}).drop("_best")


def _share(col: Column, of: Column) -> Column:
    return col / F.greatest(of, F.lit(1))


def suffixes(split: DataFrame) -> DataFrame:
    """Adds the suffixes last and pair; pair starts with last."""
    last = F.substring_index("host", ".", -1)
    return split.withColumns({"last": last, "pair": F.concat_ws("/", last, F.regexp_extract("path", "^/([^/]*)", 1))})


def lexical(split: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features but for the suffix statistics, and the suffixes."""
    u = F.coalesce(F.col(url), F.lit(""))
    out = suffixes(split).withColumn("_u", u)
    query = F.regexp_extract("_u", r"^[^?#]*\?([^#]*)", 1)
    chars = F.split("_u", "")
    seen = F.transform(F.array_distinct(chars), lambda c: F.length("_u") - F.length(F.replace("_u", c, F.lit(""))))
    entropy = F.aggregate(seen, F.lit(0.0), lambda a, n: a - n / F.length("_u") * F.log2(n / F.length("_u")))
    n = F.length("_u")
    return out.withColumns(
        {
            "url_chars": n,
            "host_chars": F.length("host"),
            "path_chars": F.length("path"),
            "host_depth": F.regexp_count("host", F.lit(r"\.")),
            "path_depth": F.regexp_count("path", F.lit("/")),
            "digit_ratio": _share(F.regexp_count("_u", F.lit("[0-9]")), n),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
            "param_chars": F.length(query),
            "fragment": F.instr("_u", "#").cast("boolean").cast("int"),
            "marks": F.regexp_count("_u", F.lit("[-_%=]")),
        }
    ).drop("_u")


def _suffix_counts(labelled: DataFrame) -> DataFrame:
    """last, pair, fold (of the host), ones, seen: all of `labelled` counted."""
    rows = suffixes(split_url(labelled)).withColumn("fold", _fold())
    return scratch_table(rows.groupBy("last", "pair", "fold").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).cast("double").alias("seen")), "suffixes")


def _fold() -> Column:
    return F.pmod(F.xxhash64("host", F.lit("fold")), F.lit(FOLDS)).cast("int")


def _rates(counts: DataFrame) -> dict[str, DataFrame]:
    """Per suffix, broadcast if counted to be few: ones and seen."""
    tables = {s: scratch_table(counts.groupBy(s).agg(F.sum("ones").alias(f"{s}_ones"), F.sum("seen").alias(f"{s}_seen")), s) for s in ("last", "pair")}
    return {s: F.broadcast(t) if t.count() <= BROADCAST_IDS // 10 else t for s, t in tables.items()}


def _with_stats(rows: DataFrame, counts: DataFrame, own: bool) -> DataFrame:
    """Adds smoothed share of label 1 and count of both suffixes; `own` rows are among the counted ones and are taken out."""
    for suffix, table in _rates(counts).items():
        rows = rows.join(table, suffix, "left")
    if own:
        rows = rows.withColumns({"fold": _fold(), "apart": F.pmod(F.xxhash64("url", F.lit("apart")), F.lit(2)) == 0})
        for suffix in ("last", "pair"):
            mine = counts.groupBy(suffix, "fold").agg(F.sum("ones").alias("mine_ones"), F.sum("seen").alias("mine_seen"))
            rows = rows.join(mine, [suffix, "fold"], "left")
            for c in ("ones", "seen"):
                whole = F.when(F.col("apart"), F.col(f"pair_{c}")).otherwise(F.col(f"mine_{c}"))  # what is taken out
                rows = rows.withColumn(f"{suffix}_{c}_left", F.col(f"{suffix}_{c}") - whole)
            rows = rows.drop("mine_ones", "mine_seen")
        rows = rows.withColumns({f"{s}_{c}": F.col(f"{s}_{c}_left") for s in ("last", "pair") for c in ("ones", "seen")})
    for s in ("last", "pair"):
        seen = F.coalesce(f"{s}_seen", F.lit(0.0))
        rows = rows.withColumn(f"{s}_rate", (F.coalesce(f"{s}_ones", F.lit(0.0)) + 0.5) / (seen + 1)).withColumn(f"{s}_seen", seen)
    return rows


def _sample(labelled: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """About `most` of the n rows, each by its own chance, so that rows of one URL come in part."""
    return labelled.where(F.rand(seed) < most / n) if n > most else labelled


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, most: int = MOST_LABELLED, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """`pages` (url and any columns) with host, path, rule, score, verdict.

    labelled: url and label (1: block); by default the URLs of `pages` that a rule judges.  verdict is the
    rule's, else block where the trees' score is 0.5 or more.  With labels of one kind only the score is that
    label, without any it is 0.  Every row is kept; repeated URLs get equal verdicts.
    """
    # the caller's columns travel in one, so that none of their names clash
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    known = match_rules(split_url(pages.select(F.struct(*own).alias("_row"), "url")), rules)
    if labelled is None:
        labelled = known.where("rule is not null").select("url", (F.col("rule_verdict") == "block").cast("double").alias("label"))
    else:
        labelled = labelled.where("label is not null").select("url", F.col("label").cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        scored = known.withColumn("score", F.lit([*counts, 0.0][0]))
    else:
        suffix_counts = _suffix_counts(labelled)
        # the sample is taken by all tasks; what is written of it is small
        learned = scratch_table(lexical(split_url(_sample(labelled, sum(counts.values()), most, seed))), "labelled_urls")
        even = {label: sum(counts.values()) / (2 * n) for label, n in counts.items()}
        learned = _with_stats(learned, suffix_counts, own=True).withColumn("_weight", F.when(F.col("label") == 1, even[1.0]).otherwise(even[0.0]))
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        model = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=trees, maxDepth=depth, seed=seed)
        # fitting goes over the small table many times
        fitted = scratch_table(vector.transform(learned).select("_features", "label", "_weight"), "url_features").coalesce(4)
        model = model.fit(fitted)
        scored = model.transform(vector.transform(_with_stats(lexical(known), suffix_counts, own=False)))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("_row.*", "host", "path", "rule", "score", verdict.alias("verdict"))
