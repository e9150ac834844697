"""Quality rules with risk-controlled thresholds.

Each rule is a ratio that grows with badness.  A labelled holdout tells, per stratum, rule and cutoff of a fixed
grid, how many good and how many bad documents the cutoff would reject.  A cutoff is certified only if the exact
(Clopper-Pearson) upper bound of its rate of false rejections stays within the allowed risk, at a confidence
that is divided by the number of strata and rules (Bonferroni).  The cutoffs of a rule are nested, so testing them from lax to strict
until one fails needs no further division.  Of the certified cutoffs that one is taken which separates bad from good
best; a rule that certifies none, or that tells bad from good nowhere, rejects nothing there.

Strata with too few good documents to certify anything are one pooled stratum, and the promise is one for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, free_name, let, scratch_table, without, words_sql

#: Rules: SQL over the base columns, cutoffs tried from strict to lax (ratio above cutoff: rejected), part of the risk.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.2, 0.3), 0.6),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.5, 0.7), 0.1),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.5), 0.1),
    "shouting": ("n_upper / greatest(word_chars, 1)", (0.15, 0.3, 0.5, 0.7), 0.1),
    "marks": ("n_marks / greatest(n_words, 1)", (0.3, 0.6, 0.9, 1.2), 0.1),
}


def repeat_words_sql(words: str) -> str:
    """SQL: how many words lie in 8-word windows found twice or more in `words` (first finding included).

    Windows are compared by 64-bit hash.  Only texts with a repeated window are sorted: windows by
    (hash, place), then the places of repeated ones; each place adds at most the 8 words up to the next.
    """
    hashes = f"transform(slice({words}, 1, greatest(size({words}) - 7, 0)), (x, i) -> xxhash64(slice({words}, i + 1, 8)))"
    pairs = "sort_array(transform(h, (x, i) -> struct(x as h, i as i)))"
    places = "sort_array(transform(filter(s, (x, i) -> x.h = try_element_at(s, i + 2).h or (i > 0 and x.h = s[greatest(i - 1, 0)].h)), x -> x.i))"
    covered = "aggregate(p, struct(0 as n, -8 as last), (a, x) -> struct(a.n + least(8, x - a.last) as n, x as last), a -> a.n)"
    counted = let(pairs, "s", let(places, "p", covered))
    return let(hashes, "h", f"if(size(array_distinct(h)) = size(h), 0, {counted})")


def base_features(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """`keep` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks, base_failed.

    Null texts have no words.  Everything is taken from the whole text.
    """
    text = F.coalesce("text", F.lit(""))
    lines = r"filter(split(_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"
    out = docs.select(*keep, text.alias("_t")).select(
        *keep,
        F.expr(let(words_sql("_t"), "w", f"named_struct('n', cast(size(w) as bigint), 'c', cast(length(array_join(w, '')) as bigint), 'r', cast({repeat_words_sql('w')} as bigint))")).alias("_w"),
        F.expr(let(lines, "l", "named_struct('n', cast(size(l) as bigint), 'd', cast(size(l) - size(array_distinct(l)) as bigint))")).alias("_l"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^!?]+", "")).cast("long").alias("n_marks"),
    )
    out = out.select(*keep, F.col("_w.n").alias("n_words"), F.col("_w.c").alias("word_chars"), "n_symbols", F.col("_l.d").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"), F.col("_l.n").alias("n_lines"), "n_upper", "n_marks")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def binomial_cdf(bad: int, n: int, rate: float) -> float:
    """P(X <= bad) for n trials at `rate`, summed from the largest term down (bad lies below the mean)."""
    if bad >= n * rate:
        return 1.0
    total, k = 0.0, bad
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    term = math.exp(log)
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k / (n - k + 1) * (1 - rate) / rate
        k -= 1
    return total


def certified(bad: int, n: int, rate: float, alpha: float) -> bool:
    """Is the exact (Clopper-Pearson) upper bound, at confidence 1 - alpha, for `bad` of `n` within `rate`?

    The bound is the rate at which seeing `bad` or fewer has chance alpha, so it lies within `rate` just if that chance at `rate` is alpha at most.
    """
    return n > 0 and binomial_cdf(bad, n, rate) <= alpha


def _lgamma_sql(x: str) -> str:
    """SQL: log of gamma(x) for x >= 1, by Stirling's series at x + 8."""
    z = f"({x} + 8D)"
    series = f"1D / (12D * {z}) - 1D / (360D * pow({z}, 3D)) + 1D / (1260D * pow({z}, 5D)) - 1D / (1680D * pow({z}, 7D))"
    steps = " - ".join(f"ln({x} + {i}D)" for i in range(8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + {series} - {steps})"


def chance_sql(bad: str, n: str, rate: float) -> str:
    """SQL: binomial_cdf of the bigints `bad` and `n`.  Terms farther below the mean than summed add less than 1e-17 of the whole."""
    log = f"{_lgamma_sql('(n + 1D)')} - {_lgamma_sql('(k + 1D)')} - {_lgamma_sql('(n - k + 1D)')} + k * {math.log(rate)!r}D + (n - k) * {math.log1p(-rate)!r}D"
    step = f"(a, i) -> struct(a.term * ((k - i) / (n - k + i + 1D)) * {(1 - rate) / rate!r}D as term, a.total + a.term as total)"
    summed = f"aggregate(sequence(0, cast(least(k, 9D * sqrt(n * {rate!r}D) + 40D) as int)), struct(exp({log}) as term, 0D as total), {step}, a -> a.total)"
    return let(f"cast({bad} as double)", "k", let(f"cast({n} as double)", "n", f"if(k >= n * {rate!r}D, 1D, {summed})"))


def rejected_counts(labelled: DataFrame, stratum: str, rules=RULES) -> DataFrame:
    """Per stratum of rows with good (boolean): numbers of good and bad ones and, per rule and cutoff, how many of each lie above it."""
    counts = [F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")]
    for name, (sql, cuts, _) in rules.items():
        for i, c in enumerate(cuts):
            above = F.expr(sql) > c
            counts += [F.count_if(above & F.col("good")).alias(f"good|{name}|{i}"), F.count_if(above & ~F.col("good")).alias(f"bad|{name}|{i}")]
    return labelled.groupBy(F.col(stratum).alias("_stratum")).agg(*counts)


def choose_cutoffs(counts: DataFrame, alpha: float, risk: float, rules=RULES) -> DataFrame:
    """_stratum and, per rule, _cut_ and its name, the cutoff taken, or null.

    risk: the most good documents, as a share, that a stratum may lose to all rules together; the rules split
    it by their part.  alpha: the chance of a wrong certificate per stratum and rule.  Of equally good cutoffs the laxest is taken.
    """
    chosen = []
    for name, (_, cuts, part) in rules.items():
        tried = []
        for i, c in enumerate(cuts):
            gain = F.try_divide(F.col(f"bad|{name}|{i}"), F.col("bad")) - F.try_divide(F.col(f"good|{name}|{i}"), F.col("good"))
            fits = (F.expr(chance_sql(f"`good|{name}|{i}`", "`good`", risk * part)) <= alpha) & (gain > 0)
            tried.append(F.when(fits, F.struct(gain.alias("gain"), F.lit(i).alias("i"), F.lit(float(c)).alias("cut"))))
        chosen.append(F.array_max(F.array_compact(F.array(*tried)))["cut"].alias(f"_cut_{name}"))
    return counts.select("_stratum", *chosen)


def cutoffs_by_stratum(counts: DataFrame, risk: float, delta: float, rules=RULES) -> tuple[DataFrame, dict[str, float | None]]:
    """choose_cutoffs() of the strata of rejected_counts() that have enough good documents, and the cutoffs of all others together.

    delta: the chance that any promise is broken.
    """
    counts = scratch_table(counts, "strata")
    alpha = delta / (max(1, counts.count()) * len(rules))
    enough = F.pow(F.lit(1 - risk * max(part for _, _, part in rules.values())), F.col("good")) <= alpha
    own = scratch_table(choose_cutoffs(counts.where(enough), alpha, risk, rules), "cutoffs")
    sums = [F.sum(c).alias(c) for c in counts.columns if c != "_stratum"]
    pooled = choose_cutoffs(counts.where(~enough).groupBy(F.lit("pooled").alias("_stratum")).agg(*sums), alpha, risk, rules).first()
    return own, {name: pooled[f"_cut_{name}"] if pooled else None for name in rules}


def verdict(pooled: dict[str, float | None], rules=RULES) -> Column:
    """Column: does a document of base_features pass the cutoffs of its stratum beside it (_own), or else the pooled ones?"""
    passes = F.lit(True)
    for name, (sql, _, _) in rules.items():
        cut = F.when(F.col("_own"), F.col(f"_cut_{name}")).otherwise(F.lit(pooled[name]).cast("double"))
        passes = passes & ~F.coalesce(F.expr(sql) > cut, F.lit(False))
    return passes


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.1, delta: float = 0.05, rules=RULES) -> DataFrame:
    """doc_id, stratum, text_hash and base columns, base_failed, kept for each row of `docs` (doc_id, text, `stratum`).

    labels: doc_id, quality (1 good, 0 bad; an id with both is bad); rows with null in either, and ids that `docs`
    lacks, say nothing.  Documents of the holdout that the base rules already reject are left out of it.  Null strata form
    one stratum.  Strata with few labels or none fall under the pooled cutoffs.
    Without labels `kept` is `not base_failed`.  Repeated rows give repeated results.
    """
    rows = docs.select("doc_id", stratum, "text", F.xxhash64("text").alias("text_hash"))
    base = scratch_table(base_features(rows, keep=("doc_id", stratum, "text_hash")), "quality")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    own, pooled = cutoffs_by_stratum(rejected_counts(base.where("not base_failed").join(known, "doc_id"), stratum, rules), risk, delta, rules)
    own = own.withColumn("_own", F.lit(True))
    beside = base.join(F.broadcast(own) if own.count() <= BROADCAST_IDS else own, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    beside = beside.withColumn("_own", F.coalesce("_own", F.lit(False)))
    return beside.select(*base.columns, (~F.col("base_failed") & verdict(pooled, rules)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`docs` without the rows that quality() doesn't keep; rows are told apart by doc_id and text.  Columns stay as they are, whatever their names."""
    judged = quality(docs, labels, **options)
    id_, hash_ = free_name(docs, "id"), free_name(docs, "hash")
    gone = judged.where("not kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return without(docs, gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)))
