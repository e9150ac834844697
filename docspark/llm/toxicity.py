"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings is fitted in numpy from confirmed toxic texts (P) and
unlabelled texts (U), minimising the class-prior-corrected risk

    prior * mean_P loss(g) + max(0, mean_U loss(-g) - prior * mean_P loss(-g))

with the logistic loss; while the part in max() is negative, its gradient is undone instead (Kiryo et al., 2017).
Words are chosen by their rates in all training texts; fitting takes a bounded sample, scoring every text as a whole.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, scratch_table, small_batches, without
from .piece_table import by_chars, tidied

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The fit's sample: about this many confirmed toxic texts at most, and the method's sample of unlabelled ones, chosen by hash of doc_id.
MOST_TOXIC, MOST_UNLABELLED = 5_000, 20_000
#: Beginnings of words that are features beside the words, and how clearly (in standard errors) features must favour P.
BEGINNINGS, CLEAR = (4, 5, 6), 4.0
#: Times the rate in U that toxic texts alone would give a feature.
SPARE = 2.5
#: Words whose weight a worker keeps.
KEPT_WORDS = 100_000
FOLDS = 5

_LETTERS = re.compile(r"[^\W\d_]+")


def fold(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, mod 5; 0 is held out.  A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS))


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def text_features(text: str) -> Counter:
    """How many distinct words of the text have each feature."""
    return Counter(f for w in set(_LETTERS.findall(text.lower())) for f in word_features(w))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float] | None:
    """text, p, u of the bounded sample, and the share of toxic among labelled training rows; None without toxic ones."""
    marked = labels.where("doc_id is not null and toxic is not null").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = marked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not seen["p"]:
        return None
    rank = F.pmod(F.xxhash64("doc_id", F.lit("pu")), F.lit(1_000_000_007)) / 1_000_000_007
    toxic = marked.where("toxic = 1").where(rank < MOST_TOXIC / seen["p"]).select("doc_id", F.lit(True).alias("p"))
    total = docs.count()
    # toxic is bounded by MOST_TOXIC rows
    both = docs.select("doc_id", "text").join(F.broadcast(toxic), "doc_id", "left")
    both = both.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("p", F.lit(False)).alias("p"), ((fold() != 0) & (rank < MOST_UNLABELLED / max(total, 1))).alias("u"))
    return scratch_table(both.where("p or u"), "pu_sample"), seen["p"] / seen["n"]


def _choose(docs: DataFrame, sample: DataFrame, prior: float) -> list[str]:
    """The features that favour P over U most clearly, and that U has hardly beyond its toxic texts' part.

    A feature of toxic texts alone has a rate in U of prior times that in P.  U is every training text of `docs`
    here; counted are the features of two texts of P or more.
    """

    def of_toxic(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in by_chars(batches, "text"):
            p = Counter(f for t in texts for f in text_features(t))
            yield pa.RecordBatch.from_pydict({"feature": pa.array([*p], pa.string()), "p": pa.array([*p.values()], pa.int64())})

    toxic = sample.where("p")
    found = toxic.select("text").mapInArrow(tidied(of_toxic), "feature string, p long").groupBy("feature").agg(F.sum("p").alias("p")).where("p >= 2").toArrow()
    names = found["feature"].to_pylist()
    p, n_p = found["p"].to_numpy().astype(np.float64), toxic.count()
    place = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def of_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = place.value, {}
        u, n = np.zeros(len(at), np.int64), 0
        for _, texts in by_chars(batches, "text"):
            for t in texts:
                has: set[int] = set()
                for w in set(_LETTERS.findall(t.lower())):
                    if w not in known:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        known[w] = tuple(at[f] for f in word_features(w) if f in at)
                    has.update(known[w])
                u[list(has)] += 1
                n += 1
        some = np.flatnonzero(u)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(u[some], n), pa.int64())], names=["i", "u"])

    counted = docs.where(fold() != 0).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidied(of_all), "i long, u long").groupBy("i").agg(F.sum("u").alias("u")).toArrow()
    seen = dict(zip(counted["i"].to_pylist(), counted["u"].to_pylist()))
    n_u = max(seen.get(-1, 0), 1)
    u = np.array([seen.get(i, 0) for i in range(len(names))], dtype=np.float64)
    rate_p, rate_u = p / n_p, u / n_u
    z = (rate_p - rate_u) / np.sqrt((p + u) / (n_p + n_u) * (1 / n_p + 1 / n_u))
    fits = np.flatnonzero((z >= CLEAR) & (rate_u <= SPARE * prior * rate_p + 2 / n_u))
    return [names[i] for i in sorted(fits, key=lambda i: (-z[i], names[i]))]


def _matrix(sample: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """p and u per sampled text; row, column and value of each feature that a text has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(features)}
        for batch in batches:
            for part, texts in by_chars([batch], "text"):
                has = [[(place[f], n) for f, n in text_features(t).items() if f in place] for t in texts]
                yield pa.RecordBatch.from_pydict({"p": part["p"], "u": part["u"], "cols": pa.array([[c for c, _ in h] for h in has], pa.list_(pa.int32())), "values": pa.array([[n for _, n in h] for h in has], pa.list_(pa.int32()))})

    got = sample.mapInArrow(tidied(run), "p boolean, u boolean, cols array<int>, values array<int>").toArrow()
    sizes = np.array([len(x) for x in got["cols"].to_pylist()], dtype=np.int64)
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy() if len(got) else np.empty(0, np.int32)
    return got["p"].to_numpy(), got["u"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), flat("cols"), flat("values").astype(np.float64)


def fit_nnpu(p: np.ndarray, u: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_features: int, prior: float, steps: int = 600, rate: float = 0.1, lasso: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk plus lasso times the weights, by Adam over the whole sample.

    The lasso leaves nothing to words that toxic texts only happen to share, which would add up in long texts.
    """
    p, u = p.astype(np.float64), u.astype(np.float64)
    p, u, n = p / max(p.sum(), 1), u / max(u.sum(), 1), len(p)
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    for step in range(1, steps + 1):
        g = np.bincount(rows, values * w[cols], minlength=n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
        negative = u @ np.logaddexp(0, g) - prior * (p @ np.logaddexp(0, g))
        positive_grad, negative_grad = prior * p * (s - 1), (u - prior * p) * s
        d = positive_grad + negative_grad if negative >= 0 else -negative_grad
        grad = np.append(np.bincount(cols, values * d[rows], minlength=n_features), d.sum())
        grad[:-1] += lasso * np.sign(w[:-1])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return np.where(np.abs(w[:-1]) < 0.05, 0, w[:-1]), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[dict[str, float], float]:
    """Feature weights and bias.  labels: doc_id, toxic; only rows of folds other than 0 are looked at.

    prior: the share of toxic texts; by default that of the labelled training rows.  Without toxic labels
    there are no weights and the score is 0 throughout.
    """
    small_batches(docs.sparkSession)
    sampled = _sample(docs, labels)
    if sampled is None:
        return {}, -50.0
    sample, share = sampled
    prior = min(max(prior if prior is not None else share, 1e-4), 0.999)
    if not sample.where("p").head(1):
        return {}, -50.0
    features = _choose(docs, sample, prior)
    w, b = fit_nnpu(*_matrix(sample, features), len(features), prior)
    return {f: float(x) for f, x in zip(features, w) if x}, b


def score(docs: DataFrame, weights: dict[str, float], bias: float, keep_text: bool = False) -> DataFrame:
    """`docs` with held_out, score and predicted, and without text unless it is kept; null texts are empty, every row stays.

    Columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted") and (keep_text or c != "text")]
    rows = docs.select(*dict.fromkeys([*keep, "text"]), (fold() == 0).alias("held_out"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for part, texts in by_chars(batches, "text"):
            sums = []
            for t in texts:
                words = set(_LETTERS.findall(t.lower()))
                new = [w for w in words if w not in known]
                if len(known) + len(new) > KEPT_WORDS:
                    known.clear()
                    new = list(words)
                for w in new:
                    known[w] = sum(weights.get(f, 0.0) for f in word_features(w))
                sums.append(sum(sorted(x for x in map(known.__getitem__, words) if x)) + bias)
            s = 1 / (1 + np.exp(-np.clip(np.array(sums), -500, 500)))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), part["held_out"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    schema = rows.select(*keep, "held_out").schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return rows.mapInArrow(tidied(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """fit() and score() over the same documents (doc_id, text, any columns)."""
    return score(docs, *fit(docs, labels, prior))


def keep_clean(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """`docs` without the rows that are predicted toxic; rows are told apart by doc_id and text.  Only ids and texts go to Python."""
    id_, hash_ = free_name(docs, "id"), free_name(docs, "hash")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    gone = score(texts, *fit(docs, labels, prior)).where("predicted = 1").select(F.col("doc_id").alias(id_), F.col("h").alias(hash_)).distinct()
    return without(docs, gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)))
