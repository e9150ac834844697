"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold, and their components.

Exact copies of a set are one node, a 64-bit hash of the sorted set.  Two sets of n <= m shingles link only if they
share 3/7 (n + m) of them, so a set lacks at most n/4 of its shingles in a partner, and m <= 4/3 n.

1. Lists of each set's prefix_size(n) smallest hashes tell how many of these another set lists as well.  A set with
   too few (lone()) has no partner; what is left are whole sets of a small part of the documents.
2. Among these, shingles are ordered by how many sets have them, rare ones first.  Linked sets share one of their
   first n/4 + 1 shingles (the prefix) in that order: each looks for partners in the lists of its prefix alone.
3. Set relations: every set takes a leader, the most central set (by the mean length of its lists) of most lists
   of a sketch, if they are alike by half.  Its difference to the leader is computed once; from then on
   it stands for the set: two sets of a leader differ by |a| + |b| - 2 |a and b| shingles, a and b their differences.
4. Index lists hold one block per leader, with its sizes and its first position in the sets' order.  Pairs of blocks
   whose sizes or positions leave too little to share are skipped; what is left are pairs of leaders.  The distance
   of two leaders, computed once, bounds that of all their sets: d(s, t) >= d(l, m) - d(s, l) - d(t, m).
   Sets and whole pairs of leaders that this keeps apart are answered without being compared.
5. The rest is compared in units: the sets of one leader, or those of two leaders that may link.  Large units are dealt
   into blocks of bounded size; a pair of blocks is one small product of matrices.  It gives the number of links of
   each set and a spanning forest of the links, so neither is a row per link.

All links are found: every step leaves out only what can't link.  (Hashes of 64 bits are taken to be free of collisions.)
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, narrow, scratch_table, small_batches
from .piece_table import by_chars, tidied

#: Executors get this module's code with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 5
#: Words whose hash a worker keeps.
KEPT_WORDS = 100_000
#: Shingles of the sketch by which a set finds its leader.
SKETCH = 24
#: Nodes and shingles of a block, about; a unit of no more is compared as a whole.
BLOCK, BLOCK_SHINGLES = 256, 2**18
#: Shingles of the small units that one task takes together, about.
POOL_SHINGLES = 2**16


class _Hashes(dict):
    """64-bit hash of each word, kept for up to KEPT_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


class ShingleSets:
    """Makes the sorted distinct 64-bit hashes of the k-word shingles of texts (as bytes), A-Z lower-cased; of fewer words, that of them all."""

    def __init__(self, k: int):
        self.k, self.word, self.hashes = k, re.compile(rb"[^\x20\x09-\x0D]+"), _Hashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = self.word.findall(text.lower())  # of bytes: ASCII letters alone
        n, k = len(words), self.k
        if n < k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], dtype=np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        a = h[: n - k + 1].copy()
        for j in range(1, k):
            a ^= a >> np.uint64(29)
            a *= np.uint64(0x9E3779B97F4A7C15)
            a += h[j : n - k + 1 + j]
        for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB), (32, 1)):
            a ^= a >> np.uint64(shift)
            a *= np.uint64(factor)
        return np.unique(a)


def shingle_sets(docs: DataFrame, keep: str, k: int = SHINGLE_WORDS) -> DataFrame:
    """`keep`, node and toks of rows with `keep` (a long) and text (null: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = ShingleSets(k)
        for part, texts in by_chars(batches, "text", as_bytes=True):
            sets = [make(t) for t in texts]
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in sets], out=offsets[1:])
            toks = pa.ListArray.from_arrays(offsets, np.concatenate(sets).view(np.int64))
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part[keep].cast(pa.int64()), pa.array(node), toks], names=[keep, "node", "toks"])

    return docs.select(keep, "text").mapInArrow(tidied(run), f"{keep} long, node long, toks array<long>")


def prefix_size(n):
    """How many of its smallest hashes a set of n shingles lists; an int or an array of them."""
    return np.minimum(n, n * 3 // 10 + 2)


def lone(n: Column, others: Column) -> Column:
    """Of the hashes that a set of n lists, `others` are listed by another set too: are these too few for a partner?

    Of a linked pair let the set of m be the one whose list ends at the lower hash, and o = ceil(3/7 (n + m)) what they
    share at least.  It misses m - o at most in the other, so prefix_size(m) - (m - o) of its listed hashes are
    in the other set, and listed there as that one's list goes on to a higher hash.  For sizes that can link, this
    is at least prefix_size - size/4 - 1 of either set (tests go through the sizes).
    """
    listed = F.least(n, F.floor(n * 3 / 10) + 2)
    return (others < 1) | (others < listed - F.floor(n / 4) - 1)


def _entries(docs: DataFrame, k: int) -> DataFrame:
    """Two kinds of rows: own (doc_id, n, h: hash of the text) and node per document; and node, c, parts of the number of its listed shingles that another node lists too."""

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = ShingleSets(k)
        seen: set[int] = set()  # of the task's nodes: copies of a set enter the lists once a task
        for part, texts in by_chars(batches, "text", as_bytes=True):
            sets = [make(t) for t in texts]
            ids = [xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets]
            node, n = np.array(ids, dtype=np.uint64).view(np.int64), np.array([len(x) for x in sets], dtype=np.int64)
            own = pa.StructArray.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(n), part["h"]], names=["doc_id", "n", "h"])
            spread = pa.array(node ^ (np.arange(len(node)) << 40))  # copies aren't one key
            yield pa.RecordBatch.from_arrays([spread, pa.array(node), own], names=names)
            new = np.array([not (x in seen or seen.add(x)) for x in ids], dtype=bool)
            each = np.where(new, prefix_size(n), 0)
            toks = np.concatenate([x[:m] for x, m in zip(sets, each)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(toks), pa.array(np.repeat(node, each)), pa.nulls(len(toks), own.type)], names=names)

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held, before = [none, none], False  # the last entry so far, whose next isn't known; has the one before it the same tok?

        def counted(nodes: np.ndarray) -> pa.RecordBatch:
            node, c = np.unique(nodes, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(c.astype(np.int64)), pa.nulls(len(node), kind)], names=["node", "c", "own"])

        for batch in batches:
            kind, is_own = batch["own"].type, batch["own"].is_valid()
            mine = batch.filter(is_own)
            if mine.num_rows:
                yield pa.RecordBatch.from_arrays([mine["node"], pa.array(np.zeros(mine.num_rows, np.int64)), mine["own"]], names=["node", "c", "own"])
            some = batch.filter(pa.compute.invert(is_own)) if mine.num_rows else batch
            tok, node = (np.concatenate([x, some[c].to_numpy()]) for x, c in zip(held, ("tok", "node")))
            if not len(tok):
                continue
            fresh = np.append(True, (tok[1:] != tok[:-1]) | (node[1:] != node[:-1]))
            tok, node = tok[fresh], node[fresh]
            same = tok[1:] == tok[:-1]
            keep = np.append(before, same) | np.append(same, False)
            held, before = [tok[-1:], node[-1:]], bool(keep[-1])
            yield counted(node[:-1][keep[:-1]])
        if before:
            yield counted(held[1])

    names = ["tok", "node", "own"]
    own = "own struct<doc_id: bigint, n: bigint, h: bigint>"
    exploded = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(tidied(explode), f"tok long, node long, {own}")
    return exploded.repartition("tok").sortWithinPartitions("tok", "node").mapInArrow(tidied(shared), f"node long, c long, {own}")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for the nodes of edges (x, y), by alternating large and small stars.

    Every round is written to the shared folder; rounds grow with the logarithm of the largest component.
    """
    now = scratch_table(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    state = None
    if not now.head(1):
        return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = scratch_table(star.distinct(), "edges")
        # null-safe sums that any change of the edges changes, for all that matters
        after = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets x has in common with each of y."""
    tx, ty = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(tx, ty)
    sides = []
    for sets, toks in ((x, tx), (y, ty)):
        row = np.repeat(np.arange(len(sets)), [len(a) for a in sets])
        at = np.minimum(np.searchsorted(common, toks), max(len(common) - 1, 0))
        has = common[at] == toks if len(common) else np.zeros(len(toks), bool)
        sides.append((row[has], at[has]))
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for start in range(0, len(common), 4096):
        some = []
        for sets, (row, at) in zip((x, y), sides):
            here = (at >= start) & (at < start + 4096)
            m = np.zeros((len(sets), min(4096, len(common) - start)), dtype=np.float32)
            m[row[here], at[here] - start] = 1
            some.append(m)
        out += (some[0] @ some[1].T).astype(np.int64)  # whole numbers up to 4096: exact
    return out


def _forest(link: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the smallest index that each row reaches."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(units: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Compare the sets of each unit (unit, a, b), of its first side with the second or (a = b) with one another.

    rel stands for the set, by what it differs from a set that all of the unit share; c is the set's number of shingles
    that others have, n that of all.  Gives (pairs) the links x < y with shared, or node, others (documents of
    other nodes that it links with, within the unit) and root, a node that its links within the unit lead to.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("unit", "ascending"), ("a", "ascending"), ("b", "ascending"), ("second", "ascending"), ("node", "ascending")])
        keys = [rows[c].to_numpy() for c in ("unit", "a", "b")]
        second, node, n, c, copies = (rows[x].to_numpy() for x in ("second", "node", "n", "c", "copies"))
        lists = rows["rel"].combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [values[i:j] for i, j in zip(ends[:-1], ends[1:])]
        size = np.diff(ends).astype(np.int64)
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        found = []
        for i, j in zip([0, *cuts], [*cuts, len(node)]):
            one = keys[1][i] == keys[2][i]
            middle = j if one else i + int(np.searchsorted(second[i:j], 1))
            x, y = slice(i, middle), slice(i, j) if one else slice(middle, j)
            if x.start == x.stop or y.start == y.stop:
                continue
            # |a| + |b| - 2 |a and b| is how far the shared parts differ
            shared = (c[x][:, None] + c[y][None, :] - size[x][:, None] - size[y][None, :]) // 2 + _shared(sets[x], sets[y])
            link = shared * 100 >= (n[x][:, None] + n[y][None, :] - shared) * percent
            if one:
                np.fill_diagonal(link, False)
            if pairs:
                p, q = np.nonzero(np.triu(link) if one else link)
                u, v = node[x][p], node[y][q]
                found.append((np.minimum(u, v), np.maximum(u, v), shared[p, q]))
            elif one:
                found.append((node[x], link @ copies[y], node[x][_forest(link)]))
            else:
                k = middle - i
                both = np.zeros((j - i, j - i), dtype=bool)
                both[:k, k:], both[k:, :k] = link, link.T
                found.append((node[i:j], both @ copies[i:j], node[i:j][_forest(both)]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=names)

    names = ["x", "y", "shared"] if pairs else ["node", "others", "root"]
    return units.groupBy("pool").applyInArrow(run, ", ".join(f"{c} long" for c in names))


def _dealt(sides: DataFrame, percent: int) -> DataFrame:
    """Rows of units (unit, sides, side, node, n, c, copies, d, rel), dealt into blocks where a unit is large: with a, b, second, pool.

    A unit has one side (sides 0), all of whose sets are compared, or two (sides 1), compared with each other.  Within one side d
    is the distance to a set that all share, so sets whose d differ by more than a link allows aren't compared; nor are sets of unlike sizes.
    """
    width = F.size("rel") + 1
    per_unit = sides.groupBy("unit").agg(F.count(F.lit(1)).alias("nodes"), F.sum(width).alias("all"))
    per_unit = scratch_table(per_unit.withColumn("large", (F.col("nodes") > BLOCK) | (F.col("all") > BLOCK_SHINGLES)), "units")
    total = per_unit.where("not large").agg(F.sum("all")).first()[0] or 0
    pools, zero = int(total // POOL_SHINGLES) + 1, F.lit(0).cast("long")
    small = narrow(sides, per_unit.where("not large").select("unit"), "unit")
    columns = ["unit", "node", "n", "c", "copies", "rel"]
    out = small.select(*columns, zero.alias("a"), F.col("sides").cast("long").alias("b"), F.col("side").cast("int").alias("second"), F.pmod(F.xxhash64("unit"), F.lit(pools)).alias("pool"))
    large = per_unit.where("large").select("unit")
    if not large.head(1):
        return out
    rows = narrow(sides, large, "unit").withColumn("class", F.floor(F.log1p("d") / np.log(1.5)) * 4096 + F.floor(F.log("n") / np.log(1.25)))
    parts = rows.groupBy("unit", "side", "class").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(width) / BLOCK_SHINGLES)).alias("parts"))
    rows = rows.join(parts, ["unit", "side", "class"]).withColumn("block", F.col("class") * 2**32 + F.pmod(F.xxhash64("node", F.lit(1)), "parts") * 2 + F.col("side"))
    rows = scratch_table(rows.select(*columns, "d", "side", "sides", "block"), "blocks")
    blocks = rows.groupBy("unit", "sides", "side", "block").agg(*(f(c).alias(f"{name}_{c}") for c in ("n", "d") for name, f in (("least", F.min), ("most", F.max))))
    bounds = [f"{name}_{c}" for c in ("n", "d") for name in ("least", "most")]
    end = lambda s, where: blocks.where(where).select("unit", "sides", F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in bounds))
    near = "most_n_a * 4 >= least_n_b * 3 and most_n_b * 4 >= least_n_a * 3"
    # of one reference only: of two sides, d refers to each side's own
    alike = "sides = 1 or 7 * greatest(least_d_a - most_d_b, least_d_b - most_d_a) <= most_n_a + most_n_b"
    pairs = end("a", "side = 0").join(end("b", "side = sides").drop("sides"), "unit").where(f"(sides = 1 or a <= b) and {near} and ({alike})")
    pairs = scratch_table(pairs.select("unit", "a", "b"), "block_pairs")
    dealt = lambda s, second, some: rows.withColumnRenamed("block", s).join(some, ["unit", s]).select(*columns, "a", "b", F.lit(second).alias("second"), F.xxhash64("unit", "a", "b").alias("pool"))
    return out.unionByName(dealt("a", 0, pairs)).unionByName(dealt("b", 1, pairs.where("a <> b")))


@dataclass
class Join:
    """documents: doc_id, h (hash of the text), n_shingles, node (null for empty sets), component_id, n_links and first (is it
    the component's first by doc_id, null last, then h?); links: x, y, shared of all linked pairs x < y of nodes, computed if read."""

    documents: DataFrame
    links: DataFrame


def _candidates(docs: DataFrame, info: DataFrame, k: int) -> DataFrame:
    """node, n, copies, u, c, score, toks of the sets that may have a partner: c shingles that others of them have, rare ones first, and u that none has.

    info: node, n, copies, rep (doc_id, h of a document with that set).
    """
    # each set is made again from the text of one document; one that repeats, id and all, gives it as often as it repeats
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    wanted = info.select(F.col("node").alias("want"), F.col("rep.doc_id").alias("want_id"), F.col("rep.h").alias("want_h"))
    found = narrow(texts, wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("want_id")) & (F.col("h") == F.col("want_h")))
    made = scratch_table(shingle_sets(found.select("want", "text"), "want", k).select("node", "toks"), "sets")
    if made.groupBy("node").count().where("count > 1").head(1):
        made = made.groupBy("node").agg(F.first("toks").alias("toks"))
    flat = made.select("node", F.explode("toks").alias("tok"))
    several = flat.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = flat.join(several, "tok").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("in_order"))
    kept = kept.join(info.select("node", "n", "copies"), "node").withColumns({"c": F.size("in_order").cast("long"), "u": F.col("n") - F.size("in_order")})
    score = F.aggregate("in_order", F.lit(0).cast("long"), lambda a, x: a + x["df"]) / F.col("n")
    return scratch_table(kept.where("u * 4 <= n").select("node", "n", "copies", "u", "c", score.alias("score"), F.transform("in_order", lambda x: x["tok"]).alias("toks")), "candidates")


def _with_leaders(sets: DataFrame) -> DataFrame:
    """Adds leader, d (the distance to it) and rel (the shared shingles in which they differ)."""
    sketch = sets.select("node", "score", F.explode(F.slice(F.sort_array("toks"), 1, SKETCH)).alias("tok"))
    heads = sketch.groupBy("tok").agg(F.max_by("node", F.struct("score", "node")).alias("head"), F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets")
    chosen = sketch.join(heads, "tok").groupBy("node", "head").agg(F.count(F.lit(1)).alias("times")).groupBy("node").agg(F.max_by("head", F.struct("times", "head")).alias("head")).where("node <> head")
    chosen = scratch_table(chosen, "heads")
    leaders = narrow(sets.select(F.col("node").alias("head"), F.col("n").alias("n_head"), F.col("u").alias("u_head"), F.col("toks").alias("head_toks")), chosen.select("head").distinct(), "head")
    led = sets.join(chosen, "node").join(leaders, "head").withColumn("rel", F.concat(F.array_except("toks", "head_toks"), F.array_except("head_toks", "toks")))
    led = led.withColumn("d", F.col("u") + F.col("u_head") + F.size("rel"))
    # half of all shingles shared: 3 shared >= n + m, where 2 shared = n + m - d
    led = scratch_table(led.where("3 * d <= n + n_head").select("node", F.col("head").alias("leader"), "d", "rel"), "led")
    led = led.join(led.select(F.col("leader").alias("node")).distinct(), "node", "left_anti")  # who leads has no leader
    none = F.array().cast("array<bigint>")
    out = sets.join(led, "node", "left").withColumns({"leader": F.coalesce("leader", "node"), "d": F.coalesce("d", F.lit(0).cast("long")), "rel": F.coalesce("rel", none)})
    return scratch_table(out, "led_sets")


def _near_leaders(sets: DataFrame) -> DataFrame:
    """unit, l, m, apart, reach_l, reach_m for pairs of leaders l < m with sets that may link: reach is how far a linked set may be from the other leader."""
    first = F.slice("toks", 1, F.greatest((F.floor(F.col("n") / 4) + 1 - F.col("u")).cast("int"), F.lit(0)))
    entries = sets.select("leader", "n", "u", F.posexplode(first).alias("pos", "tok"))
    # a block of a list: the sets of one leader, with what they have from this position on
    blocks = entries.groupBy("tok", "leader").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("u") - F.col("pos")).alias("rest"))
    blocks = scratch_table(blocks, "list_blocks")
    several = blocks.groupBy("tok").agg(F.min("leader").alias("p"), F.max("leader").alias("q")).where("p <> q").select("tok")
    blocks = blocks.join(several, "tok", "left_semi")
    x, y = (blocks.select("tok", *(F.col(c).alias(f"{c}_{s}") for c in ("leader", "least", "most", "rest"))) for s in "xy")
    fits = "leader_x < leader_y and most_x * 4 >= least_y * 3 and most_y * 4 >= least_x * 3 and 7 * least(rest_x, rest_y) >= 3 * (least_x + least_y)"
    met = scratch_table(x.join(y, "tok").where(fits).select(F.col("leader_x").alias("l"), F.col("leader_y").alias("m")).distinct(), "met")
    span = sets.groupBy("leader").agg(F.max("d").alias("radius"), F.max("n").alias("most"))
    of = sets.where("node = leader").join(span, "leader")
    a, b = (of.select(F.col("leader").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("u", "c", "toks", "radius", "most"))) for s in "lm")
    both = met.join(a, "l").join(b, "m").withColumn("apart", F.col("u_l") + F.col("u_m") + F.col("c_l") + F.col("c_m") - 2 * F.size(F.array_intersect("toks_l", "toks_m")))
    # linked sets of n and m shingles are (n + m) / 7 apart at most
    reach = lambda s: F.col(f"radius_{s}") + (F.col("most_l") + F.col("most_m")) / 7
    both = both.where("7 * (apart - radius_l - radius_m) <= most_l + most_m")
    return scratch_table(both.select(F.xxhash64("l", "m").alias("unit"), "l", "m", "apart", reach("m").alias("reach_l"), reach("l").alias("reach_m")), "near_leaders")


def _sides(sets: DataFrame) -> DataFrame:
    """The units: the sets of each leader, by their differences to it, and those of two leaders that may link, whole."""
    columns = ["node", "n", "c", "copies"]
    several = sets.groupBy("leader").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("leader")
    zero, one = F.lit(0), F.lit(1)
    inside = sets.join(several, "leader", "left_semi").select(F.col("leader").alias("unit"), zero.alias("sides"), zero.alias("side"), *columns, "d", "rel")
    near = _near_leaders(sets)
    # by the triangle, no set of the other leader is near one that lies too far off
    ends = [near.select("unit", F.col(s).alias("leader"), "apart", F.col(f"reach_{s}").alias("reach"), F.lit(i).alias("side")) for i, s in enumerate("lm")]
    across = sets.join(ends[0].unionByName(ends[1]), "leader").where("apart - d <= reach").select("unit", one.alias("sides"), "side", *columns, "d", F.col("toks").alias("rel"))
    return scratch_table(inside.unionByName(across), "sides")


def join(docs: DataFrame, percent: int = 75, k: int = SHINGLE_WORDS) -> Join:
    """Link documents of `docs` (doc_id, text) if 100 * shared >= percent * all of their shingles.

    Null, empty and blank texts have empty sets and link with nothing.  Equal sets always link.  component_id is
    the smallest doc_id reachable by links (null only if all of them are null).  Repeated rows and equal doc_ids
    are documents of their own.  The links are all pairs x < y of distinct nodes that link; n_links is the number
    of other documents that a document links with, copies included.  Other columns are ignored; an empty table
    gives an empty result.  Works for a percent of 75 or more.
    """
    if percent < 75:
        raise ValueError("lists are made for 75 percent or more")
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    table = scratch_table(_entries(docs, k), "entries")
    own = table.where("own is not null").select("own.*", "node")
    others = table.where("own is null").groupBy("node").agg(F.sum("c").alias("others"))
    info = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("rep"))
    info = scratch_table(info.join(others, "node", "left").withColumn("others", F.coalesce("others", F.lit(0))), "nodes")
    sets = _with_leaders(_candidates(docs, info.where(~lone(F.col("n"), F.col("others"))), k))
    units = _dealt(_sides(sets), percent)
    compared = scratch_table(_compare(units, percent, pairs=False), "compared")
    label = components(compared.select(F.col("node").alias("x"), F.col("root").alias("y")))
    # the small end of each star isn't a row of label
    label = label.select("node", "label").union(label.select("label", "label").distinct())
    of_label = label.join(info.select("node", "first_id", "rep"), "node").groupBy("label").agg(F.min("first_id").alias("id"), F.min("rep").alias("leads"))
    linked = compared.groupBy("node").agg(F.sum("others").alias("linked"))
    found = linked.join(label.join(of_label, "label").select("node", "id", "leads"), "node", "left")
    place = info.select("node", "first_id", "copies", "rep").join(found, "node", "left")
    place = place.select("node", F.coalesce("id", "first_id").alias("component_id"), F.coalesce("leads", "rep").alias("leads"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = own.where("n > 0").join(place, "node").select("doc_id", "h", F.col("n").alias("n_shingles"), "node", "component_id", "n_links", (F.col("doc_id").eqNullSafe(F.col("leads.doc_id")) & (F.col("h") == F.col("leads.h"))).alias("first"))
    empty = own.where("n = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return Join(out.unionByName(empty), _compare(units, percent, pairs=True))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each component, the first by doc_id (null last), then by its text's hash; rows without words all stay.

    Rows that repeat, id and text, are in one component, so one of them stays (any, if they differ in other columns).
    Columns stay as they are, whatever their names.
    """
    found = join(docs, **options).documents.where("n_shingles > 0")
    id_, h = free_name(docs, "id"), free_name(docs, "h")
    odd = found.groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h)).agg(F.count(F.lit(1)).alias("rows"), F.max("first").alias("first")).where("not first or rows > 1")
    odd = scratch_table(odd, "odd")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(h))
    kept = narrow(docs, odd.where("not first").select(id_, h), same, "left_anti")
    again = odd.where("first").select(id_, h)
    if not again.head(1):
        return kept
    row = free_name(docs, "row")
    twice = narrow(kept.select(F.struct(*docs.columns).alias(row), "doc_id", "text"), again, same).groupBy(id_, h).agg(F.first(row).alias(row))
    return narrow(kept, again, same, "left_anti").unionByName(twice.select(f"{row}.*"))
