"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines; long lines are several, cut by content: after each word whose hash ends in so
many zero bits, fewer in short texts, so that short or shifted copies still share some.  The set of their 64-bit
digests goes into cells: each digest is counted and XORed into one cell of each of three tables.  Sketches of
two versions subtract cell by cell, and peeling recovers the digests in which the versions differ: a cell that
holds one digest alone gives it away, and taking it out of the other tables frees more.

Where the fingerprints' own cells are too few, both versions are dealt into blocks by digest bits, and each block's
sketches are subtracted and peeled; a block that gets stuck is tried again with twice the cells and other hashes, until it comes
apart.  Work grows in proportion to the digests (and their sorting).

A fingerprint alone tells likeness only of versions that differ in up to about 20 paragraphs; for others the larger sketches
are made from the digests, which fingerprint() gives beside it.

All of it is SQL over arrays inside a row; nothing is shuffled but the texts that have to meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import let

#: A word ends a paragraph if its hash has so many low bits zero: by the text's words, of fewer than which.
CUTS = ((64, 2), (128, 3), (256, 4), (None, 5))
#: The fingerprint: log2 of the cells per table.
BITS = 3
#: Digests per block when nothing is shared, and log2 of the cells per table that a block starts with.
SHARE, FIRST_BITS = 8, 3
#: The most retries of a block, each with twice the cells; a chance in 10^30 of more, which would raise an error.
MOST_RETRIES = 16


def digests_sql(text: str) -> str:
    """SQL: the distinct 64-bit digests of a text's paragraphs; null and blank texts have none.  Words end at blanks and line ends."""
    hashes = "filter(transform(split(t, '\\n', -1), l -> transform(filter(split(l, ' ', -1), w -> w <> ''), w -> xxhash64(w))), h -> size(h) > 0)"
    bits = "case " + " ".join(f"when n < {most} then {2**bits - 1}L" for most, bits in CUTS[:-1]) + f" else {2 ** CUTS[-1][1] - 1}L end"
    starts = "filter(sequence(0, size(h) - 1), i -> i = 0 or (h[greatest(i - 1, 0)] & m) = 0)"
    pieces = let(starts, "at", "transform(at, (i, x) -> xxhash64(slice(h, i + 1, coalesce(try_element_at(at, x + 2), size(h)) - i)))")
    n = "aggregate(hs, 0, (a, h) -> a + size(h))"
    each = let(let(n, "n", bits), "m", f"array_distinct(flatten(transform(hs, h -> {pieces})))")
    return let(f"coalesce({text}, '')", "t", let(hashes, "hs", each))


def _placed_sql(items: str, h: str, b: str) -> str:
    """SQL: items (k, c, n) with p0, p1, p2, their cells in the three tables of 2^b, by the bits of the hash `h` of x."""
    cells = ", ".join(f"cast(shiftrightunsigned({h}, {t} * {b}) & (shiftleft(1, {b}) - 1) as int) as p{t}" for t in range(3))
    return f"transform({items}, x -> struct(x.k as k, x.c as c, x.n as n, {cells}))"


def _tables_sql(placed: str, b: str) -> list[str]:
    """SQL of the three tables: per cell the count, XOR of digests, XOR of their checks."""
    one = "aggregate({0}, struct(0 as n, 0L as k, 0L as c), (t, x) -> if(x.p{1} = i, struct(t.n + x.n as n, t.k ^ x.k as k, t.c ^ x.c as c), t))"
    return [f"transform(sequence(0, shiftleft(1, {b}) - 1), i -> {one.format(placed, t)})" for t in range(3)]


def _peel_sql(tables: list[str], h: str, b: str, rounds: str) -> str:
    """SQL: struct(ok, found) of a difference; found has digest k and n, 1 if only the left has it and -1 if only the right.

    Each round takes the lone digests of one table out of all three; after three idle rounds nothing more comes.
    """
    pure = _placed_sql("filter(element_at(array(s.t0, s.t1, s.t2), r % 3 + 1), x -> abs(x.n) = 1 and x.c = xxhash64(x.k))", h, b)
    left = ", ".join(f"transform(s.t{t}, (x, i) -> aggregate(p, x, (y, q) -> if(q.p{t} = i, struct(y.n - q.n as n, y.k ^ q.k as k, y.c ^ q.c as c), y))) as t{t}" for t in range(3))
    same = ", ".join(f"s.t{t} as t{t}" for t in range(3))
    step = let(pure, "p", f"if(size(p) = 0, struct(s.idle + 1 as idle, {same}, s.found as found), struct(0 as idle, {left}, concat(s.found, transform(p, x -> struct(x.k as k, x.n as n))) as found))")
    start = f"struct(0 as idle, {', '.join(f'{sql} as t{t}' for t, sql in enumerate(tables))}, cast(array() as array<struct<k:bigint,n:int>>) as found)"
    end = f"s -> struct({' and '.join(f'forall(s.t{t}, x -> x.n = 0 and x.k = 0L and x.c = 0L)' for t in range(3))} as ok, s.found as found)"
    return f"aggregate(sequence(1, {rounds}), {start}, (s, r) -> if(s.idle >= 3, s, {step}), {end})"


def sketch_sql(keys: str) -> str:
    """SQL: the fingerprint's cells (n, k, c), one table after the other."""
    placed = _placed_sql(f"transform({keys}, k -> struct(k as k, xxhash64(k) as c, 1 as n))", "x.k", str(BITS))
    return let(placed, "y", f"concat({', '.join(_tables_sql('y', str(BITS)))})")


def minus_sql(left: str, right: str) -> str:
    """SQL: the cells of `left` minus those of `right`."""
    return f"zip_with({left}, {right}, (x, y) -> struct(x.n - y.n as n, x.k ^ y.k as k, x.c ^ y.c as c))"


def peel_sql(cells: str) -> str:
    """SQL: struct(ok, found) of the difference of two fingerprints' cells."""
    size = 2**BITS
    return let(cells, "d", _peel_sql([f"slice(d, {t * size + 1}, {size})" for t in range(3)], "x.k", str(BITS), str(9 * size)))


def _retry_sql(block: str) -> str:
    """SQL: struct(found, tries) of a block of signed digests (k, c, n), by larger and larger sketches with other hashes.

    The digests of one version are taken from a cell as those of the other are put in: the same as subtracting their sketches.
    """
    h = "xxhash64(x.k, b)"
    peeled = let(_placed_sql(block, h, "b"), "y", _peel_sql(_tables_sql("y", "b"), h, "b", "3 * size(y) + 3"))
    again = let(f"{FIRST_BITS - 1} + e.tries", "b", let(peeled, "d", "struct(d.ok as ok, d.found as found, e.tries + 1 as tries)"))
    none = "struct(false as ok, cast(array() as array<struct<k:bigint,n:int>>) as found, 1 as tries)"
    end = "struct(if(e.ok, e.found, cast(raise_error('a block of digests does not peel') as array<struct<k:bigint,n:int>>)) as found, e.tries as tries)"
    return f"aggregate(sequence(1, {MOST_RETRIES}), {none}, (e, again) -> if(e.ok, e, {again}), e -> {end})"


def _blocks_sql(a: str, b: str) -> str:
    """SQL: struct(found, tries) by sketches of (|a| + |b|) / SHARE blocks; equal digests of both are in one block."""
    of = lambda keys, sign: f"transform({keys}, k -> struct(cast(pmod(shiftrightunsigned(k, 40), m) as int) as j, k as k, xxhash64(k) as c, {sign} as n))"
    starts = "if(size(v) = 0, cast(array() as array<int>), filter(sequence(0, size(v) - 1), i -> i = 0 or v[i].j <> v[greatest(i - 1, 0)].j))"
    one = let("slice(v, i + 1, coalesce(try_element_at(at, x + 2), size(v)) - i)", "z", _retry_sql("z"))
    each = let(starts, "at", f"transform(at, (i, x) -> {one})")
    signed = f"if(m = 1, concat({of(a, 1)}, {of(b, -1)}), sort_array(concat({of(a, 1)}, {of(b, -1)})))"
    body = let(signed, "v", let(each, "e", "struct(flatten(transform(e, x -> x.found)) as found, coalesce(array_max(transform(e, x -> x.tries)), 2) as tries)"))
    return let(f"cast(greatest(1, ceil((size({a}) + size({b})) / {SHARE})) as int)", "m", body)


def _outcome_sql(peeled: str, ok: str, a: str, b: str, tries: str) -> str:
    """SQL: struct(fits, only_a, only_b, tries) of a struct with found."""
    of = lambda sign: f"transform(filter(d.found, x -> x.n {sign} 0), x -> x.k)"
    sides = f"struct({ok} as ok, {of('>')} as only_a, {of('<')} as only_b, {tries} as tries)"
    body = f"struct(o.ok and size({a}) - size(o.only_a) = size({b}) - size(o.only_b) as fits, o.only_a as only_a, o.only_b as only_b, o.tries as tries)"
    return let(let(peeled, "d", sides), "o", body)


def with_difference(rows: DataFrame, name: str, a: str, b: str, cells_a: str, cells_b: str) -> DataFrame:
    """Adds `name`, struct(fits, only_a, only_b, tries): digests of column `a` that `b` lacks, and the other way round.

    First the fingerprints' own cells are tried, then larger sketches (tries is the most that a block took).  A difference that is larger
    than all cells by the numbers of digests alone isn't tried on them.
    """
    cells = 3 * 2**BITS
    first = _outcome_sql(peel_sql(minus_sql(cells_a, cells_b)), "d.ok", a, b, "1")
    none = "struct(false as fits, cast(array() as array<bigint>) as only_a, cast(array() as array<bigint>) as only_b, 1 as tries)"
    rows = rows.withColumn(name, F.expr(f"if(abs(size({a}) - size({b})) > {cells}, {none}, {first})"))
    return rows.withColumn(name, F.expr(f"if({name}.fits, {name}, {_outcome_sql(_blocks_sql(a, b), 'true', a, b, 'd.tries')})"))


def likeness(name: str, a: str):
    """Column: shared digests over all digests of two texts, from the recovered difference; 1 for two empty texts."""
    return F.expr(f"if(size({a}) + size({name}.only_b) = 0, 1.0D, (size({a}) - size({name}.only_a)) / (size({a}) + size({name}.only_b)))")


def text_sql(keys: str, cells: str) -> str:
    """SQL: a sketch as a string: number of digests, then base64 of the cells (digest XOR, 32 bits of check, count)."""
    hexed = f"transform({cells}, x -> concat(lpad(hex(x.k), 16, '0'), lpad(hex(x.c & 4294967295L), 8, '0'), lpad(hex(x.n), 6, '0')))"
    return f"concat(size({keys}), ':', regexp_replace(base64(unhex(array_join({hexed}, ''))), '[\\\\r\\\\n]+', ''))"


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds digests, cells and fingerprint.  Equal texts get equal ones; null texts count as empty."""
    out = docs.withColumn("digests", F.expr(digests_sql(text)))
    out = out.withColumn("cells", F.expr(let("digests", "ds", sketch_sql("ds"))))
    return out.withColumn("fingerprint", F.expr(text_sql("digests", "cells")))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text and the columns of the document next in order: next_text, next_digests; with own digests.

    Order: doc_id, null last, then text hash; the last is followed by the first.  Null texts are empty.
    Documents are split into buckets by doc_id and move once; the first of each bucket goes along with the
    bucket before as well.  The driver sees two ids per bucket.
    """
    spark = docs.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [(i + 1) / buckets for i in range(buckets - 1)] or [0.5], max(10_000, 4 * buckets))).first()[0] or []
    cuts = sorted({int(c) for c in cuts})
    steps = [2**i for i in reversed(range(len(cuts).bit_length()))]
    if cuts:
        # how many cuts lie at or below the id, by halving; a null id lies above all
        bucket = let(
            f"array({', '.join(f'{c}L' for c in cuts)})",
            "cuts",
            f"aggregate(array({', '.join(map(str, steps))}), 0, (lo, s) -> if(lo + s <= {len(cuts)} and (doc_id is null or element_at(cuts, least(lo + s, {len(cuts)})) <= doc_id), lo + s, lo))",
        )
    else:
        bucket = "0"
    firsts = ids.where("doc_id is not null").groupBy(F.expr(bucket).alias("bucket")).agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(bucket).alias("bucket"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late"), F.lit(True).alias("own"))
    homes = F.array(own)
    if firsts:
        last = firsts[-1]["bucket"] if not cuts else len(cuts)  # null ids are in the last bucket of all
        before = {r["bucket"]: (r["first"], firsts[i - 1]["bucket"] if i else last, 0 if i else 1) for i, r in enumerate(firsts)}
        # by bucket: its first id, the bucket that the id closes (empty ones have no rows to close), and whether it closes the whole table
        table = "array(" + ", ".join("null" if j not in before else "named_struct('first', {}L, 'bucket', {}, 'late', {})".format(*before[j]) for j in range(len(cuts) + 1)) + ")"
        at = F.expr(let(table, "closing", "element_at(closing, bucket + 1)"))
        ghost = F.when(F.col("doc_id") == at["first"], F.struct(at["bucket"].alias("bucket"), at["late"].alias("late"), F.lit(False).alias("own")))
        homes = F.when(ghost.isNull(), homes).otherwise(F.array(own, ghost))
    moved = rows.withColumn("home", F.explode(homes)).select("doc_id", "text", F.expr(digests_sql("text")).alias("digests"), "home.*")
    order = W.partitionBy("bucket").orderBy("late", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    following = F.coalesce(F.lead(F.struct("text", "digests")).over(order), F.first(F.struct("text", "digests")).over(order))
    return moved.withColumn("next", following).where("own").select("doc_id", "text", "digests", F.col("next.text").alias("next_text"), F.col("next.digests").alias("next_digests"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_tries, next_tries.

    The edited text has its last quarter replaced by as much (or all) of the start of the next document.
    """
    quarter = F.floor(F.length("text") / 4).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - quarter), F.substr("next_text", F.lit(1), quarter)))
    rows = rows.withColumn("edited_digests", F.expr(digests_sql("edited")))
    for c in ("", "edited_", "next_"):
        rows = rows.withColumn(f"{c}cells", F.expr(let(f"{c}digests", "ds", sketch_sql("ds"))))
    rows = with_difference(rows, "to_edited", "digests", "edited_digests", "cells", "edited_cells")
    rows = with_difference(rows, "to_next", "digests", "next_digests", "cells", "next_cells")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(text_sql("digests", "cells")).alias("fingerprint"),
        F.expr(text_sql("edited_digests", "edited_cells")).alias("edited_fingerprint"),
        likeness("to_edited", "digests").alias("near_edited"),
        likeness("to_next", "digests").alias("near_next"),
        F.col("to_edited.tries").alias("edited_tries"),
        F.col("to_next.tries").alias("next_tries"),
    )
