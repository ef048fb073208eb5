"""Near-duplicates from bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles (64-bit hashes); the ``k``
smallest hashes are its sketch.  The stages:

1.  One pass over the texts writes (set size, set digest, sketch) per row.
    Rows with equal sets (128-bit digests) collapse into one class, whatever
    their number.
2.  Inverted lists of the retained values: a value held by one class only can
    not be shared, so a class with too many of those has no partner and is
    done ("too many" is exact where sketches are whole sets, otherwise six
    standard deviations beyond the expectation at the threshold).
3.  Classes that remain get their whole sets and a finer sketch.  Their
    rarest shared values - enough of them that two linked classes must meet -
    are the inverted lists that generate overlaps.
4.  First round: each list proposes its most central class against the others
    (linear in the list).  Second round: only pairs whose classes are not yet
    connected, inside size classes.  So a group of n copies costs about n
    checks, not n squared, and no pair is skipped that could still link two
    components.
5.  Proposed pairs pass the union-sketch estimate, then exact Jaccard on the
    full sets in integers: ``den * |A & B| >= num * |A | B|``.
6.  Components by label propagation with pointer jumping, on the cluster.

Defined results: null or word-less text has an empty set, is linked with
nothing and is kept; fewer than five words make one shingle; null ids never
become a component's id unless no other exists; repeated rows get the same
answer; empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashFilter, chunks, discard, materialize, mix64, utf8_list

#: Standard deviations that sampling may move a sketch before a pair is lost.
SIGMAS = 6.0
#: More values than any set holds.
_WHOLE = (1 << 31) - 1
_BATCH_BYTES = 8 << 20


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if n < width:
        return np.array([digest(b" ".join(words), seed=n + 1)], np.uint64)
    h = np.fromiter(map(digest, words), np.uint64, n)
    out = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + mix64(h[i : n - width + 1 + i] + np.uint64(i))
    return np.unique(mix64(out))


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _fingerprints(width: int, keep: int | None, bits: int = 64):
    """Batches of (row, row2, id, n, cls, chk, values); ``keep`` None: the whole set.

    ``cls`` and ``chk`` are the two halves of a 128-bit digest of the set; of
    ``cls`` the leading ``bits`` are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, "text", _BATCH_BYTES):
                sets = [shingles(t, width) for t in utf8_list(b.column("text"))]
                digest = [xxhash.xxh3_128_intdigest(s) if len(s) else None for s in sets]
                cls = [None if d is None else (d >> (128 - bits)) - (1 << (bits - 1)) for d in digest]
                chk = [None if d is None else (d & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for d in digest]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("row"),
                        b.column("row2"),
                        b.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(cls, pa.int64()),
                        pa.array(chk, pa.int64()),
                        _list_array([s[:keep] for s in sets]),
                    ],
                    ["row", "row2", "id", "n", "cls", "chk", "vals"],
                )

    return run


_SCHEMA = "row bigint, row2 bigint, id bigint, n bigint, cls bigint, chk bigint, vals array<bigint>"


def _row_keys(id_col: str, text: str) -> list[Column]:
    """A row's 128-bit key, as two columns."""
    return [F.xxhash64(id_col, text), F.xxhash64(F.lit(1), text, id_col)]


def _told_apart(classes: DataFrame):
    """Function that gives classes of equal ``cls`` but different ``chk`` keys of their own.

    Two 64-bit halves of different sets agree about once in 10**10 sets, so this
    is nearly always the identity, but then no pair of sets is taken for one.
    """
    twins = materialize(classes.groupBy("cls").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("cls"), "near-twins", reduced=True)
    if twins.isEmpty():
        discard(twins)
        return lambda df: df
    flags = twins.select("cls", F.lit(True).alias("_pw_twin"))

    def apart(df: DataFrame) -> DataFrame:
        out = df.join(flags, "cls", "left")
        return out.withColumn("cls", F.when(F.col("_pw_twin"), F.xxhash64("cls", "chk")).otherwise(F.col("cls"))).drop("_pw_twin").select(*df.columns)

    return apart


def _allowed(num: int, den: int, k: int) -> str:
    """SQL: most values of a sketch that a linked partner may lack.

    Sets of up to ``num/den * k`` values meet partners whose sketches are whole
    sets too, so the bound is exact; beyond, the retained values are a uniform
    sample and ``SIGMAS`` deviations are allowed for.
    """
    miss = (den - num) / den
    return (
        f"case when n <= {num * k // den} then cast(floor({den - num}L * n / {den}L) as int) "
        f"else cast(ceil({miss}D * m + {SIGMAS}D * sqrt({miss * (1 - miss)}D * m)) as int) end"
    )


def _shared_values(sets: DataFrame) -> DataFrame:
    """(v, cls, df) of the retained values that two classes or more hold."""
    post = sets.select("cls", F.explode("vals").alias("v"))
    lists = post.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return post.join(lists, "v")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """The pairs (a, b) that are linked: estimate first, then exact Jaccard."""
    t = num / den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for name in ("x", "y"):
                arr = batch.column(name)
                cols.append((arr.values.to_numpy(zero_copy_only=False).view(np.uint64), arr.offsets.to_numpy()))
            (xv, xo), (yv, yo) = cols
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                if len(x) > k or len(y) > k:
                    low = np.concatenate([x[:k], y[:k]])
                    low.sort()
                    same = low[1:] == low[:-1]
                    both = low[1:][same]
                    union = np.concatenate([low[:1], low[1:][~same]])[:k]
                    est = np.searchsorted(both, union[-1], side="right") / len(union)
                    if est < t - SIGMAS * math.sqrt(t * (1 - t) / len(union)):
                        continue
                allv = np.concatenate([x, y])
                allv.sort()
                inter = int(np.count_nonzero(allv[1:] == allv[:-1]))
                ok[i] = den * inter >= num * (len(x) + len(y) - inter)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    x = sets.select(F.col("cls").alias("a"), F.col("vals").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("vals").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label): label is the smallest node reachable over ``edges`` (a, b).

    Every round each node takes the smallest label around it, then the label
    of its label; both halves are shuffles with partial aggregation, and each
    round's table cuts the lineage.  Rounds grow with the logarithm of the
    longest path, not with the size of a component.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
    both = materialize(both.unionAll(both.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), f"{name}-edges", reduced=True)
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), f"{name}-labels", reduced=True)
    while True:
        seen = labels.select(F.col("node").alias("near"), F.col("label").alias("near_label"))
        best = both.join(seen, "near").groupBy("node").agg(F.min("near_label").alias("best"))
        step = labels.join(best, "node").select("node", F.col("label").alias("old"), F.least("label", "best").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = step.join(up, "label").select("node", "old", F.least("label", "up").alias("label"))
        new = materialize(moved, f"{name}-labels", reduced=True)
        discard(labels)
        labels = new
        if labels.where("old <> label").isEmpty():
            discard(both)
            return labels.select("node", "label")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = 5,
    num: int = 80,
    den: int = 100,
    sketch_size: int = 64,
    fine_size: int = 1024,
    filter_bits: int | None = None,
    exact: bool = False,
    class_bits: int = 64,
) -> DataFrame:
    """One row per row of ``docs``: row, row2, id, n_shingles, component_id, kept.

    ``row`` and ``row2`` hash id and text.  Documents are linked when
    ``den * |A & B| >= num * |A | B|`` over full shingle sets; the component's
    id is the smallest id in it and that document is ``kept``.  ``exact`` retains
    every value instead of the smallest ones: all bounds are exact then, at the
    price of inverted lists over whole sets.
    """
    if exact:
        sketch_size = fine_size = _WHOLE
    source = docs.select(*(k.alias(c) for k, c in zip(_row_keys(id_col, text), ("row", "row2"), strict=True)), F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    rows = materialize(source.mapInArrow(_fingerprints(width, sketch_size, class_bits), _SCHEMA), "near-rows")

    # 1. classes of equal sets
    first = [F.min("id").alias("first_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("vals").alias("vals")]
    classes = materialize(rows.where("n > 0").groupBy("cls", "chk").agg(*first), "near-classes")
    apart = _told_apart(classes.select("cls"))
    rows, same = apart(rows), apart(classes.select("cls", "chk", "first_id", "row", "n", "vals"))
    classes, made = same.drop("chk"), classes

    # 2. classes that share enough retained values to have a partner at all
    held = _shared_values(classes).groupBy("cls").agg(F.count(F.lit(1)).cast("int").alias("held"))
    sized = classes.select("cls", "row", "n", F.size("vals").alias("m"))
    alive = sized.join(held, "cls").where(f"m - held <= {_allowed(num, den, sketch_size)}").select("cls", "row")
    alive = materialize(alive, "near-alive", reduced=True)

    # 3. their whole sets, rarest shared values first
    wanted = HashFilter(alive, "row", filter_bits)
    chosen = wanted.flag(source, "row", "_pw_may").where("_pw_may").select("row", "row2", "id", "text")
    whole = apart(chosen.mapInArrow(_fingerprints(width, None, class_bits), _SCHEMA)).join(alive.select("cls"), "cls", "left_semi")
    sets = materialize(whole.groupBy("cls").agg(F.first("n").alias("n"), F.first("vals").alias("vals")), "near-sets")

    fine = sets.select("cls", "n", F.slice("vals", 1, fine_size).alias("vals"))
    ranked = _shared_values(fine).groupBy("cls").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held")  # at most fine_size values a class
    )
    nodes = (
        fine.select("cls", "n", F.size("vals").alias("m"))
        .join(ranked, "cls")
        .withColumn("u", F.col("m") - F.size("held"))
        .withColumn("take", F.expr(f"{_allowed(num, den, fine_size)} + 1 - u"))
        .where("take > 0")
        .select("cls", "n", "u", (F.col("u") / F.col("m")).alias("odd"), F.expr("transform(slice(held, 1, take), x -> x.v)").alias("keys"))
    )
    nodes = materialize(nodes, "near-nodes", reduced=True)
    # pos: values of the class that come before v.  At the first value two classes have in
    # common, none of those is shared, which bounds the overlap; a linked pair always passes in
    # that list.  Counted only where partners' sketches are whole sets.
    post = nodes.select("cls", "n", "u", "odd", F.posexplode("keys").alias("i", "v"))
    post = post.select("v", "cls", "n", "odd", F.expr(f"case when n <= {num * fine_size // den} then u + i else 0 end").alias("pos"))

    # 4a. each list's most central class against the others
    possible = (
        f"{den} * least(n - pos, n2 - pos2) >= {num} * (n + n2 - least(n - pos, n2 - pos2)) "
        f"and {den} * least(n, n2) >= {num} * greatest(n, n2)"
    )
    center = F.min(F.struct("odd", (-F.col("n")).alias("neg"), "cls", "pos"))
    stars = post.groupBy("v").agg(center.alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = stars.select("v", F.col("c.cls").alias("cls2"), (-F.col("c.neg")).alias("n2"), F.col("c.pos").alias("pos2"))
    order = [F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")]
    proposed = post.join(stars, "v").where(f"cls <> cls2 and {possible}").select(*order).distinct()
    proposed = materialize(proposed, "near-stars", reduced=True)
    links = materialize(_verified(proposed, sets, num, den, sketch_size), "near-links")
    labels = connected_components(links)

    # 4b. pairs of classes that are still apart, inside neighbouring size classes
    grouped = post.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    grouped = grouped.withColumn("band", F.floor(F.log("n") / math.log(den / num)).cast("long"))
    open_lists = grouped.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")
    grouped = materialize(grouped.join(open_lists, "v"), "near-open", reduced=True)
    right = grouped.select("v", "band", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("label").alias("label2"))
    left = grouped.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    rest = left.join(right, ["v", "band"]).where(f"label <> label2 and (n < n2 or n = n2 and cls < cls2) and {possible}")
    rest = rest.select(*order).distinct().join(proposed, ["a", "b"], "left_anti")
    more = materialize(_verified(rest, sets, num, den, sketch_size), "near-more")
    labels = connected_components(links.unionAll(more), "cc2") if not more.isEmpty() else labels

    # 5. one row per input row
    ids = classes.select("cls", "first_id").join(labels.withColumnRenamed("node", "cls"), "cls")
    comp = materialize(ids.groupBy("label").agg(F.min("first_id").alias("component_id")), "near-comp", reduced=True)
    by_class = (
        classes.select("cls", "first_id")
        .join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        .join(comp, "label", "left")
        .select("cls", F.coalesce("component_id", "first_id").alias("component_id"))
    )
    by_class = materialize(by_class, "near-by-class", reduced=True)
    for t in (alive, sets, nodes, proposed, links, grouped, more, comp, made):
        discard(t)
    out = rows.select("row", "row2", "id", "n", "cls").join(by_class, "cls", "left")
    found = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        "row", "row2", "id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, found.isNull()).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", filter_bits: int | None = None, **params) -> DataFrame:
    """Rows of ``docs`` that stay: one document of each component.

    Only rows that a bounded bitmap says may be dropped meet the exact
    anti-join; the others never leave their scan.
    """
    ledger = near_duplicates(docs, id_col, text, filter_bits=filter_bits, **params)
    one, two = _row_keys(id_col, text)
    gone = ledger.where(~F.col("kept")).select(F.col("row").alias("_pw_row"), F.col("row2").alias("_pw_row2")).distinct()
    gone = materialize(gone, "near-gone", reduced=True)
    keyed = HashFilter(gone, "_pw_row", filter_bits).flag(docs.withColumns({"_pw_row": one, "_pw_row2": two}), "_pw_row", "_pw_may")
    sure = keyed.where(~F.col("_pw_may"))
    doubtful = keyed.where("_pw_may").join(gone, ["_pw_row", "_pw_row2"], "left_anti")
    return sure.unionByName(doubtful).select(*[F.col(f"`{c}`") for c in docs.columns])
