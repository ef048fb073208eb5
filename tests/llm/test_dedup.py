import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelweave.llm import exact_dedup, near_dup

from .conftest import EDGE

WS = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(WS), []).append((i, t or ""))
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        for i, t in g:
            out.append((i, keep[0], len(g), i == keep[0] and len(t) == len(keep[1]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [4, 24])  # a saturated filter must change nothing
def test_exact_edge(edge, bits):
    found = exact_dedup.find_duplicates(edge.drop("kept"), filter_bits=bits)
    found = found.withColumn("sha", F.coalesce("_pw_sha", exact_dedup.normalized_sha256(F.col("text"))))
    got = [tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "sha").collect()]
    assert sorted(got, key=str) == brute_exact(EDGE)


def test_exact_drop_keeps_one_of_each(edge):
    out = exact_dedup.drop_duplicates(edge)
    assert out.columns == edge.columns
    texts = [(r.text or "").translate(WS) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(WS) for _, t in EDGE})
    assert {r.kept for r in out.collect()} == {"kept"}  # the input's own column


def test_exact_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = exact_dedup.find_duplicates(documents).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(r[:4]) for r in brute_exact(rows))


def test_exact_empty(empty):
    assert exact_dedup.find_duplicates(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).columns == empty.columns


def brute_near(rows, num=80, den=100, width=5):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    comp = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            comp[find(k)] = min(comp.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = comp.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, c is None or i == c))
    return sorted(out, key=str)


def near(df, **kw):
    return sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, **kw).collect()), key=str)


def test_near_edge(edge):
    assert near(edge) == brute_near(EDGE)


def test_near_empty(empty):
    assert near(empty) == []
    assert near_dup.drop_near_duplicates(empty).count() == 0


def planted(seed=3):
    """Groups of edited copies with similarities on both sides of the threshold."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([20, 80, 150, 700]))]
        for _ in range(rnd.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    for _ in range(40):  # a passage that many documents share
        own = [rnd.choice(vocab) for _ in range(rnd.randrange(2, 60))]
        rows.append((len(rows), " ".join([*own, *passage])))
    return rows


# class_bits: sets of equal leading digest bits must still be told apart
@pytest.mark.parametrize("params", [{}, {"sketch_size": 16, "fine_size": 64, "class_bits": 3}, {"num": 85, "exact": True}])
def test_near_planted(spark, params):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert near(df, **params) == brute_near(rows, params.get("num", 80))


def test_near_drop(spark):
    rows = planted(5)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kept string")
    out = near_dup.drop_near_duplicates(df, filter_bits=6)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in brute_near(rows) if r[3])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in near_dup.connected_components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5}
