from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from panelweave.llm import pii, quality

from .conftest import SF
from .test_dedup import WS, brute_near
from .test_text import WORD, brute_base, brute_quality


def good(text):
    """The pipeline's quality policy, written out."""
    n, chars, symbols, dup, repeated = brute_quality(text)
    words = WORD.findall(text or "")
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    giant = sum(len(w) for w in words if len(w) > 1000 and w.isascii())
    spaced = 2 * sum(len(w.encode()) for w in words) <= 3 * chars
    fails = (n < 50, 2 * repeated > n, 4 * symbols > n, 2 * dup > lines, 2 * chars < 5 * n, spaced and chars - giant > 12 * n, 2 * giant > chars)
    return not any(fails)


def expected(rows):
    """Texts that the stages before the personal data keep, by brute force."""
    groups = defaultdict(list)
    for i, t in rows:
        if good(t):
            groups[t.translate(WS)].append((i, t))
    single = sorted(min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values())
    kept = {r[0] for r in brute_near(single) if r[3]}
    return {i: t for i, t in single if i in kept}


def personal(text):
    """What the base patterns find in a text."""
    return [text[a:b] for spans in brute_base(text).values() for a, b in spans]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SF)
        assert got.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert set(texts) == set(want)
    for i, (t, n) in texts.items():
        assert n == len(t)
        assert all(x not in t for x in personal(want[i]) if "@" in x)
        if not pii.find_spans(want[i]):
            assert t == want[i]
    pieces = corpus_pipeline.run(spark, SF)
    per_doc = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("n")).collect()}
    assert per_doc == dict.fromkeys(want, True)


def test_quality_stage_keeps_clean_documents(spark):
    plain = " ".join(f"word{i}" for i in range(3000))
    run, more = "QUJD" * 500, "REVG" * 6000
    spaceless = " ".join(chr(0x4E00 + i) * 5 + "漢字仮名交文" * 4 for i in range(80))
    texts = {1: plain, 2: f"{plain} {run}", 3: f"{plain} {more}", 4: spaceless, 5: " ".join(f"{i:032x}" for i in range(100)), 6: spaceless.replace(" ", "漢" * 400 + " ", 1), 7: None, 8: f"{plain} {more[:16000]}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert kept == {1, 2, 4, 6, 8}
    # The earlier policies mean what they meant.
    assert {r.doc_id for r in quality.keep_good(docs, "v2").collect()} == {1}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if docs.columns[0] == "doc_id" and "start" not in docs.columns:
            assert "source" in docs.columns


def test_stages_on_nulls_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "a", None, 5), (1, text, "a", None, 5), (None, text + " more", None, "s", None), (2, None, "b", "s", 0), (3, "", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert [(r.doc_id, r.text) for r in docs.collect()] in ([(1, text)], [(None, text + " more")])
