import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelweave.llm import byte_bpe, packing, queries, token_count

from .conftest import SF


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(queries.BPE_RANKS)


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(queries.BPE_RANKS, P.PATTERN)


# ---- byte-level BPE --------------------------------------------------------- #
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_bpe_any_text(bpe, reference, texts):
    ids, ends = bpe.encode_batch(texts)
    for i, t in enumerate(texts):
        got = ids[ends[i] : ends[i + 1]].tolist()
        assert got == reference.encode_ordinary(t)
        assert bpe.decode(got) == t.encode()


def test_bpe_long_pieces(bpe, reference):
    texts = ["a" * 3000, "ab" * 700 + "!" * 500, "x" * 256 + " " + "y" * 257, "<|endoftext|>", "\n" * 900]
    ids, ends = bpe.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == reference.encode_ordinary(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcABC  \n=-漢字é\U0001f600", min_size=1, max_size=6), st.integers(1, 60)), max_size=4))
def test_bpe_repeated_text(bpe, reference, parts):
    text = "".join(p * n for p, n in parts)
    assert bpe.encode_batch([text])[0].tolist() == reference.encode_ordinary(text)


def test_long_words_are_linear():
    auto = token_count.LongestMatch([b"a", b"ab", b"abc", b"b", b"c", b" a"])
    words = [b"abc" * 100_000, b"ab" * 5, b"x", b"cab" * 40_000 + b"x"]
    assert auto.count(words * 6).tolist() == [100_000, 5, 0, 0] * 6


def test_bpe_frames(edge, empty, documents, reference):
    for df in (edge, documents.limit(60)):
        out = byte_bpe.decode(byte_bpe.encode(df, queries.BPE_RANKS, P.PATTERN), queries.BPE_RANKS, P.PATTERN)
        for r in out.collect():
            assert r.ids == reference.encode_ordinary(r.text or "")
            assert bytes(r.bytes) == (r.text or "").encode()
    assert byte_bpe.encode(empty, queries.BPE_RANKS, P.PATTERN).count() == 0


def test_bpe_query(spark, documents, reference):
    want = {}
    for r in documents.collect():
        ids = reference.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_byte_bpe(spark, SF).collect()}
    assert got == want


# ---- longest match ---------------------------------------------------------- #
def greedy(word, first, later, longest=99):
    """Pieces of a word by greedy longest match; 0 if stuck."""
    n, i = 0, 0
    while i < len(word):
        pool = first if i == 0 else later
        j = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in pool), None)
        if j is None:
            return 0
        n, i = n + 1, j
    return n


_piece = st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b))
_word = st.binary(min_size=1, max_size=12).map(lambda b: bytes(97 + x % 3 for x in b))


@settings(max_examples=200, deadline=None)
@given(st.sets(_piece, max_size=12), st.sets(_piece, max_size=12), st.lists(_word, min_size=1, max_size=10))
def test_automaton(first, later, words):
    two = token_count.LongestMatch(first, later)
    assert two.count(words).tolist() == [greedy(w, first, later) for w in words]
    one = token_count.LongestMatch(first)
    assert one.count(words).tolist() == [greedy(w, first, first) for w in words]


def test_token_counts(edge, empty, documents, ranks):
    longest = max(map(len, ranks))
    for df in (edge, documents):
        for r in token_count.count_tokens(df, queries.BPE_RANKS).collect():
            words = (r.text or "").encode().lower().split()
            each = {w: greedy(b" " + w, ranks, ranks, longest) for w in set(words)}
            assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(each[w] for w in words), 0)
    assert token_count.count_tokens(empty, queries.BPE_RANKS).count() == 0


# ---- packing ---------------------------------------------------------------- #
def check_packing(pieces, docs, capacity=2048, max_segments=128):
    """Every id in exactly one piece, sequences gapless and within limits."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_doc[p.id].append(p)
        by_seq[p.sequence_id].append(p)
    for key, ids in docs.items():
        parts = sorted(by_doc.pop(key, []), key=lambda p: p.start)
        assert np.array_equal(np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]), ids)
        assert all(p.doc_tokens == len(ids) for p in parts)
    assert not by_doc
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and len(parts) <= max_segments
    return by_seq


def test_pack_documents(documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.BPE_JSON)
    docs = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in documents.collect()}
    out = packing.pack_documents(documents.coalesce(1), queries.BPE_JSON, queries.BPE_RANKS, P.PATTERN).collect()
    seqs = check_packing(out, docs)
    total = sum(map(len, docs.values()))
    assert len(seqs) == -(-total // 2048)  # only the last sequence is short


def test_pack_edge(edge, empty):
    out = queries.pieces(edge).collect()
    got = defaultdict(int)
    for p in out:
        got[p.doc_id] += p.length
    slow = packing.pack_documents(edge, queries.BPE_JSON)
    assert sum(got.values()) == sum(p.length for p in slow.collect())
    assert got[4] == got[5] == 1
    assert queries.pieces(empty).count() == 0


def test_pack_query(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.BPE_JSON)
    docs = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in documents.collect()}
    taken, filled = defaultdict(list), defaultdict(list)
    for p in queries.op3_packing(spark, SF).collect():
        ids = docs[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        taken[p.doc_id].append((p.start, p.length))
        filled[p.sequence_id].append((p.offset, p.length))
    assert set(taken) == set(docs)
    for parts, total in [(v, len(docs[k])) for k, v in taken.items()] + [(v, None) for v in filled.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 2048


@pytest.mark.parametrize("seed", range(4))
def test_vector_limits(seed):
    rnd = random.Random(seed)
    packer = packing.VectorPacker(capacity=64, max_segments=4, max_loss=40, window=16)
    out, sent = [], {}
    for k in range(200):
        ids = np.arange(rnd.randrange(1, 200), dtype=np.uint32) + 1000 * k
        loss = np.array([rnd.random() < 0.7 for _ in ids])
        sent[k] = (ids, loss)
        out += packer.add(k, ids, loss)
    out += packer.finish()
    seqs, seen = defaultdict(list), defaultdict(list)
    for key, start, ids, total, seq, offset in out:
        assert total == len(sent[key][0]) and np.array_equal(ids, sent[key][0][start : start + len(ids)])
        seqs[seq].append((offset, len(ids), int(sent[key][1][start : start + len(ids)].sum())))
        seen[key].append((start, len(ids)))
    for parts in seqs.values():
        assert len(parts) <= 4 and sum(p[1] for p in parts) <= 64 and sum(p[2] for p in parts) <= 40
    for key, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(sent[key][0])


def test_pack_tokens(spark):
    rows = [(1, [1, 2, 3], [True, False, True]), (2, [], []), (3, None, None), (4, list(range(100)), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, toks array<int>, mask array<boolean>").coalesce(1)
    out = packing.pack_tokens(df, "doc_id", "toks", "mask", capacity=16, max_segments=2, max_loss=8).collect()
    assert sum(p.length for p in out if p.id == 4) == 100
    assert sum(p.length for p in out if p.id == 1) == 3
    assert {p.id for p in out} == {1, 4}


def test_rank_file_matches_json(ranks):
    import json

    vocab = json.load(open(queries.BPE_JSON))["model"]["vocab"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    to_byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}
    assert {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if i < 50256} == ranks
