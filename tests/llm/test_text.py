import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelweave.llm import chat_format, lm_score, pii, quality, queries

from .conftest import EDGE, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# ---- language model --------------------------------------------------------- #
def brute_lm(rows, mu):
    docs = [(i, [*WORD.findall(lower(t)), None]) for i, t in rows]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 if i is not None else False for i, _ in docs]
    uni, pair, triple = Counter(), Counter(), Counter()
    for (_, ws), t in zip(docs, train, strict=True):
        if t:
            uni.update(ws)
            pair.update(zip([None, *ws], ws, strict=False))
            triple.update(zip([None, *ws], ws, ws[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda h, w: (pair[h, w] + mu[0] * p1(w)) / (uni[h] + mu[0])
    p3 = lambda g, h, w: (triple[g, h, w] + mu[1] * p2(h, w)) / (pair[g, h] + mu[1])
    out = []
    for (i, ws), t in zip(docs, train, strict=True):
        base = sum(math.log10(p1(w)) for w in ws)
        full = math.log10(p2(None, ws[0])) + sum(math.log10(p3(*x)) for x in zip([None, *ws], ws, ws[1:], strict=False))
        out.append((i, not t, len(ws), sum(uni[w] > 0 for w in ws), n, base, full))
    return out


def same_scores(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("block", "bits"), [(200, 64), (200, 48), (None, None)])
def test_lm_edge(edge, block, bits):
    same_scores(lm_score.score(edge, mu=(3.0, 2.0), block_bytes=block, bits=bits).collect(), brute_lm(EDGE, (3.0, 2.0)))


def test_lm_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    same_scores(lm_score.score(documents, block_bytes=100_000).collect(), brute_lm(rows, lm_score.MU))


def test_lm_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same_scores(queries.op4_lm_score(spark, SF).select(*names).collect(), brute_lm(rows, lm_score.MU))


def test_lm_traversal_does_not_depend_on_pieces(documents):
    texts = [(r.text or "").encode() for r in documents.collect()]
    train = np.arange(len(texts)) % 3 > 0
    t = lm_score.Tokens(texts)
    words, grams = t.counts(train)
    auto = lm_score.BackoffAutomaton(t, words, grams, int(words.sum()), int((words > 0).sum()), lm_score.MU)
    whole = auto.traverse(t, piece=1 << 40)
    for piece in (2, 7, 256):
        assert np.allclose(auto.traverse(t, piece), whole, rtol=1e-12)


def test_lm_models_are_distributions():
    texts = [b"a b a b c", b"b c a", b"", b"c c c b a"]
    t = lm_score.Tokens(texts)
    words, grams = t.counts(np.array([True, True, True, False]))
    v, n = int((words > 0).sum()), int(words.sum())
    auto = lm_score.BackoffAutomaton(t, words, grams, n, v, (3.0, 2.0))
    every = np.arange(len(words))
    unknown = 0.1 / (n + 0.1 * (v + 1))
    for state in {auto.start, *auto.to_word.tolist(), *auto.target.tolist()}:
        if auto.fail[state] == auto.start != state:
            continue  # after a document's end nothing is read
        here = np.full(len(every), state)
        at, weight = state, 0.0
        while at != 0:
            weight, at = weight + auto.fail_weight[at], int(auto.fail[at])
        rest = unknown * 10.0**weight  # one further, unseen word
        assert (10.0 ** auto.read(here, every)[1]).sum() + rest == pytest.approx(1.0)


def test_lm_block_size():
    assert lm_score.block_size(10**10) == lm_score.BLOCK_BYTES
    assert lm_score.block_size(10**12) > lm_score.BLOCK_BYTES
    for total in (10**13, 10**14):
        assert lm_score.block_size(total) <= lm_score.MOST_BYTES
    assert (lm_score.key_bits(10**9), lm_score.key_bits(10**14)) == (48, 64)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(2**63, 2**63 + 40)), min_size=1, max_size=80))
def test_lm_distinct(numbers):
    keys = np.array(numbers, np.uint64)
    found, index, first = lm_score.distinct(keys)
    want, at, back = np.unique(keys, return_index=True, return_inverse=True)
    assert found.tolist() == want.tolist() and index.tolist() == back.tolist() and first.tolist() == at.tolist()
    assert lm_score._unpack(lm_score._pack(keys)).tolist() == numbers


def test_lm_empty(empty):
    assert lm_score.score(empty).count() == 0


# ---- personal data ---------------------------------------------------------- #
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= sum(c.isdigit() for c in s) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
}


def brute_base(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in BASE.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ09@.-+ 4()\né", max_size=60))
def test_pii_base_any_text(text):
    found = pii.find_spans(text)
    for kind, want in brute_base(text).items():
        assert [s[1:3] for s in found if s[0] == kind] == want


def test_pii_documents(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in queries.op5_pii(spark, SF).collect():
        base = brute_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in BASE)
        spans = sorted((a, list(BASE).index(k), b) for k, found in base.items() for a, b in found)
        joined = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        every = [x.split(":") for x in r.spans.split(",") if x]
        assert ",".join(":".join(x) for x in every if x[0] in BASE) == joined
        assert [int(x[1]) for x in every] == sorted(int(x[1]) for x in every)
    for r in pii.detect(documents).collect():
        base = brute_base(texts[r.doc_id])
        for kind, want in base.items():
            assert [(s.start, s.end) for s in r.pii_spans if s.kind == kind] == want


def test_pii_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    kinds = lambda t: [(k, t[a:b]) for k, a, b, _ in pii.find_spans(t)]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds("konto DE89 3704 0044 0532 0130 00, bitte")
    assert "iban" not in dict(kinds("DE88 3704 0044 0532 0130 00"))
    assert ("ssn", "123-45-6789") in kinds("my social security number 123-45-6789")
    assert "ssn" not in dict(kinds("part 123-45-6789 of the list"))
    low, high = pii.score("at 10.0.0.1", "ip", 3, 11), pii.score("server 10.0.0.1", "ip", 7, 15)
    assert low < high


# Example accounts of the countries beyond the first 33 of the table.
IBANS = """
    AD1200012030200359100100 AE070331234567890123456 AL47212110090000000235698741 AZ21NABZ00000000137010001944 BA391290079401028494
    BH67BMAG00001299123456 BI4210000100010000332045181 BR1800360305000010009795493C1 BY13NBRB3600900000002Z00AB00 CR05015202001026284066
    DJ2100010000000154000100186 DO28BAGR00000001212453611324 EG380019000500000000263180002 FK88SC123456789012 FO6264600001631634
    GE29NB0000000101904917 GI75NWBK000000007099453 GL8964710001000206 GT82TRAJ01020000001210029690 HN88CABF00000000000250005469
    IL620108000000099999999 IQ98NBIQ850123456789012 JO94CBJO0010000000000131000302 KW81CBKU0000000000001234560101 KZ86125KZT5004100100
    LB62099900000001001901229114 LC55HEMM000100010012001200023015 LY83002048000020100120361 MD24AG000225100013104168 ME25505000012345678951
    MK07250120000058984 MN121234123456789123 MR1300020001010000123456753 MU17BOMM0101101030300200000MUR NI45BAPR00000013000003558124
    OM810180000001299123456 PK36SCBL0000001123456702 PS92PALS000000000400123456702 QA58DOHB00001234567890ABCDEFG RS35260005601001611379
    RU0304452522540817810538091310419 SA0380000000608010167519 SC18SSCB11010000000000001497USD SD2129010501234001 SM86U0322509800000000270100
    SO211000001001000100141 ST23000100010051845310146 SV62CENR00000000000000700025 TL380080012345678910157 TN5910006035183598478831
    TR330006100519786457841326 UA213223130000026007233566001 VA59001123000012345678 VG96VPVG0000012345678901 XK051212012345678906
    YE15CBYE0001018861234567891234
""".split()


def test_pii_iban_of_every_registered_country():
    assert len(pii.IBAN_LENGTHS) == 89
    for account in IBANS:
        spaced = " ".join(account[i : i + 4] for i in range(0, len(account), 4))
        for text in (account, spaced):
            assert pii.redact(f"konto {text}, bitte", pii.find_spans(f"konto {text}, bitte")) == "konto [IBAN], bitte"
        wrong = account[:2] + f"{(int(account[2:4]) + 1) % 100:02d}" + account[4:]
        assert "iban" not in [s[0] for s in pii.find_spans(f"konto {wrong}, bitte")]


def test_pii_edge(edge, empty):
    out = pii.redact_texts(edge)
    assert out.columns == edge.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(t) for _, t in EDGE)
    assert pii.detect(empty).count() == 0
    assert pii.redact("a b@c.de 10.0.0.1 z", pii.find_spans("a b@c.de 10.0.0.1 z")) == "a [EMAIL] [IP] z"


def test_pii_long_runs_are_linear():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "@" * 300_000, "+1" + "(" * 300_000):
        pii.find_spans(t)


# ---- chat formatting -------------------------------------------------------- #
@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text("asu:#<\\ é", max_size=6)), st.one_of(st.none(), st.text("#<\\/>tu: \né", max_size=12))), max_size=6))
def test_chat_round_trip(turns):
    role, text = (pa.array([t[i] for t in turns], pa.string()) for i in (0, 1))
    col, start, end = chat_format.assemble(role, text)
    for (r, t), made, a, b in zip(turns, col.to_pylist(), start, end, strict=True):
        raw = made.encode()
        assert chat_format.parse_turn(raw) == ((r or "").encode(), (t or "").encode())
        assert chat_format.unescape(raw[a:b]) == (t or "").encode()
        assert raw.count(b"</turn>") == 1 and raw[1:].count(b"### ") == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.PROBE[1]), (-7, 1, "assistant", queries.PROBE[1])]
    got = {r.conv_id: r for r in queries.op6_chat_format(spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for key, r in got.items():
        own = sorted(x for x in rows if x[0] == key)
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in own)
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_edge(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string"
    rows = [(1, 0, "user", None, "x"), (1, 0, None, "a", "x"), (1, None, "assistant", "é" * 50000, "x"), (None, 1, "assistant", "", "x")]
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 50000 and out[None].n_turns == 1
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], schema))).count() == 0


# ---- quality ---------------------------------------------------------------- #
def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines, dup = [], 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality(edge, empty, documents):
    for df in (edge, documents):
        for r in quality.ledger(df).collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == brute_quality(r.text)
            assert (r.failed_bits & quality.mask("base") != 0) == (got[0] < 50 or 100 * got[4] > 50 * got[0])
    assert quality.ledger(empty).count() == 0
    assert quality.keep_good(edge).columns == edge.columns


def test_quality_policies_and_ablations(documents):
    rows = quality.ledger(documents)
    bits = [r.failed_bits for r in rows.collect()]
    for policy in quality.POLICIES:
        m = quality.mask(policy)
        got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(rows, policy).collect()}
        for rule in quality.RULES:
            if rule.name in quality.POLICIES[policy]:
                b = 1 << rule.bit
                assert got[rule.name] == (sum(x & b != 0 for x in bits), sum(x & m == b for x in bits))
    kept = {r.doc_id for r in quality.keep_good(documents, "v2").collect()}
    assert kept == {r.doc_id for r in rows.collect() if not r.failed_bits & quality.mask("v2")}


def test_quality_many_words_falls_back():
    words = [str(i).encode() for i in range(1 << 21)] + [b"1", b"2", b"3"]
    assert quality.repeat_words(words) == 6
