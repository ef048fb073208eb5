"""The registered queries: one per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, exact_dedup, lm_score, near_dup, packing, pii, quality, token_count, warc
from .common import bound_batches

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: A conversation whose texts look like the template's control strings.
PROBE = (-7, r"\### Assistant: </turn> ok")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


# ---- 1 -------------------------------------------------------------------- #
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    # the table has no time of retrieval: a second a page from 2000 on
    date = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.pmod("page_id", F.lit(10**9))), "yyyyMMddHHmmss")
    manifest = warc.write_archives(pages, date=date)
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = r"""
with t as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
g as (select *, max(page_id) over (partition by html) as top,
  list_aggregate(list_transform(string_split(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') as bits from t)
select page_id, strlen(html) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * k + 1, 1)::int + 8 * substr(bits, 5 * k + 2, 1)::int
    + 4 * substr(bits, 5 * k + 3, 1)::int + 2 * substr(bits, 5 * k + 4, 1)::int + substr(bits, 5 * k + 5, 1)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from g
"""


# ---- 2 -------------------------------------------------------------------- #
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_duplicates(_documents(spark, sf_dir))
    digest = F.coalesce("_pw_sha", exact_dedup.normalized_sha256(F.col("text")))
    return found.select("doc_id", "keep_id", "group_size", "kept", digest.alias("text_sha256"))


OP2_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
)
select doc_id,
       first_value(doc_id) over (partition by norm order by length(raw) desc, doc_id) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = first_value(doc_id) over (partition by norm order by length(raw) desc, doc_id) as kept,
       sha256(norm) as text_sha256
from t
"""


# ---- 3 -------------------------------------------------------------------- #
def pieces(docs: DataFrame) -> DataFrame:
    packed = packing.pack_documents(docs, BPE_JSON, BPE_RANKS, PATTERN)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(_documents(spark, sf_dir))


# ---- 4 -------------------------------------------------------------------- #
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


# ---- 5 -------------------------------------------------------------------- #
def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_documents(spark, sf_dir)).drop("text")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [F.size(F.expr(f"filter(pii_spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"))


# ---- 6 -------------------------------------------------------------------- #
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    conv, text = PROBE
    probe = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], turns.schema)
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(probe)))


OP6_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
select conv_id,
       count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('### ') + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(': ')
           + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + length('</turn>') + 1)::bigint as formatted_chars
from t group by conv_id
"""


# ---- 7 -------------------------------------------------------------------- #
def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, sf_dir), BPE_RANKS).drop("text")


# ---- 8 -------------------------------------------------------------------- #
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode(_documents(spark, sf_dir), BPE_RANKS, PATTERN).drop("text")
    back = byte_bpe.decode(ids, BPE_RANKS, PATTERN)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


# ---- 9 -------------------------------------------------------------------- #
#: The policy that the query's SQL states; the pipeline applies a later one.
POLICY = "v2"


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(_documents(spark, sf_dir), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality.fails("base").alias("base_failed"),
        (~quality.fails(POLICY)).alias("kept"),
        F.col("failed_bits").bitwiseAND(F.lit(quality.mask(POLICY)).cast("long")).alias("failed_bits"),
    )


OP9_SQL = r"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (select r, unnest(range(1, len(w) - 1)) as i, w from t),
d as (select r, i from g qualify count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) > 1),
c as (select r, count(distinct i + o) as n from d, (select unnest([0, 1, 2]) as o) group by r),
m as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
  len(l) as n_lines, coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) as longest_word from t left join c using (r)),
b as (select *, case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 100 * n_symbols > 25 * n_words then 4 else 0 end
  + case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end + case when 100 * word_chars < 250 * n_words then 16 else 0 end + case when word_chars > 12 * n_words then 32 else 0 end
  + case when longest_word > 1000 then 64 else 0 end as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, bits = 0 as kept, bits::bigint as failed_bits from b
"""


# ---- 10 ------------------------------------------------------------------- #
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = near_dup.near_duplicates(_table(spark, sf_dir, "documents"), num=85, den=100)
    return ledger.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP10_SQL = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from t where len(w) > 0),
s as (select distinct doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') as g from p),
n as (select doc_id, count(*) as n from s group by doc_id),
j as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select x, y from j join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
r as (select doc_id as x, doc_id as y from t union select r.x, e.y from r join e on e.x = r.y),
k as (select x as doc_id, min(y) as component_id from r group by x)
select t.doc_id, coalesce(n.n, 0) as n_shingles, component_id, t.doc_id = component_id as kept from t join k using (doc_id) left join n using (doc_id)
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_lm_score": op4_lm_score,
    "op5_pii": op5_pii,
    "op6_chat_format": op6_chat_format,
    "op7_token_count": op7_token_count,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL = {
    "op1_warc": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op6_chat_format": OP6_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_near_dedup": OP10_SQL,
}
