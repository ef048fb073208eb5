"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``.  Each refinement looks only at rows that the one before
could not rule out: rows are counted by length; where a length repeats, by length
and a hash of the first characters; where that repeats, by the full hash.  What a
refinement found travels as a bitmap of bounded size and is applied inside the next
scan, so rows that are ruled out never enter a shuffle.  All groupings use partial
aggregation, so a group holding a third of all rows costs one partial row per
task.  Everything is built-in column functions.

Defined results: null text equals the empty text; a null id sorts after every
other id; rows that repeat the winner's id and length are all marked ``kept``
in the ledger, and :func:`drop_duplicates` leaves exactly one of them; an empty
table gives an empty result; extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashFilter, discard, materialize

#: Deleted before texts are compared.
WHITESPACE = " \t\n\x0b\x0c\r"
#: Normalised characters that the second refinement looks at.
PREFIX_CHARS = 64


def normalized(text: Column) -> Column:
    """The text without white space; null: empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITESPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def normalized_sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text (null: empty)."""
    return F.sha2(normalized(text), 256)


def _split(docs: DataFrame, text: str, filter_bits: int | None):
    """(rows that cannot have a copy, rows that may, scratch to discard)."""
    norm = normalized(F.col(text))
    sized = docs.withColumn("_pw_len", F.octet_length(norm))
    lengths = sized.groupBy("_pw_len").agg(F.count(F.lit(1)).alias("_pw_n")).where("_pw_n > 1").select("_pw_len")
    lengths = materialize(lengths, "dedup-lengths", reduced=True)
    second = HashFilter(lengths, "_pw_len", filter_bits)
    prefix = F.when(F.col("_pw_may_len"), F.xxhash64("_pw_len", F.left(norm, F.lit(PREFIX_CHARS))))
    keyed = second.flag(sized, "_pw_len", "_pw_may_len").withColumn("_pw_key", prefix).drop("_pw_len", "_pw_may_len")
    heads = keyed.where("_pw_key is not null").groupBy("_pw_key").agg(F.count(F.lit(1)).alias("_pw_n")).where("_pw_n > 1").select("_pw_key")
    heads = materialize(heads, "dedup-prefix", reduced=True)
    third = HashFilter(heads, "_pw_key", filter_bits)
    flagged = third.flag(keyed, "_pw_key", "_pw_may").drop("_pw_key")
    scratch = (lengths, heads)
    return flagged.where(~F.col("_pw_may")).drop("_pw_may"), flagged.where("_pw_may").drop("_pw_may"), scratch


def _ledgers(docs: DataFrame, id_col: str, text: str, filter_bits: int | None) -> tuple[DataFrame, DataFrame]:
    alone, maybe, scratch = _split(docs, text, filter_bits)
    maybe = maybe.withColumn("_pw_sha", normalized_sha256(F.col(text))).withColumn("_pw_len", F.coalesce(F.char_length(text), F.lit(0)))
    best = F.min(F.struct((-F.col("_pw_len")).alias("l"), F.col(id_col).isNull().alias("x"), F.col(id_col).alias("i")))
    groups = maybe.groupBy("_pw_sha").agg(best.alias("_pw_best"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "dedup-groups", reduced=True)
    for t in scratch:
        discard(t)
    copies = (
        maybe.join(groups, "_pw_sha")  # all of a text's copies, so at most the repeated part of the table
        .withColumn("keep_id", F.col("_pw_best.i"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_pw_len") == -F.col("_pw_best.l")))
        .drop("_pw_best", "_pw_len")
    )
    alone = alone.select(
        "*",
        F.lit(None).cast("string").alias("_pw_sha"),
        F.lit(1).cast("long").alias("group_size"),
        F.col(id_col).alias("keep_id"),
        F.lit(True).alias("kept"),
    )
    return alone, copies


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", filter_bits: int | None = None) -> DataFrame:
    """Every input row with ``keep_id``, ``group_size``, ``kept`` added.

    Of equal texts the row with the most code points, then the smallest id
    stays.  ``_pw_sha`` holds the full hash where refinement got that far.
    Input columns of the three names are replaced.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    alone, copies = _ledgers(docs, id_col, text, filter_bits)
    return alone.unionByName(copies)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", filter_bits: int | None = None) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; one row a group."""
    names = docs.columns
    docs = docs.withColumnsRenamed({c: f"_pw_in_{c}" for c in ("keep_id", "group_size", "kept") if c in names})
    alone, copies = _ledgers(docs, id_col, text, filter_bits)
    rows = alone.unionByName(copies.where("kept").dropDuplicates(["_pw_sha"])).drop("_pw_sha", "keep_id", "group_size", "kept")
    return rows.withColumnsRenamed({f"_pw_in_{c}": c for c in names}).select(*[F.col(f"`{c}`") for c in names])
