"""Quality rules as a bitmask ledger.

Every document is measured once (one Arrow pass) and every rule evaluated once
over the measurements, as SQL expressions; the result is one row per document
with the measurements and a bit per failed rule.  Policies are versioned masks
over those bits: applying one, or comparing several, never touches text again,
and ablations come from the counts of distinct bit patterns.

Defined results: null text has no words; an empty ledger has no rows; ids may
be null or repeated, every row is judged by itself; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8_list

SYMBOLS = b"#*$%&|<>"

_BATCH_BYTES = 8 << 20
#: Measurements, all bigint; ``giant_chars`` is in ASCII words of over 1000 characters.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word", "word_bytes", "giant_chars")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes meaning."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "100 * word_chars < 250 * n_words"),
    Rule(5, "long_words", "word_chars > 12 * n_words"),
    Rule(6, "giant_word", "longest_word > 1000"),
    # Where characters take more than 1.5 bytes on average, words need not be set apart by blanks.
    Rule(7, "long_words_spaced", "word_chars - giant_chars > 12 * n_words and 2 * word_bytes <= 3 * word_chars"),
    Rule(8, "giant_share", "100 * giant_chars > 50 * word_chars"),
)

#: Policy version -> names of the rules it applies.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "giant_word"),
    "v3": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words_spaced", "giant_share"),
}


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = [index.setdefault(w, len(index)) for w in words]
    if len(index) ** width >= 1 << 62:
        keys = list(zip(*(ids[i : n + i] for i in range(width)), strict=True))
        count = Counter(keys)
        hit = np.fromiter((count[k] > 1 for k in keys), bool, n)
    else:
        a = np.array(ids, np.int64)
        key = np.zeros(n, np.int64)
        for i in range(width):
            key = key * len(index) + a[i : n + i]
        order = np.sort(key)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hit = twice[at] == key
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : n + i] |= hit
    return int(covered.sum())


def _measure(text: bytes, n_chars: int) -> tuple:
    words = text.split()
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dups += line in seen
            seen.add(line)
    sizes = list(map(len, words))
    size, longest = sum(sizes), max(sizes, default=0)
    blank = len(text) - size
    giant = sum(len(w) for w in words if len(w) > 1000 and w.isascii()) if longest > 1000 else 0
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), n_chars - blank, symbols, dups, repeat_words(words), lines, longest, size, giant


def _measure_udf():
    fields = [pa.field(m, pa.int64()) for m in MEASURES]

    @F.arrow_udf(f"struct<{','.join(f'{m}:bigint' for m in MEASURES)}>")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for b in chunks(pa.RecordBatch.from_arrays([text], names=["text"]), "text", _BATCH_BYTES):
            col = b.column("text")
            chars = pc.fill_null(pc.utf8_length(col), 0).to_pylist()
            out += [_measure(t, n) for t, n in zip(utf8_list(col), chars, strict=True)]
        cols = zip(*out, strict=True) if out else [[]] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=fields)

    return run


def measure(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the measurements added (clashing names are replaced).

    Only the text goes to Python; the other columns stay in the JVM.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES and (keep_text or c != text)]
    found = docs.withColumn("_pw_m", _measure_udf()(F.col(f"`{text}`")))
    return found.select(*kept, *[F.col(f"_pw_m.{m}").alias(m) for m in MEASURES])


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def bits(prefix: str = "") -> Column:
    """One bit per failed rule; ``prefix`` says where the measurements are."""
    out = F.lit(0).cast("long")
    for r in RULES:
        test = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{prefix}\1", r.fails)
        out = out.bitwiseOR(F.when(F.expr(test), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out


def fails(policy: str, column: str = "failed_bits") -> Column:
    return F.col(column).bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ledger(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with measurements and ``failed_bits``."""
    return measure(docs, text, keep_text).withColumn("failed_bits", bits())


def ablations(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and that only it rejects.

    Computed from the counts of distinct bit patterns: at most ``2**rules``
    rows, whatever the corpus.
    """
    chosen = mask(policy)
    patterns = ledger_rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(chosen).cast("long")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if chosen >> r.bit & 1]))
    each = patterns.select("p", "n", names.alias("r"))
    failed = F.sum(F.when(F.col("p").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0))
    only = F.sum(F.when(F.col("p") == F.col("r.bit"), F.col("n")).otherwise(0))
    return each.groupBy("r.rule").agg(failed.alias("n_failed"), only.alias("n_only"))


def keep_good(docs: DataFrame, policy: str = "v3", text: str = "text") -> DataFrame:
    """Rows that pass the policy, with the columns of ``docs``."""
    found = docs.withColumn("_pw_m", _measure_udf()(F.col(f"`{text}`")))
    found = found.withColumn("_pw_bits", bits("_pw_m."))
    return found.where(~fails(policy, "_pw_bits")).select(*[F.col(f"`{c}`") for c in docs.columns])
