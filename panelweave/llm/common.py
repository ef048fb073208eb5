"""Shared pieces: scratch tables, bounded hash filters, Arrow helpers.

Conventions every operator of this subpackage follows:

* words are the maximal runs of ``[^\\x20\\x09-\\x0D]``; on UTF-8 bytes that is
  exactly ``bytes.split()``, and lower-casing ``A-Z`` is ``bytes.lower()``;
* a null text is treated as the empty text unless the operator says otherwise;
* internal columns start with ``_pw_`` so that extra input columns cannot clash.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U64 = np.uint64
#: Bits held by one row of ``bitmap_construct_agg``.
_BITMAP_BITS = 32768
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = "8m"


# --------------------------------------------------------------------------- #
# scratch tables
# --------------------------------------------------------------------------- #
def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in one local process (plain
    tests) a folder of our own is created and recorded in the session, so that
    later calls agree on it; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelweave-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/panelweave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, reduced: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder.

    ``reduced``: the rows are what is left of far larger shuffles; they are
    dealt out once more to an eighth of the shuffle partitions (16 at least), for
    fewer and larger files, while the stages before keep their width.  While it
    runs, batches to Python hold at most ``ARROW_BYTES``, so that wide rows (whole
    texts, pairs of sets) do not fill the workers.  The job's shuffle files are
    removed at its end; from then on the table stands for them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if reduced:
        df = df.repartition(max(16, shuffle_width(spark) // 8))
    own = {_ARROW_CONF: ARROW_BYTES, _CLEANUP_CONF: "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._pw_path = path
    return out


def bound_batches(spark: SparkSession) -> None:
    """Small batches for this session, for jobs over whole texts.

    At most ``ARROW_BYTES`` a batch to Python, instead of 10000 rows or 64 MB
    in the JVM and again in each worker, and 512 rows a batch from Parquet
    instead of 4096, whose texts make arrays of tens of MB on the heap.
    """
    spark.conf.set(_ARROW_CONF, ARROW_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 512)


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`materialize` once nothing reads it."""
    path = getattr(df, "_pw_path", None)
    if path:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- #
# bounded set-membership filter, all in the JVM
# --------------------------------------------------------------------------- #
class HashFilter:
    """A bitmap of at most ``2**bits`` bits saying which keys *may* matter.

    Built from a DataFrame of keys and applied by a broadcast join against its
    rows (4 KB each).  Without ``bits`` it gets 16 bits a key, between 2**12
    and 2**30 in all, so the broadcast is at most 128 MB however many keys
    there are.  False positives are possible, false negatives are not, so
    whoever uses it must follow with an exact step; a saturated filter costs
    speed, never rows.  ``keys`` is read twice and should be materialized.
    """

    LEAST, MOST = 12, 30

    def __init__(self, keys: DataFrame, key: str, bits: int | None = None):
        self.bits = bits or min(self.MOST, max(self.LEAST, (16 * keys.count()).bit_length()))
        slot = self._slot(F.col(key))
        rows = (
            keys.select(slot.alias("_pw_slot"))
            .groupBy(F.shiftright("_pw_slot", 15).alias("_pw_bucket"))
            .agg(F.bitmap_construct_agg(F.col("_pw_slot") % _BITMAP_BITS).alias("_pw_bits"))
        )
        self.rows = materialize(rows, "filter", reduced=True)  # small, and read by every plan that applies it

    def _slot(self, key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.bits)

    def flag(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """Add boolean ``name``: the key may be in the set (null key: false)."""
        slot = self._slot(F.col(key))
        left = df.withColumn("_pw_slot", slot).withColumn("_pw_bucket", F.shiftright("_pw_slot", 15))
        byte = f"cast(conv(hex(substring(_pw_bits, cast((_pw_slot % {_BITMAP_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
        hit = F.expr(f"shiftright({byte}, cast(_pw_slot % 8 as int)) & 1 = 1")
        return (
            left.join(F.broadcast(self.rows), "_pw_bucket", "left")
            .withColumn(name, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False)))
            .drop("_pw_slot", "_pw_bucket", "_pw_bits")
        )


# --------------------------------------------------------------------------- #
# Arrow helpers
# --------------------------------------------------------------------------- #
def utf8_list(col: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null becomes empty."""
    return pc.fill_null(col, "").cast(pa.binary()).to_pylist()


def str_list(col: pa.Array) -> list[str]:
    return pc.fill_null(col, "").to_pylist()


def chunks(batch: pa.RecordBatch, text: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``text`` adds up to about ``budget`` bytes.

    A single longer text forms a slice of its own, whole.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a bijection on 64 bits)."""
    with np.errstate(over="ignore"):
        x = x.astype(_U64, copy=True)
        x ^= x >> _U64(30)
        x *= _U64(0xBF58476D1CE4E5B9)
        x ^= x >> _U64(27)
        x *= _U64(0x94D049BB133111EB)
        x ^= x >> _U64(31)
    return x


class IntTable:
    """Distinct int64 keys (>= 0) to int32 values by open addressing, in two arrays."""

    def __init__(self, keys: np.ndarray, vals: np.ndarray, missing: int, spare: int = 4):
        self.missing = np.int32(missing)
        self.bits = max(8, int(spare * len(keys)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, missing, np.int32)
        slots = self._slot(keys)
        self.longest = 0
        while len(keys):
            self.longest += 1
            free = np.flatnonzero(self.keys[slots] == -1)
            self.keys[slots[free]] = keys[free]  # of several keys for a slot the last one stays
            took = self.keys[slots] == keys
            self.vals[slots[took]] = vals[took]
            rest = ~took
            keys, vals, slots = keys[rest], vals[rest], (slots[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.view(_U64) * _U64(0x9E3779B97F4A7C15)
        return (h >> _U64(64 - self.bits)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key (one dimension), ``missing`` where absent."""
        out = np.full(len(keys), self.missing, np.int32)
        todo, slots = np.arange(len(keys)), self._slot(keys)
        for _ in range(self.longest):
            found = self.keys[slots]
            hit = found == keys
            out[todo[hit]] = self.vals[slots[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) & self.mask
        return out

    def get(self, key: int) -> int:
        """Value of one key."""
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        mask = int(self.mask)
        while (found := int(self.keys[slot])) != key:
            if found == -1:
                return int(self.missing)
            slot = (slot + 1) & mask
        return int(self.vals[slot])
