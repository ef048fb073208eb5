"""Byte-level BPE with length-bucketed padded numpy matrices.

Distinct pre-tokens of a batch are cut between bytes that no token holds next to
each other, which no merge can cross, and grouped by length into matrices of
token ids, one row a piece, padded to the bucket's width.  Each round every row
merges its leftmost pair of minimum rank; pair ranks come from an
open-addressing hash table held in two arrays, and rows are compacted.  Where no
pair with the merged token ranks below it, the same pair's next occurrences to
the right would be merged in the following rounds; they are merged in the same
one, so that a long run takes few rounds.  Rows without a mergeable pair leave
the matrix.  Results equal merging one pair at a time, lowest rank first,
leftmost among equals, for pieces of every length.

Defined results: null text encodes like the empty text, to no ids; decoding a
null id list gives empty bytes; an id outside the vocabulary is an error;
special tokens are never produced; extra columns pass through.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import IntTable, chunks, str_list

_NONE = np.int32(0x7FFFFFFF)
_BATCH_BYTES = 6 << 20
_DECODE_IDS = 1 << 20
#: Widths of the first buckets, each further one twice as wide; a piece goes to the smallest that holds it.
_WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 48, 64)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 token, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def white_space_class(pattern: str) -> str:
    """``\\s`` as the Unicode White_Space property.

    The ``regex`` module also counts U+001C..U+001F as white space; the split
    must not.
    """
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        left, right, merged = np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32)
        self.table = IntTable((left << 32) | right, merged, int(_NONE))
        #: Tokens that some pair holds whose rank is lower than the token's own.
        self.sinking = np.zeros(max(ranks.values()) + 1, bool)
        for part in (left, right):
            self.sinking[part[merged < part]] = True

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` where it does not merge (or is padding)."""
        out = np.full(left.shape, _NONE, np.int32)
        real = (left >= 0) & (right >= 0)
        out[real] = self.table.lookup((left[real].astype(np.int64) << 32) | right[real].astype(np.int64))
        return out


class ByteBPE:
    """Encoder and decoder for one vocabulary; holds only arrays and tables."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(white_space_class(pattern)).findall
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = {i: t for t, i in ranks.items()}
        self.inside = np.zeros((256, 256), bool)
        for t in ranks:
            self.inside[list(t[:-1]), list(t[1:])] = True
        sizes = np.zeros(max(self.tokens) + 1, np.int64)
        for i, t in self.tokens.items():
            sizes[i] = len(t)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), np.uint8)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words back to back, number of ids of each)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cut = np.empty(len(data), bool)
        cut[:-1] = ~self.inside[data[:-1], data[1:]]
        cut[ends[ends > 0] - 1] = True
        stops = np.flatnonzero(cut) + 1
        sizes = np.diff(stops, prepend=0)
        starts = stops - sizes
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, ids matrix, lengths
        lo = width = 0
        for width in self._widths(int(sizes.max())):
            rows = np.flatnonzero((sizes > lo) & (sizes <= width))
            lo = width
            if len(rows):
                parts += self._merge(rows, data, starts[rows], sizes[rows], width)
        counts = np.zeros(len(sizes), np.int64)
        for rows, _, n in parts:
            counts[rows] = n
        at = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for rows, ids, n in parts:
            col = np.arange(ids.shape[1])
            inside = col < n[:, None]
            flat[(at[rows][:, None] + col)[inside]] = ids[inside]
        until = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(stops, ends, side="right")]
        return flat, np.diff(until, prepend=0)

    @staticmethod
    def _widths(longest: int) -> Iterator[int]:
        yield from _WIDTHS
        width = _WIDTHS[-1]
        while width < longest:
            width *= 2
            yield width

    def _merge(self, rows, data, starts, size, width):
        col = np.arange(width)
        real = col < size[:, None]
        ids = np.full((len(rows), width), -1, np.int32)
        ids[real] = self.byte_ids[data[(starts[:, None] + col)[real]]]
        rank = np.full(ids.shape, _NONE, np.int32)  # of each token and the one after it
        rank[:, :-1] = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        done = []
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            go = best != _NONE
            if not go.all():
                stop = ~go
                done.append((rows[stop], ids[stop], size[stop]))
                rows, ids, rank, size, at, best = rows[go], ids[go], rank[go], size[go], at[go], best[go]
                if not len(rows):
                    return done
            ids, rank, size = self._round(ids, rank, size, at, best)

    def _round(self, ids, rank, size, at, best):
        """Every row's merge, or merges, of one round."""
        each = np.arange(len(ids))
        hit = np.zeros(ids.shape, bool)
        hit[each, at] = True
        more = np.flatnonzero(~self.pairs.sinking[best])
        if ids.shape[1] > 3 and len(more):
            same = rank[more] == best[more, None]
            if len(more) < np.count_nonzero(same):
                # of occurrences that overlap (a run of one token) every second, from the left
                col = np.arange(ids.shape[1])
                before = np.maximum.accumulate(np.where(same, -1, col), axis=1)
                hit[more] = same & ((col - before) % 2 == 1)
        gone = np.zeros(ids.shape, bool)
        gone[:, 1:] = hit[:, :-1]
        ids = np.where(hit, best[:, None], ids)
        size = size - np.count_nonzero(hit, axis=1)
        keep = ~gone & (ids >= 0)
        into = np.arange(int(size.max())) < size[:, None]
        new_ids = np.full(into.shape, -1, np.int32)
        new_rank = np.full(into.shape, _NONE, np.int32)
        merged = np.zeros((len(ids), into.shape[1] + 1), bool)
        new_ids[into], new_rank[into], merged[:, :-1][into] = ids[keep], rank[keep], hit[keep]
        i, j = np.nonzero(merged[:, :-1] | merged[:, 1:])  # pairs with a merged token
        last = j + 1 == new_ids.shape[1]
        new_rank[i[last], j[last]] = _NONE
        i, j = i[~last], j[~last]
        new_rank[i, j] = self.pairs.lookup(new_ids[i, j], new_ids[i, j + 1])
        return new_ids, new_rank, size

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts back to back, offsets)."""
        seen: dict[str, int] = {}
        which, ends = [], [0]
        for t in texts:
            which += [seen.setdefault(p, len(seen)) for p in self.split(t)]
            ends.append(len(which))
        flat, counts = self.encode_words([p.encode() for p in seen])
        idx = np.array(which, np.int64)
        n = counts[idx]
        start = (np.cumsum(counts) - counts)[idx]
        total = np.concatenate([[0], np.cumsum(n)])
        pos = np.arange(total[-1]) + np.repeat(start - total[:-1], n)
        return flat[pos], total[np.array(ends)]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids back to back, where each id's bytes end)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.bytes[np.arange(n.sum()) + np.repeat(self.starts[ids] - (ends - n), n)], ends

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_flat(np.array(ids, np.int64))[0].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The vocabulary, once per Python worker."""
    return ByteBPE(read_ranks(path), pattern)



def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: array<int> of each whole text's ids."""
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for big in batches:
            for b in chunks(big, text, _BATCH_BYTES):
                ids, offsets = bpe.encode_batch(str_list(b.column(text)))
                col = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), col], names=[*(f.name for f in kept), out])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``docs`` with ``out``: binary of the decoded ids."""
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for big in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(big.column(ids)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < big.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + _DECODE_IDS, side="right")))
                b = big.slice(lo, hi - lo)
                data, stops = bpe.decode_flat(b.column(ids).flatten().to_numpy(zero_copy_only=False))
                stops = np.concatenate([[0], stops])[np.concatenate([[0], ends[lo:hi] - before])]
                col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), col.cast(pa.binary())], names=[*(f.name for f in kept), out])
                lo = hi

    return docs.mapInArrow(run, schema)
