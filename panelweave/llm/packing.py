"""Vector bin packing of token sequences.

Every sequence is a bin with three limits: tokens, segments, loss-bearing
tokens.  Items wait in a bounded window; the open bin takes the fitting item
with the largest dot product of its demand and the bin's residual capacity
(each dimension divided by its capacity and weighted by the window's mean
demand).  When nothing fits, the largest item is cut to fill what is left, so
only a task's last sequence can need padding.  Each task packs its own rows:
no shuffle, memory bounded by the window, and the result depends only on the
task's input, so a lost task is simply run again.

Defined results: null text is the empty text (one end id); a null id is
carried along; every id lies in exactly one piece; an item without loss-bearing
tokens has demand 0 there; repeated rows are packed one by one; an empty table
gives no pieces; columns other than the id are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, str_list

_BATCH_BYTES = 8 << 20
_OUT_IDS = 1 << 20


class VectorPacker:
    """Streams items in, sequences of pieces out.

    ``add(key, ids, loss)`` and ``finish()`` yield pieces as tuples
    (key, start, ids, doc_tokens, sequence, offset).  ``loss`` is None when
    every token bears loss, else a boolean array.
    """

    def __init__(self, capacity: int = 2048, max_segments: int = 128, max_loss: int | None = None, window: int = 1024):
        if capacity < 1 or max_segments < 1 or (max_loss is not None and max_loss < 1):
            raise ValueError("capacities must be positive")
        self.cap = np.array([capacity, max_segments, max_loss or capacity], np.float64)
        self.window = window
        self.items: list[list] = []  # key, start, ids, loss, doc_tokens
        self.tok = np.zeros(0)
        self.loss = np.zeros(0)
        self.sequence = 0

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[tuple]:
        total, start, limit = len(ids), 0, int(self.cap[0])
        if loss is None and self.cap[2] >= limit:  # whole sequences of a long item need no search
            while total - start >= limit:
                yield (key, start, ids[start : start + limit], total, self.sequence, 0)
                self.sequence += 1
                start += limit
        if start < total:
            self.items.append([key, start, ids[start:], None if loss is None else loss[start:], total])
            if len(self.items) >= self.window:
                yield from self._pack(self.window // 2)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(0)

    def _demands(self) -> np.ndarray:
        tok = np.fromiter((len(x[2]) for x in self.items), np.float64, len(self.items))
        loss = np.fromiter((len(x[2]) if x[3] is None else np.count_nonzero(x[3]) for x in self.items), np.float64, len(self.items))
        return np.column_stack([tok, np.ones(len(tok)), loss])

    def _pack(self, leave: int) -> Iterator[tuple]:
        need = self._demands()
        alive = np.ones(len(need), bool)
        left = len(need)
        weight = need.mean(axis=0) / self.cap**2 if left else 0
        while left > leave:
            room, offset = self.cap.copy(), 0
            while left and room[0] >= 1 and room[1] >= 1:
                fits = alive & (need[:, 0] <= room[0]) & (need[:, 2] <= room[2])
                score = np.where(fits, need @ (weight * room), -1.0)
                best = int(score.argmax())
                if fits[best]:
                    take = int(need[best, 0])
                else:
                    best = int(np.where(alive, need[:, 0], -1.0).argmax())
                    take = self._fitting(self.items[best], room)
                    if take == 0:
                        break
                item = self.items[best]
                key, start, ids, loss, total = item
                used = take if loss is None else int(np.count_nonzero(loss[:take]))
                yield (key, start, ids[:take], total, self.sequence, offset)
                offset += take
                room -= (take, 1, used)
                if take == len(ids):
                    alive[best] = False
                    left -= 1
                else:
                    item[1:4] = start + take, ids[take:], None if loss is None else loss[take:]
                    need[best] -= (take, 0, used)
            self.sequence += 1
        self.items = [x for x, a in zip(self.items, alive.tolist(), strict=True) if a]

    @staticmethod
    def _fitting(item: list, room: np.ndarray) -> int:
        """Longest head of the item that fits the room."""
        n = min(len(item[2]), int(room[0]))
        if item[3] is None:
            return min(n, int(room[2]))
        return int(np.searchsorted(np.cumsum(item[3][:n]), room[2], side="right"))


@functools.lru_cache(maxsize=2)
def _tokenizer(json_path: str, ranks_path: str, pattern: str):
    """Text to ids as the ``tokenizers`` library gives them.

    Where a rank file of the same vocabulary is given, texts whose characters
    lie below U+0280 go through ``tiktoken``, three times as fast and equal
    there; all others go through ``tokenizers``, so that the two libraries'
    Unicode tables cannot make a difference.
    """
    from tokenizers import Tokenizer

    @functools.lru_cache(maxsize=1)
    def slow() -> Tokenizer:
        return Tokenizer.from_file(json_path)

    if not ranks_path:
        return lambda texts: [np.array(e.ids, np.uint32) for e in slow().encode_batch(texts, add_special_tokens=False)]
    import json

    import tiktoken

    from .byte_bpe import read_ranks

    with open(json_path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens=special)
    allowed = set(special)

    def run(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            raw = np.frombuffer(t.encode(), np.uint8)
            if len(raw) == 0 or raw.max() < 0xCA:
                out.append(fast.encode_to_numpy(t, allowed_special=allowed))
            else:
                out.append(np.array(slow().encode(t, add_special_tokens=False).ids, np.uint32))
        return out

    return run


def _table(key_type: pa.DataType, rows: list[tuple], base: int) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cols[0], key_type),
            pa.array(cols[1], pa.int64()),
            pa.array([len(x) for x in cols[2]], pa.int64()),
            pa.array([x.astype("<u4").tobytes() for x in cols[2]], pa.binary()),
            pa.array(cols[3], pa.int64()),
            pa.array([base + x for x in cols[4]], pa.int64()),
            pa.array(cols[5], pa.int64()),
        ],
        ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


PIECES = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(
    docs: DataFrame,
    json_path: str,
    ranks_path: str = "",
    pattern: str = "",
    id_col: str = "doc_id",
    text: str = "text",
    end_id: int | None = 1,
    capacity: int = 2048,
    max_segments: int = 128,
    max_loss: int | None = None,
    window: int = 1024,
) -> DataFrame:
    """Pieces of every text's ids (``end_id`` appended), packed.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.
    ``sequence_id`` is unique over the whole result: task number, then a
    running number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = _tokenizer(json_path, ranks_path, pattern)
        packer = VectorPacker(capacity, max_segments, max_loss, window)
        base = TaskContext.get().partitionId() << 33
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        rows, held = [], 0

        def pieces() -> Iterator[tuple]:
            for big in batches:
                for b in chunks(big, "text", _BATCH_BYTES):
                    for key, ids in zip(b.column("id").to_pylist(), tokenize(str_list(b.column("text"))), strict=True):
                        yield from packer.add(key, np.concatenate([ids, tail]))
            yield from packer.finish()

        for piece in pieces():
            rows.append(piece)
            held += len(piece[2])
            if held >= _OUT_IDS:
                yield _table(pa.int64(), rows, base)
                rows, held = [], 0
        yield _table(pa.int64(), rows, base)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def pack_tokens(docs: DataFrame, id_col: str, ids: str, loss: str | None = None, capacity: int = 2048, max_segments: int = 128, max_loss: int | None = None, window: int = 1024) -> DataFrame:
    """Like :func:`pack_documents` for instruction data that is tokenised.

    ``ids``: array<int>; ``loss``: array<boolean> of the same length, true for
    loss-bearing tokens (null array: all of them).  Rows without ids give no
    piece.
    """
    mask = F.lit(None).cast("array<boolean>") if loss is None else F.col(loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(capacity, max_segments, max_loss, window)
        base = TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for key, x, m in zip(*(b.column(c).to_pylist() for c in ("id", "ids", "loss")), strict=True):
                rows += packer.add(key, np.array(x or [], np.uint32), None if m is None else np.array(m, bool))
            yield _table(pa.int64(), rows, base)
        yield _table(pa.int64(), list(packer.finish()), base)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(ids).alias("ids"), mask.alias("loss"))
    return chosen.mapInArrow(run, PIECES)
