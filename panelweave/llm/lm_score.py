"""Scores from a smoothed trigram model run as a weighted backoff automaton.

Model: each order is Dirichlet-smoothed by the one below, over an additive base::

    p1(w)      = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p2(w|h)    = (c(h w) + mu2 p1(w)) / (c(h) + mu2)
    p3(w|g h)  = (c(g h w) + mu3 p2(w|h)) / (c(g h) + mu3)

Automaton: the root, one state for each known word and one for each known pair.
An n-gram seen in training is an arc from the state of its history, with its own
weight; every other word takes the state's failure arc, ``log10(mu / (c + mu))``,
which consumes nothing, to the state of the shorter history.  A document starts in
the end token's state; one traversal from left to right carries the state, which
is what the last arc led to, and adds the weights up.  Traversal is vectorised
over pieces of documents: a later piece first reads the two tokens before it, from
the root and without adding weights, which leads to the state it must start in.

The model is never in one place.  Scan tasks cut their documents into blocks of
bounded size and write them once.  A block asks for the counts of its distinct
words and n-grams as sorted hashes, cut into ranges; each range sums what the
blocks counted in training documents and answers each of them in its own order;
the block then builds the part of the automaton that its documents can reach.
Texts are shuffled once, compressed, to meet their answers.  What moves is
proportional to distinct n-grams per block.  Frequent n-grams cost one entry a
block, so no key is hot, and blocks are cut by size, so no id or text is either.

Words are told apart by 64-bit hashes; n-grams by as many bits as keep the
chance that one meets another near one in a million (:func:`key_bits`).  Defined
results: null text is the empty text (its one token is the end); documents with
a null id count as held out; without training documents every count is 0 and
scores stay finite; repeated rows are scored one by one; an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IntTable, chunks, materialize, mix64, shuffle_width, utf8_list

#: Weight of the word base against a word's continuations, and of those against a pair's.
MU = (500.0, 5.0)
#: Added to every word's count.
ADD = 0.1
#: Least and most text in a block (and text per range of hashes).
BLOCK_BYTES, MOST_BYTES = 4 << 20, 128 << 20
#: Distinct n-grams per byte of text, about, and how many a (block, range) row
#: should hold at least, so that the rows' own cost stays small.
_KEYS_PER_BYTE, _KEYS_PER_ROW = 0.27, 64
#: Tokens a vectorised traversal reads in one go.
PIECE = 256

_U64 = np.uint64
_END = _U64(xxhash.xxh3_64_intdigest(b"", seed=77))
_ROOT = 0


# --------------------------------------------------------------------------- #
# sorted sets of hashes
# --------------------------------------------------------------------------- #
def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, index of each key among them, where each occurs first).

    Hashes differ in their leading bits, so these and the position are sorted as
    one number; the few places that need the bits left out are put right after.
    """
    n = len(keys)
    low = _U64(max(1, n).bit_length())
    mask = (_U64(1) << low) - _U64(1)
    packed = keys & ~mask
    packed |= np.arange(n, dtype=_U64)
    packed.sort()
    packed &= mask
    order = packed.astype(np.int32) if n < 1 << 31 else packed.astype(np.int64)
    del packed
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong) > 1000:
        order = np.argsort(keys, kind="stable").astype(order.dtype)
        found = keys[order]
    elif len(wrong):
        lead = found >> low
        lo, hi = np.searchsorted(lead, lead[wrong]), np.searchsorted(lead, lead[wrong], side="right")
        for a, b in set(zip(lo.tolist(), hi.tolist(), strict=True)):
            order[a:b] = order[a:b][np.argsort(found[a:b], kind="stable")]
        found = keys[order]
    new = np.ones(n, bool)
    new[1:] = found[1:] != found[:-1]
    index = np.empty_like(order)
    index[order] = np.cumsum(new, dtype=order.dtype) - 1
    return found[new], index, order[new]


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    n = len(numbers)
    size = max(1, (int(numbers.max()).bit_length() + 7) // 8) if n else 1
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.copy()
    return struct.pack("<BI", size, n) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    size, n = struct.unpack_from("<BI", data)
    planes = np.frombuffer(pa.decompress(data[5:], size * n, "zstd", asbytes=True), np.uint8).reshape(size, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


def _bounds(ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal parts of the hash space begins."""
    return np.array([(i << 64) // ranges for i in range(ranges)], _U64)


def _cut(keys: np.ndarray, counts: np.ndarray, ranges: int, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, packed keys, packed counts) of the ranges that hold keys."""
    bounds = _bounds(ranges)
    cuts = [*np.searchsorted(keys, bounds).tolist(), len(keys)]
    drop = _U64(64 - bits)
    for i in range(ranges):
        lo, hi = cuts[i], cuts[i + 1]
        if lo < hi:
            steps = np.diff(keys[lo:hi] >> drop, prepend=bounds[i] >> drop)
            yield i, _pack(steps), _pack(counts[lo:hi])


def _uncut(data: bytes, part: int, ranges: int, bits: int) -> np.ndarray:
    drop = _U64(64 - bits)
    start = _U64((part << 64) // ranges) >> drop
    return (np.cumsum(_unpack(data), dtype=_U64) + start) << drop


# --------------------------------------------------------------------------- #
# one block
# --------------------------------------------------------------------------- #
class Tokens:
    """Tokens of a block's documents, back to back, each document with its end.

    ``word``, ``pair`` and ``triple`` are each token's index among the distinct
    ``words`` and ``grams``; a document's first token ends no triple (-1).
    """

    def __init__(self, texts: list[bytes], bits: int = 64):
        parts, end = [], np.array([_END])
        for t in texts:
            words = t.lower().split()
            parts += (np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U64, len(words)), end)
        h = np.concatenate(parts) if parts else np.zeros(0, _U64)
        n = len(h)
        self.ends = np.cumsum([len(p) + 1 for p in parts[::2]], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if parts else self.ends
        del parts
        self.words, self.word, _ = distinct(h)
        before = np.full(n + 1, _END)  # a document follows the previous one's end
        before[1:] = h
        later = np.ones(n, bool)
        later[self.starts] = False
        self.later = later
        two = np.flatnonzero(later).astype(np.int32)
        keys = np.empty(n + len(two), _U64)
        with np.errstate(over="ignore"):
            keys[:n] = mix64(before[:-1] * _U64(0x9E3779B97F4A7C15) + mix64(h))
            keys[n:] = mix64(before[two - 1] * _U64(0xC2B2AE3D27D4EB4F) + keys[two])
        del h, before
        keys &= ~((_U64(1) << _U64(64 - bits)) - _U64(1)) if bits < 64 else ~_U64(0)
        self.grams, index, first = distinct(keys)
        del keys
        self.pair, self.triple = index[:n].copy(), np.full(n, -1, index.dtype)
        self.triple[two] = index[n:]
        del index
        #: whether each n-gram is a pair, and the token it first ends with
        self.is_pair, self.at = first < n, first
        last = first[~self.is_pair] - n
        self.at[~self.is_pair] = two[last]

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each word and each n-gram in the documents flagged."""
        use = np.repeat(train, self.ends - self.starts)
        grams = np.concatenate([self.pair[use], self.triple[use & self.later]])
        return np.bincount(self.word[use], minlength=len(self.words)), np.bincount(grams, minlength=len(self.grams))


class BackoffAutomaton:
    """The part of the model that one block can reach.

    State 0 is the root, ``1 + w`` a known word, ``1 + words + k`` the pair with
    n-gram index k.  The root has an arc for every word of the block.
    """

    def __init__(self, t: Tokens, words: np.ndarray, grams: np.ndarray, n: int, v: int, mu: tuple[float, float]):
        size, (mu2, mu3) = len(words), mu
        self.base = np.log10(words + ADD) - math.log10(n + ADD * (v + 1))
        self.to_word = np.where(words > 0, 1 + np.arange(size, dtype=np.int32), np.int32(_ROOT))
        end = int(np.searchsorted(t.words, _END))
        self.start = int(self.to_word[end]) if size and t.words[min(end, size - 1)] == _END else _ROOT
        # histories: failure arcs
        self.fail = np.zeros(1 + size + len(grams), np.int32)
        self.fail_weight = np.zeros(len(self.fail))
        self.fail_weight[1 : 1 + size] = math.log10(mu2) - np.log10(words + mu2)
        # pairs: arcs from words' states to their own
        known = grams > 0
        k = np.flatnonzero(t.is_pair & known).astype(np.int32)
        at = t.at[k]
        w, c = t.word[at], grams[k]
        h = np.where(t.later[at], t.word[at - 1], end)
        self.fail[1 + size + k] = self.to_word[w]
        self.fail_weight[1 + size + k] = math.log10(mu3) - np.log10(c + mu3)
        j = np.flatnonzero(~t.is_pair & known).astype(np.int32)
        pairs, many = len(k), len(k) + len(j)
        self.weight, self.target, keys = np.empty(many), np.empty(many, np.int32), np.empty(many, np.int64)
        self.weight[:pairs] = np.log10(c + mu2 * 10.0 ** self.base[w]) - np.log10(words[h] + mu2)
        self.target[:pairs] = 1 + size + k
        keys[:pairs] = self._key(self.to_word[h], w)
        # triples: the pair they end with gives the lower order and the state they lead to
        lower = np.zeros(len(grams))
        lower[k] = self.weight[:pairs]
        del k, at, w, c, h
        at = t.at[j]
        last, history = t.pair[at], t.pair[at - 1]
        self.weight[pairs:] = np.log10(grams[j] + mu3 * 10.0 ** lower[last]) - np.log10(grams[history] + mu3)
        self.target[pairs:] = 1 + size + last
        keys[pairs:] = self._key(1 + size + history, t.word[at])
        del lower, j, at, last, history
        self.arcs = IntTable(keys, np.arange(many, dtype=np.int32), -1, spare=2)

    @staticmethod
    def _key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = state.astype(np.int64) << 31
        out |= word
        return out

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after reading a word each, weights of the arcs taken)."""
        weight, after = np.zeros(len(state)), np.empty(len(state), np.int32)
        todo = np.arange(len(state))
        while len(todo):
            root = state == _ROOT
            if root.any():
                done, w = todo[root], word[root]
                weight[done] += self.base[w]
                after[done] = self.to_word[w]
                todo, state, word = todo[~root], state[~root], word[~root]
            arc = self.arcs.lookup(self._key(state, word))
            found = arc >= 0
            weight[todo[found]] += self.weight[arc[found]]
            after[todo[found]] = self.target[arc[found]]
            left = ~found
            todo, state, word = todo[left], state[left], word[left]
            weight[todo] += self.fail_weight[state]
            state = self.fail[state]
        return after, weight

    def traverse(self, t: Tokens, piece: int = PIECE) -> np.ndarray:
        """Sum of weights of each document."""
        sizes = t.ends - t.starts
        many = -(-sizes // piece)
        doc = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        lo = t.starts[doc] + nth * piece
        length = np.minimum(piece, t.ends[doc] - lo)
        state = np.where(nth == 0, self.start, _ROOT).astype(np.int32)
        run_up = np.flatnonzero(nth > 0)
        for back in (2, 1):
            state[run_up], _ = self.read(state[run_up], t.word[lo[run_up] - back])
        order = np.argsort(-length, kind="stable")
        lo, length, state = lo[order], length[order], state[order]
        total = np.zeros(len(lo))
        for step in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -step, side="left"))
            state[:live], weight = self.read(state[:live], t.word[lo[:live] + step])
            total[:live] += weight
        out = np.zeros(len(sizes))
        np.add.at(out, doc[order], total)
        return out


# --------------------------------------------------------------------------- #
# on the cluster
# --------------------------------------------------------------------------- #
_BLOCK = "block bigint, part bigint, data binary, counts binary"
_SCORES = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["block", "part", "data", "counts"])


def _blocks(size: int):
    """Documents to rows of one block each: id, flag and text as compressed Arrow data."""

    def packed(parts: list[pa.RecordBatch]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for p in parts:
                out.write_batch(p)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts, held = [], 0
        for big in batches:
            for b in chunks(big, "text", size):
                more = b.column("text").nbytes
                if parts and held + more > size:
                    yield _rows([(number, -1, packed(parts), None)])
                    number, parts, held = number + 1, [], 0
                parts.append(b)
                held += more
        if parts:
            yield _rows([(number, -1, packed(parts), None)])

    return run


def _documents(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _texts(docs: pa.Table) -> list[bytes]:
    return [t for c in docs.column("text").chunks for t in utf8_list(c)]


def _ask(ranges: int, bits: int):
    """Each block's distinct words (parts below ``ranges``) and n-grams, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                docs = _documents(data.as_py())
                tokens = Tokens(_texts(docs), bits)
                words, grams = tokens.counts(docs.column("train").to_numpy())
                yield _rows([(block, i, k, c) for i, k, c in _cut(tokens.words, words, ranges, 64)])
                yield _rows([(block, ranges + i, k, c) for i, k, c in _cut(tokens.grams, grams, ranges, bits)])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of equal ``key`` in sorted batches."""
    now, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _answer(ranges: int, bits: int):
    """One range at a time: total counts, sent back to each block in its own order.

    Rows of block -1 carry a range's training tokens and distinct words.
    """
    names = ["block", "part", "data", "n_tokens", "n_types"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups(batches, "part"):
            words = part < ranges
            keys = [_uncut(r["data"], part % ranges, ranges, 64 if words else bits) for r in rows]
            counts = np.concatenate([_unpack(r["counts"]) for r in rows]).astype(np.float64)
            blocks = [r["block"] for r in rows]
            rows.clear()
            at = np.cumsum([0, *map(len, keys)]).tolist()
            _, index, _ = distinct(np.concatenate(keys))
            total = np.bincount(index, weights=counts).astype(np.int64)
            found = total[index]
            out = [(b, part, _pack(found[lo:hi]), 0, 0) for b, lo, hi in zip(blocks, at, at[1:], strict=False)]
            if words:
                out.append((-1, part, b"", int(total.sum()), int(np.count_nonzero(total))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _score(ranges: int, bits: int, n: int, v: int, mu: tuple[float, float]):
    """One block at a time: its documents, then the answers in order of their parts."""
    names = [c.split()[0] for c in _SCORES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            docs = _documents(rows[0]["data"])
            none = np.zeros(0, np.uint64)
            words = np.concatenate([none, *(_unpack(r["data"]) for r in rows[1:] if r["part"] < ranges)]).astype(np.int64)
            grams = np.concatenate([none, *(_unpack(r["data"]) for r in rows[1:] if r["part"] >= ranges)]).astype(np.int64)
            rows.clear()
            t = Tokens(_texts(docs), bits)
            docs = docs.drop_columns("text")
            if (len(words), len(grams)) != (len(t.words), len(t.grams)):
                raise ValueError("a block did not get an answer for each of its n-grams")
            del t.grams
            auto = BackoffAutomaton(t, words, grams, n, v, mu)
            known = np.concatenate([[0], np.cumsum(words[t.word] > 0)])
            yield pa.RecordBatch.from_arrays(
                [
                    docs.column("id").combine_chunks(),
                    pa.array(~docs.column("train").to_numpy()),
                    pa.array(t.ends - t.starts),
                    pa.array(known[t.ends] - known[t.starts]),
                    pa.array(np.full(docs.num_rows, n, np.int64)),
                    pa.array(np.add.reduceat(auto.base[t.word], t.starts)),
                    pa.array(auto.traverse(t)),
                ],
                names,
            )

    return run


def block_size(total: int) -> int:
    """Text in a block: ``BLOCK_BYTES`` up to some 70 GB of text, then by its square root, ``MOST_BYTES`` at most.

    There are about total / size blocks and as many ranges, so a (block, range)
    row holds ``_KEYS_PER_BYTE * size ** 2 / total`` n-grams; below
    ``BLOCK_BYTES`` the number of rows, not of n-grams, would grow with the
    square of the input.  From some 75 TB on blocks stay at ``MOST_BYTES``, about
    4 GB in a task, and rows hold fewer n-grams: 48 at 100 TB.
    """
    return min(MOST_BYTES, max(BLOCK_BYTES, math.isqrt(int(total * _KEYS_PER_ROW / _KEYS_PER_BYTE))))


def key_bits(total: int) -> int:
    """Bits of an n-gram's hash, whole bytes: 18 more than it takes to number the text's bytes."""
    return min(64, 8 * -(-(total.bit_length() + 18) // 8))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mu: tuple[float, float] = MU, block_bytes: int | None = None, bits: int | None = None) -> DataFrame:
    """Per document: held_out, token counts, ``base_score`` and ``score`` (log10).

    Training documents are those whose crc32 of the id as text is not 0
    modulo 10; counts cover all of them, and all documents are scored.
    """
    size = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = (size.b or 0) + 16 * size.n
    block_bytes, bits = block_bytes or block_size(total), bits or key_bits(total)
    ranges = max(1, math.ceil(total / block_bytes))
    bucket = F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 10
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), (bucket != 0).alias("train"))
    blocks = materialize(rows.mapInArrow(_blocks(block_bytes), _BLOCK), "lm-blocks")
    tasks = min(ranges, 8 * shuffle_width(docs.sparkSession))
    asked = blocks.select("block", "data").mapInArrow(_ask(ranges, bits), _BLOCK)
    asked = asked.repartition(tasks, "part").sortWithinPartitions("part", "block")
    answers = asked.mapInArrow(_answer(ranges, bits), "block bigint, part bigint, data binary, n_tokens bigint, n_types bigint")
    answers = materialize(answers, "lm-answers")
    stats = answers.where("block = -1").agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).first()
    met = blocks.select("block", "part", "data").unionAll(answers.where("block >= 0").select("block", "part", "data"))
    met = met.repartition(tasks, "block").sortWithinPartitions("block", "part")
    return met.mapInArrow(_score(ranges, bits, stats.n or 0, stats.v or 0, mu), _SCORES)
