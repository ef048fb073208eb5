"""Word-piece token counts with a linear longest-match automaton.

The vocabulary is a trie.  Every trie node has a failure link to the node that
stands for what is left after greedy longest matching has popped pieces off,
and the number of those pieces, both computed once, breadth first (the LinMaxMatch
construction).  A word's count is then one walk over its symbols: follow an
edge, or add the node's popped count and follow its failure link.  No piece is
ever built.  Distinct words of a batch are walked together, longest first, one symbol
position at a time over the words that reach it, with the automaton in numpy
arrays; so the cost is linear in their bytes.

Words are the maximal runs outside ``[\\x20\\x09-\\x0D]`` as UTF-8 bytes, ``A-Z``
lower-cased where asked.  Every word is matched with ``prefix`` before it (a
space, for vocabularies whose word-opening pieces begin with one).  Pieces after
a word's first may also be a separate set (``later``).

Defined results: null or word-less text counts 0; a word that greedy matching
cannot cover counts as one unknown token; null ids and repeated rows are
treated row by row; extra columns pass through.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import read_ranks
from .common import IntTable, chunks, utf8_list

_BATCH_BYTES = 8 << 20
_SYMBOLS = 256
#: So few words are walked one by one.
_FEW = 16


class LongestMatch:
    """``first``/``later``: pieces that open / continue a word (one set: both)."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes] | None = None):
        children: list[dict[int, int]] = [{}]
        final: list[bool] = [False]

        def insert(root: int, seq: bytes) -> None:
            node = root
            for c in seq:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][c]
            if seq:
                final[node] = True

        for seq in first:
            insert(0, seq)
        self.again = 0
        if later is not None:
            self.again = len(children)
            children.append({})
            final.append(False)
            for seq in later:
                insert(self.again, seq)
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = deque({0, self.again})
        while queue:
            u = queue.popleft()
            for c, v in children[u].items():
                if final[v]:
                    fail[v], pops[v] = self.again, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and c not in children[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = children[z][c], n
                queue.append(v)
        keys = [u * _SYMBOLS + c for u, ch in enumerate(children) for c in ch]
        vals = [v for ch in children for v in ch.values()]
        self.edges = IntTable(np.array(keys, np.int64), np.array(vals, np.int32), -1)
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int64)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; 0 where greedy matching cannot cover it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        out = np.empty(len(words), np.int64)
        out[order] = self._walk([words[i] for i in order.tolist()], sizes[order])
        return out

    def _walk(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Counts of words sorted by falling length: each position costs its live rows only."""
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(sizes) - sizes
        n = np.zeros(len(words), np.int64)
        node = np.zeros(len(words), np.int64)
        longer = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left").tolist()
        for pos, rows in enumerate(longer):
            if rows <= _FEW:
                for i in range(rows):
                    n[i], node[i] = self._rest(words[i], pos, int(n[i]), int(node[i]))
                break
            live = np.flatnonzero(node[:rows] >= 0)
            sym = data[start[live] + pos].astype(np.int64)
            while len(live):
                to = self.edges.lookup(node[live] * _SYMBOLS + sym)
                ok = to >= 0
                node[live[ok]] = to[ok]
                live, sym = live[~ok], sym[~ok]
                n[live] += self.pops[node[live]]
                node[live] = self.fail[node[live]]
                alive = node[live] >= 0
                live, sym = live[alive], sym[alive]
        left = np.flatnonzero((node >= 0) & (node != self.again))
        while len(left):
            n[left] += self.pops[node[left]]
            node[left] = self.fail[node[left]]
            left = left[(node[left] >= 0) & (node[left] != self.again)]
        n[node < 0] = 0
        return n

    def _rest(self, word: bytes, pos: int, n: int, node: int) -> tuple[int, int]:
        """The walk over one word from ``pos`` on, for the few longest words of a batch."""
        edge = self.edges.get
        for c in word[pos:]:
            while node >= 0:
                to = edge(node * _SYMBOLS + c)
                if to >= 0:
                    node = to
                    break
                n += int(self.pops[node])
                node = int(self.fail[node])
            else:
                break
        return n, node


@functools.lru_cache(maxsize=2)
def load(path: str) -> LongestMatch:
    """Automaton of a rank file's vocabulary, once per Python worker."""
    return LongestMatch(read_ranks(path))


def count_tokens(docs: DataFrame, path: str, text: str = "text", lower: bool = True, prefix: bytes = b" ") -> DataFrame:
    """``docs`` with ``n_words``, ``n_tokens`` and ``n_unknown`` (bigint).

    ``n_tokens`` counts one token for each unknown word.
    """
    added = ("n_words", "n_tokens", "n_unknown")
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType(), False) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = load(path)
        for big in batches:
            for b in chunks(big, text, _BATCH_BYTES):
                seen: dict[bytes, int] = {}
                which, ends = [], [0]
                for t in utf8_list(b.column(text)):
                    which += [seen.setdefault(w, len(seen)) for w in (t.lower() if lower else t).split()]
                    ends.append(len(which))
                found = auto.count([prefix + w for w in seen])
                idx, ends = np.array(which, np.int64), np.array(ends)
                each = found[idx]
                total = np.concatenate([[0], np.cumsum(np.maximum(each, 1))])
                unknown = np.concatenate([[0], np.cumsum(each == 0)])
                cols = [np.diff(ends), np.diff(total[ends]), np.diff(unknown[ends])]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array(c, pa.int64()) for c in cols)], names=schema.names)

    return docs.mapInArrow(run, schema)
