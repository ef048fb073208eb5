"""Chat formatting by columnar byte assembly.

Per Arrow batch, roles and texts arrive as two byte buffers with offsets.
Segment lengths (header, role, separator, text, footer) give cumulative
offsets; escapes and contents are scattered by numpy index arrays into one
preallocated buffer, which becomes the output column without copies.

Template of a turn::

    ### <role>: <text></turn>\\n

``\\``, ``#`` and ``<`` in a text or role, and ``:`` in a role, are preceded by a
backslash, so neither ``###`` nor ``</turn>`` can occur inside one and the
formatting is reversible.  The loss mask of a turn is the byte range of its
text, for assistant turns only.

Defined results: null role or text is the empty string; unknown roles are
formatted and bear no loss; repeated turns are formatted one by one; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, SEP, FOOT = b"### ", b": ", b"</turn>\n"
LOSS_ROLE = "assistant"
_ESCAPED = {"text": b"\\#<", "role": b"\\#<:"}


def _segments(col: pa.Array, escaped: bytes):
    """(bytes back to back, row of each byte, lengths, escape flags, escaped lengths)."""
    col = pc.fill_null(col, "").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    table = np.zeros(256, bool)
    table[np.frombuffer(escaped, np.uint8)] = True
    flags = table[data]
    running = np.concatenate([[0], np.cumsum(flags)])
    extra = running[offsets[1:]] - running[offsets[:-1]]
    sizes = np.diff(offsets)
    return data, offsets, sizes, flags, running, sizes + extra


def _scatter(out: np.ndarray, base: np.ndarray, seg) -> None:
    """Copy each row's escaped bytes to ``out`` from ``base[row]`` on."""
    data, offsets, sizes, flags, running, _ = seg
    shift = base - offsets[:-1] - running[offsets[:-1]]
    dest = np.arange(len(data)) + running[1:] + np.repeat(shift, sizes)
    out[dest] = data
    out[dest[flags] - 1] = ord("\\")


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted turns as strings, start and end byte of each text inside)."""
    r, t = _segments(role, _ESCAPED["role"]), _segments(text, _ESCAPED["text"])
    n = len(role)
    start = len(HEAD) + r[-1] + len(SEP)
    sizes = start + t[-1] + len(FOOT)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(offsets[-1]), np.uint8)
    base = offsets[:-1]
    for piece, at in ((HEAD, base), (SEP, base + len(HEAD) + r[-1]), (FOOT, offsets[1:] - len(FOOT))):
        out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    _scatter(out, base + len(HEAD), r)
    _scatter(out, base + start, t)
    col = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    return col, start, start + t[-1]


def format_turns(turns: DataFrame, role: str = "role", text: str = "text", out: str = "formatted") -> DataFrame:
    """Every row with ``out``, ``loss_start`` and ``loss_end`` (bytes; equal: no loss).

    Row by row and without a shuffle: a conversation's formatted text is its
    rows' ``out`` in turn order.
    """
    added = (out, "loss_start", "loss_end")
    kept = [f for f in turns.schema.fields if f.name not in added]
    schema = T.StructType([*kept, T.StructField(out, T.StringType(), False), *(T.StructField(c, T.LongType(), False) for c in added[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, start, end = assemble(b.column(role), b.column(text))
            loss = pc.fill_null(pc.equal(b.column(role), LOSS_ROLE), False).to_numpy(zero_copy_only=False)
            spans = [pa.array(np.where(loss, x, 0), pa.int64()) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), made.cast(pa.string()), *spans], names=schema.names)

    return turns.mapInArrow(run, schema)


_UNESCAPE = re.compile(rb"\\(.)", re.S)
_ROLE = re.compile(rb"((?:[^\\:]|\\.)*): ", re.S)


def unescape(data: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", data) if b"\\" in data else data


def parse_turn(turn: bytes) -> tuple[bytes, bytes]:
    """(role, text) of one formatted turn."""
    if not (turn.startswith(HEAD) and turn.endswith(FOOT)):
        raise ValueError("not a formatted turn")
    m = _ROLE.match(turn, len(HEAD))
    if not m:
        raise ValueError("a formatted turn has no role")
    return unescape(m[1]), unescape(turn[m.end() : len(turn) - len(FOOT)])


def read_back(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn", out: str = "formatted") -> DataFrame:
    """Per conversation what its formatted turns say; nothing else is read.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.  Turns are sorted inside hash partitions and streamed
    through running digests, so a conversation of any length needs the memory
    of one batch.  Equal turn numbers are ordered by their formatted text.
    """
    rows = formatted.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(out).alias("made"), "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "made")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> tuple:
            n, said, chars, loss, total = state
            return now, n, said.hexdigest(), chars, loss.hexdigest(), total

        for b in batches:
            done = []
            made = b.column("made").cast(pa.binary()).to_pylist()
            chars = pc.utf8_length(b.column("made")).to_pylist()
            for key, data, size, lo, hi in zip(b.column("conv_id").to_pylist(), made, chars, b.column("loss_start").to_pylist(), b.column("loss_end").to_pylist(), strict=True):
                if state is None or key != now:
                    if state is not None:
                        done.append(row())
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(data)
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
                lost = unescape(data[lo:hi])
                state[2] += len(lost.decode())
                state[3].update(lost)
                state[4] += size
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), types, strict=True)], names)

    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
