"""Chat formatting by columnar byte assembly.

Template, per turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles every ``<``, any
backslashes and ``|`` in a row get one more backslash, so no control string can appear; reading takes it
away again. A role's own backslashes and line ends are written as ``\\\\`` and ``\\n``. The loss mask lists
the byte ranges of the assistants' texts.

Assembly: an Arrow batch of turns is formatted as columns. Segment lengths (header, text, footer of each
turn) give cumulative offsets; scatter indices copy all headers and contents into one preallocated
buffer, which becomes the Arrow column of formatted parts without another copy.

Rows are range-partitioned by conversation and turn, so a conversation that holds a third of all rows
spreads over tasks. A formatted row is a part of a conversation: whole turns, at most about ``PART`` bytes
or one turn; ``part`` orders the parts. ``read_back`` parses parts in that order with a running hash, so
no conversation is ever held as a whole.

Turns are ordered by turn (null first), role, the text's first ``TIE`` code points, then the md5 of the text. Rows are
dealt out and sorted by that same order, with a number behind it that lets equal rows, which stay in a row, spread
over tasks too. Null texts and roles are empty strings. A null conversation id is a conversation like any other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm.common import small_batches

# fixed values: the template
START, END, TRAINED = "<|im_start|>", "<|im_end|>\n", "assistant"
PART = 1 << 20
TIE = 64
_LONG = 1 << 16


def escape(a: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(a, r"<(\\*)\|", r"<\1\\|")


def escape_role(a: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(a, "\\", "\\\\"), "\n", "\\n"))


def unescape(s: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", s)


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string array without nulls."""
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), off


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy the segments ``data[start:start + length]`` to ``out[to:to + length]``."""
    for i in np.flatnonzero(length >= _LONG):          # an index per byte would cost more than the text
        out[to[i]:to[i] + length[i]] = data[start[i]:start[i] + length[i]]
    some = length < _LONG
    to, start, length = to[some], start[some], length[some]
    if length.sum():
        first = np.cumsum(length) - length
        step = np.arange(length.sum()) - np.repeat(first, length)
        out[np.repeat(to, length) + step] = data[np.repeat(start, length) + step]


def assemble(roles: pa.Array, texts: pa.Array, breaks: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Format turns; ``breaks``: the turns at which a formatted part begins. Returns the parts, and where
    each turn's text starts and ends in the bytes of all parts."""
    n = len(roles)
    kinds = roles.dictionary_encode()
    heads, head_off = _bytes(pc.binary_join_element_wise(pa.scalar(START), escape_role(kinds.dictionary), pa.scalar("\n"), ""))
    kind = kinds.indices.to_numpy(zero_copy_only=False)
    data, text_off = _bytes(escape(texts))
    foot = np.frombuffer(END.encode(), np.uint8)
    length = np.empty((n, 3), np.int64)
    length[:, 0] = (head_off[1:] - head_off[:-1])[kind]
    length[:, 1] = text_off[1:] - text_off[:-1]
    length[:, 2] = len(foot)
    ends = np.cumsum(length.ravel())
    begin = (ends - length.ravel()).reshape(n, 3)
    buffer = pa.allocate_buffer(int(ends[-1]), resizable=False)
    out = np.frombuffer(buffer, np.uint8)
    scatter(out, begin[:, 0], heads, head_off[:-1][kind], length[:, 0])
    scatter(out, begin[:, 1], data, text_off[:-1], length[:, 1])
    scatter(out, begin[:, 2], foot, np.zeros(n, np.int64), length[:, 2])
    offsets = np.append(begin[breaks, 0], ends[-1])
    parts = pa.Array.from_buffers(pa.large_binary(), len(breaks), [None, pa.py_buffer(offsets.tobytes()), buffer])
    return parts, begin[:, 1], begin[:, 2]


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """(conv, part, n_turns, formatted binary, loss array of byte ranges): one row per part."""
    src = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                      F.coalesce(text_col, F.lit("")).alias("text"))
    order = ["conv", "turn", "role", "head", "digest", "number"]
    src = src.withColumns({"head": F.substring("text", 1, TIE), "digest": F.md5("text"), "number": F.monotonically_increasing_id()})
    small_batches(rows.sparkSession)
    src = src.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32          # range partitions are in order
        for b in batches:
            if not b.num_rows:
                continue
            conv, roles, texts = b.column("conv"), b.column("role"), b.column("text")
            size = np.cumsum(np.asarray(pc.binary_length(texts).cast(pa.int64())) + 64)
            same = pc.fill_null(pc.equal(conv[1:], conv[:-1]), False).to_numpy(zero_copy_only=False)
            both_null = pc.and_(pc.is_null(conv[1:]), pc.is_null(conv[:-1])).to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], ~(same | both_null)))
            breaks, last = [], 0
            for i in range(b.num_rows):
                if new[i] or size[i] - last > PART:
                    breaks.append(i)
                    last = size[i - 1] if i else 0
            breaks = np.array(breaks)
            done, lo, hi = assemble(roles, texts, breaks)
            ends = np.append(breaks[1:], b.num_rows)
            trained = pc.equal(roles, TRAINED).to_numpy(zero_copy_only=False)
            starts = np.frombuffer(done.buffers()[1], np.int64)[:-1]
            own = np.repeat(starts, ends - breaks)
            loss_lo, loss_hi = (lo - own)[trained], (hi - own)[trained]
            per = np.add.reduceat(trained.astype(np.int64), breaks)
            pairs = pa.StructArray.from_arrays([pa.array(loss_lo), pa.array(loss_hi)], names=["lo", "hi"])
            loss = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pairs)
            yield pa.record_batch([conv.take(pa.array(breaks)), pa.array(part + np.arange(len(breaks))), pa.array(ends - breaks),
                                   done.cast(pa.binary()), loss], names=["conv", "part", "n_turns", "formatted", "loss"])
            part += len(breaks)

    kind = src.schema["conv"].dataType.simpleString()
    return src.mapInArrow(run, f"conv {kind}, part long, n_turns long, formatted binary, loss array<struct<lo:long,hi:long>>")


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn of a part, unescaped."""
    out = []
    for turn in formatted.decode().split(START)[1:]:
        role, _, text = turn.partition("\n")
        if not text.endswith(END):
            raise ValueError("a turn without its end")
        out.append((unescape_role(role), unescape(text[:-len(END)])))
    return out


def read_back(parts: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation, from the
    formatted bytes and the loss mask alone."""
    small_batches(parts.sparkSession)
    src = parts.repartition("conv").sortWithinPartitions("conv", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, have = None, None, False

        def result():
            n, turns, chars, loss, size = state
            return pa.record_batch([pa.array([key], kind), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([chars]),
                                    pa.array([loss.hexdigest()]), pa.array([size])],
                                   names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kind = None
        for b in batches:
            kind, ready = b.schema.field("conv").type, []
            for conv, data, loss in zip(*(b.column(c).to_pylist() for c in ("conv", "formatted", "loss"))):
                if not have or conv != key:
                    if have:
                        ready.append(result())
                    state, key, have = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv, True
                for role, text in parse(data):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(data[span["lo"]:span["hi"]].decode())
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(data.decode())
            if ready:
                yield pa.concat_batches(ready)
        if have:
            yield result()

    kind = src.schema["conv"].dataType.simpleString()
    return src.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
