r"""Chat formatting by columnar byte assembly.

A turn is written as ``### role: text</turn>\n``. Inside role and text a
backslash is doubled, ``</turn>`` becomes ``<\/turn>`` and ``###`` becomes
``#\##``; in a role ``:`` becomes ``\:``. So the control strings never occur in
contents, and dropping each escaping backslash gives the contents back.

Assembly is columnar: the lengths of all segments (header, contents, footer) give
cumulative offsets, these give scatter indices, and every byte is copied once
into one preallocated buffer that becomes the Arrow column. Turns are grouped in
blocks of turn numbers, so a conversation of any length is made in parallel, and
a block in parts of bounded size, so that neither many nor very long turns are
held at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PART_SCHEMA = "conv_id long, block long, part int, n_turns long, text string, loss array<long>"
#: Bytes of roles and texts in a part; a longer turn is a part of its own. Parts are assembled several at once.
PART_BYTES, AT_ONCE = 8 << 20, 8


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    column = pc.fill_null(column, "")
    for plain, safe in (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("###", "#\\##"), *(((":", "\\:"),) if role else ())):
        column = pc.replace_substring(column, plain, safe)
    return column


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and n + 1 offsets of a large string array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def assemble(segments: list[pa.Array | bytes], rows: int) -> tuple[pa.Buffer, np.ndarray]:
    """One buffer with the segments of each row in turn, and the rows' offsets. Constant segments are bytes."""
    lengths = np.stack([np.full(rows, len(s)) if isinstance(s, bytes) else np.diff(_bytes(s)[1]) for s in segments], axis=1)
    at = np.concatenate(([0], np.cumsum(lengths.ravel())))
    buffer = pa.allocate_buffer(int(at[-1]))
    out = np.frombuffer(buffer, np.uint8)
    starts = at[:-1].reshape(rows, len(segments))
    for k, segment in enumerate(segments):
        if isinstance(segment, bytes):
            out[(starts[:, k][:, None] + np.arange(len(segment))).ravel()] = np.tile(np.frombuffer(segment, np.uint8), rows)
        else:
            data, offsets = _bytes(segment)
            shift = np.repeat(starts[:, k] - offsets[:-1], lengths[:, k])
            source = np.arange(offsets[0], offsets[-1])
            out[source + shift] = data[offsets[0] : offsets[-1]]
    return buffer, at[:: len(segments)]


def _format(table: pa.Table, first: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Parts of a table sorted by conversation, block and turn; first rows of the parts, and their numbers in their blocks."""
    n = table.num_rows
    conv, block = table.column("conv_id").combine_chunks(), table.column("block").combine_chunks()
    roles = escape(table.column("role").cast(pa.large_string()).combine_chunks(), role=True)
    texts = escape(table.column("text").cast(pa.large_string()).combine_chunks())
    buffer, offsets = assemble([OPEN.encode(), roles, MIDDLE.encode(), texts, CLOSE.encode()], n)
    last = np.append(first[1:], n)
    role_chars, text_chars = (pc.utf8_length(c).to_numpy().astype(np.int64) for c in (roles, texts))
    chars = role_chars + text_chars + len(OPEN) + len(MIDDLE) + len(CLOSE)
    before = np.concatenate(([0], np.cumsum(chars)))[:-1]
    before = before - np.repeat(before[first], last - first)
    begin = before + len(OPEN) + role_chars + len(MIDDLE)
    learnt = pc.fill_null(pc.equal(table.column("role").combine_chunks(), "assistant"), False).to_numpy(zero_copy_only=False)
    marks = np.stack([begin, begin + text_chars], axis=1)[learnt].ravel()
    ends = 2 * np.concatenate(([0], np.cumsum(learnt)))[np.append(first, n)]
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets[np.append(first, n)].astype(np.int32)), buffer)
    loss = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(marks))
    take = pa.array(first)
    return pa.RecordBatch.from_arrays([conv.take(take), block.take(take), pa.array(part, pa.int32()), pa.array(last - first), text, loss], ["conv_id", "block", "part", "n_turns", "text", "loss"])


def _sizes(table: pa.Table) -> np.ndarray:
    return sum(pc.fill_null(pc.binary_length(table.column(c)), 0).to_numpy().astype(np.int64) for c in ("role", "text"))


def _breaks(table: pa.Table, sizes: np.ndarray, part: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the parts and their numbers; the first part has number ``part`` in its block."""
    key = [table.column(c).to_numpy() for c in ("conv_key", "block")]
    new = np.concatenate(([True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])))
    first, number, held = [], [], 0
    for i, (fresh, size) in enumerate(zip(new.tolist(), sizes.tolist(), strict=True)):
        if fresh or held + size > most:
            number.append(part if not i else 0 if fresh else number[-1] + 1)
            first.append(i)
            held = 0
        held += size
    return np.array(first), np.array(number)


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The last part of a batch waits for the next, where it may go on."""
    held, number = None, 0
    for batch in chain(batches, (None,)):
        if batch is not None:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
        if held is None:
            return
        sizes = _sizes(held)
        first, part = _breaks(held, sizes, number, most)
        done = len(first) - 1 if batch is not None else len(first)
        ends, upto, lo = np.append(first[1:], held.num_rows), np.concatenate(([0], np.cumsum(sizes))), 0
        while lo < done:
            hi = max(lo + 1, min(done, int(np.searchsorted(upto[ends], upto[first[lo]] + AT_ONCE * most, "right"))))
            yield _format(held.slice(first[lo], ends[hi - 1] - first[lo]), first[lo:hi] - first[lo], part[lo:hi])
            lo = hi
        if batch is not None:
            held, number = held.slice(first[-1]), int(part[-1])


def format_chats(turns: DataFrame, block: int = 1024, part_bytes: int = PART_BYTES) -> DataFrame:
    """Formatted parts of all conversations: conv_id, block, part, n_turns, text, loss.

    ``turns`` has conv_id, turn, role and text; rows go by turn (null first), ties
    by role and text. Null role or text counts as empty, null conv_id as a
    conversation of its own. A block holds the turns whose number divided by
    ``block`` is the same (turns without a number come first), in parts of
    about ``part_bytes``; parts by block and part number make up the conversation.
    loss has starts and ends (code points of the part) of assistant texts. Repeated
    rows are kept, other columns are ignored, an empty table gives no parts.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_key"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long").alias("block"), "turn", F.col("role").cast("string"), F.col("text").cast("string"),
    )
    dealt = rows.repartition("conv_key", "block").sortWithinPartitions("conv_key", "block", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(lambda batches: _parts(batches, part_bytes), PART_SCHEMA)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part; fails unless the part is made of whole turns."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def chat_digests(parts: DataFrame) -> DataFrame:
    """What the formatted parts hold, read back from them: one row a conversation.

    A digest needs its conversation's parts in turn, so they stream through one
    task; it holds one part and a hash state at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done = []
            for conv, n_turns, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "text", "loss")), strict=True):
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(text)
                if len(turns) != n_turns:
                    raise ValueError(f"conversation {conv}: {len(turns)} turns read, {n_turns} written")
                now[1] += len(turns)
                now[2].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                for start, end in zip(loss[::2], loss[1::2], strict=True):
                    plain = unescape(text[start:end])
                    now[3] += len(plain)
                    now[4].update(plain.encode())
                now[5] += len(text)
            if done:
                yield _rows(done)
        if now:
            yield _rows([now])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return parts.repartition(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).sortWithinPartitions("conv_id", "block", "part").mapInArrow(run, schema)


def _rows(done: list[list]) -> pa.RecordBatch:
    columns = [[d[0] for d in done], [d[1] for d in done], [d[2].hexdigest() for d in done], [d[3] for d in done], [d[4].hexdigest() for d in done], [d[5] for d in done]]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
