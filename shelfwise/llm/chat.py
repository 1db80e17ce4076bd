"""Chat formatting by columnar byte assembly.

Every turn becomes one segment ``<|im_start|>role\\ntext<|im_end|>\\n``. The segments of a whole Arrow batch are put together at
once: their lengths and cumulative offsets say where every byte of the texts goes, and headers, texts and ends are scattered
into one preallocated buffer that is the Arrow column. Segments need no other turn, so a conversation of any length is
formatted by many tasks; its text is its segments in order.

Control strings inside texts are escaped: a ``<``, any number of backslashes and a ``|`` get one backslash more behind the
``<``. No escaped text holds ``<|``, and taking one backslash away gives the text back. In roles ``%``, ``<`` and line feeds are
percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.textbytes import Texts, chunks

START, END, LEARNED = "<|im_start|>", "<|im_end|>\n", "assistant"
_START, _END = START.encode(), END.encode()
_ESCAPED = re.compile(r"<\\(\\*\|)")
_LT, _BACK, _BAR = b"<\\|"

Batches = Iterator[pa.RecordBatch]


def insert_points(texts: Texts) -> np.ndarray:
    """Bytes before which the escape puts a backslash: those behind the ``<`` of every ``<``, backslashes, ``|``."""
    data = texts.data
    at = np.flatnonzero(data == _BAR)
    least = texts.offsets[np.searchsorted(texts.offsets, at, "right") - 1]
    found = []
    while len(at):
        inside = at > least
        at, least = at[inside] - 1, least[inside]
        found.append(at[data[at] == _LT] + 1)
        more = data[at] == _BACK
        at, least = at[more], least[more]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def role_header(role: str | None) -> bytes:
    """A role cannot hold a control string or end its line: ``%``, line feeds and ``<`` are percent-encoded."""
    return _START + (role or "").replace("%", "%25").replace("\n", "%0A").replace("<", "%3C").encode() + b"\n"


def assemble(texts: Texts, roles: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All segments of a chunk in one buffer, and their offsets."""
    points = insert_points(texts)
    before = np.searchsorted(points, texts.offsets)  # insertions ahead of each text
    headers = {r: np.frombuffer(role_header(r), np.uint8) for r in set(roles)}
    header_lengths = np.array([len(headers[r]) for r in roles], np.int64)
    lengths = header_lengths + np.diff(texts.offsets) + np.diff(before) + len(_END)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(int(offsets[-1]), np.uint8)

    content = offsets[:-1] + header_lengths
    target = np.arange(len(texts.data)) + np.repeat(content - texts.offsets[:-1], np.diff(texts.offsets))
    # Within its text, a byte moves on by one for every insertion up to it.
    moved = np.zeros(len(texts.data) + 1, np.int64)
    np.add.at(moved, points, 1)
    target += np.cumsum(moved)[:-1] - np.repeat(before[:-1], np.diff(texts.offsets))
    out[target] = texts.data
    out[target[points] - 1] = _BACK

    kinds = np.array([list(headers).index(r) for r in roles], np.int64)
    for k, header in enumerate(headers.values()):
        rows = offsets[:-1][kinds == k]
        out[rows[:, None] + np.arange(len(header))] = header
    out[(offsets[1:] - len(_END))[:, None] + np.arange(len(_END))] = np.frombuffer(_END, np.uint8)
    return out, offsets


def _format_batches(batches: Batches) -> Batches:
    for batch in batches:
        roles = batch.column("role").to_pylist()
        for part in chunks(batch.column("text")):
            rows = slice(part.first_row, part.first_row + len(part))
            out, offsets = assemble(part, roles[rows])
            segments = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets), pa.py_buffer(out))
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            learned = np.array([r == LEARNED for r in roles[rows]], bool)
            header = np.array([len(role_header(r).decode()) for r in roles[rows]], np.int64)
            inner = points[offsets[1:]] - points[offsets[:-1]] - header - len(END)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id")[rows],
                    batch.column("turn")[rows],
                    segments.cast(pa.string()),
                    pa.array(np.where(learned, header, 0), pa.int64()),
                    pa.array(np.where(learned, inner, 0), pa.int64()),
                ],
                names=["conv_id", "turn", "segment", "loss_start", "loss_length"],
            )


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, segment, loss_start, loss_length`` for every row of ``conv_id, turn, role, text``. No shuffle.

    The loss mask is a span of the segment, in code points: the text of an assistant turn, else nothing. A null text or role
    is empty; null ids and turns stay as they are; repeated rows give repeated segments. Other columns are not read.
    """
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    ).mapInArrow(_format_batches, "conv_id bigint, turn bigint, segment string, loss_start bigint, loss_length bigint")


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted``: the segments of each conversation in one text, which must fit in a value."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "segment")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["segment"]), "").alias("formatted"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(END, line + 1)
        role = formatted[at + len(START) : line].replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")
        turns.append((role, unescape(formatted[line + 1 : stop])))
        at = stop + len(END)
    return turns


def _read_batches(batches: Batches) -> Batches:
    """Digests of whole conversations from a stream of segments in order; a conversation may span batches."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    at, state = object(), None

    def close() -> None:
        if state:
            conv, n, turns, learned, loss, size = state
            done.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), size))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length"))):
            conv, segment, start, length = row
            if state is None or conv != at:
                close()
                at, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(segment):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            learned = unescape(segment[start : start + length])
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += len(segment)
        yield flush()
    close()
    yield flush()


def read_back(turns: DataFrame) -> DataFrame:
    """What the formatted turns hold, per conversation: number and digest of its turns, and of the text under its mask.

    Turns stand by number, ties by their segment; null numbers first, null ids together. The segments stream through in
    that order, so a conversation of any length needs no more memory than a batch.
    """
    return (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "segment")
        .mapInArrow(
            _read_batches,
            "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
        )
    )
