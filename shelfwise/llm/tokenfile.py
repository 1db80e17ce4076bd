"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A text is encoded piece by piece, a piece being white space and what follows it up to the next white space. No token of the
vocabulary's split pattern reaches across the start of white space, so the ids of the pieces are the ids of the text, and
every distinct piece has to go through the tokenizer only once per task.

A token table is a folder of shards. Each row of it is a block: the documents of consecutive ids, their token counts, one
control byte for four ids (two bits each: bytes of the id less one) and the bytes of the ids, low byte first. Ids are ranks by
frequency in the corpus, so most take one byte; the ranks' meaning lies in a table beside the blocks.
"""

from __future__ import annotations

import contextlib
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.textbytes import Texts, as_bytes, chunks, mix
from shelfwise.sources.storage import write_once

END_ID = 0
#: Bytes of text that are encoded together; a longer text is encoded alone. Small, so that the work stays in the processor's cache.
_ENCODE_BYTES = 1 << 18
#: Bytes of rows that are handed to a worker at once, where the engine's limit is higher.
_BATCH_BYTES = 4 << 20
#: Distinct short pieces after which a worker begins a new memo, about 40 bytes each. It keeps the one before, no older ones.
_MEMO_PIECES = 500_000
#: Places of the memo's table where a piece may stand, in a row.
_PROBES = 24
_BLOCK_TOKENS = 1 << 18

_ascii_space = np.zeros(256, bool)
_ascii_space[[0x20, *range(0x09, 0x0E)]] = True
#: Pieces that go through the tokenizer as one text, and bytes of a short piece.
_JOINED, SHORT = 200, 15

#: Ids take two bytes each if all of the vocabulary do, else four. A task ends with a row that only tells how often each id occurred.
_ENCODED = "doc_id bigint, start bigint, n_tokens bigint, ids binary, counts binary"
_BLOCKS = (
    "start bigint, doc_ids array<bigint>, lengths array<bigint>, n_values bigint, control binary, data binary, shard int"
)
_DECODED = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _behind_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places stand behind a white space character of Unicode that is not ASCII (fixed values: their bytes)."""
    behind = np.zeros(len(at), bool)
    odd = np.flatnonzero((data[at - 1] >= 0x80) & (data[at - 1] <= 0xAF))
    last, two, three = (data[np.maximum(at[odd] - k, 0)] for k in (1, 2, 3))
    wide = (two == 0xC2) & ((last == 0x85) | (last == 0xA0))
    wide |= (three == 0xE1) & (two == 0x9A) & (last == 0x80)
    wide |= (three == 0xE2) & ((two == 0x80) | (two == 0x81))
    wide |= (three == 0xE3) & (two == 0x80) & (last == 0x80)
    behind[odd] = wide
    return behind


def piece_starts(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of all texts begin, and the index of each text's first piece (one more entry than texts).

    A text is cut before every run of ASCII white space, but not behind other white space of Unicode, which the
    pattern would take as one run with it.
    """
    data, offsets = texts.data, texts.offsets
    space = _ascii_space[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    cut[at[_behind_wide_space(data, at)]] = False
    begins = offsets[:-1][np.diff(offsets) > 0]
    cut[begins] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of the spans, one span after the other."""
    upto = np.cumsum(lengths)
    return np.repeat(starts - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)


#: Masks that leave the first n bytes of eight.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def short_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes and, in the last one, the length of each piece of at most ``SHORT`` bytes, as two integers: they tell it exactly."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    keys = np.empty((len(starts), 2), np.uint64)
    keys[:, 0] = eight[starts] & _FIRST_BYTES[np.minimum(lengths, 8)]
    keys[:, 1] = eight[starts + 8] & _FIRST_BYTES[np.maximum(lengths - 8, 0)]
    keys[:, 1] |= lengths.astype(np.uint64) << np.uint64(56)
    return keys


def piece_hashes(keys: np.ndarray) -> np.ndarray:
    return mix(mix(keys[:, 0]) + keys[:, 1])


def distinct_keys(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one of each distinct key, and for every key the number of its kind."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if (keys != keys[first][inverse]).any():
        _, first, inverse = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def _grown(held: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` rows, or for half as many again as it has."""
    room = np.empty((max(size, len(held) * 3 // 2), *held.shape[1:]), held.dtype)
    room[: len(held)] = held
    return room


class PieceMemo:
    """Ids of short pieces, found by key in a hash table with linear probing.

    Keys are compared, so pieces that share a hash only lie further from their place; one that finds no place within ``_PROBES`` is
    not remembered.
    """

    def __init__(self, kind: type):
        self._bits = max(2 * _MEMO_PIECES, 64).bit_length()
        self._table = np.zeros(1 << self._bits, np.int32)  # number of a piece plus one; 0 where free
        self._keys = np.empty((1024, 2), np.uint64)
        self._begins = np.empty(1024, np.int64)
        self._counts = np.empty(1024, np.int32)
        self.ids = np.empty(4096, kind)
        self.size = self.used = 0

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it is not known."""
        at, found, todo = self._places(hashes), None, None
        for _ in range(_PROBES):
            number = self._table[at] - 1
            same = self._keys[number] == (keys if todo is None else keys[todo])
            same = same[:, 0] & same[:, 1] & (number >= 0)
            if found is None:
                found = np.where(same, number, -1)
                todo = np.flatnonzero((number >= 0) & ~same)
                at = at[todo]
            else:
                found[todo[same]] = number[same]
                left = (number >= 0) & ~same
                todo, at = todo[left], at[left]
            if not len(todo):
                break
            at = (at + 1) & (len(self._table) - 1)
        return found

    def put(self, ids: np.ndarray) -> int:
        """Lay ids behind those remembered, until the next call, and tell where they begin."""
        if self.used + len(ids) > len(self.ids):
            self.ids = _grown(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        return self.used

    def learn(self, keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Remember new distinct pieces and return their numbers."""
        first, size = self.size, self.size + len(keys)
        if size > len(self._begins):
            self._keys, self._begins, self._counts = (_grown(x, size) for x in (self._keys, self._begins, self._counts))
        self._keys[first:size] = keys
        self._begins[first:size] = self.put(ids) + np.cumsum(counts) - counts
        self._counts[first:size] = counts
        self.size, self.used = size, self.used + len(ids)
        todo, at = np.arange(first, size), self._places(hashes)
        for _ in range(_PROBES):
            free = self._table[at] == 0
            self._table[at[free]] = todo[free] + 1  # of several for one place the last gets it
            left = self._table[at] != todo + 1
            todo, at = todo[left], (at[left] + 1) & (len(self._table) - 1)
            if not len(todo):
                break
        return np.arange(first, size)

    def spans(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these pieces begin among ``ids``, and how many there are."""
        return self._begins[numbers], self._counts[numbers]


class PieceEncoder:
    """Encodes texts with a tokenizer, remembering the ids of distinct pieces.

    Short pieces are looked up by their key. Longer pieces are told apart by their bytes, and not remembered beyond the chunk.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # How many bytes of text an id stands for: a character of a byte-level token is a byte, an added token is spelled out.
        added = self.tokenizer.get_added_tokens_decoder()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.encode()) if i in added else len(token)
        self.kind = np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32
        self.memo, self.earlier = PieceMemo(self.kind), PieceMemo(self.kind)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, and how many each has.

        Inner pieces begin with white space and do not end with it, so many go through the tokenizer as one text; the ids'
        lengths in bytes tell where each ends. Should they not meet the ends, and else, pieces go one by one.
        """
        ends = starts + lengths
        inner = _ascii_space[data[starts]] & ~_ascii_space[data[ends - 1]] & ~_behind_wide_space(data, ends)
        counts = np.zeros(len(starts), np.int64)
        parts, order = [], []
        for group, joined in ((np.flatnonzero(inner), True), (np.flatnonzero(~inner), False)):
            if not len(group):
                continue
            raw = data[_spans(starts[group], lengths[group])].tobytes()
            upto = np.concatenate([[0], np.cumsum(lengths[group])])
            if joined:
                edges = upto[np.append(np.arange(0, len(group), _JOINED), len(group))].tolist()
                ids = np.concatenate(self._encode([raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:])]))
                reach = np.cumsum(self.bytes_of[ids])
                last = np.minimum(np.searchsorted(reach, upto[1:]), len(ids) - 1)
                joined = reach[-1] == upto[-1] and (reach[last] == upto[1:]).all()
                counts[group] = np.diff(last, prepend=-1)
            if not joined:
                edges = upto.tolist()
                each = self._encode([raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:])])
                ids = np.concatenate(each)
                counts[group] = [len(x) for x in each]
            parts.append(ids)
            order.append(group)
        # Back into the order of the pieces.
        ids, order = np.concatenate(parts), np.concatenate(order)
        begins = np.empty(len(starts), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return ids[_spans(begins, counts)], counts

    def _short(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each short piece begin in the memo, and how many there are."""
        if self.memo.size >= _MEMO_PIECES:
            self.memo, self.earlier = PieceMemo(self.kind), self.memo
        keys = short_keys(data, starts, lengths)
        hashes = piece_hashes(keys)
        numbers = self.memo.find(keys, hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            first, inverse = distinct_keys(keys[missing], hashes[missing])
            new = missing[first]
            before = self.earlier.find(keys[new], hashes[new])
            learnt = np.empty(len(new), np.int64)
            for group, known in ((np.flatnonzero(before >= 0), True), (np.flatnonzero(before < 0), False)):
                if not len(group):
                    continue
                if known:
                    begins, counts = self.earlier.spans(before[group])
                    ids = self.earlier.ids[_spans(begins, counts)]
                else:
                    ids, counts = self._encode_pieces(data, starts[new[group]], lengths[new[group]])
                learnt[group] = self.memo.learn(keys[new[group]], hashes[new[group]], ids, counts)
            numbers[missing] = learnt[inverse]
        return self.memo.spans(numbers)

    def _long(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct long pieces, and for each piece where its ids begin there and how many there are."""
        raw = data.tobytes()
        number: dict[bytes, int] = {}
        which = [number.setdefault(raw[a : a + n], len(number)) for a, n in zip(starts.tolist(), lengths.tolist())]
        _, first = np.unique(which, return_index=True)
        ids, counts = self._encode_pieces(data, starts[first], lengths[first])
        return ids, (np.cumsum(counts) - counts)[which], counts[which]

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk and where the ids of each text begin (one more entry than texts)."""
        data = texts.data
        starts, bounds = piece_starts(texts)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        lengths = np.diff(np.append(starts, len(data)))
        short = lengths <= SHORT
        begins, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begins[short], counts[short] = self._short(data, starts[short], lengths[short])
        if not short.all():
            ids, at, counts[~short] = self._long(data, starts[~short], lengths[~short])
            begins[~short] = at + self.memo.put(ids)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return self.memo.ids[_spans(begins, counts)], upto[bounds]


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(tokenizer_file: str) -> PieceEncoder:
    """One encoder per worker process, so that later tasks know the pieces of earlier ones."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = PieceEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(extra.astype(np.int64) + 1)
    begins = ends - extra - 1
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        longer = extra >= k
        out[begins[longer] + k] = (ranks[longer] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), out.tobytes()


#: Bytes taken by each of the four values of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values that ``pack`` has coded: lengths come from a table by control byte, bytes from where they point."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    raw = np.frombuffer(data, np.uint8)
    begins = np.cumsum(lengths) - lengths
    values = raw[begins].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        values[longer] |= raw[begins[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def _encode_batches(tokenizer_file: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, counted = 0, np.zeros(0, np.int64)
        for batch in batches:
            encoder = _encoder(tokenizer_file)
            kind = encoder.kind if end_id < 1 << 16 else np.uint32
            text = batch.column("text")
            for part in chunks(text, _ENCODE_BYTES):
                ids, bounds = encoder(part)
                # One more id at the end of every document.
                lengths = np.diff(bounds) + 1
                upto = np.concatenate([[0], np.cumsum(lengths)])
                whole = np.full(int(upto[-1]), end_id, kind)
                mask = np.ones(len(whole), bool)
                mask[upto[1:] - 1] = False
                whole[mask] = ids
                held = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(part), [None, pa.py_buffer((upto * whole.itemsize).astype(np.int64)), pa.py_buffer(whole)]
                )
                rows = slice(part.first_row, part.first_row + len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[rows],
                        pa.array(start + upto[:-1], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        held.cast(pa.binary()),
                        pa.nulls(len(part), pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids", "counts"],
                )
                start += int(upto[-1])
                counted = _added(counted, np.bincount(whole))
        none = [pa.array([None], kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array([counted.astype("<i8").tobytes()], pa.binary())],
            names=["doc_id", "start", "n_tokens", "ids", "counts"],
        )

    return run


def _added(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sum of two tables of counts, the shorter one ending in zeros. It takes the place of the longer one."""
    longer, shorter = (one, other) if len(one) >= len(other) else (other, one)
    longer[: len(shorter)] += shorter
    return longer


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every id, from the rows in which the encoding tasks have counted them."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for held in batch.column("counts").to_pylist():
            total = _added(total, np.frombuffer(held, "<i8").copy())
    present = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(present, pa.int64()), pa.array(total[present])], ["id", "n"])


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block_batches(rank_of: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block holds documents that follow each other in a shard, up to ``_BLOCK_TOKENS`` ids or one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("ids"))
            starts, lengths, shards = (np.asarray(batch.column(c)) for c in ("start", "n_tokens", "shard"))
            width = int(offsets[-1] - offsets[0]) // max(int(lengths.sum()), 1) or 4  # bytes of an id
            places = (offsets - offsets[0]) // width
            ids = data[offsets[0] : offsets[-1]].view(f"<u{width}")
            breaks = (starts[1:] != starts[:-1] + lengths[:-1]) | (shards[1:] != shards[:-1])
            runs = np.append(np.flatnonzero(breaks) + 1, batch.num_rows)
            row = 0
            while row < batch.num_rows:
                stop = int(np.searchsorted(places, places[row] + _BLOCK_TOKENS, "right")) - 1
                stop = min(max(stop, row + 1), int(runs[np.searchsorted(runs, row, "right")]))
                values = rank_of[ids[places[row] : places[stop]]]
                control, packed = pack(values)
                yield pa.RecordBatch.from_pydict(
                    {
                        "start": pa.array([starts[row]], pa.int64()),
                        "doc_ids": _one_list(batch.column("doc_id")[row:stop]),
                        "lengths": _one_list(batch.column("n_tokens")[row:stop]),
                        "n_values": pa.array([len(values)], pa.int64()),
                        "control": pa.array([control], pa.binary()),
                        "data": pa.array([packed], pa.binary()),
                        "shard": pa.array([shards[row]], pa.int32()),
                    }
                )
                row = stop

    return run


def _decode_batches(id_of: np.ndarray, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = lambda name: batch.column(name)[row]  # noqa: B023, E731
                ids = id_of[unpack(one("control").as_py(), one("data").as_py(), one("n_values").as_py())]
                lengths = np.array(one("lengths").values, np.int64)
                upto = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4")).cast("B")
                pieces = [raw[4 * a : 4 * b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                columns = {
                    "doc_id": one("doc_ids").values,
                    "start": pa.array(upto[:-1] + one("start").as_py(), pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in pieces], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, workers get rows in batches of about ``most`` bytes: rows are bounded by number alone else, whatever their size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = END_ID) -> None:
    """Encode all texts and write them as token blocks to ``folder/blocks``, the vocabulary's ranks to ``folder/ranks``.

    Documents stand in ascending order of doc_id, null first, repeated ids in any order. A null text is empty and gives the
    end id alone, as does an empty one. Only ``doc_id`` (integer) and ``text`` are read. The tokenizer runs once over the
    corpus: its ids are written in order first, counted, and then coded by rank. The counts that come back to the
    driver are one row per id of the vocabulary.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    with small_batches(spark, _BATCH_BYTES):
        encoded = write_once(
            docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
            .repartitionByRange("doc_id", tie)
            .sortWithinPartitions("doc_id", tie)
            .mapInArrow(_encode_batches(tokenizer_file, end_id), _ENCODED)
            .withColumn("shard", F.spark_partition_id()),
            "token-ids",
            compression="zstd",
        )
    counted = encoded.select("counts").filter("counts is not null").mapInArrow(_count_batches, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = sorted((-r["n"], r["id"]) for r in counted.collect())
    id_of = np.array([i for _, i in counts] or [end_id], np.uint32)
    rank_of = np.zeros(int(id_of.max()) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    ranks = [(rank, i, -n) for rank, (n, i) in enumerate(counts)]
    spark.createDataFrame(ranks, "rank bigint, id bigint, n bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    held = encoded.filter("counts is null").drop("counts")
    with small_batches(spark, _BATCH_BYTES):
        (
            held.mapInArrow(_block_batches(rank_of), _BLOCKS)
            .sortWithinPartitions("shard", "start")
            .write.partitionBy("shard")
            .option("compression", "zstd")
            .parquet(f"{folder}/blocks")
        )


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token folder: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before: blocks know their place in the shard, and the shards' lengths (one row
    per shard) are added up.
    """
    ranks = spark.read.schema("rank bigint, id bigint, n bigint").parquet(f"{folder}/ranks").select("rank", "id")
    id_of = np.array([i for _, i in sorted(ranks.collect())] or [END_ID], np.uint32)  # one row per id of the vocabulary
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    earlier = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        blocks.groupBy(F.col("shard").alias("_shard"))
        .agg(F.sum("n_values").alias("_n"))
        .select("_shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        blocks.join(F.broadcast(shards), F.col("shard") == F.col("_shard"))  # one small row per shard
        .withColumn("start", F.col("start") + F.col("_before"))
        .select("start", "doc_ids", "lengths", "n_values", "control", "data")
        .mapInArrow(_decode_batches(id_of, with_ids), _DECODED + (", ids array<bigint>" if with_ids else ""))
    )
