"""Document fingerprints by a randomised edit embedding, whose Hamming distance follows the edit distance of the texts.

All texts walk over their characters with the same random bits: at step j a walk writes down the character it stands on, and
moves on if the bit of (j, character) is one. After an insertion or deletion two walks fall in step again, so similar texts
write down the same characters at most places. The bits repeat after ``_PERIOD`` steps, so a table tells how long a walk that
comes to a character at step j stays there, and many texts walk together, one character at a time.

A fingerprint samples the embedding. At level L the steps are cut into blocks of 2**L, of which each gives one step; the choice
of level L + 1 is one of the two choices of level L in it, so fingerprints of neighbouring levels can still be compared. A text
of n characters takes about 2 n steps, and its level leaves 256 to 511 of them, each with four bits of its character. Near
documents are found by bands of sampled steps and verified on the whole fingerprints.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.neardup import components
from shelfwise.llm.textbytes import mix
from shelfwise.sources.storage import write_once

#: Sampled steps of a long text, at least; twice as many less one at most, give or take the walk's luck.
SAMPLES = 256
#: Agreement of two fingerprints, in hundredths, from which documents are near.
PERCENT = 80
#: Bands of a fingerprint and the sampled steps in each.
BANDS, BAND_STEPS = 8, 6
#: Fingerprints with fewer sampled steps are near only if they are equal.
_LEAST_STEPS = 16

_CLASSES, _PERIOD = 256, 4096
#: Characters that walk together, and the length beyond which a text walks alone, in blocks of as many characters.
_CHUNK_CHARS, _LONG = 1 << 22, 1 << 20
#: Texts that are too few to walk together.
_FEW = 24
#: Members of a bucket that are compared with each other in one task, about.
_PER_BLOCK = 512
_U = np.uint64

Batches = Iterator[pa.RecordBatch]

_PRINTED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, part int, role int, text string"
)
#: What a row of the first pass is: a document with its successor, the last or the first document of a partition.
_WHOLE, _LAST, _FIRST = 0, 1, 2


@functools.cache
def _stays() -> np.ndarray:
    """Steps a walk spends on a character of each class when it comes to it at each step of the period."""
    bits = mix(np.arange(1, _CLASSES * _PERIOD + 1, dtype=_U)).reshape(_CLASSES, _PERIOD) >> _U(63)
    twice = np.concatenate([bits, bits], axis=1).astype(bool)
    far = np.where(twice, np.arange(2 * _PERIOD), 2 * _PERIOD)
    leaves = np.minimum.accumulate(far[:, ::-1], axis=1)[:, ::-1][:, :_PERIOD]
    return (leaves - np.arange(_PERIOD) + 1).astype(np.uint8).ravel()


@functools.cache
def _stays_bytes() -> bytes:
    return _stays().tobytes()


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class (for the walk) and four bits (for the fingerprint) of every character of the joined texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    hashed = mix(points.astype(_U) + _U(0x51ED270B))
    return (hashed & _U(_CLASSES - 1)).astype(np.int32), (hashed >> _U(60)).astype(np.uint8)


def _walk_alone(classes: np.ndarray, step: int) -> tuple[np.ndarray, int]:
    """The step at which a walk comes to each character, and the one at which it leaves the last."""
    stays, come, last = _stays_bytes(), [], _PERIOD - 1
    note = come.append
    for c in (classes << 12).tolist():
        note(step)
        step += stays[c | step & last]
    return np.array(come, np.int64), step


def _walk(classes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walks over several spans of the characters: the step at which each character of each span, one after the other, is
    reached, and the step at which each span is left."""
    stays = _stays()
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    come = np.empty(int(offsets[-1]), np.int64)
    order = np.argsort(-lengths, kind="stable")
    longest_first = lengths[order]
    source, target, now = begins[order], offsets[:-1][order], steps[order].astype(np.int64)
    together = int(longest_first[_FEW - 1]) if len(order) >= _FEW else 0
    going = np.searchsorted(-longest_first, -np.arange(together), "left")
    for i, k in enumerate(going.tolist()):
        at = now[:k]
        come[target[:k] + i] = at
        at += stays[classes[source[:k] + i] << 12 | (at & (_PERIOD - 1))]
    for j in range(len(order)):
        rest = int(longest_first[j]) - together
        if rest <= 0:
            break
        first = int(source[j]) + together
        places, now[j] = _walk_alone(classes[first : first + rest], int(now[j]))
        come[target[j] + together : target[j] + together + rest] = places
    left = np.empty(len(order), np.int64)
    left[order] = now
    return come, left


def level_of(n_chars: int) -> int:
    """The level that leaves ``SAMPLES`` steps or more, but less than twice as many, of a walk over ``n_chars`` characters."""
    return max(0, (2 * n_chars // SAMPLES).bit_length() - 1)


@functools.lru_cache(256)
def _sampled(level: int, blocks: int) -> np.ndarray:
    """The step that each of the first blocks of a level gives."""
    at = np.arange(blocks, dtype=_U)
    for below in range(level - 1, -1, -1):
        at = (at << _U(1)) | (mix(at + _U((below + 1) << 48)) & _U(1))
    return at.astype(np.int64)


def sampled_steps(level: int, end: int) -> np.ndarray:
    """The sampled steps of a level before step ``end``, ascending."""
    size = 64  # a power of two, so that few lists are kept
    while (size << level) < end:
        size *= 2
    steps = _sampled(level, size)
    return steps[: np.searchsorted(steps, end)]


def _digits(nibbles: np.ndarray) -> str:
    return np.frombuffer(b"0123456789abcdef", np.uint8)[nibbles].tobytes().decode()


def _spell(level: int, nibbles: np.ndarray) -> str:
    return f"{level:02x}{_digits(nibbles)}"


def _read(print_: str) -> tuple[int, np.ndarray]:
    """Level and four-bit values of a fingerprint."""
    raw = np.frombuffer(print_.encode(), np.uint8)
    return int(print_[:2], 16), np.where(raw < 97, raw - 48, raw - 87)[2:]


@functools.lru_cache(1024)
def _which(level: int, coarser: int, count: int) -> np.ndarray:
    """Of the first ``count`` sampled steps of a level, the places of those that the coarser level samples too."""
    if level == coarser:
        return np.arange(count)
    steps = _sampled(level, 1 << max(count - 1, 1).bit_length())[:count]
    return np.flatnonzero(np.isin(steps, _sampled(coarser, (count >> (coarser - level)) + 2)))


def likeness(a: str, b: str) -> float:
    """Share of the sampled steps at which two fingerprints hold the same character; steps after a walk's end agree with none."""
    if a == b:
        return 1.0
    (level_a, one), (level_b, two) = _read(a), _read(b)
    coarser = max(level_a, level_b)
    one = one[_which(level_a, coarser, len(one))]
    two = two[_which(level_b, coarser, len(two))]
    both = min(len(one), len(two))
    most = max(len(one), len(two))
    return float((one[:both] == two[:both]).sum() / most) if most else 1.0


def _print_long(text: str) -> str:
    """Fingerprint of a long text, walked block by block."""
    level = level_of(len(text))
    step, held = 0, []
    for begin in range(0, len(text), _LONG):
        classes, nibbles = _characters([text[begin : begin + _LONG]])
        come, left = _walk_alone(classes, step)
        wanted = sampled_steps(level, left)
        wanted = wanted[np.searchsorted(wanted, step) :]
        held.append(nibbles[np.searchsorted(come, wanted, "right") - 1])
        step = left
    return _spell(level, np.concatenate(held))


class _Texts:
    """Texts that have walked together, and their fingerprints. Of a long text only a beginning walks with the others."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        begun = [t[:_LONG] for t in texts]
        self.lengths = np.array([len(t) for t in begun], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.classes, self.nibbles = _characters(begun)
        self.come, self.left = _walk(self.classes, self.begins[:-1], self.lengths, np.zeros(len(texts), np.int64))

    def step_at(self, i: int, char: int) -> int:
        """When the walk over text ``i`` comes to a character, or to the end."""
        return int(self.come[self.begins[i] + char]) if char < self.lengths[i] else int(self.left[i])

    def sample(self, i: int, steps: np.ndarray) -> np.ndarray:
        first = self.begins[i]
        at = np.searchsorted(self.come[first : self.begins[i + 1]], steps, "right") - 1
        return self.nibbles[first + at]

    def print_of(self, i: int) -> str:
        if len(self.texts[i]) > _LONG:
            return _print_long(self.texts[i])
        level = level_of(int(self.lengths[i]))
        return _spell(level, self.sample(i, sampled_steps(level, int(self.left[i]))))


def fingerprint(text: str) -> str:
    """The fingerprint of one text."""
    return _Texts([text]).print_of(0)


def _edited_prints(texts: _Texts, pairs: list[tuple[int, int]]) -> tuple[list[str], list[str]]:
    """For pairs (text, next text): SHA-256 and fingerprint of the text whose second half the next one's beginning replaces.

    The walk over what stays has been made; it goes on over the replacement from the step at which it stood.
    """
    sizes = [len(t) for t in texts.texts]
    kept = np.array([sizes[i] - sizes[i] // 2 for i, _ in pairs], np.int64)
    given = np.array([min(sizes[i] // 2, sizes[j]) for i, j in pairs], np.int64)
    alone = np.array([sizes[i] > _LONG for i, _ in pairs], bool)
    steps = np.array([0 if a else texts.step_at(i, int(k)) for (i, _), k, a in zip(pairs, kept, alone)], np.int64)
    spans = np.where(alone, 0, given)
    come, left = _walk(texts.classes, texts.begins[[j for _, j in pairs]], spans, steps)
    offsets = np.concatenate([[0], np.cumsum(spans)])
    digests, prints = [], []
    for n, (i, j) in enumerate(pairs):
        stays, comes = int(kept[n]), int(given[n])
        edited = texts.texts[i][:stays] + texts.texts[j][:comes]
        digests.append(hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
        if alone[n]:
            prints.append(_print_long(edited))
            continue
        level = level_of(stays + comes)
        wanted = sampled_steps(level, int(left[n]))
        before = int(np.searchsorted(wanted, steps[n]))
        at = np.searchsorted(come[offsets[n] : offsets[n + 1]], wanted[before:], "right") - 1
        behind = texts.nibbles[texts.begins[j] + at]
        prints.append(_spell(level, np.concatenate([texts.sample(i, wanted[:before]), behind])))
    return digests, prints


def _rows(ids: list, texts: list[str], pairs: list[tuple[int, int]], part: int) -> pa.RecordBatch:
    walked = _Texts(texts)
    prints = [walked.print_of(i) for i in range(len(texts))]
    digests, edited = _edited_prints(walked, pairs)
    columns = [
        pa.array([ids[i] for i, _ in pairs], pa.int64()),
        pa.array([len(texts[i]) for i, _ in pairs], pa.int64()),
        pa.array(digests, pa.string()),
        pa.array([prints[i] for i, _ in pairs], pa.string()),
        pa.array(edited, pa.string()),
        pa.array([likeness(prints[i], e) for (i, _), e in zip(pairs, edited)], pa.float64()),
        pa.array([likeness(prints[i], prints[j]) for i, j in pairs], pa.float64()),
        pa.array(np.full(len(pairs), part, np.int32)),
        pa.array(np.full(len(pairs), _WHOLE, np.int32)),
        pa.nulls(len(pairs), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, _PRINTED_NAMES)


_PRINTED_NAMES = [c.split()[0] for c in _PRINTED.split(", ")]


def _border(id_: int | None, text: str, part: int, role: int) -> pa.RecordBatch:
    row = [id_, None, None, None, None, None, None, part, role, text]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], _PRINTED_NAMES)


def _print_sorted(batches: Batches) -> Batches:
    """Every document of a sorted partition with the one behind it; the first and the last are handed on with their texts."""
    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    size, begun = 0, False
    for batch in batches:
        for id_, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            if not begun:
                yield _border(id_, text, part, _FIRST)
                begun = True
            ids.append(id_)
            texts.append(text)
            size += len(text)
            if size > _CHUNK_CHARS and len(ids) > 1:
                yield _rows(ids, texts, [(i, i + 1) for i in range(len(ids) - 1)], part)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield _rows(ids, texts, [(i, i + 1) for i in range(len(ids) - 1)], part)
    if ids:
        yield _border(ids[-1], texts[-1], part, _LAST)


def _print_borders(batches: Batches) -> Batches:
    for batch in batches:
        for id_, text, next_text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))):
            yield _rows([id_, None], [text, next_text], [(0, 1)], 0)


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of ``doc_id, text``.

    Documents stand in descending order of doc_id (null last, rows of one id by the hash of their text). The edited text of
    a document has the last ``floor(n_chars / 2)`` code points replaced by as many of the next document's first ones (all if it has
    fewer); behind the last document stands the first, a single one behind itself. ``near_edited`` and ``near_next`` are the
    ``likeness`` of the document's fingerprint to that of its edited text and of the next document. A null text is empty; an
    empty text has a fingerprint of no steps, which agrees with another empty one and with nothing else. Without rows the
    result has none. Runs jobs: texts are sorted once, and the result is a written table; of every partition the first and the
    last text are paired across afterwards, and the partitions' numbers reach the driver.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("copy"),  # equal rows may be many and lie in several partitions
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("copy")]
    printed = write_once(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_print_sorted, _PRINTED),
        "fingerprints",
        compression="zstd",
    )
    borders = printed.filter(F.col("role") != _WHOLE)
    parts = sorted(r["part"] for r in borders.filter(F.col("role") == _FIRST).select("part").collect())
    following = docs.sparkSession.createDataFrame(
        list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int"
    )
    lasts = borders.filter(F.col("role") == _LAST).select("part", "doc_id", "text").join(following, "part")
    firsts = borders.filter(F.col("role") == _FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    across = lasts.join(firsts, "next_part").select("doc_id", "text", "next_text").mapInArrow(_print_borders, _PRINTED)
    return printed.filter(F.col("role") == _WHOLE).union(across).drop("part", "role", "text")


@functools.lru_cache(4096)
def _band_places(blocks: int) -> np.ndarray:
    """Which sampled steps make up each band of a fingerprint of that many: the first few, of those there are, of a random order
    per band that does not depend on their number, so that fingerprints of nearly the same length share most."""
    room = 1 << max(blocks - 1, 1).bit_length()
    room = max(room, 4 * SAMPLES)
    places = np.empty((BANDS, BAND_STEPS), np.int64)
    for b in range(BANDS):
        order = np.argsort(mix(np.arange(room, dtype=_U) + _U((b + 1) << 40)), kind="stable")
        places[b] = order[order < blocks][:BAND_STEPS]
    return places


def _explode_bands(batches: Batches) -> Batches:
    """A bucket per band of the fingerprint's own level and of the next coarser one."""
    for batch in batches:
        keys, owners = [], []
        for rep, print_ in zip(batch.column("rep").to_pylist(), batch.column("fingerprint").to_pylist()):
            level, values = _read(print_)
            for at in (level, level + 1):
                held = values[_which(level, at, len(values))]
                if len(held) < _LEAST_STEPS:
                    continue
                places = _band_places(len(held))
                key = np.arange(1, BANDS + 1, dtype=_U) + _U(at << 32)
                for k in range(BAND_STEPS):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + (places[:, k].astype(_U) << _U(4)) + held[places[:, k]].astype(_U))
                keys.append(key)
                owners.append(rep)
        buckets = np.concatenate(keys) if keys else np.zeros(0, _U)
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets.view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), BANDS))], ["bucket", "rep"]
        )


def _near_pairs(percent: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            near = [
                100 * likeness(a, b) >= percent
                for a, b in zip(batch.column("print_a").to_pylist(), batch.column("print_b").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _near_in_blocks(percent: int) -> Callable[[Batches], Batches]:
    """Of the rows of a bucket's pair of blocks, links that join different groups, no more than needed to join them."""

    def run(batches: Batches) -> Batches:
        held: list[tuple] = []
        at = None

        def links() -> Iterator[tuple[int, int]]:
            group = {row[0]: row[1] for row in held}
            for n, (a, _, block_a, print_a) in enumerate(held):
                for b, _, block_b, print_b in held[n + 1 :]:
                    across = at[1] == at[2] or block_a != block_b
                    if across and group[a] != group[b] and 100 * likeness(print_a, print_b) >= percent:
                        yield min(a, b), max(a, b)
                        old, new = group[b], group[a]
                        for member, of in group.items():
                            if of == old:
                                group[member] = new

        def flush() -> pa.RecordBatch:
            found = list(links())
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"]
            )

        columns = ("bucket", "block_a", "block_b", "rep", "component", "block", "fingerprint")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[:3] != at:
                    if len(held) > 1:
                        yield flush()
                    at, held = row[:3], []
                held.append(row[3:])
        if len(held) > 1:
            yield flush()

    return run


def near_classes(prints: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``fingerprint, class_id`` of every distinct fingerprint of ``doc_id, fingerprint``.

    Fingerprints are linked that share a band and agree in ``percent`` hundredths of their steps or more; ``class_id`` is
    the smallest doc_id reachable over links. Equal fingerprints are one from the start, whatever their number. A bucket's
    members are compared with its first one, and then those that are in different classes still with each other, in blocks. With
    8 bands of 6 steps on two levels, a pair that agrees in 80 of 100 steps is found with a probability of 0.92 to 0.99. Rows
    without an id are left out. Runs jobs on written tables.
    """
    present = prints.filter("doc_id is not null and fingerprint is not null")
    distinct = present.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    # Ids need not be unique, so a fingerprint has a number of its own while classes are made.
    named = write_once(distinct.select(F.monotonically_increasing_id().alias("key"), "fingerprint", "rep"), "distinct-prints")
    banded = named.select(F.col("key").alias("rep"), "fingerprint").mapInArrow(_explode_bands, "bucket bigint, rep bigint")
    crowded = banded.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("members")).filter("members > 1")
    members = write_once(banded.join(crowded, "bucket"), "print-buckets")
    side = lambda s: named.select(F.col("key").alias(s), F.col("fingerprint").alias(f"print_{s}"))
    to_head = members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = to_head.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near_pairs(percent), "a bigint, b bigint")
    links = write_once(pairs, "print-links")
    grouped = components(links)
    open_ = (
        members.filter("members > 2 and rep <> head")
        .join(grouped, F.col("rep") == F.col("node"), "left")
        .select("bucket", "rep", F.ceil(F.col("members") / _PER_BLOCK).alias("blocks"), F.coalesce("component", "rep").alias("component"))
    )
    mixed = open_.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    blocked = (
        open_.join(mixed.select("bucket"), "bucket")
        .join(named.select(F.col("key").alias("rep"), "fingerprint"), "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
        .withColumn("partner", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(
            "bucket", F.least("block", "partner").alias("block_a"), F.greatest("block", "partner").alias("block_b"),
            "rep", "component", "block", "fingerprint",
        )
    )
    rest = write_once(
        blocked.repartition("bucket", "block_a", "block_b")
        .sortWithinPartitions("bucket", "block_a", "block_b")
        .mapInArrow(_near_in_blocks(percent), "a bigint, b bigint"),
        "print-links",
    )
    final = components(links.union(rest))
    tied = named.join(final, F.col("key") == F.col("node"), "left").select(
        "fingerprint", "rep", F.coalesce("component", "key").alias("component")
    )
    lowest = tied.groupBy("component").agg(F.min("rep").alias("class_id"))
    return tied.join(lowest, "component").select("fingerprint", "class_id")
