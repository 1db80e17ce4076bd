"""Near-duplicates by SuperMinHash: signatures, banding, exact verification and union-find grouping.

A document is its set of distinct word shingles; two are linked when their sets' Jaccard similarity reaches a threshold.
Equal sets are one class from the start. Of the classes' signatures, bands of four registers are buckets. A bucket is not
expanded into pairs: its members are compared with its smallest member first, and only members that are still in different
groups afterwards are compared with each other, in blocks of bounded size that yield a spanning forest of the links, not
the links. Links count only after the full sets have been compared.

With 32 bands of four registers two sets of similarity 0.8 miss each other with a probability of 5e-8, more similar ones with
a smaller one; the cut on agreeing registers before the full comparison loses about 1e-7 more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.naming import fresh
from shelfwise.llm.textbytes import chunks, mix, shingle_sets
from shelfwise.sources.storage import write_once

#: Words of a shingle.
WIDTH = 5
#: Similarity at which documents are linked, in hundredths.
PERCENT = 80
REGISTERS, BANDS = 128, 32
#: Agreeing registers of 128 below which no full comparison is made: five standard deviations below the mean at 0.8.
LEAST_AGREEING = 78
#: Members that one copy of a bucket's head serves; rows and shingles on one side of a block comparison, about.
PER_HEAD, PER_BLOCK, BLOCK_SHINGLES = 256, 512, 1 << 18
#: Nodes that a task's union-find holds at once.
MOST_NODES = 1 << 20
_SLICE = 1 << 16
_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15

Batches = Iterator[pa.RecordBatch]


def superminhash(values: np.ndarray, bounds: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SuperMinHash signatures of many sets at once, one row of integers per set.

    Element by element the method walks a random permutation of the registers and offers the j-th register of that walk
    the rank ``j + r`` with a random fraction r. Here all elements take their step j together; a set stops as soon as every
    register holds a rank below ``j + 1``, which later steps cannot lower. The rank is one integer: j above 48 random bits.
    """
    sets = len(bounds) - 1
    signature = np.full(sets * registers, np.iinfo(_U).max, _U)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    worst = signature.reshape(sets, registers)
    for begin in range(0, len(values), _SLICE):
        element = values[begin : begin + _SLICE]
        own = owner[begin : begin + _SLICE]
        walk = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.int32), (len(element), 1))
        active = np.arange(len(element))
        first, last = own[0], own[-1] + 1
        for j in range(registers):
            random = mix(element[active] + _U(_GOLDEN * (j + 1) & 0xFFFFFFFFFFFFFFFF))
            k = j + (((random & _U(0xFFFF)).astype(np.int64) * (registers - j)) >> 16)
            register = walk[active, k]
            walk[active, k] = walk[active, j]
            rank = (_U(j) << _U(48)) | (random >> _U(16))
            np.minimum.at(signature, own[active] * registers + register, rank)
            done = worst[first:last].max(axis=1) < _U((j + 1) << 48)
            active = active[~done[own[active] - first]]
            if not len(active):
                break
    return worst


def _bands(signature: np.ndarray) -> np.ndarray:
    """Bucket keys, one per band; the band's number is part of the key."""
    rows = signature.shape[1] // BANDS
    parts = signature.reshape(len(signature), BANDS, rows)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _U(_GOLDEN) + parts[:, :, r])
    return key.view(np.int64)


def _set_digests(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over the elements: equal sets have equal ones."""
    digests = []
    for salt in (_U(0xA5A5A5A5), _U(0x5A5A5A5A5A)):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(values + salt), dtype=_U)])
        digests.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return digests


def _fixed_binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * size).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]
    )


def _signature_batches(width: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in chunks(batch.column("text")):
                values, bounds, _ = shingle_sets(part, width)
                signature = superminhash(values, bounds)
                one, two = _set_digests(values, bounds)
                rows = slice(part.first_row, part.first_row + len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[rows],
                        batch.column("text_key")[rows],
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(one),
                        pa.array(two),
                        _fixed_binary(_bands(signature)),
                        _fixed_binary((signature & _U(0xFFFF)).astype(np.uint16)),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "signature"],
                )

    return run


def _explode_bands(batches: Batches) -> Batches:
    for batch in batches:
        keys = _matrix(batch.column("bands"), np.int64)
        repeated = [pa.array(np.repeat(np.asarray(batch.column(c)), keys.shape[1])) for c in ("rep", "n_shingles")]
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *repeated], ["bucket", "rep", "n_shingles"])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    rows = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1) if rows else np.zeros((0, 1), kind)


def _similar_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _agreeing_pairs(percent: int) -> Callable[[Batches], Batches]:
    """Pairs whose sizes and signatures allow the wanted similarity."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            agree = (_matrix(batch.column("sig_a"), np.uint16) == _matrix(batch.column("sig_b"), np.uint16)).sum(axis=1)
            sizes = _similar_sizes(np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b")), percent)
            keep = pa.array((agree >= LEAST_AGREEING * percent // PERCENT) & sizes)
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _grouped(batches: Batches, keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream; a run may span batches and must be of bounded length."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        changes = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changes |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges[:-1], edges[1:]):
            key = tuple(c[begin] for c in columns)
            if held and key != at:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _links_in_blocks(width: int, percent: int) -> Callable[[Batches], Batches]:
    """Links between different groups within a bucket's pair of blocks, on full sets: no more than join the groups.

    Pairs whose sizes or signatures rule the similarity out are passed over; a group that a link has joined to another
    counts as one with it from then on.
    """
    least = LEAST_AGREEING * percent // PERCENT

    def run(batches: Batches) -> Batches:
        for table in _grouped(batches, ["bucket", "block_a", "block_b"]):
            column = lambda name: table.column(name).combine_chunks()  # noqa: B023, E731
            rep, group, block = (np.array(column(c)) for c in ("rep", "component", "block"))
            block_a, block_b = column("block_a")[0].as_py(), column("block_b")[0].as_py()
            if (group == group[0]).all():
                continue
            signature = _matrix(column("signature"), np.uint16)
            sets = []
            for part in chunks(column("text")):
                values, bounds, _ = shingle_sets(part, width)
                sets += [values[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
            size = np.array([len(x) for x in sets])
            upto = np.concatenate([[0], np.cumsum(size)])
            names, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            own = np.zeros(len(names), bool)
            found = []
            for i in np.flatnonzero(block == block_a).tolist():
                other = (group != group[i]) & _similar_sizes(size, size[i], percent) & (block == block_b)
                j = np.flatnonzero(other & (rep > rep[i]) if block_a == block_b else other)
                j = j[(signature[j] == signature[i]).sum(axis=1) >= least]
                if not len(j):
                    continue
                mine = numbers[upto[i] : upto[i + 1]]
                own[mine] = True
                sums = np.concatenate([[0], np.cumsum(own[numbers])])
                own[mine] = False
                common = sums[upto[j + 1]] - sums[upto[j]]
                for k in j[100 * common >= percent * (size[i] + size[j] - common)].tolist():
                    if group[k] != group[i]:
                        found.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
                        group[group == group[k]] = group[i]
            if found:
                pairs = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _agreeing_members(percent: int) -> Callable[[Batches], Batches]:
    """Members of a bucket's pair of blocks whose size and signature agree with a member of another group there."""
    least = LEAST_AGREEING * percent // PERCENT

    def run(batches: Batches) -> Batches:
        for table in _grouped(batches, ["bucket", "block_a", "block_b"]):
            column = lambda name: np.array(table.column(name).combine_chunks())  # noqa: B023, E731
            rep, group, block, size = (column(c) for c in ("rep", "component", "block", "n_shingles"))
            block_a, block_b = table.column("block_a")[0].as_py(), table.column("block_b")[0].as_py()
            signature = _matrix(table.column("signature").combine_chunks(), np.uint16)
            close = np.zeros(len(rep), bool)
            for i in np.flatnonzero(block == block_a).tolist():
                j = np.flatnonzero((block == block_b) & (group != group[i]) & _similar_sizes(size, size[i], percent))
                j = j[(signature[j] == signature[i]).sum(axis=1) >= least]
                close[j] = True
                close[i] |= len(j) > 0
            buckets = table.column("bucket").combine_chunks().filter(pa.array(close))
            yield pa.RecordBatch.from_arrays([buckets, pa.array(rep[close])], ["bucket", "rep"])

    return run


def _compare_with_head(width: int, percent: int) -> Callable[[Batches], Batches]:
    """Links between heads (rows without b, first of their group) and the members that follow them, on full sets."""

    def run(batches: Batches) -> Batches:
        at, head = None, np.zeros(0, _U)
        for batch in batches:
            first, second = np.asarray(batch.column("a")), batch.column("b").fill_null(-1)
            is_head = np.asarray(batch.column("is_head"))
            second = np.asarray(second)
            linked = np.zeros(batch.num_rows, bool)
            for part in chunks(batch.column("text")):
                values, bounds, _ = shingle_sets(part, width)
                for i in range(len(part)):
                    row = part.first_row + i
                    own = values[bounds[i] : bounds[i + 1]]
                    if is_head[row]:
                        at, head = first[row], own
                    elif at == first[row] and len(head) and len(own):
                        place = np.minimum(np.searchsorted(head, own), len(head) - 1)
                        common = int((head[place] == own).sum())
                        linked[row] = 100 * common >= percent * (len(head) + len(own) - common)
            yield pa.RecordBatch.from_arrays([pa.array(first[linked]), pa.array(second[linked])], ["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are linked. Texts meet in groups of one head and a bounded number of members."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_HEAD).alias("_parts"))
    salted = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_parts").alias("salt"))
    heads = (
        salted.select("a", "salt")
        .distinct()
        .join(texts, F.col("a") == F.col("rep"))
        .select("a", F.lit(None).cast("bigint").alias("b"), "salt", F.lit(True).alias("is_head"), "text")
    )
    members = salted.join(texts, F.col("b") == F.col("rep")).select("a", "b", "salt", F.lit(False).alias("is_head"), "text")
    return (
        heads.unionByName(members)
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("is_head").desc())
        .mapInArrow(_compare_with_head(width, percent), "a bigint, b bigint")
    )


def _union_find(batches: Batches) -> Batches:
    """Spanning forests of the task's edges: every node with the smallest node it is connected to here.

    With ``MOST_NODES`` nodes the forest is handed on and another begun, so memory stays bounded; later steps join them.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def forest() -> pa.RecordBatch:
        stars = [(root(x), x) for x in list(parent) if root(x) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], ["a", "b"]
        )

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
            if len(parent) >= MOST_NODES:
                yield forest()
    yield forest()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating-star method: a node's larger (or smaller) neighbours are tied to its smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.filter("b < a")
    lowest = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    moved = near.filter("b > a") if large else near
    tied = moved.join(lowest, "a").select(F.col("low").alias("a"), "b")
    if not large:
        tied = tied.union(lowest.select(F.col("low").alias("a"), F.col("a").alias("b")))
    return tied.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; the component is its smallest node.

    Union-find within the tasks leaves a forest; large-star and small-star steps on written tables join the forests
    until nothing changes. Runs a few jobs; only a row count and a checksum come back to the driver.
    """
    forest = edges.filter("a <> b").mapInArrow(_union_find, "a bigint, b bigint").distinct()
    now = write_once(forest, "links")
    state = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state or sums[0] == 0:
            break
        state = tuple(sums)
        now = write_once(_star(_star(now, large=True), large=False), "links")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (integer ``doc_id``, ``text``; others unread).

    Words are runs of non-white-space, A-Z lower-cased; a text with fewer than ``width`` words has them all as one shingle, a
    null or empty one has none and is linked with nothing. Rows that share an id are the same document: what any of them
    is linked with, all are. ``component_id`` is the smallest id reachable over links, ``kept`` marks the documents that are
    their component's smallest; a null id is linked with nothing, has a null component and is kept.
    Runs jobs: signatures, candidates and links are written tables.
    """
    signed = write_once(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
            _signature_batches(width),
            "doc_id bigint, text_key bigint, n_shingles bigint, set_a bigint, set_b bigint, bands binary, signature binary",
        ),
        "signatures",
    )
    present = signed.filter("n_shingles > 0 and doc_id is not null")
    # A class is a set of shingles. Its number is not a document's: an id may stand in rows of several classes.
    digest = ["n_shingles", "set_a", "set_b"]
    classes = write_once(
        present.groupBy(*digest).agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"),
            F.first("bands").alias("bands"),
            F.first("signature").alias("signature"),
        ).select(F.monotonically_increasing_id().alias("rep"), *digest, F.col("first.doc_id").alias("low"),
                 F.col("first.text_key").alias("low_key"), "bands", "signature"),
        "classes",
    )
    members_of = write_once(
        signed.select("doc_id", *digest).join(classes.select("rep", *digest), digest, "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")
        ),
        "class-members",
    )
    # Classes that one id stands in are one document's.
    several = members_of.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
    several = several.filter("a < z").select(F.col("doc_id").alias("_doc"), "a")
    copies = (
        members_of.join(several, F.col("doc_id") == F.col("_doc")).filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    )

    banded = classes.select("rep", "n_shingles", "bands").mapInArrow(
        _explode_bands, "bucket bigint, rep bigint, n_shingles bigint"
    )
    crowded = (
        banded.groupBy("bucket")
        .agg(
            F.min("rep").alias("head"),
            F.count("*").alias("members"),
            F.sum("n_shingles").alias("shingles"),
            F.bit_xor(F.xxhash64("rep")).alias("who"),
        )
        .filter("members > 1")
    )
    # Buckets with the same members say the same: one of them is enough.
    one_of = crowded.groupBy("head", "members", "shingles", "who").agg(F.min("bucket").alias("bucket"))
    members = write_once(
        banded.drop("n_shingles").join(one_of.select("bucket", "head", "members", "shingles"), "bucket"), "buckets"
    )

    side = lambda s: classes.select(
        F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("signature").alias(f"sig_{s}")
    )
    to_head = members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    close = to_head.join(side("a"), "a").join(side("b"), "b").mapInArrow(_agreeing_pairs(percent), "a bigint, b bigint")
    pairs = write_once(close.distinct(), "pairs")

    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "low", "low_key")
    texts = write_once(
        docs.select(F.col("doc_id").cast("bigint").alias("low"), F.xxhash64("text").alias("low_key"), "text")
        .join(wanted, ["low", "low_key"])
        .select("rep", "text"),
        "candidate-texts",
    )
    links = write_once(_verified(pairs, texts, width, percent).union(copies), "verified")

    # Members of one bucket that are in different components yet, and neither is the head, were never compared.
    grouped = components(links)
    blocks = F.ceil(F.greatest(F.col("members") / PER_BLOCK, F.col("shingles") / BLOCK_SHINGLES))
    open_ = (
        members.filter("members > 2 and rep <> head")
        .join(grouped, F.col("rep") == F.col("node"), "left")
        .select("bucket", "rep", blocks.alias("blocks"), F.coalesce("component", "rep").alias("component"))
    )
    mixed = open_.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_ = open_.join(mixed.select("bucket"), "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))

    def paired(rows: DataFrame) -> DataFrame:
        """Every row in all pairs of blocks that its block is one of, pairs together."""
        pairs = rows.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        pairs = pairs.withColumns({"block_a": F.least("block", "partner"), "block_b": F.greatest("block", "partner")})
        key = ["bucket", "block_a", "block_b"]
        return pairs.drop("partner", "blocks").repartition(*key).sortWithinPartitions(*key)

    # Signatures first, which are small: texts move only for members that agree with one of another component.
    signatures = classes.select("rep", "n_shingles", "signature")
    close = (
        paired(open_.join(signatures, "rep"))
        .mapInArrow(_agreeing_members(percent), "bucket bigint, rep bigint")
        .distinct()
    )
    left = write_once(open_.join(close, ["bucket", "rep"]), "open-members")
    rest = paired(left.join(signatures.drop("n_shingles"), "rep").join(texts, "rep")).mapInArrow(
        _links_in_blocks(width, percent), "a bigint, b bigint"
    )
    rest = write_once(rest, "verified")
    final = components(links.union(rest))
    placed = classes.select("rep", "low").join(final, F.col("rep") == F.col("node"), "left")
    placed = placed.select("rep", "low", F.coalesce("component", "rep").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = placed.join(lowest, "component").select("rep", "component_id")
    return (
        members_of.join(of_class, "rep", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_one(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents that represent their group; rows without an id all stay.

    Of rows that share an id one stays, the one whose text has the smallest hash. The ids that go and those that repeat are
    written tables of known size: small ones are broadcast, and only rows of repeated ids are dealt out by id.
    """
    id_, nth, hash_ = fresh(docs, "_id"), fresh(docs, "_nth"), fresh(docs, "_hash")
    known = verdicts.filter("doc_id is not null")
    gone = write_once(known.filter("not kept").select(F.col("doc_id").alias(id_)).distinct(), "ids-that-go")
    often = known.filter("kept").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("n")).filter("n > 1")
    often = write_once(often.select(id_), "repeated-ids")
    same = F.col("doc_id") == F.col(id_)
    stay = docs.join(gone, same, "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(hash_))
    repeated = stay.join(often, same, "left_semi").withColumn(hash_, F.xxhash64("text")).withColumn(nth, first)
    chosen = repeated.filter(F.col(nth) == 1).select([F.col(c) for c in docs.columns])
    return stay.join(often, same, "left_anti").unionByName(chosen)
