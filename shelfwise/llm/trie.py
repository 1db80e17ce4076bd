"""The trie of the turns that conversations begin with, and subtree totals by parallel tree contraction.

Rows move without their texts: a turn is the digest of its role and text and its length. The name of a node is the sum of the
digests of its turns and their places, so the names of all prefixes of a conversation are running sums. These are taken over a
range-partitioned order, in which even a conversation with a third of all turns is spread over many tasks; one row per partition
carries the sums across. Nodes are checked to have one parent and one last turn each, so a name shared by two different
sequences would stop the job instead of giving a wrong result.

Totals of subtrees do not go up level by level, which would take as many rounds as the longest conversation has turns.
Rounds of two steps contract the tree: *rake* takes all leaves away and adds their totals to their parents, *compress* takes
all nodes with one child away, chain by chain, with joins that double the reach each time. Every round at least halves the
leaves. What was compressed is expanded again in the opposite order, when the totals of the chains' ends are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.storage import write_once

_LANES = 4
_ROOT = bytes(8 * _LANES)
_NUMBERED = "conv_id bigint, item binary, chars bigint, place bigint, sums binary, part int"
#: Rows up to which a table is one partition, so that joining and grouping it moves nothing.
_ONE_PARTITION = 50_000

Batches = Iterator[pa.RecordBatch]


def _lanes(column: pa.Array) -> np.ndarray:
    """A column of 32-byte values as rows of four unsigned integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, _LANES)


def _binary(lanes: np.ndarray) -> pa.Array:
    size = lanes.shape[1] * 8
    offsets = (np.arange(len(lanes) + 1) * size).astype(np.int32)
    held = pa.py_buffer(np.ascontiguousarray(lanes.astype("<u8")))
    return pa.BinaryArray.from_buffers(pa.binary(), len(lanes), [None, pa.py_buffer(offsets), held])


def _running(batches: Batches) -> Batches:
    """Number the rows of each conversation in a sorted partition and sum up their ``step``, both from the partition's start."""
    at, place, sums = None, 0, np.zeros(_LANES, np.uint64)
    part = TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = np.asarray(batch.column("conv_id"))
        if conv[0] != at:
            place, sums = 0, np.zeros(_LANES, np.uint64)
        edges = np.flatnonzero(np.diff(conv)) + 1
        starts = np.concatenate([[0], edges])
        lengths = np.diff(np.append(starts, len(conv)))
        places = np.arange(1, len(conv) + 1) - np.repeat(starts, lengths)
        upto = np.cumsum(_lanes(batch.column("step")), axis=0, dtype=np.uint64)
        before = np.concatenate([np.zeros((1, _LANES), np.uint64), upto])[starts]
        upto = upto - np.repeat(before, lengths, axis=0)
        places[: lengths[0]] += place
        upto[: lengths[0]] += sums
        at, place, sums = conv[-1], int(places[-1]), upto[-1].copy()
        parts = pa.array(np.full(len(conv), part, np.int32))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "item", "chars")), pa.array(places), _binary(upto), parts],
            ["conv_id", "item", "chars", "place", "sums", "part"],
        )


def _carried(before: dict[int, tuple[int, int, np.ndarray]]) -> Callable[[Batches], Batches]:
    """Add what the conversation at a partition's start had in the partitions before."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            conv, part = (np.asarray(batch.column(c)) for c in ("conv_id", "part"))
            place, sums = np.array(batch.column("place")), _lanes(batch.column("sums")).copy()
            for p in np.unique(part).tolist():
                if p in before:
                    rows = (part == p) & (conv == before[p][0])
                    place[rows] += before[p][1]
                    sums[rows] += before[p][2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "item", "chars")), pa.array(place), _binary(sums)],
                ["conv_id", "item", "chars", "place", "sums"],
            )

    return run


def _running_sums(turns: DataFrame, order: list[Column]) -> DataFrame:
    """``conv_id, item, chars, place, sums`` of ``conv_id, item, chars, step``: rows numbered from 1 in their conversation, and
    the running sums of ``step`` (32 bytes, four sums modulo 2**64). One row per partition reaches the driver."""
    written = write_once(
        turns.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).mapInArrow(_running, _NUMBERED),
        "running",
    )
    ends = written.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", "sums")).alias("last"))
    before: dict[int, tuple[int, int, np.ndarray]] = {}
    held = None
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        last = row["last"]
        conv, place, sums = last["conv_id"], last["place"], np.frombuffer(last["sums"], "<u8").copy()
        if held is not None and held[0] == row["first"]:
            before[row["part"]] = held
            if conv == held[0]:
                place, sums = place + held[1], sums + held[2]
        held = (conv, place, sums)
    return written.mapInArrow(_carried(before), "conv_id bigint, item binary, chars bigint, place bigint, sums binary")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, item, chars`` of every row: its number in the conversation from 1, digest of role and text, code points.

    Rows are ordered by ``turn``, null first; rows with the same turn by digest. Null role or text is empty; rows without a
    conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    item = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(" "), role, text), 256))
    narrow = write_once(
        turns.filter("conv_id is not null").select(
            F.col("conv_id").cast("bigint").alias("conv_id"), "turn", item.alias("item"), F.length(text).cast("bigint").alias("chars")
        ),
        "turns",
    )
    # Equal rows may be many; a number of their own lets them lie in several partitions.
    narrow = narrow.select("*", F.lit(_ROOT).alias("step"), F.monotonically_increasing_id().alias("copy"))
    order = [F.col("turn").asc_nulls_first(), F.col("item"), F.col("copy")]
    return _running_sums(narrow, order).select("conv_id", "place", "item", "chars")


def with_shared_heads(turns: DataFrame, family: int = 100, variants: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: their turns ``conv_id, place, item, chars``, and all ids.

    Conversation c takes the first h turns of conversation ``c - c % family`` (all if it has fewer, none if it is absent)
    in place of its own first h; h is the CRC-32 of its id in decimal modulo ``variants``.
    """
    head = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % variants
    ids = turns.filter("place = 1").select("conv_id")
    begins = turns.filter((F.col("place") < variants) & (F.col("conv_id") % family == 0))
    begins = begins.select(F.col("conv_id").alias("base"), "place", "item", "chars")
    members = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), head("conv_id").alias("h"))
    given = members.join(begins, "base").filter("place <= h").select("conv_id", "place", "item", "chars")
    lengths = begins.groupBy("base").agg(F.max("place").alias("n"))
    own = turns.withColumn("h", head("conv_id")).filter("place > h")
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(lengths, "base", "left")
    place = F.col("place") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))
    return given.union(own.select("conv_id", place.alias("place"), "item", "chars")), ids


def _steps(batches: Batches) -> Batches:
    """The digest of a turn and its place."""
    for batch in batches:
        digests = [
            hashlib.sha256(place.to_bytes(8, "little") + item).digest()
            for place, item in zip(batch.column("place").to_pylist(), batch.column("item").to_pylist())
        ]
        steps = pa.array(digests, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "item", "chars", "place")), steps], ["conv_id", "item", "chars", "place", "step"]
        )


def _name_nodes(batches: Batches) -> Batches:
    """The node each row ends in, and that node's parent: the running sums with and without the row's own digest."""
    for batch in batches:
        places, items = batch.column("place").to_pylist(), batch.column("item").to_pylist()
        own = b"".join(hashlib.sha256(p.to_bytes(8, "little") + i).digest() for p, i in zip(places, items))
        sums = _lanes(batch.column("sums"))
        parent = _binary(sums - np.frombuffer(own, "<u8").reshape(-1, _LANES))
        yield pa.RecordBatch.from_arrays(
            [batch.column("sums"), parent, *(batch.column(c) for c in ("conv_id", "place", "item", "chars"))],
            ["id", "parent", "conv_id", "depth", "item", "chars"],
        )


def _end_digests(batches: Batches) -> Batches:
    """SHA-256 of the comma-joined conv_ids of each node, from a stream sorted by node and conv_id; a list is never held whole."""
    at, digest = None, hashlib.sha256()
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, convs = batch.column("id").to_pylist(), batch.column("conv_id").to_pylist()
        edges = [0, *(i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1]), len(nodes)]
        done = []
        for begin, end in zip(edges[:-1], edges[1:]):
            text = ",".join(map(str, convs[begin:end])).encode()
            if nodes[begin] == at:
                digest.update(b"," + text)
                continue
            if at is not None:
                done.append((at, digest.hexdigest()))
            at, digest = nodes[begin], hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                                         ["id", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], ["id", "ends_sha256"])


def _held(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The frame written, as one partition if it is small, and its rows."""
    written = write_once(df, label)
    rows = written.count()
    return (written.coalesce(1) if rows <= _ONE_PARTITION else written), rows


def _chain_ends(unary: DataFrame) -> DataFrame:
    """``id, end, leaves, saved`` of the nodes ``id, child, leaves, saved`` with one child: the first node below them that is
    none of them, and the sums of all nodes above that, from each on. Every join doubles how far a node sees."""
    known = unary.select(F.col("id").alias("next_id"))
    chain, _ = _held(
        unary.join(known, F.col("child") == F.col("next_id"), "left").select(
            "id", F.col("child").alias("next"), "leaves", "saved", F.col("next_id").isNull().alias("over")
        ),
        "chain",
    )
    while not chain.filter("not over").isEmpty():
        ahead = chain.select(
            F.col("id").alias("next"), F.col("next").alias("far"), F.col("leaves").alias("more_leaves"),
            F.col("saved").alias("more_saved"), F.col("over").alias("far_over"),
        )
        # Nodes that are not over point at different nodes, so no key of this join is frequent.
        moved = chain.filter("not over").join(ahead, "next").select(
            "id", F.col("far").alias("next"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"),
            (F.col("saved") + F.col("more_saved")).alias("saved"), F.col("far_over").alias("over"),
        )
        chain, _ = _held(chain.filter("over").union(moved), "chain")
    return chain.select("id", F.col("next").alias("end"), "leaves", "saved")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """``id, n_children, n_leaves, total`` of the tree ``id, parent, own`` (null parent: the root): children, leaves of the
    subtree, and the sum of ``own`` over it. Runs jobs, a number that grows with the logarithm of the nodes."""
    children = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n")).withColumnRenamed("parent", "of")
    counted = write_once(
        nodes.join(children, F.col("id") == F.col("of"), "left").select(
            "id", "parent", F.coalesce("n", F.lit(0)).alias("n_children"), "own"
        ),
        "tree",
    )
    is_leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint")
    none = F.lit(0).cast("bigint")
    # What a node holds by now, and what compressed nodes between it and its parent hold besides.
    tree = counted.select(
        "id", "parent", "n_children", is_leaf.alias("leaves"), F.col("own").alias("saved"),
        none.alias("up_leaves"), none.alias("up_saved"),
    )
    raked, compressed = [], []
    while True:
        raked.append(tree.filter("n_children = 0").select("id", "leaves", "saved"))
        # What each inner node gets from its leaves, how many other children it has, and one of these.
        leaf = F.col("n_children") == 0
        below = tree.filter("parent is not null").groupBy(F.col("parent").alias("of")).agg(
            F.sum(F.when(leaf, F.col("leaves") + F.col("up_leaves")).otherwise(none)).alias("more_leaves"),
            F.sum(F.when(leaf, F.col("saved") + F.col("up_saved")).otherwise(none)).alias("more_saved"),
            F.count_if(~leaf).alias("n"),
            F.min(F.when(~leaf, F.col("id"))).alias("child"),
            F.sum(F.when(leaf, none).otherwise(F.col("up_leaves"))).alias("child_leaves"),
            F.sum(F.when(leaf, none).otherwise(F.col("up_saved"))).alias("child_saved"),
        )
        inner, rows = _held(
            tree.filter("n_children > 0").join(below, F.col("id") == F.col("of")).select(
                "id", "parent", F.col("n").alias("n_children"), "child", "child_leaves", "child_saved", "up_leaves", "up_saved",
                (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"),
            ),
            "raked",
        )
        if not rows:
            break
        unary = inner.filter("n_children = 1")
        chains = _chain_ends(
            unary.select("id", "child", (F.col("leaves") + F.col("child_leaves")).alias("leaves"),
                         (F.col("saved") + F.col("child_saved")).alias("saved"))
        )
        compressed.append(chains)
        # The first node of a chain hands its parent and all that the chain holds on to the chain's end.
        within = unary.select(F.col("id").alias("unary_id"))
        firsts = (
            unary.select("id", "parent", "up_leaves", "up_saved")
            .join(within, F.col("parent") == F.col("unary_id"), "left_anti")
            .join(chains.select("id", F.col("end").alias("below"), "leaves", "saved"), "id")
            .select(
                "below", F.col("parent").alias("above"), F.lit(True).alias("moved"),
                (F.col("up_leaves") + F.col("leaves")).alias("new_leaves"), (F.col("up_saved") + F.col("saved")).alias("new_saved"),
            )
        )
        tree, _ = _held(
            inner.filter("n_children <> 1")
            .join(firsts, F.col("id") == F.col("below"), "left")
            .select("id", F.when(F.col("moved"), F.col("above")).otherwise(F.col("parent")).alias("parent"),
                    "n_children", "leaves", "saved", F.coalesce("new_leaves", "up_leaves").alias("up_leaves"),
                    F.coalesce("new_saved", "up_saved").alias("up_saved")),
            "compressed",
        )
    totals = raked.pop()
    for leaves, chains in zip(reversed(raked), reversed(compressed)):
        ends = totals.select(F.col("id").alias("end"), F.col("leaves").alias("end_leaves"), F.col("saved").alias("end_saved"))
        expanded = chains.join(ends, "end").select(
            "id", (F.col("leaves") + F.col("end_leaves")).alias("leaves"), (F.col("saved") + F.col("end_saved")).alias("saved")
        )
        totals, _ = _held(totals.union(expanded).union(leaves), "totals")
    found = totals.select(F.col("id").alias("of"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("total"))
    return counted.join(found, F.col("id") == F.col("of")).select("id", F.col("n_children"), "n_leaves", "total")


def trie_nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all conversations: see ``prefix_trie``. ``turns`` are numbered (``conv_id, place, item,
    chars``, places from 1 without gaps), ``conversations`` are all ids, also of conversations without turns."""
    summed = _running_sums(
        turns.mapInArrow(_steps, "conv_id bigint, item binary, chars bigint, place bigint, step binary"), [F.col("place")]
    )
    rows = summed.mapInArrow(
        _name_nodes, "id binary, parent binary, conv_id bigint, depth bigint, item binary, chars bigint"
    )
    rows = write_once(rows, "prefixes")
    same = lambda c: F.min(c) == F.max(c)
    grouped = rows.groupBy("id").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.count("*").alias("n_convs"),
        F.when(same("parent") & same("item") & same("depth"), F.min("chars"))
        .otherwise(F.raise_error(F.lit("two different prefixes have the same name")).cast("bigint"))
        .alias("chars"),
    )
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        F.lit(_ROOT).alias("id"), "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"),
        "n_convs", F.lit(0).cast("bigint").alias("chars"),
    )
    nodes = write_once(grouped.union(root), "nodes")
    totals = subtree_totals(nodes.select("id", "parent", ((F.col("n_convs") - 1) * F.col("chars")).alias("own")))

    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "id")).alias("last"))
    ends = conversations.join(last, "conv_id", "left").select(F.coalesce("last.id", F.lit(_ROOT)).alias("id"), "conv_id")
    digests = ends.repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(_end_digests, "id binary, ends_sha256 string")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(totals, "id")
        .join(digests, "id", "left")
        .join(above, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("total").alias("saved_tokens"),
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations ``conv_id, turn, role, text``: a node for every distinct sequence of first turns.

    Returns per node ``conv_id`` (its smallest member), ``depth`` (0: the root), ``parent_conv_id`` (null for the root),
    ``n_convs`` (members: conversations that begin so), ``n_children``, ``n_leaves`` (childless nodes in its subtree),
    ``saved_tokens`` (over its subtree, code points of a node's last text times the members but one: what storing every
    node once saves) and ``ends_sha256`` (of the ids of the members that end here, ascending, comma-joined).

    Turns are ordered by ``turn``, null first, ties by the digest of role and text; null role or text counts as empty, rows
    without a conv_id are left out, repeated rows are turns of their own. Without rows there is no node. Other columns are not
    read. Runs jobs: numbered turns, nodes and the rounds of the contraction are written tables.
    """
    numbered = numbered_turns(turns)
    return trie_nodes(numbered, numbered.filter("place = 1").select("conv_id"))
