"""The prefix trie against a recursive one in plain Python."""

import hashlib
import random
import zlib

import pytest

from shelfwise.llm import trie
from shelfwise.sources.storage import scope

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """Turns of every conversation in order; ties by the digest of role and text."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)} {role}{text}".encode()).digest()
            found.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    return {conv: [t for _, _, t in sorted(turns)] for conv, turns in found.items()}


def rebuilt(convs):
    result = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        result[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return result


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    totals = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [totals[x] for x in children.get(path, [])]
        own = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        totals[path] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + own)
    rows = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        rows.append((min(members), len(path), parent, len(members), len(children.get(path, [])), *totals[path],
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def table(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "conv_id bigint, turn bigint, role string, text string, place int, item string, id int")
    return df.repartition(4)


def some_rows(seed, convs, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 1000), convs):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_any_conversations(spark, seed):
    rows = some_rows(seed, 60, ["a", "bb", None, "", "é\U0001f600"])
    rows += [(5000, None, "user", "null turn"), (5000, 1, "user", "a"), (5001, None, "user", "null turn")]
    rows += [(5002, 1, "user", "a")] * 3 + [(5002, 1, "user", "bb"), (None, 1, "user", "nobody's"), (-7, 0, None, None)]
    with scope(spark):
        assert got(trie.prefix_trie(table(spark, rows))) == brute(sequences(rows))


def test_shared_heads_and_turnless_conversations(spark):
    rows = some_rows(3, 150, ["a", "b", "c"]) + [(2001, 0, "user", "short"), (3000, 0, "user", "x"), (3007, 0, "user", "y")]
    with scope(spark):
        nodes = trie.trie_nodes(*trie.with_shared_heads(trie.numbered_turns(table(spark, rows))))
        assert got(nodes) == brute(rebuilt(sequences(rows)))


def test_one_long_conversation_and_many_copies(spark):
    rows = [(1, t, "user", str(t % 7)) for t in range(1500)] + [(2, t, "user", str(t % 7)) for t in range(700)]
    rows += [(c, 0, "user", "same") for c in range(10, 400)]
    with scope(spark):
        assert got(trie.prefix_trie(table(spark, rows))) == brute(sequences(rows))


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    steps = []
    held = trie._held
    monkeypatch.setattr(trie, "_held", lambda df, label: (steps.append(label), held(df, label))[1])
    nodes = spark.createDataFrame([(str(i).encode(), str(i - 1).encode() if i else None, 1) for i in range(1000)], "id binary, parent binary, own bigint")
    with scope(spark):
        totals = {int(bytes(r["id"])): (r["n_children"], r["n_leaves"], r["total"]) for r in trie.subtree_totals(nodes).collect()}
    assert totals == {i: (int(i < 999), 1, 1000 - i) for i in range(1000)}
    assert len(steps) < 25


def test_partitions_carry_over(spark):
    rows = [(c, t, "user", f"{t}") for c, n in ((1, 30), (2, 500), (3, 1)) for t in range(n)]
    with scope(spark):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            numbered = trie.numbered_turns(table(spark, rows)).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["conv_id"], r["place"], r["chars"]) for r in numbered) == [(c, t + 1, len(x)) for c, t, _, x in rows]


def test_no_rows(spark):
    with scope(spark):
        assert trie.prefix_trie(table(spark, [(1, 1, "a", "b")]).filter("false")).collect() == []
