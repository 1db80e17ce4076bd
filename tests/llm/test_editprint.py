"""Edit fingerprints against a walk that goes step by step."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import editprint
from shelfwise.sources.storage import scope


def slow_print(text):
    stays = editprint._stays()
    classes, nibbles = editprint._characters([text])
    written = []
    for c, n in zip(classes.tolist(), nibbles.tolist()):
        written += [n] * int(stays[c << 12 | len(written) % 4096])
    level = editprint.level_of(len(text))
    return f"{level:02x}" + "".join(f"{written[s]:x}" for s in editprint.sampled_steps(level, len(written)))


def slow_likeness(a, b):
    if a == b:
        return 1.0
    level = max(int(a[:2], 16), int(b[:2], 16))
    held = []
    for p in (a, b):
        own = int(p[:2], 16)
        steps = editprint._sampled(own, len(p))[: len(p) - 2].tolist()
        wanted = set(editprint._sampled(level, len(p) + 2).tolist())
        held.append([c for s, c in zip(steps, p[2:]) if s in wanted])
    most = max(map(len, held))
    return sum(x == y for x, y in zip(*held)) / most if most else 1.0


def brute(rows):
    """Rows (doc_id, text) in the order in which documents follow each other."""
    result = []
    for n, (doc_id, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed = slow_print(text), slow_print(edited)
        result.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed,
                       slow_likeness(own, changed), slow_likeness(own, slow_print(following))))
    return sorted(result, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark, documents):
    rows = [(r["doc_id"], r["text"] or "") for r in documents.orderBy(F.col("doc_id").desc()).collect()]
    with scope(spark):
        assert got(editprint.edit_fingerprints(documents)) == brute(rows)


def test_many_partitions_and_odd_texts(spark, odd_documents):
    ordered = odd_documents.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = [(r["doc_id"], r["text"] or "") for r in ordered.collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with scope(spark):
            assert got(editprint.edit_fingerprints(odd_documents)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_row_and_none(spark, no_documents):
    one = spark.createDataFrame([(4, "abcdefg")], "doc_id bigint, text string")
    with scope(spark):
        assert got(editprint.edit_fingerprints(one)) == brute([(4, "abcdefg")])
        assert editprint.edit_fingerprints(no_documents).collect() == []


def test_long_texts_walk_block_by_block(monkeypatch):
    text = "".join(random.Random(2).choice("abcdef é\U0001f600") for _ in range(5000))
    want = editprint._rows([1, 2], [text, text[::-1]], [(0, 1), (1, 0)], 0)
    assert want.column("fingerprint")[0].as_py() == slow_print(text)
    monkeypatch.setattr(editprint, "_LONG", 700)
    assert editprint._rows([1, 2], [text, text[::-1]], [(0, 1), (1, 0)], 0).equals(want)


def test_likeness_follows_the_edits():
    rng = random.Random(3)
    text = " ".join(rng.choice(["one", "seven", "thing", "und", "so"]) for _ in range(2000))

    def edited(k):
        held = list(text)
        for _ in range(k):
            held[rng.randrange(len(held))] = rng.choice(["", "xy", "q"])
        return "".join(held)

    mean = lambda k: sum(editprint.likeness(editprint.fingerprint(text), editprint.fingerprint(edited(k))) for _ in range(5)) / 5
    few, some, many = mean(3), mean(60), mean(2500)
    assert few > 0.9 > some > many and many < 0.5
    assert editprint.likeness(editprint.fingerprint("abc"), editprint.fingerprint("")) == 0


@pytest.mark.parametrize("per_block", [512, 2])
def test_near_classes(spark, monkeypatch, per_block):
    monkeypatch.setattr(editprint, "_PER_BLOCK", per_block)
    rng = random.Random(4)
    texts = {}
    for group in range(12):
        base = "".join(rng.choice("abcdefghij klmno") for _ in range(600 + 37 * group))
        for copy in range(5):
            texts[10 * group + copy] = base if copy < 2 else base[: 300 + copy] + "z" * (copy - 1) + base[301 + copy :]
    texts |= {500: "", 501: "", 502: "short", 503: "sh0rt"}
    rows = [(i, editprint.fingerprint(t)) for i, t in texts.items()] + [(None, editprint.fingerprint("nobody"))]
    prints = spark.createDataFrame(rows, "doc_id bigint, fingerprint string").repartition(3)
    with scope(spark):
        classes = {r["fingerprint"]: r["class_id"] for r in editprint.near_classes(prints).collect()}
    parent = {i: i for i, _ in rows[:-1]}
    ids = list(parent)
    for n, a in enumerate(ids):  # every pair, no bands
        for b in ids[n + 1 :]:
            one, two = rows[ids.index(a)][1], rows[ids.index(b)][1]
            if one == two or (min(len(one), len(two)) > 18 and 100 * slow_likeness(one, two) >= 80):
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    assert {i: classes[p] for i, p in rows[:-1]} == parent
