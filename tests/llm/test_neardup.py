import random
import re

import numpy as np

from shelfwise.llm import neardup
from shelfwise.llm.textbytes import LOWER, Texts, shingle_sets


def shingles(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, width=4):
    """Smallest id reachable over links, for every id."""
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    ids = sorted({d for d, _ in sets})
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return {d: root(d) for d in ids}


def family(seed, size, base_words, changed):
    """Variants of one text that differ from it, and more from each other, in a few words."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(size):
        words = list(base)
        for place in rng.sample(range(base_words), changed):
            words[place] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = neardup.near_duplicates(docs, width=4).collect()
    want = brute(rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((d is not None, d or 0) for d, _ in rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_families_of_all_similarities(spark):
    rows, n = [], 0
    for seed, (size, words, changed) in enumerate([(40, 120, 2), (40, 120, 4), (40, 120, 6), (30, 60, 1), (20, 9, 1), (25, 300, 8)]):
        for text in family(seed, size, words, changed):
            rows.append((n, text))
            n += 1
    rows += [(n + i, rows[3][1].upper()) for i in range(50)]
    check(spark, rows)


def test_chains_reach_their_smallest_member(spark):
    """Each text shares most with the next, little with the far ones."""
    words = [f"c{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(words[3 * i : 3 * i + 60])) for i in range(60)]
    check(spark, rows)


def test_odd_documents(spark, odd_documents):
    check(spark, [(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    assert neardup.near_duplicates(odd_documents.filter("false")).count() == 0


def test_shingle_counts_and_kept_rows(spark, odd_documents):
    counts = {(r["doc_id"], r["n_shingles"]) for r in neardup.near_duplicates(odd_documents, width=4).collect()}
    assert counts == {(r["doc_id"], len(shingles(r["text"]))) for r in odd_documents.collect()}
    kept = neardup.keep_one(odd_documents, neardup.near_duplicates(odd_documents))
    assert kept.columns == odd_documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids


def test_blocks_compare_what_the_heads_do_not(spark, monkeypatch):
    """With tiny blocks and heads' parts the result is the same."""
    monkeypatch.setattr(neardup, "PER_HEAD", 2)
    monkeypatch.setattr(neardup, "PER_BLOCK", 3)
    check(spark, [(i, t) for i, t in enumerate(family(5, 60, 100, 5) + family(6, 20, 100, 3))])


def test_signature_is_a_minhash():
    """Registers agree as often as the sets overlap, whatever the order and repetition of the elements."""
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        common, own = int(1000 * share), int(1000 * (1 - share) / 2)
        agreed = []
        for _ in range(30):
            pool = rng.integers(0, 2**52, common + 2 * own).astype(np.uint64)
            a, b = pool[: common + own], np.concatenate([pool[:common], pool[common + own :]])
            both = neardup.superminhash(np.concatenate([np.sort(a), rng.permutation(b)]), np.array([0, len(a), len(a) + len(b)]))
            agreed.append((both[0] == both[1]).mean())
        assert abs(np.mean(agreed) - common / (common + 2 * own)) < 0.03


def test_slices_do_not_change_signatures(monkeypatch):
    values = np.random.default_rng(2).integers(0, 2**52, 5000).astype(np.uint64)
    bounds = np.array([0, 10, 10, 4000, 5000])
    whole = neardup.superminhash(values, bounds)
    monkeypatch.setattr(neardup, "_SLICE", 700)
    assert (neardup.superminhash(values, bounds) == whole).all()


def test_shingles_are_those_of_the_words():
    texts = ["a B c d e a b c d", "a b", "", "x y z w"]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    _, bounds, words = shingle_sets(Texts(np.frombuffer(raw, np.uint8), offsets, 0), 4)
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    assert words.tolist() == [9, 2, 0, 4]
    assert LOWER[ord("Z")] == ord("z")


def words_of(seed, n=60):
    return [f"w{(seed * 7919 + i * 104729) % 5003}" for i in range(n)]


def test_an_id_with_two_texts_ties_what_either_is_linked_with(spark):
    a, b = words_of(1), words_of(2)
    near = lambda w: " ".join(w[:-1] + ["other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(words_of(3)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}
    verdicts = neardup.near_duplicates(docs)
    kept = [tuple(r) for _ in range(2) for r in neardup.keep_one(docs.repartition(2), verdicts).orderBy("doc_id").collect()]
    assert [k[0] for k in kept] == [1, 4, 1, 4] and kept[:2] == kept[2:]


def test_small_forests_join_to_the_same_components(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(5, 250)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").coalesce(1)
    want = {r["node"]: r["component"] for r in neardup.components(df).collect()}
    forests = list(neardup._union_find(iter(df.toArrow().to_batches())))
    monkeypatch.setattr(neardup, "MOST_NODES", 7)
    parts = list(neardup._union_find(iter(df.toArrow().to_batches())))
    assert len(forests) == 1 < len(parts)
    again = spark.createDataFrame([p for b in parts for p in zip(*b.to_pydict().values())], "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in neardup.components(again).collect()} == want


def test_open_members_without_agreement_move_no_text(spark, monkeypatch):
    """A crowded bucket whose members are not like each other: nothing is left after the signatures are compared."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 40
    signature = rng.integers(0, 1 << 16, (n, neardup.REGISTERS)).astype(np.uint16)
    signature[7] = signature[3]
    batch = pa.RecordBatch.from_pydict(
        {"bucket": [1] * n, "block_a": [0] * n, "block_b": [0] * n, "block": [0] * n, "rep": list(range(n)),
         "component": list(range(n)), "n_shingles": [100] * n, "signature": [s.tobytes() for s in signature]}
    )
    left = [r for b in neardup._agreeing_members(80)(iter([batch])) for r in b.to_pydict()["rep"]]
    assert sorted(left) == [3, 7]
