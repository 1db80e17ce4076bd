import hashlib
import re
from fractions import Fraction

from shelfwise.llm import mixing


def brute(rows, weights=(3, 1, 2), share=Fraction(3, 2), repeats=2):
    """Targets by repeated resharing, takes by walking each source in hash order."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, targets, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        rest = budget - sum(targets.values())
        parts = {s: Fraction(rest) * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if parts[s] > repeats * sizes[s]]
        if not over:
            targets |= parts
            break
        targets |= {s: Fraction(repeats * sizes[s]) for s in over}
        open_ -= set(over)
    out = []
    for s in names:
        passes = int(targets[s] // sizes[s]) if sizes[s] else 0
        left = targets[s] - passes * sizes[s]
        groups = {}
        for d, t, x in rows:
            if x == s:
                h = int(hashlib.md5(str("null" if d is None else d).encode()).hexdigest()[:15], 16)
                groups.setdefault(h, []).append((d, size(t)))
        before = 0
        for h in sorted(groups):
            n = sum(k for _, k in groups[h])
            extra = 2 * before + n <= 2 * left
            before += n
            out += [(d, k, sizes[s], float(targets[s]), k * (passes + extra)) for d, k in groups[h]]
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix_sources(docs).collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert [r[:3] + r[4:] for r in sorted(got, key=key)] == [r[:3] + r[4:] for r in sorted(brute(rows), key=key)]
    assert all(abs(a[3] - b[3]) <= 1e-9 * max(1, b[3]) for a, b in zip(sorted(got, key=key), sorted(brute(rows), key=key)))


def test_hot_source_small_sources_and_null(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    rows += [(1000 + i, "a b c", None) for i in range(5)] + [(2000, "one two", "tiny"), (2001, "", "empty"), (2002, None, "empty")]
    check(spark, rows)


def test_one_giant_document_and_repeated_rows(spark):
    check(spark, [(1, "w " * 5000, "a")] + [(i, "w w", "a") for i in range(2, 40)] + [(5, "x y z", "b")] * 20 + [(None, "p q", "b")] * 3)


def test_many_documents_share_a_bucket(spark, monkeypatch):
    """With few bits a level the search goes through several levels."""
    monkeypatch.setattr(mixing, "LEVEL_BITS", 3)
    check(spark, [(i, "w " * (1 + i % 5), f"s{i % 2}") for i in range(300)])


def test_mixes_are_nested(spark, documents):
    def taken(share):
        mixed = mixing.mix_sources(documents, share=Fraction(share))
        return {r["doc_id"]: r["copies"] for r in mixed.filter("size > 0").collect()}

    small, large = taken("1/2"), taken("1/1")
    assert all(small[d] <= large[d] for d in small)


def test_odd_documents_and_copies(spark, odd_documents, no_documents):
    mixed = mixing.mix_sources(odd_documents)
    assert mixed.count() == odd_documents.count()
    applied = mixing.apply_mix(odd_documents)
    assert applied.columns == odd_documents.columns
    assert applied.count() == sum(r["copies"] for r in mixed.collect())
    assert mixing.mix_sources(no_documents).count() == 0
    only_empty = odd_documents.filter("doc_id = 1")
    assert [(r["taken"], r["target"]) for r in mixing.mix_sources(only_empty).collect()] == [(0, 0.0)]


def test_applying_a_mix_moves_no_text(documents):
    """The documents meet one broadcast row per source: nothing of them is sorted or exchanged."""
    plan = mixing.apply_mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Sort" not in plan
    assert not re.search(r"Exchange (?!.*Broadcast)", plan.replace("BroadcastExchange", "")), plan
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(documents).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in mixing.apply_mix(documents).groupBy("doc_id").count().collect()}
    assert got == want
