import random
from functools import lru_cache

from shelfwise.llm import licenses

MIT = licenses.TEMPLATES["MIT", "permissive"][1]


def longest_common(a, b):
    @lru_cache(None)
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return best(i + 1, j + 1) + 1 if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))

    return best(0, 0)


def test_alignment_rises_and_reaches_the_longest_common_subsequence():
    """On sequences of mostly different words patience finds as much as the exact method; it never finds wrong pairs."""
    rng = random.Random(5)
    total, most = 0, 0
    for _ in range(200):
        base = [rng.randrange(10_000) for _ in range(rng.randrange(1, 60))]
        other = [w for w in base if rng.random() > 0.2]
        for _ in range(rng.randrange(6)):
            other.insert(rng.randrange(len(other) + 1), rng.choice([*base, rng.randrange(10_000)]))
        found = licenses.patience(tuple(base), tuple(other))
        assert all(base[i] == other[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        exact = longest_common(tuple(base), tuple(other))
        assert len(found) <= exact
        total, most = total + len(found), most + exact
    assert total >= 0.99 * most


def test_words_that_repeat_align_too():
    assert len(licenses.patience((1, 2, 1, 2, 3), (1, 2, 1, 2, 3))) == 5
    assert len(licenses.patience((1, 1, 2, 2), (2, 2, 1, 1))) == 2
    assert licenses.patience((), (1,)) == []


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    return {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}


def test_passages(spark):
    changed = MIT.replace("free of charge", "at no cost").replace("publish, distribute", "spread")
    got = scan(spark, [
        "prose before. " * 30 + MIT + " prose after" * 30,
        "x " + changed.upper().replace(" ", "\n"),
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0. Released under the MIT License!",
        " ".join(MIT.split()[: len(MIT.split()) // 2]),
        "the of license version and under the terms " * 2000,
        "ALL   rights\nreserved",
    ])
    assert got[0]["licenses"] == "MIT" and got[0]["best_coverage"] == 1.0 and got[0]["found"][0]["first"] == 60
    assert got[1]["licenses"] == "MIT" and 0.8 <= got[1]["best_coverage"] < 1
    assert got[2]["licenses"] == "CC-BY-NC-4.0,MIT" and got[2]["n_passages"] == 3 and got[2]["restricted"]
    assert got[3]["n_passages"] == 0 and got[3]["licenses"] == "" and got[3]["best_coverage"] == 0
    assert got[4]["n_passages"] == 0
    assert got[5]["licenses"] == "Reserved"


def test_scan_equals_search_without_candidates(spark, documents):
    """Aligning every template with every text finds the same passages."""
    all_ = licenses.templates()
    want = {}
    for r in documents.collect():
        words = licenses.np.array(licenses.word_ids(r["text"] or ""), licenses.np.uint64)
        want[r["doc_id"]] = licenses.distinct_passages([(a, b, c, t) for t in all_ for a, b, c in licenses.matches(words, t)])
    got = {r["doc_id"]: [f.asDict() for f in r["found"]] for r in licenses.license_scan(documents).collect()}
    assert got == want and any(want.values())


def test_odd_documents(spark, odd_documents, no_documents):
    assert licenses.license_scan(odd_documents).count() == odd_documents.count()
    assert licenses.license_scan(no_documents).count() == 0


def test_versions_and_variants_are_told_apart(spark):
    cases = {
        "Licensed under CC BY-SA 4.0.": ("CC-BY-SA-4.0", True),
        "Licensed under CC BY-ND 4.0.": ("CC-BY-ND-4.0", True),
        "Licensed under CC BY 3.0.": ("CC-BY-3.0", False),
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.": ("CC-BY-NC-SA-3.0", True),
        "This work is licensed under the GNU General Public License, version 2.": ("GPL-2.0", True),
        "This work is licensed under the GNU General Public License, version 9.": ("", False),
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": ("LGPL-2.1", True),
        "This work is licensed under the GNU Affero General Public License, version 3.": ("AGPL-3.0", True),
        "Licensed under the Mozilla Public License, version 2.0.": ("MPL-2.0", True),
        "Released under the ISC License.": ("ISC", False),
        "Released under the XYZ License.": ("", False),
        "Licensed under the Apache License, Version 1.1.": ("", False),
        "SPDX-License-Identifier: CC0-1.0": ("CC0-1.0", False),
    }
    got = scan(spark, [f"some words before. {c} Some words behind." for c in cases])
    assert {c: (got[i]["licenses"], got[i]["restricted"]) for i, c in enumerate(cases)} == cases


def test_whole_texts_are_found_as_themselves():
    folder = licenses.Path(licenses.__file__).parent / "license_texts"
    all_ = licenses.templates()
    for file, (_, name, _) in licenses._WHOLE.items():
        words = licenses.np.array(licenses.word_ids((folder / f"{file}.txt").read_text()), licenses.np.uint64)
        found = licenses.distinct_passages([(a, b, c, t) for t in all_ for a, b, c in licenses.matches(words, t)])
        best = max(found, key=lambda f: f["words"])
        assert (best["license"], best["coverage"]) == (name, 1.0), file


def exact_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = above[j - 1] + 1 if x == y else max(above[j], row[j - 1])
    return row[-1]


def test_large_gaps_are_aligned_exactly():
    """Sequences of a few words that repeat have no anchors at all: the common subsequence is as long as can be."""
    rng = random.Random(8)
    for size in (3, 80, 300):
        a, b = (tuple(rng.randrange(4) for _ in range(size + rng.randrange(20))) for _ in range(2))
        found = licenses._common_subsequence(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert len(found) == exact_length(a, b)
    once = tuple(range(1, 50))
    assert licenses._common_subsequence((7,), tuple([1] * 9000 + [7])) == [(0, 9000)]
    assert len(licenses.patience((1, 2) * 100 + once, once + (2, 1) * 100)) >= 49


def test_scan_against_all_windows_of_whole_texts(spark):
    """Passages with words left out, changed and put in, anywhere in prose: found if and only if some window covers enough."""
    rng = random.Random(11)
    template = licenses._template("X", "y", MIT)
    size = len(template.words)
    prose = [f"p{i}" for i in range(400)]
    width = 2 * size
    for trial in range(60):
        lost, put_in = rng.choice([0, 0.1, 0.3]), rng.choice([0, 0.3, 0.6])
        passage = []
        for w in MIT.split():
            if rng.random() >= lost:
                passage.append(w)
            if rng.random() < put_in:
                passage.append(rng.choice(prose))
        stray = [rng.choice(MIT.split())] + rng.choices(prose, k=rng.randrange(1, size)) if trial % 3 == 0 else []
        text = " ".join(rng.choices(prose, k=50) + stray + passage + rng.choices(prose, k=50))
        words = licenses.word_ids(text)
        best = max(exact_length(template.words, words[i : i + width]) for i in range(0, len(words), 7)) / size
        found = licenses.matches(licenses.np.array(words, licenses.np.uint64), template)
        if best >= 0.86:
            assert len(found) == 1 and found[0][2] >= best - 0.06, (trial, best, found)
        if best < 0.8:
            assert not found, (trial, best, found)


def test_a_stray_word_does_not_cut_the_end_off():
    template = licenses._template("X", "y", MIT)
    size = len(template.words)
    text = "software " + "zzz " * (size - 10) + MIT
    found = licenses.matches(licenses.np.array(licenses.word_ids(text), licenses.np.uint64), template)
    assert [f[2] for f in found] == [1.0] and found[0][1] - found[0][0] == size
