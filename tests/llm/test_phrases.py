"""Phrase collocations against a count of all phrases in plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import phrases

ALL = phrases.Sieve(64, np.full(1, 2**64 - 1, np.uint64))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(docs, least, top):
    found, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for order in range(1, 6):
                for i in range(len(words) - order + 1):
                    found.setdefault(lang, Counter())[tuple(words[i : i + order])] += 1
    rows = []
    for lang, counts in found.items():
        kept = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            inside = any(
                f >= a and len(longer) > len(phrase) and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
                for longer, f in counts.items()
                if f >= least
            )
            if inside:
                continue
            cuts = [(counts[phrase[:k]], counts[phrase[k:]]) for k in range(1, len(phrase))]
            scores = [1000 * a * totals[lang] // (x * y) for x, y in cuts]
            best = scores.index(min(scores))
            kept.append((-scores[best], -a, " ".join(phrase).encode(), cuts[best]))
        for rank, (score, a, phrase, (x, y)) in enumerate(sorted(kept)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, x, y, totals[lang], -score))
    return sorted(rows)


def spark_rows(spark, docs, **options):
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "\U0001f600", "\x00", "a-b", "\x1fz"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " \r\n", "! ", " "]
    docs = [(None if i % 7 == 0 else ["en", "de"][i % 2],
             "".join(words[w] + ends[e] for w, e in zip(rng.integers(0, len(words), 60), rng.integers(0, len(ends), 60))))
            for i in range(60)]
    docs += [("en", "one two three four five six, one two three four five six")] * 8 + [("und", "one two")] * 9
    docs += [("en", None), ("en", ""), (None, None), ("xx", " \t\n.")]
    for least, top in ((3, 2000), (6, 5)):
        assert spark_rows(spark, docs, least=least, top=top) == brute(docs, least, top)


def test_ties_keep_the_smallest_cut(spark):
    rows = spark_rows(spark, [("en", "a b c")] * 4, least=2)
    assert rows == [("en", 1, "a b c", 4, 4, 4, 12, 3000)]


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([(3 * 10**15, [10**15 + 1], [10**15 + 3], 10**16)], "f bigint, firsts array<bigint>, rests array<bigint>, n bigint")
    cut = counts.selectExpr(f"{phrases._SCORED} AS cut").first()["cut"]
    assert cut["score"] == 1000 * 3 * 10**15 * 10**16 // ((10**15 + 1) * (10**15 + 3))


@pytest.mark.parametrize("limit", [16, 64, 1000])
def test_long_texts_in_parts_count_every_phrase_once(monkeypatch, limit):
    text = " ".join(f"w{i % 13}" for i in range(300)) + ". " + "x" * 200 + " y z, " + "a b c d e f g " * 20
    monkeypatch.setattr(phrases, "_CHUNK_BYTES", limit)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])

    def counted(stripes):
        total = Counter()
        for b in stripes:
            for prefix, word, n in zip(*(b.column(c).flatten().to_pylist() for c in ("prefix", "next", "counts"))):
                total[(prefix, word)] += n
        return total

    want = {order: Counter() for order in range(1, 6)}
    for words in pieces(text):
        for order in want:
            for i in range(len(words) - order + 1):
                want[order][" ".join(words[i : i + order - 1]), words[i + order - 1]] += 1
    short = counted(phrases._count_phrases(range(1, 3))(iter([batch])))
    assert short.pop((None, "")) == sum(want[1].values()) and short == want[1] + want[2]
    assert counted(phrases._count_phrases(range(3, 6), ALL)(iter([batch]))) == want[3] + want[4] + want[5]


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    docs = [("en", "one two three two one two three")] * 5
    want = spark_rows(spark, docs, least=4)
    monkeypatch.setattr(phrases, "sieve_of", lambda frequent: ALL)
    assert spark_rows(spark, docs, least=4) == want == brute(docs, 4, 2000)


def test_odd_and_empty_tables(odd_documents, no_documents):
    docs = [(r["lang"], r["text"]) for r in odd_documents.select("lang", "text").collect()]
    short = [d for d in docs if len(d[1] or "") < 1000]
    found = phrases.collocations(odd_documents.filter("length(text) < 1000 or text is null"), least=2)
    assert sorted(tuple(r) for r in found.collect()) == brute(short, 2, 2000)
    assert phrases.collocations(odd_documents, least=2).count() > 0
    assert phrases.collocations(no_documents).collect() == []
