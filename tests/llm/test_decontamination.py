import re

from shelfwise.llm import decontamination as dc

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found - {None}), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, **options):
    got = dc.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"),
        **options,
    )
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got.collect()]
    assert sorted(rows, key=str) == brute(docs, items)


LONG = " ".join(f"t{i}" for i in range(25))
ITEMS = [(1, LONG), (2, "short item"), (3, "short ITEM!"), (4, ""), (5, None), (6, "été déjà vu"), (None, "nobody knows this item")]


def test_windows_of_all_lengths(spark):
    docs = [
        (1, "x " + LONG.upper().replace(" ", ", ") + " y"), (2, " ".join(LONG.split()[5:14])), (3, " ".join(LONG.split()[5:15])),
        (4, "a short  item, SHORT item"), (5, "Été déjà-vu"), (6, None), (7, ""), (8, "short"), (None, "short item"),
        (9, "short item")] + [(10, "short item"), (10, "short item"), (10, "other")] + [(11, "nobody knows this item")]
    check(spark, docs, ITEMS)


def test_windows_in_blocks(spark):
    docs = [(i, f"a b {' '.join(LONG.split()[i % 20 :])} short item") for i in range(40)]
    check(spark, docs, ITEMS, block_windows=3)


def test_empty_tables_and_odd_documents(spark, odd_documents, no_documents):
    items = [(1, "Ünïcödé 中文 x"), (2, "word1x1 word2x2 word3x3")]
    check(spark, [(r["doc_id"], r["text"]) for r in odd_documents.collect()], items)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert dc.contamination(no_documents, benchmark).count() == 0
    verdicts = dc.contamination(odd_documents, benchmark.filter("false"))
    assert verdicts.count() == odd_documents.count() and verdicts.filter("contaminated").count() == 0
    clean = dc.clean_documents(odd_documents, dc.contamination(odd_documents, benchmark))
    assert clean.columns == odd_documents.columns and clean.filter("doc_id = 8").count() == 0
    assert clean.filter("doc_id is null").count() == 1


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, f"Keep this, {LONG}. And this."), (2, "Nothing here.")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    spans = dc.contamination(docs, benchmark).select("doc_id", "spans")
    cut = docs.join(spans, "doc_id").select("doc_id", dc.cut_spans(docs["text"], spans["spans"]).alias("t"))
    texts = {r["doc_id"]: r["t"] for r in cut.collect()}
    assert texts[2] == "Nothing here." and texts[1] == "Keep this, . And this."


def test_only_the_hit_rows_of_an_id_go(spark):
    rows = [(None, f"bad {LONG}"), (None, "a clean text"), (None, None), (1, LONG), (1, "clean too"), (1, "clean too"), (2, LONG)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    benchmark = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    clean = dc.clean_documents(docs, dc.contamination(docs, benchmark))
    left = [(None, "a clean text"), (None, None), (1, "clean too"), (1, "clean too")]
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(left, key=str)


def test_windows_that_share_the_hashed_words_only_do_not_count(spark):
    """Keys hash four words of a window; they hashed all ten, most of the operator's work."""
    w = [f"w{i}" for i in range(10)]
    other = [x if i in (0, 3, 6, 9) else f"v{i}" for i, x in enumerate(w)]
    items = [(1, " ".join(w)), (2, "a b c"), (3, "a x c"), (4, "a"), (5, "a a")]
    docs = [(1, " ".join(["x", *w, "y"])), (2, " ".join(["x", *other, "y"])), (3, "a b c, A a!"), (4, "z a z c"), (5, None)]
    check(spark, docs, items)
    check(spark, docs, items, block_windows=2)
    assert str(dc._window_keys(10)).count("get") == 4


def test_words_are_what_lies_between_breaks(spark):
    texts = ["", "...", "A-b  Cé`d[E]", "-x-", "x", None, "ÀB\u00a0c\u2003d"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(dc.words(dc.F.col("t"))).collect()
    assert [r[0] for r in found] == [words(t) for t in texts]
