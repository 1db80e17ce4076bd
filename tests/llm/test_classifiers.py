import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import classifier, toxicity
from shelfwise.llm.queries import op4_quality_classifier, op7_toxicity
from shelfwise.llm.sampling import labelled_sample
from shelfwise.llm.textbytes import SpanHasher, mix

CHECKED = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{CHECKED}/labels.parquet").collect()}
    rows = op4_quality_classifier(spark, CHECKED).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    right = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)


def test_factorisation_identity():
    """The linear-time score equals the sum over all pairs of inputs."""
    random_ = np.random.default_rng(3)
    width = classifier.BUCKETS + classifier.STATISTICS
    machine = classifier.FactorisationMachine(
        0.3, random_.normal(size=width), random_.normal(size=(width, classifier.RANK)),
        np.zeros(classifier.STATISTICS), np.ones(classifier.STATISTICS),
    )
    rows, columns, values = np.array([0, 0, 0, 1, 1]), np.array([5, 9, 5 + classifier.BUCKETS, 2, 9]), random_.normal(size=5)
    got = machine.margin(rows, columns, values, 2)
    for text in (0, 1):
        at = np.flatnonzero(rows == text)
        want = 0.3 + sum(machine.weights[columns[i]] * values[i] for i in at)
        want += sum(machine.vectors[columns[i]] @ machine.vectors[columns[j]] * values[i] * values[j] for i in at for j in at if i < j)
        assert abs(got[text] - want) < 1e-9


def test_classifier_takes_anything(spark, odd_documents, no_documents, labels):
    machine = classifier.fit(odd_documents, spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id bigint, quality int"))
    scored = classifier.quality_scores(odd_documents, machine).collect()
    assert len(scored) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert classifier.quality_scores(no_documents, machine).count() == 0
    for known in ([], [(1, 1), (2, 1)], [(1, None), (None, 1)]):
        one = classifier.fit(odd_documents, spark.createDataFrame(known, "doc_id bigint, quality int"))
        assert {r["score"] >= 0.5 for r in classifier.quality_scores(odd_documents, one).collect()} == {True}


def test_toxic_documents_are_rejected_that_the_chain_has_not_seen(spark):
    """Fitted on two thirds of the labels, copies of their texts left out of the count on the rest."""
    docs, labels = (spark.read.parquet(f"{CHECKED}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    kept_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    chain = toxicity.fit_chain(docs, labels.filter(~kept_out))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {texts[i] for i in marked if not held(i) and i in texts}
    rows = {r["doc_id"]: r["rejected"] for r in toxicity.toxicity(docs, chain).collect()}
    unseen = [i for i in marked if held(i) and i in texts and texts[i] not in seen]
    toxic, clean = ([rows[i] for i in unseen if marked[i] == kind] for kind in (1, 0))
    # A third of the toxic labels there are of texts without a word that toxic texts of the small fitted part have.
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.03 * len(clean)
    assert op7_toxicity(spark, CHECKED).count() == 1000


def test_scores_equal_the_chain_by_hand(spark, odd_documents):
    """Marks found word by word in plain Python, and the links computed one after the other."""
    train = spark.createDataFrame(corpus(7, 500), "doc_id bigint, text string, toxic int")
    chain = toxicity.fit_chain(train.drop("toxic"), train.drop("text"))
    docs = train.drop("toxic").union(odd_documents.filter("length(text) < 200 or text is null").select("doc_id", "text"))
    place = {int(m): i for i, m in enumerate(chain.marks)}

    def hashed(raw, kind):
        data = np.frombuffer(raw, np.uint8)
        value = SpanHasher(data)(np.array([0]), np.array([len(data)]))
        return int((mix(value + np.uint64(kind)) if kind else value)[0])

    def by_hand(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(toxicity.LOWER[np.frombuffer((text or "").encode(), np.uint8)]))
        has = np.zeros(len(place))
        for w in words:
            for h in (hashed(w, 0), *(hashed(w[:k], k) for k in toxicity.PREFIXES)):
                if h in place:
                    has[place[h]] = 1
        out = []
        for weights in chain.weights:
            margin = weights[: len(has)] @ has + weights[len(has) : -1] @ np.array(out) + weights[-1]
            out.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
        return out

    want = sorted((r["doc_id"] or -1, *by_hand(r["text"])) for r in docs.collect())
    got = sorted((r["doc_id"] or -1, *(r[c] for c in toxicity.CATEGORIES)) for r in toxicity.toxicity(docs, chain).collect())
    assert np.allclose(np.array(want, float), np.array(got, float), atol=1e-9)


def test_copies_share_a_fold_and_repeated_ids_count_once(spark):
    rows = [(i % 50, f"word{i % 50} and more", i % 2) for i in range(400)] + [(3, "another text of three", 1)] * 30
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    sample = labelled_sample(docs, labels, "toxic", 10_000).collect()
    assert sorted(r["doc_id"] for r in sample) == list(range(50))
    assert toxicity.fit_chain(docs, labels).categories[-1] == "toxic"


def corpus(seed, rows):
    """Clean words, and in a third of the texts inflected forms of three stems."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(rng.randrange(20, 200))]
        bad = i % 3 == 0
        if bad:
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(["grubba", "FLOKKE", "snurt"]) + rng.choice(["", "s", "ing", "ed", "er"])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_held_out_accuracy_with_unseen_forms(spark):
    schema = "doc_id bigint, text string, toxic int"
    train = spark.createDataFrame(corpus(1, 900), schema)
    chain = toxicity.fit_chain(train.drop("toxic"), train.drop("text"))
    fresh = corpus(2, 300) + [(900, "a1 b2 c3 d4 e5 f6 grubbation g7 h8 " * 3, 1), (901, "a1 b2 c3 d4 " * 50, 0)]
    docs = spark.createDataFrame(fresh, schema)
    label = {i: bool(bad) for i, _, bad in fresh}
    wrong = [r for r in toxicity.toxicity(docs, chain).collect() if r["rejected"] != label[r["doc_id"]]]
    assert len(wrong) <= 3
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, chain).collect()}
    assert kept == {r["doc_id"] for r in toxicity.toxicity(docs, chain).filter("not rejected").collect()}


def test_later_categories_see_earlier_ones(spark):
    train = spark.createDataFrame(corpus(4, 600), "doc_id bigint, text string, toxic int")
    chain = toxicity.fit_chain(train.drop("toxic"), train.drop("text"))
    assert [len(w) for w in chain.weights] == [len(chain.marks) + 1 + k for k in range(3)]
    assert chain.categories == ("dense", "repeated", "toxic")
    assert chain.weights[2][len(chain.marks) + 1] > 0


def test_chain_takes_anything(spark, odd_documents, no_documents):
    for known in ([], [(1, 1)], [(i, i % 2) for i in range(9)], [(1, None), (None, 1), (1, 0), (1, 1)]):
        chain = toxicity.fit_chain(odd_documents, spark.createDataFrame(known, "doc_id bigint, toxic int"))
        assert toxicity.toxicity(odd_documents, chain).count() == odd_documents.count()
        assert toxicity.toxicity(no_documents, chain).count() == 0
        kept = toxicity.without_toxic(odd_documents, chain)
        assert kept.schema == odd_documents.schema
    none = toxicity.fit_chain(no_documents, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.without_toxic(odd_documents, none).count() == odd_documents.count()


def test_fitting_the_chain_holds_one_array_of_inputs():
    """The driver held the inputs of a model three times."""
    import tracemalloc

    rng = np.random.default_rng(3)
    has, y = rng.random((2000, 300)) < 0.1, (rng.random(2000) < 0.5).astype(float)
    columns, earlier = list(range(0, 300, 2)), rng.random((2000, 1))
    rows = np.flatnonzero(rng.random(2000) < 0.7)
    before = np.column_stack([has[:, columns], earlier, np.ones(2000)])[rows]
    tracemalloc.start()
    inputs = toxicity._inputs(has, earlier, rows, columns)
    weights = toxicity.fit_logistic(inputs, y[rows], steps=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (inputs == before).all() and len(weights) == inputs.shape[1]
    assert peak < 1.5 * inputs.nbytes
