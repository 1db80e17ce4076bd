import re

from llm.test_neardup import brute as groups_of

import corpus_pipeline
from shelfwise.llm import decontamination, mixing, neardup, tokenfile, toxicity

SMALL = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir):
    """The documents after each stage."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        out.append(docs)
    return out


def test_stages_decide_as_their_operators_and_as_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean, single, safe, mixed, tokens = stages(spark, docs, SMALL)
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.toxicity(docs, chain).filter("rejected").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = sorted(set(texts) - rejected)
    assert sorted(r["doc_id"] for r in clean.collect()) == left

    low = groups_of([(d, texts[d]) for d in left], width=5)
    left = sorted(set(low.values()))
    assert sorted(r["doc_id"] for r in single.collect()) == left

    words = lambda t: re.findall(decontamination.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    left = [d for d in left if not any(tuple(w[i : i + 10]) in windows for w in [words(texts[d])] for i in range(len(w) - 9))]
    assert sorted(r["doc_id"] for r in safe.collect()) == left

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(safe).collect()}
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(d for d in left for _ in range(copies[d]))
    for frame in (clean, single, safe, mixed):
        assert frame.columns == docs.columns
    assert sorted(r["doc_id"] for r in tokens.collect()) == sorted(d for d in left for _ in range(copies[d]))
    assert corpus_pipeline.run(spark, SMALL).count() == tokens.count()
    assert (neardup.WIDTH, neardup.PERCENT, tokenfile.END_ID) == (5, 80, 0)


def test_odd_documents_pass_all_stages(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        done = stages(spark, docs, SMALL)
        assert all(frame.schema == docs.schema for frame in done[:3])
        assert done[3].columns == docs.columns
        done[4].collect()
