"""Benchmark decontamination: a broadcast hash set of normalised test n-grams meets every window of the documents.

Window hashes, of four of their words, are exploded next to the words and probe the broadcast set in the same stage; a hit counts
only after all its words have been compared. One pass over the texts, no shuffle of texts or windows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.naming import fresh
from shelfwise.sources.storage import write_once

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words.
BREAK = WORD.replace("^", "")
WIDTH = 10
#: Windows in one broadcast, about 200 bytes each; a larger benchmark is taken in blocks of that many.
BLOCK_WINDOWS = 500_000


def words(text: Column) -> Column:
    """Normalised words: A-Z lower-cased, split at every other ASCII character that is no digit; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, BREAK, -1), lambda w: w != "")


def _windows(count: Column, length: int | Column) -> Column:
    return F.greatest(count - length + 1, F.lit(0))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct ``item_id, window`` (array of words) of all items; an item of fewer words is one window, of none no row."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter("size(words) > 0")
    length = F.least(F.size("words"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    return items.select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("window")
    ).distinct()


def _key(array: Column | str, start: Column, length: Column | int) -> Column:
    """Hash of a window's first and last word and two between: a window with this key is compared word by word before it counts."""
    places = [0, length / 3, 2 * length / 3, length - 1] if isinstance(length, Column) else [0, length // 3, 2 * length // 3, length - 1]
    return F.xxhash64(*[F.get(array, (start + p).cast("int")) for p in places])


def _window_keys(length: int) -> Column:
    """Keys of all windows of that many words."""
    starts = F.sequence(F.lit(0), F.size("words") - length)
    keys = F.transform(starts, lambda i: _key("words", i, length))
    return F.when(F.size("words") >= length, keys).otherwise(F.array().cast("array<bigint>"))


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], with_documents: bool) -> DataFrame:
    """One row for every document and window occurrence, and one with a null window per document if asked for."""
    keys = [_window_keys(n) for n in lengths]
    # Element 0 stands for the document itself; the windows of each length follow.
    exploded = docs.select("*", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), *keys)).alias("_at", "_key"))
    start, length, rest = F.lit(1), F.lit(0), F.col("_at") - 1
    for n in reversed(lengths):
        before = sum((_windows(F.size("words"), m) for m in lengths[: lengths.index(n)]), F.lit(0))
        here = rest >= before
        start, length = F.when(here & (length == 0), rest - before + 1).otherwise(start), F.when(
            here & (length == 0), F.lit(n)
        ).otherwise(length)
    equal = F.slice("words", start, length) == F.col("window")
    same = (F.col("_at") > 0) & (F.col("_key") == F.col("_window_key")) & equal
    found = F.col("window").isNotNull() | (F.lit(with_documents) & (F.col("_at") == 0))
    return (
        exploded.join(F.broadcast(windows), same, "left")
        .filter(found)
        .select(
            "doc_id",
            "_text",
            F.size("words").cast("bigint").alias("n_words"),
            F.when(F.col("window").isNotNull(), F.struct(start.alias("start"), length.alias("length"))).alias("span"),
            F.when(F.col("window").isNotNull(), F.col("_window_id")).alias("_window_id"),
        )
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """Benchmark passages in every document.

    Returns one row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, text_hash``
    where ``spans`` are the word positions (start from 1, length) of all hit windows in order and ``text_hash`` tells rows of one
    id apart. Null and empty texts have no words
    and no hits; benchmark items without words match nothing; a null item id is left out of the items, its hits count.
    Repeated rows each get the same verdict. Only ``doc_id, text`` and ``item_id, text`` are read.
    Runs jobs: the hits of every document are a written table.
    """
    by_item = benchmark_windows(benchmark, width).withColumn("_window_id", F.md5(F.concat_ws(" ", "window")))
    distinct = by_item.select("window", "_window_id").distinct().withColumn("_window_key", _key("window", F.lit(0), F.size("window")))
    counted = distinct.groupBy(F.size("window").alias("n")).count().collect()  # at most one row per length
    lengths = sorted(r["n"] for r in counted) or [width]
    blocks = max(1, -(-sum(r["count"] for r in counted) // block_windows))

    texts = docs.select("doc_id", F.xxhash64("text").alias("_text"), words(F.col("text")).alias("words"))
    hits = None
    for block in range(blocks):
        part = distinct if blocks == 1 else distinct.filter(F.pmod("_window_key", F.lit(blocks)) == block)
        found = _hits(texts, part, lengths, with_documents=block == 0)
        hits = found if hits is None else hits.unionByName(found)

    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    documents = write_once(
        hits.groupBy("doc_id", "_text")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count_if(F.col("span").isNull()).alias("_rows"),
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.collect_set("_window_id").alias("_windows"),
        )
        .withColumn("n_hit", F.size(F.array_distinct(covered)).cast("bigint")),
        "contamination",
    )
    items = (
        documents.filter("n_hit > 0")
        .select("doc_id", "_text", F.explode("_windows").alias("_window_id"))
        .join(by_item.filter("item_id is not null").select("_window_id", "item_id"), "_window_id")
        .groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"))
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))
    found_items = F.coalesce("_items", F.array().cast("array<string>"))
    return (
        documents.join(items, same, "left")
        .withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size(found_items).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(found_items, ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            "spans",
            F.col("_text").alias("text_hash"),
        )
    )


def clean_documents(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose own text has no hit; other rows of the same id, or without one, do not count.

    The hit rows' ids and hashes are a written table, so the engine knows its size and, if it is small, broadcasts it in place of
    moving texts.
    """
    id_, hash_ = fresh(docs, "_id"), fresh(docs, "_hash")
    bad = verdicts.filter("contaminated").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    bad = write_once(bad, "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    return docs.join(bad, same, "left_anti")


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the words inside ``spans`` and what separates them; everything else stays as it is."""
    inside = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    pattern = WORD.replace(r"\x60", r"\x40\x5B-\x60")  # the words before lower-casing
    kept_words = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda w, i: F.when(F.array_contains(inside, i + 1), F.lit("")).otherwise(w),
    )
    gaps = F.split(text, pattern, -1)
    kept_gaps = F.transform(
        gaps, lambda g, i: F.when(F.array_contains(inside, i) & F.array_contains(inside, i + 1), F.lit("")).otherwise(g)
    )
    return F.array_join(
        F.zip_with(kept_gaps, kept_words, lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit("")))), ""
    )
