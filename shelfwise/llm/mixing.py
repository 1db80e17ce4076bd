"""Mixing sources to target weights: hash-threshold histograms.

Every document has a fixed hash. Per source, token counts are summed by hash bucket; the bucket in which the budget runs out
is the only one that is looked into again, with the next bits of the hash, until one hash decides. Documents below the
resulting threshold are taken: a filter, no sort. A larger budget moves the threshold up, so mixes are nested.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.naming import fresh
from shelfwise.sources.storage import write_once

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key as text, the same on every run and engine; null is hashed as the text ``null``."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: Fraction, repeats: int) -> DataFrame:
    """Target of every source as an exact fraction ``num / den``, from one row per source (``source, source_size``).

    Sources take the weights in turn by code point, null last. A target above ``repeats`` times the source's size stops
    there and the excess is shared again by weight: in ascending order of size per weight, a source is capped as long as
    the share that is left for it exceeds its cap. Windows here run over one row per source.
    """
    lcm = math.lcm(*weights)
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), turn + 1)
    earlier = Window.orderBy("per_weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # All amounts in parts of a word, so that they stay whole numbers: share = parts / unit.
    unit, parts = share.denominator, share.numerator
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * repeats * unit)
        .withColumn("per_weight", F.expr(f"source_size * {lcm} div weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * parts)
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    )
    capped = (F.col("budget") - F.col("cap_before")) * F.col("weight") > F.col("cap") * (
        F.col("weights") - F.col("weight_before")
    )
    of_capped = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(whole), F.lit(0))
    return (
        ranked.withColumn("capped", capped)
        .withColumn("rest", F.col("budget") - of_capped("cap"))
        .withColumn("open_weight", F.col("weights") - of_capped("weight"))
        .select(
            "source",
            "source_size",
            F.when(F.col("capped"), F.col("cap")).otherwise(F.col("rest") * F.col("weight")).alias("num"),
            F.when(F.col("capped"), F.lit(unit)).otherwise(F.col("open_weight") * unit).cast("bigint").alias("den"),
        )
        .withColumn("passes", F.expr("coalesce(num div nullif(den * source_size, 0), 0)"))
        .withColumn("left_num", F.col("num") - F.col("passes") * F.col("den") * F.col("source_size"))
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``threshold``: documents of the source whose hash is below it fill what whole passes leave of the target.

    Runs one small job per level of the hash; every level but the first reads only the boundary buckets' documents.
    """
    open_ = write_once(
        targets.withColumn("before", F.lit(0).cast("bigint")).withColumn("bucket", F.lit(0).cast("bigint")), "mix-level"
    )
    done = None
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        b = open_.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"))
        inside = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("_b"))
        histogram = (
            sized.join(b, inside, "left_semi" if level > 1 else "inner")
            .groupBy(F.col("source").alias("_s"), F.shiftright("hash", shift).alias("_b"))
            .agg(F.sum("size").alias("_n"), F.min("hash").alias("_low"), F.max("hash").alias("_high"))
        )
        below = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        over = (
            histogram.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
            .join(open_, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("_before", F.col("before") + F.col("_below"))
            .filter((F.col("_before") + F.col("_n")) * F.col("den") > F.col("left_num"))
        )
        first = Window.partitionBy("source").orderBy("_b")
        nearer = (2 * F.col("_before") + F.col("_n")) * F.col("den") <= 2 * F.col("left_num")
        boundary = write_once(
            over.withColumn("_rank", F.row_number().over(first))
            .filter("_rank = 1")
            .withColumn("single", F.col("_low") == F.col("_high"))
            .withColumn("threshold", F.when(nearer, F.col("_high") + 1).otherwise(F.col("_low")))
            .select(*targets.columns, F.col("_before").alias("before"), F.col("_b").alias("bucket"), "single", "threshold"),
            "mix-level",
        )
        found = boundary.filter("single").select("source", "threshold")
        done = found if done is None else done.unionByName(found)
        open_ = boundary.filter("not single").drop("single", "threshold")
        if open_.isEmpty():
            break
    # A source without words has no boundary; nothing of it is left to take.
    return targets.join(
        done.select(F.col("source").alias("_s"), "threshold"), F.col("source").eqNullSafe(F.col("_s")), "left"
    ).select(*targets.columns, F.coalesce("threshold", F.lit(0)).alias("threshold"))


def _sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """The narrow table all figures come from, written."""
    return write_once(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            document_hash(F.col(key)).alias("hash"),
        ),
        "mix-sizes",
    )


def _limits(sized: DataFrame, weights: tuple[int, ...], share: Fraction, repeats: int) -> DataFrame:
    """One row per source (``_s``): its size, target, whole passes and the hash below which a document is taken once more."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, repeats)
    return write_once(thresholds(sized, targets).withColumnRenamed("source", "_s"), "mix-limits")


def _copies(hash_: Column, passes: Column, threshold: Column) -> Column:
    return (passes + F.when(hash_ < threshold, 1).otherwise(0)).cast("bigint")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    repeats: int = 2,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """How often every document enters a mix of ``share`` times all words, split over the sources by weight.

    Returns ``doc_id, source, hash, size, source_size, target, copies, taken``, one row per row of ``docs``. A null text is
    empty, an empty text has size 0; null sources are one source; a null key is a key like any other. Rows with equal keys
    and source share a hash and are taken or left together, so repeated rows can move a source off its target by their
    size. Columns of ``docs`` other than the three named are not read. An empty table gives an empty result.
    Writes the narrow size table and one row per source and level; the documents are read once.
    """
    sized = _sized(docs, key, source, text)
    limits = _limits(sized, weights, share, repeats)
    return (
        sized.join(limits, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", _copies(F.col("hash"), F.col("passes"), F.col("threshold")))
        .select(
            "doc_id",
            "source",
            "hash",
            "size",
            "source_size",
            (F.col("num") / F.col("den")).alias("target"),
            "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def apply_mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), repeats: int = 2
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` says, by the columns ``doc_id, source, text``.

    A filter: a document's hash is held against its source's limits, one small written row per source, which the engine
    broadcasts if they are small enough. Texts are neither sorted nor, then, moved. The documents are read twice.
    """
    limits = _limits(_sized(docs, "doc_id", "source", "text"), weights, share, repeats)
    source, passes, threshold, copy = (fresh(docs, name) for name in ("_source", "_passes", "_threshold", "_copy"))
    narrow = limits.select(F.col("_s").alias(source), F.col("passes").alias(passes), F.col("threshold").alias(threshold))
    copies = _copies(document_hash(F.col("doc_id")), F.col(passes), F.col(threshold))
    return (
        docs.join(narrow, F.col("source").eqNullSafe(F.col(source)))
        .withColumn(copy, copies)
        .filter(F.col(copy) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copy))))
        .select(*[F.col(c) for c in docs.columns])
    )
