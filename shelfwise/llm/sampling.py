"""A bounded sample of labelled documents to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` (int) of about ``rows`` labelled documents, or of all if there are fewer.

    Rows are chosen by hash of the id, so the choice does not depend on how the tables are split. The chosen labels, bounded by
    ``rows`` and small, go to the documents, not the documents' texts to the labels. A document labelled several times
    counts once, with its largest label; null ids and labels are left out, null texts count as empty. Of an id that
    stands in several rows one text counts, the one with the smallest hash, so the sample is bounded whatever the documents.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("_id"))
        .agg(F.max(F.col(label)).cast("int").alias("label"))
    )
    share = min(1.0, rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(_PARTS)) < int(share * _PARTS))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return (
        texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .groupBy("doc_id", "label")
        .agg(first.alias("first"))
        .select("doc_id", F.col("first.text").alias("text"), "label")
    )
