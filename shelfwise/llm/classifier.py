"""Quality classifier: a factorisation machine over hashed words and structure statistics of whole texts.

The score of a text with inputs x is ``w0 + w.x`` plus all pairwise interactions, whose strengths are products of low-rank
vectors: ``sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``, linear in the number of inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.sampling import labelled_sample
from shelfwise.llm.textbytes import LOWER, SpanHasher, Texts, chunks, words_of
from shelfwise.sources.storage import write_once

#: Labelled documents the model is fitted on, about; buckets of hashed words; rank of the interactions.
SAMPLE_ROWS, BUCKETS, RANK = 4000, 1 << 14, 8
EPOCHS, STEP, PENALTY = 60, 0.05, 1e-4

Batches = Iterator[pa.RecordBatch]


def _mask(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_CLASSES = {
    "upper": _mask(bytes(range(65, 91))),
    "digit": _mask(bytes(range(48, 58))),
    "symbol": _mask(b"#*$%&|<>"),
    "shout": _mask(b"!"),
    "comma": _mask(b",;:"),
    "stop": _mask(b".?"),
    "wide": np.arange(256) >= 0x80,
    "feed": _mask(b"\n"),
}
STATISTICS = 7 + len(_CLASSES)


def inputs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed-word inputs as (text, bucket, value), and the matrix of structure statistics.

    A word bucket's value is its share of the text's words under the Euclidean norm.
    """
    n = len(texts)
    data = LOWER[texts.data]
    words = words_of(Texts(data, texts.offsets, texts.first_row))
    counts, owner = words.counts, words.text_of()
    total = np.maximum(counts, 1)
    hashes = SpanHasher(data)(words.starts, words.ends)

    # Distinct words of every text, by full hash, and how often they occur.
    keys = (owner.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12))
    distinct, times = np.unique(keys, return_counts=True)
    of = (distinct >> np.uint64(52)).astype(np.int64)
    n_distinct = np.bincount(of, minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, times)
    bucket_keys, place = np.unique(of * BUCKETS + (distinct % np.uint64(BUCKETS)).astype(np.int64), return_inverse=True)
    value = np.bincount(place, times, len(bucket_keys))
    text, bucket = bucket_keys // BUCKETS, bucket_keys % BUCKETS
    norm = np.sqrt(np.bincount(text, value * value, n))
    value = value / norm[text]

    size = np.diff(texts.offsets)
    sized = np.maximum(size, 1)
    neighbours = np.append(hashes[1:] == hashes[:-1], False) if len(hashes) else np.zeros(0, bool)
    last = words.bounds[1:][counts > 0] - 1
    neighbours[last] = False
    columns = [
        np.log1p(counts),
        np.log1p(size),
        size / total,
        n_distinct / total,
        most / total,
        np.bincount(owner[neighbours], minlength=n) / total,
        np.bincount(owner, words.ends - words.starts == 1, n) / total,
    ]
    for table in _CLASSES.values():
        sums = np.concatenate([[0], np.cumsum(table[texts.data])])
        columns.append((sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]) / sized)
    return text, bucket, value, np.column_stack(columns)


@dataclass
class FactorisationMachine:
    """Weights of all inputs: the word buckets, then the statistics, which are centred, scaled and clipped."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def all_inputs(
        self, text: np.ndarray, bucket: np.ndarray, value: np.ndarray, statistics: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(statistics)
        scaled = np.clip((statistics - self.mean) / self.scale, -4, 4) / 2
        order = np.argsort(np.concatenate([text, np.repeat(np.arange(n), STATISTICS)]), kind="stable")
        rows = np.concatenate([text, np.repeat(np.arange(n), STATISTICS)])[order]
        columns = np.concatenate([bucket, np.tile(BUCKETS + np.arange(STATISTICS), n)])[order]
        return rows, columns, np.concatenate([value, scaled.ravel()])[order]

    def margin(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic function; rows ascend and every text has its statistics."""
        begins = np.searchsorted(rows, np.arange(n))
        linear = np.add.reduceat(self.weights[columns] * values, begins)
        weighted = self.vectors[columns] * values[:, None]
        sums = np.add.reduceat(weighted, begins, axis=0)
        squares = np.add.reduceat(weighted * weighted, begins, axis=0)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], y: np.ndarray) -> FactorisationMachine:
    """Fit by Adam over all rows at once, classes weighted alike."""
    text, bucket, value, statistics = parts
    n, width = len(y), BUCKETS + STATISTICS
    random = np.random.default_rng(7)
    mean, scale = statistics.mean(axis=0), np.maximum(statistics.std(axis=0), 1e-6)
    machine = FactorisationMachine(0.0, np.zeros(width), random.normal(0, 0.05, (width, RANK)), mean, scale)
    rows, columns, values = machine.all_inputs(text, bucket, value, statistics)
    begins = np.searchsorted(rows, np.arange(n))
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    balance = np.where(y == 1, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9)) / n
    moments = [np.zeros((width, RANK + 1)), np.zeros((width, RANK + 1))]
    bias_moments = [0.0, 0.0]
    for t in range(1, EPOCHS + 1):
        weighted = machine.vectors[columns] * values[:, None]
        sums = np.add.reduceat(weighted, begins, axis=0)
        squares = np.add.reduceat(weighted * weighted, begins, axis=0)
        linear = np.add.reduceat(machine.weights[columns] * values, begins)
        margin = machine.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)
        error = (sigmoid(margin) - y) * balance
        pull = error[rows] * values
        gradient = np.empty((width, RANK + 1))
        gradient[:, 0] = np.bincount(columns, pull, width) + PENALTY * machine.weights
        inner = pull[:, None] * (sums[rows] - weighted)
        for f in range(RANK):
            gradient[:, f + 1] = np.bincount(columns, inner[:, f], width) + PENALTY * machine.vectors[:, f]
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = STEP * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        machine.weights -= move[:, 0]
        machine.vectors -= move[:, 1:]
        bias_moments = [0.9 * bias_moments[0] + 0.1 * error.sum(), 0.999 * bias_moments[1] + 0.001 * error.sum() ** 2]
        machine.bias -= STEP * (bias_moments[0] / (1 - 0.9**t)) / (np.sqrt(bias_moments[1] / (1 - 0.999**t)) + 1e-8)
    return machine


def _input_batches(batches: Batches) -> Batches:
    for batch in batches:
        for part in chunks(batch.column("text")):
            text, bucket, value, statistics = inputs(part)
            cuts = np.searchsorted(text, np.arange(1, len(part)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[part.first_row : part.first_row + len(part)],
                    batch.column("label")[part.first_row : part.first_row + len(part)],
                    pa.array([b.astype(np.int32) for b in np.split(bucket, cuts)], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for v in np.split(value, cuts)], pa.list_(pa.float32())),
                    pa.array(list(statistics), pa.list_(pa.float64())),
                ],
                ["doc_id", "label", "buckets", "values", "statistics"],
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fit on about ``sample_rows`` labelled documents (all, if there are fewer), chosen by hash of the id.

    The inputs of the sample come to the driver, at most some hundred numbers a document. Without labels, or with one class
    only, the model gives every text the same score: 0.5, or that of the only class.
    """
    sample = write_once(labelled_sample(docs, labels, label, sample_rows), "labelled")
    rows = (
        sample.mapInArrow(
            _input_batches, "doc_id bigint, label int, buckets array<int>, values array<float>, statistics array<double>"
        )
        .orderBy("doc_id")
        .toArrow()
    )
    y = rows.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        constant = 0.0 if not len(y) else (4.0 if y[0] == 1 else -4.0)
        empty = np.zeros(BUCKETS + STATISTICS)
        return FactorisationMachine(constant, empty, np.zeros((len(empty), RANK)), np.zeros(STATISTICS), np.ones(STATISTICS))
    lists = [rows.column(c).combine_chunks() for c in ("buckets", "values", "statistics")]
    text = np.repeat(np.arange(len(y)), np.diff(lists[0].offsets.to_numpy()))
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
    return train((text, flat[0].astype(np.int64), flat[1].astype(float), flat[2].reshape(len(y), -1)), y)


def _score_batches(machine: FactorisationMachine) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in chunks(batch.column("text")):
                scores = sigmoid(machine.margin(*machine.all_inputs(*inputs(part)), len(part)))
                rows = slice(part.first_row, part.first_row + len(part))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], pa.array(scores)], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, machine: FactorisationMachine) -> DataFrame:
    """``doc_id, score`` of every row: the whole text is scored, nothing else is read. Null and empty texts have no
    words and are scored by their statistics, all of them zero; repeated rows get equal scores."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, score double"
    return docs.select("doc_id", "text").mapInArrow(_score_batches(machine), schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from the fit: a third of the ids, by the CRC of the id as text; null ids are not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
