"""Toxicity by a classifier chain over hashed words and word beginnings.

The categories are ordered, degrees of toxicity first and the label's own last, whose model decides. Each has a linear model
whose inputs are the marks found in a text and the probabilities of the categories before it; in training these earlier
probabilities are out-of-fold predictions, so that a later model sees them as unsure as they will be on new texts. The marks
are the words and word beginnings (4, 5 and 6 bytes, for inflected forms) that tell the classes of the fitting sample apart
best. Folds are made of whole texts (copies share one), and for each fold the marks are chosen without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.sampling import labelled_sample
from shelfwise.llm.textbytes import LOWER, SpanHasher, Texts, chunks, mix, words_of
from shelfwise.sources.storage import write_once

#: Labelled documents a chain is fitted on, about; marks it keeps; documents a mark must be in.
SAMPLE_ROWS, MARKS, LEAST_DOCUMENTS = 8000, 512, 3
#: Likelihood ratio from which a mark counts as one (chance of one in a thousand).
LEAST_STRENGTH = 10.8
FOLDS = 3
PREFIXES = (4, 5, 6)
CATEGORIES = ("dense", "repeated", "toxic")

_letter = np.zeros(256, bool)
for _range in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _letter[slice(*_range)] = True

_COUNTED_NAMES = ["mark", *(f"{kind}{k}" for k in range(FOLDS) for kind in ("n", "with"))]

Batches = Iterator[pa.RecordBatch]


def text_marks(texts: Texts) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, one array per kind; the text of every word; word counts."""
    data = LOWER[texts.data]
    words = words_of(Texts(data, texts.offsets, texts.first_row), _letter)
    hashed = SpanHasher(data)
    kinds = [hashed(words.starts, words.ends)]
    for length in PREFIXES:
        # The kind is part of the hash; a word shorter than that has its whole self as its beginning.
        kinds.append(mix(hashed(words.starts, np.minimum(words.ends, words.starts + length)) + np.uint64(length)))
    return kinds, words.text_of(), words.counts


def _count_marks() -> Callable[[Batches], Batches]:
    """Documents with each mark per fold, and how many of them carry the label, of one task's part of the sample."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            label, fold = (np.asarray(batch.column(c)).astype(np.int64) for c in ("label", "fold"))
            for part in chunks(batch.column("text")):
                kinds, owner, _ = text_marks(part)
                marks = np.concatenate(kinds)
                owners = np.tile(owner, len(kinds))
                order = np.lexsort((owners, marks))
                marks, owners = marks[order], owners[order]
                if not len(marks):
                    continue
                fresh = np.append(True, (marks[1:] != marks[:-1]) | (owners[1:] != owners[:-1]))
                marks, owners = marks[fresh], owners[fresh]
                distinct, first = np.unique(marks, return_index=True)
                of_fold, with_label = fold[part.first_row + owners], label[part.first_row + owners]
                counts = [np.add.reduceat((of_fold == k) * x, first) for k in range(FOLDS) for x in (1, with_label)]
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *map(pa.array, counts)], _COUNTED_NAMES)

    return run


class MarkFinder:
    """Which of the chosen marks the texts of a chunk hold."""

    def __init__(self, marks: np.ndarray):
        self.order = np.argsort(marks)
        self.sorted = marks[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(marks & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, mark index) pairs, and word counts."""
        kinds, owner, counts = text_marks(texts)
        rows, columns = [], []
        for hashes in kinds:
            at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.sorted, hashes[at]), max(len(self.sorted) - 1, 0))
            right = self.sorted[place] == hashes[at] if len(self.sorted) else np.zeros(len(at), bool)
            rows.append(owner[at[right]])
            columns.append(self.order[place[right]])
        pairs = np.unique(np.concatenate(rows) * (len(self.sorted) + 1) + np.concatenate(columns))
        return pairs // (len(self.sorted) + 1), pairs % (len(self.sorted) + 1), counts


def _find_marks(marks: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        finder = MarkFinder(marks)
        for batch in batches:
            for part in chunks(batch.column("text")):
                rows, columns, counts = finder(part)
                lists = [c.tolist() for c in np.split(columns, np.searchsorted(rows, np.arange(1, len(part))))]
                label, fold = (batch.column(c)[part.first_row : part.first_row + len(part)] for c in ("label", "fold"))
                held = pa.array(lists, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([label, fold, pa.array(counts, pa.int64()), held], ["label", "fold", "words", "marks"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(has: np.ndarray, earlier: np.ndarray, rows: np.ndarray, columns: list[int]) -> np.ndarray:
    """What a model sees of some rows, one array made in one step: some marks, the earlier probabilities and, last, a 1."""
    inputs = np.ones((len(rows), len(columns) + earlier.shape[1] + 1))
    for at, column in enumerate(columns):
        inputs[:, at] = has[rows, column]
    inputs[:, len(columns) : -1] = earlier[rows]
    return inputs


def fit_logistic(inputs: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 400) -> np.ndarray:
    """Weights and, last, the intercept of a linear model under logistic loss, both classes weighing alike.

    The last column of ``inputs`` is 1; they are the driver's largest array and not copied. Accelerated gradient descent over all rows; the step comes from the largest eigenvalue of the weighted inputs.
    """
    weights = np.zeros(inputs.shape[1])
    if len(y) == 0 or y.min() == y.max():
        weights[-1] = 5.0 if len(y) and y[0] else -5.0
        return weights
    balance = len(y) / 2 * np.where(y == 1, 1 / y.sum(), 1 / (len(y) - y.sum()))
    top = np.ones(inputs.shape[1])
    for _ in range(30):
        top = inputs.T @ (balance * (inputs @ (top / np.linalg.norm(top))))
    step = 1 / (0.3 * np.linalg.norm(top) + penalty)
    ridge = np.full(inputs.shape[1], penalty)
    ridge[-1] = 0
    ahead, old = weights.copy(), weights.copy()
    for t in range(steps):
        error = balance * (_sigmoid(inputs @ ahead) - y)
        weights = ahead - step * (inputs.T @ error + ridge * ahead)
        ahead = weights + t / (t + 3) * (weights - old)
        old = weights
    return weights


@dataclass
class Chain:
    """The marks, per category the weights (marks, earlier categories' probabilities, intercept), and the probability of the
    last category from which a text is rejected."""

    marks: np.ndarray
    weights: list[np.ndarray]
    threshold: float = 0.5
    categories: tuple[str, ...] = CATEGORIES

    def scores(self, rows: np.ndarray, columns: np.ndarray, n_texts: int) -> np.ndarray:
        """Probabilities, texts by categories, from the (text, mark) pairs found."""
        found = np.zeros((n_texts, 0))
        for weights in self.weights:
            earlier = found.shape[1]
            margin = np.bincount(rows, weights[columns], n_texts) if len(rows) else np.zeros(n_texts)
            margin = margin + found @ weights[len(self.marks) : len(self.marks) + earlier] + weights[-1]
            found = np.column_stack([found, _sigmoid(margin)])
        return found


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The cut with fewest errors on scores of unseen texts, in the middle (of the logits) between its neighbours."""
    if len(y) == 0 or y.min() == y.max():
        return 0.5
    order = np.argsort(scores)
    ranked, bad = scores[order], y[order]
    # Errors of a cut ahead of each place: toxic texts below it and clean ones from there on.
    errors = np.concatenate([[0], np.cumsum(bad)]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - bad)])
    possible = np.concatenate([[True], ranked[1:] > ranked[:-1], [True]])
    at = int(np.flatnonzero(possible & (errors == errors[possible].min()))[-1])
    low, high = ranked[max(at - 1, 0)], ranked[at] if at < len(ranked) else 1.0
    ends = np.clip([low, high], 1e-6, 1 - 1e-6)
    return float(_sigmoid(np.log(ends / (1 - ends)).mean()))


def _best_marks(counted: DataFrame, without: int | None, n: int, p: int) -> DataFrame:
    """The strongest marks by the documents outside one fold: ``mark, n, with_label``, ``MARKS`` rows at most.

    ``n`` documents and ``p`` of them with the label are outside. Strength is the likelihood ratio of mark and label.
    """
    folds = [k for k in range(FOLDS) if k != without]
    total = lambda kind: sum((F.col(f"{kind}{k}") for k in folds), F.lit(0))
    held = counted.select("mark", total("n").alias("n"), total("with").alias("with_label")).filter(F.col("n") >= LEAST_DOCUMENTS)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    have, lack = F.col("with_label"), F.col("n") - F.col("with_label")
    strength = (
        part(have, F.col("n") * p / max(n, 1))
        + part(lack, F.col("n") * (n - p) / max(n, 1))
        + part(p - have, (n - F.col("n")) * p / max(n, 1))
        + part(n - p - lack, (n - F.col("n")) * (n - p) / max(n, 1))
    )
    ranked = held.withColumn("strength", 2 * strength).filter(F.col("strength") >= LEAST_STRENGTH)
    return ranked.orderBy(F.col("strength").desc(), "mark").limit(MARKS).select("mark", "n", "with_label")


def fit_chain(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit the chain on about ``sample_rows`` labelled documents (all, if there are fewer), chosen by hash of the id.

    ``labels`` has ``doc_id`` and a 0/1 column; rows with a null label or id, or without a document, teach nothing. The
    categories before ``toxic`` are degrees of it: ``repeated`` for toxic texts with four or more different marks that no
    clean text of the sample has, ``dense`` for toxic texts in which these come to five or more per hundred words. Without
    any labelled row the chain gives every text the same low score. The threshold is the one with fewest errors on
    out-of-fold scores of the last category. What reaches the driver is bounded by the sample.
    """
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    sample = write_once(labelled_sample(docs, labels, label, sample_rows).select("text", "label", fold), "labelled")
    sizes = {r["fold"]: (r["n"], r["p"]) for r in sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}
    counted = write_once(
        sample.mapInArrow(_count_marks(), ", ".join(f"{c} bigint" for c in _COUNTED_NAMES))
        .groupBy("mark")
        .agg(*[F.sum(c).alias(c) for c in _COUNTED_NAMES[1:]]),
        "marks",
    )
    chosen: dict[int | None, list[int]] = {}
    pure: set[int] = set()
    for without in (None, *range(FOLDS)):
        n, p = (sum(size[x] for k, size in sizes.items() if k != without) for x in (0, 1))
        best = _best_marks(counted, without, n, p).collect()
        chosen[without] = [r["mark"] for r in best]
        if without is None:
            pure = {r["mark"] for r in best if r["with_label"] == r["n"]}
    every = sorted({m for marks in chosen.values() for m in marks})
    place = {m: i for i, m in enumerate(every)}
    columns = {without: [place[m] for m in marks] for without, marks in chosen.items()}

    found = sample.mapInArrow(
        _find_marks(np.array(every, np.int64).view(np.uint64)), "label int, fold int, words bigint, marks array<bigint>"
    )
    rows = sorted(found.collect(), key=lambda r: (r["label"], r["fold"], r["words"], r["marks"]))
    has = np.zeros((len(rows), len(every)), bool)
    for i, r in enumerate(rows):
        has[i, r["marks"]] = 1
    toxic, folds = (np.array([r[c] for r in rows], float) for c in ("label", "fold"))
    hits = has[:, [place[m] for m in sorted(pure)]].sum(axis=1) if len(rows) else np.zeros(0)
    n_words = np.array([max(r["words"], 1) for r in rows], float)
    targets = [toxic * (hits >= 0.05 * n_words) * (hits > 0), toxic * (hits >= 4), toxic]

    del rows
    weights, earlier, unseen = [], np.zeros((len(toxic), 0)), np.zeros(len(toxic))
    for y in targets:
        weights.append(fit_logistic(_inputs(has, earlier, np.arange(len(y)), columns[None]), y))
        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            inside, outside = np.flatnonzero(folds == k), np.flatnonzero(folds != k)
            w = fit_logistic(_inputs(has, earlier, outside, columns[k]), y[outside])
            unseen[inside] = _sigmoid(_inputs(has, earlier, inside, columns[k])[:, :-1] @ w[:-1] + w[-1])
        earlier = np.column_stack([earlier, unseen])
    return Chain(np.array(chosen[None], np.int64).view(np.uint64), weights, best_threshold(unseen, targets[-1]))


def _score_batches(chain: Chain) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        finder = MarkFinder(chain.marks)
        for batch in batches:
            for part in chunks(batch.column("text")):
                rows, columns, _ = finder(part)
                scores = chain.scores(rows, columns, len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.first_row : part.first_row + len(part)]]
                    + [pa.array(scores[:, c]) for c in range(scores.shape[1])],
                    [batch.schema.names[0], *chain.categories],
                )

    return run


def toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability per category and ``rejected`` for every row: the whole text is scored.

    Rejected is a text whose last category, which sees the probabilities of the others, reaches the chain's threshold. Null and empty texts hold no mark and get the score of
    a text without any. Only ``doc_id`` and ``text`` are read; repeated rows get equal scores.
    """
    schema = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *(f"{c} double" for c in chain.categories)])
    scored = docs.select("doc_id", "text").mapInArrow(_score_batches(chain), schema)
    return scored.withColumn("rejected", F.col(chain.categories[-1]) >= chain.threshold)


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is not rejected. No shuffle."""

    def run(batches: Batches) -> Batches:
        finder = MarkFinder(chain.marks)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for part in chunks(batch.column("text")):
                rows, columns, _ = finder(part)
                keep[part.first_row : part.first_row + len(part)] = chain.scores(rows, columns, len(part))[:, -1] < chain.threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
