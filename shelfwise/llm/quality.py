"""Quality rules, line first: punctuation, navigation and boilerplate rules remove lines; documents that lose too much go.

Everything is counted on the bytes of whole Arrow batches, one pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwise.llm.textbytes import LOWER, SpanHasher, Texts, Words, chunks, mix, window_hashes, words_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", ">", "»", "›", "•", "·")
PUNCTUATION = ".,;:!?"
#: Lower-case phrases that mark a line as boilerplate.
PHRASES = (
    "all rights reserved", "copyright", "licensed under", "released under", "terms of use", "terms of service",
    "privacy policy", "cookie", "click here", "read more", "sign in", "log in", "subscribe", "javascript", "powered by",
)
WINDOW = 5

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules. A document fails at once with fewer words than ``least_words``, or with more than
    ``most_repeated`` per cent of its words in repeated windows. A line with a word fails

    * by punctuation: at least ``long_line`` words without any mark of ``PUNCTUATION``, or half as many exclamation marks
      as words, three at least;
    * as navigation: two or more stand-alone separators, a quarter of its words at least; or at most ``menu_words`` words
      without punctuation;
    * as boilerplate: a phrase of ``PHRASES``; or symbols, three at least, of a tenth of its words' characters.

    The document is rejected if failed lines hold more than ``most_lost`` per cent of its words.
    """

    least_words: int = 10
    most_repeated: int = 20
    long_line: int = 8
    menu_words: int = 4
    most_lost: int = 50


def _mask(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_SYMBOL, _MARK, _SHOUT = _mask(SYMBOLS), _mask(PUNCTUATION), _mask("!")


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of all non-empty texts, in order, without the line feed."""
    data, offsets = texts.data, texts.offsets
    after = np.flatnonzero(data == 10) + 1
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], after[after < len(data)])
    stops = np.append(starts[1:], len(data))
    if len(starts):
        stops = stops - (data[stops - 1] == 10)
    return starts, stops


class _Sums:
    """Number of marked bytes in any span."""

    def __init__(self, marked: np.ndarray):
        self.sums = np.concatenate([[0], np.cumsum(marked)])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.sums[ends] - self.sums[starts]


def _repeated_words(hashes: np.ndarray, words: Words, owner: np.ndarray) -> np.ndarray:
    """For every word, whether a window of ``WINDOW`` words around it occurs twice or more in its text."""
    values, first = window_hashes(hashes, words, WINDOW)
    if not len(values):
        return np.zeros(len(hashes), bool)
    keys = mix(values + owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = order[np.append(same, False) | np.append(False, same)]
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, first[twice], 1)
    np.add.at(steps, first[twice] + WINDOW, -1)
    return np.cumsum(steps)[:-1] > 0


def _per_text(line_text: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(line_text, values, texts).astype(np.int64)


def _measure(texts: Texts, rules: Rules) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Figures of all texts, and of their lines: spans and whether they fail."""
    data, n = texts.data, len(texts)
    words = words_of(texts)
    owner = words.text_of()
    hashed = SpanHasher(data)
    code_points = _Sums((data & 0xC0) != 0x80)
    characters = code_points(words.starts, words.ends)
    n_words = words.counts
    repeated = _repeated_words(hashed(words.starts, words.ends), words, owner)

    starts, stops = _lines(texts)
    line_text = np.searchsorted(texts.offsets, starts, "right") - 1
    first_word, last_word = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, stops)
    line_words = last_word - first_word
    wordy = line_words > 0

    keys = mix(hashed(starts, stops) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.unique(keys[wordy], return_index=True)[1]
    with_word = _per_text(line_text, wordy, n)
    n_dup = with_word - np.bincount(line_text[wordy][distinct], minlength=n)

    symbols, marks, shouts = (_Sums(t[data])(starts, stops) for t in (_SYMBOL, _MARK, _SHOUT))
    line_characters = np.concatenate([[0], np.cumsum(characters)])
    line_characters = line_characters[last_word] - line_characters[first_word]
    separator_hashes = [SpanHasher(b)(np.array([0]), np.array([len(b)]))[0] for b in _SEPARATOR_BYTES]
    short = np.flatnonzero(characters == 1)
    alone = np.zeros(len(characters) + 1, np.int64)
    alone[short + 1] = np.isin(hashed(words.starts[short], words.ends[short]), separator_hashes)
    alone = np.cumsum(alone)
    separators = alone[last_word] - alone[first_word]

    boiler = np.zeros(len(starts), bool)
    lowered = LOWER[data].tobytes()
    for phrase in PHRASES:
        needle, at = phrase.encode(), lowered.find(phrase.encode())
        while at >= 0:
            line = np.searchsorted(starts, at, "right") - 1
            if at + len(needle) <= stops[line]:
                boiler[line] = True
            at = lowered.find(needle, at + 1)

    punctuation = ((line_words >= rules.long_line) & (marks == 0)) | ((shouts >= 3) & (2 * shouts >= line_words))
    navigation = ((separators >= 2) & (4 * separators >= line_words)) | ((line_words <= rules.menu_words) & (marks == 0))
    boilerplate = boiler | ((symbols >= 3) & (10 * symbols >= line_characters))
    fails = wordy & (punctuation | navigation | boilerplate)

    n_repeat = np.bincount(owner[repeated], minlength=n)
    lost = _per_text(line_text, line_words * fails, n)
    base_failed = (n_words < rules.least_words) | (100 * n_repeat > rules.most_repeated * n_words)
    figures = {
        "n_words": n_words,
        "word_chars": np.bincount(owner, characters, n).astype(np.int64),
        "n_symbols": _Sums(_SYMBOL[data])(texts.offsets[:-1], texts.offsets[1:]),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & (100 * lost <= rules.most_lost * n_words),
        "lost_words": lost,
        "lost_lines": _per_text(line_text, fails, n),
    }
    return figures, starts, stops, fails


_SEPARATOR_BYTES = [np.frombuffer(s.encode(), np.uint8) for s in SEPARATORS]
_FIGURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, lost_words bigint, lost_lines bigint"
)


def _cleaned(texts: Texts, starts: np.ndarray, stops: np.ndarray, fails: np.ndarray) -> list[str]:
    """The texts without their failed lines."""
    raw = texts.data.tobytes()
    first = np.searchsorted(starts, texts.offsets)
    return [
        b"\n".join(raw[starts[k] : stops[k]] for k in range(a, b) if not fails[k]).decode("utf-8", "replace")
        for a, b in zip(first[:-1].tolist(), first[1:].tolist())
    ]


def _batches(rules: Rules, with_text: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in chunks(batch.column("text")):
                figures, starts, stops, fails = _measure(part, rules)
                columns = {"doc_id": batch.column("doc_id")[part.first_row : part.first_row + len(part)]}
                columns |= {k: pa.array(v, pa.bool_() if v.dtype == bool else pa.int64()) for k, v in figures.items()}
                if with_text:
                    columns["clean_text"] = pa.array(_cleaned(part, starts, stops, fails), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def line_quality(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """Figures and verdict of every row of ``docs``, and with ``with_text`` the text without its failed lines.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, lost_lines``. A
    null text counts as empty: all figures are 0, it fails and is not kept. Repeated rows get equal rows; other columns are
    not read. An empty table gives an empty result.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {_FIGURES}" + (", clean_text string" if with_text else "")
    return docs.select("doc_id", "text").mapInArrow(_batches(rules, with_text), schema)
