"""Words, word hashes and shingles of many texts at once, straight from the bytes of an Arrow string column.

A text is cut at bytes, not characters: every separator is ASCII, so the words are those of the code-point pattern. All
work is done per chunk of about half a megabyte, whatever the size of the Arrow batch, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 2000
#: Bits of a shingle key that hold its hash; the bits above number the text within its chunk.
HASH_BITS = 52

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
#: Spans are hashed by two polynomials modulo this prime. (Modulo a power of two, some strings collide whatever the base.)
_PRIME = (1 << 31) - 1
_BASES = (0x4F1BBCDD, 0x2C9277B5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: What each byte counts in either polynomial.
_BYTE_VALUES = [mix(np.arange(1, 257, dtype=_U) + _U(k << 32)) % _U(_PRIME - 1) + _U(1) for k in range(2)]

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that belong to a word `[^\x20\x09-\x0D]+`.
WORD_BYTE = ~_space
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
#: Byte table that lower-cases A-Z and leaves everything else.
LOWER = _lower

#: Powers of either base and of its inverse, as far as any chunk has needed them.
_powers = [[np.ones(1, np.uint32), np.ones(1, np.uint32)] for _ in _BASES]


def _reduced(x: np.ndarray) -> np.ndarray:
    """Residues modulo the prime (or the prime for 0) of integers below 2**62."""
    x = (x & _U(_PRIME)) + (x >> _U(31))
    return (x & _U(_PRIME)) + (x >> _U(31))


def _power_tables(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[lane][0]) < size:
        for i, base in enumerate((_BASES[lane], pow(_BASES[lane], -1, _PRIME))):
            table = np.ones(1, _U)
            while len(table) < max(size, CHUNK_BYTES + 1):
                table = np.concatenate([table, _reduced(table * _U(pow(base, len(table), _PRIME)))])
            _powers[lane][i] = table.astype(np.uint32)
    return _powers[lane][0][:size], _powers[lane][1][:size]


@dataclass
class Texts:
    """A chunk of texts: all their bytes, where each text begins (one more entry than texts), and its first row."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Byte spans of all words of a chunk; those of text ``i`` are ``bounds[i]:bounds[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_rows: int = CHUNK_ROWS) -> Iterator[Texts]:
    """The rows of a column in chunks of bounded size; a text longer than that is a chunk of its own."""
    data, offsets = as_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        stop = min(max(stop, row + 1), row + max_rows, rows)
        yield Texts(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row)
        row = stop


def words_of(texts: Texts, is_word: np.ndarray = WORD_BYTE) -> Words:
    """Maximal runs of word bytes within each text."""
    inside = is_word[texts.data]
    size = len(inside)
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    begins = texts.offsets[:-1]
    before[begins[begins < size]] = False
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    last = texts.offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


class SpanHasher:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand; the bytes are summed up once."""

    def __init__(self, data: np.ndarray):
        self._lanes = []
        for lane, values in enumerate(_BYTE_VALUES):
            up, down = _power_tables(lane, len(data) + 1)
            sums = np.zeros(len(data) + 1, _U)
            np.cumsum(_reduced(values[data] * up[: len(data)]), out=sums[1:])
            self._lanes.append((sums, down))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashed = (ends - starts).astype(_U)
        for sums, down in self._lanes:
            at_start = _reduced(_reduced(sums[ends] - sums[starts]) * down[starts])
            hashed = mix(hashed + _GOLDEN) ^ np.where(at_start == _U(_PRIME), _U(0), at_start)
        return mix(hashed)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of one set of spans, see ``SpanHasher``."""
    return SpanHasher(data)(starts, ends)


def window_hashes(hashes: np.ndarray, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` consecutive words of a text, and the index of the window's first word."""
    total = len(hashes)
    if total < width:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    combined = hashes[: total - width + 1].copy()
    for k in range(1, width):
        combined = mix(combined + _GOLDEN) + hashes[k : total - width + 1 + k]
    valid = np.ones(total - width + 1, bool)
    # A window must not begin in the last width-1 words of its text.
    for back in range(1, width):
        at = words.bounds[1:] - back
        at = at[(at >= words.bounds[:-1]) & (at < len(valid))]
        valid[at] = False
    first = np.flatnonzero(valid)
    return mix(combined[first]), first


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words, A-Z lower-cased: per text sorted hashes, bounds of the texts, word counts.

    A text of fewer words has its whole word sequence as its only shingle; one without words has none.
    """
    lowered = Texts(LOWER[texts.data], texts.offsets, texts.first_row)
    words = words_of(lowered)
    hashes = span_hashes(lowered.data, words.starts, words.ends)
    values, first = window_hashes(hashes, words, width)
    owner = words.text_of()[first]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = []
        for i in short:
            h = hashes[words.bounds[i] : words.bounds[i + 1]]
            folded = h[:1].copy()
            for k in range(1, len(h)):
                folded = mix(folded + _GOLDEN) + h[k]
            whole.append(int(mix(folded + _U(len(h)))[0]))
        values = np.concatenate([values, np.array(whole, _U)])
        owner = np.concatenate([owner, short])
    keys = np.unique((owner.astype(_U) << _U(HASH_BITS)) | (values >> _U(64 - HASH_BITS)))
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=_U) << _U(HASH_BITS))
    return keys & _U((1 << HASH_BITS) - 1), bounds, counts
