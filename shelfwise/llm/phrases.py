"""Phrase collocations by stripes: every prefix keys an associative counter of the words that follow it.

A task turns its texts into stripes (a prefix, the next words and how often each followed), and stripes of one prefix are
merged element by element. The merged stripes hold all that the scores need: an entry is an extension and its count, the
entries' counts are the totals of the prefixes of the next order, and the largest entry of a stripe tells whether the
prefix is always continued the same way. Words are compared as bytes, never by hash.

One pass over the texts counts words and pairs, another phrases of three to five words. A phrase can only be frequent if the
pairs in it are, so the second pass leaves out most others by a bitmap of fixed size, a hash of the frequent pairs. The
bitmap only saves work: a false hit costs an entry that the count drops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.textbytes import mix
from shelfwise.sources.storage import write_once

#: Occurrences a phrase needs, words of the longest one, phrases reported per language.
LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"

#: Bytes of text whose words are counted together, entries of stripes that one row holds, and rows handed on at once.
_CHUNK_BYTES, _ROW_ENTRIES, _BATCH_ROWS = 3 << 20, 4096, 16
#: Words a task remembers; beyond that it forgets them and starts again.
_KNOWN_WORDS = 250_000
#: Bits of the bitmap: 64 for every frequent phrase, but no more than this (8 MB), whatever the corpus.
_MOST_BITS = 1 << 26

#: A row holds stripes one after the other, the prefix beside each of its next words.
_STRIPES = "lang string, prefix array<string>, next array<string>, counts array<bigint>"
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)

# What parts pieces, what parts words, and the letters that are lower-cased.
_PIECE_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NORMAL = bytes.maketrans(_CAPITALS + _PIECE_ENDS + _BLANKS, _CAPITALS.lower() + b"\n" * len(_PIECE_ENDS) + b"  ")

Batches = Iterator[pa.RecordBatch]


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _seed(lang: str) -> np.uint64:
    return mix(np.array([_word_hash(b"lang " + lang.encode())], _U))[0]


def _fold(seed: np.uint64, words: list[np.ndarray]) -> np.ndarray:
    """One hash per phrase, from the hashes of its first, second, ... words."""
    folded = np.full(len(words[0]), seed, _U)
    for w in words:
        folded = mix(folded * _GOLDEN + w)
    return folded


class Sieve:
    """A bitmap that holds every phrase put into it, and a few others."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = _U(bits - 1), words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.words[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1


def _sieve_words(mask: int) -> Callable[[Batches], Batches]:
    """Which words of the bitmap the phrases set, and the bits."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            hashes = np.zeros(batch.num_rows, _U)
            for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())):
                words = [np.array([_word_hash(w)], _U) for w in phrase.encode().split(b" ")]
                hashes[i] = _fold(_seed(lang), words)[0]
            at = hashes & _U(mask)
            bits = (_U(1) << (at & _U(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array(bits)], ["word", "bits"])

    return run


def sieve_of(frequent: DataFrame) -> Sieve:
    """A bitmap of the phrases ``lang, phrase``. It reaches the driver, 8 MB at most however many phrases there are."""
    bits = 1 << 10
    wanted = 64 * frequent.count()
    while bits < min(wanted, _MOST_BITS):
        bits *= 2
    found = (
        frequent.select("lang", "phrase")
        .mapInArrow(_sieve_words(bits - 1), "word bigint, bits bigint")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    words = np.zeros(bits >> 6, _U)
    words[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(_U)
    return Sieve(bits, words)


def _cut(text: bytes, longest: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts of about ``limit`` bytes, and how many words at a part's start stood in the part before too.

    Cuts are made between pieces; in a piece longer than the limit between words, and there the last ``longest - 1`` words are
    repeated, so that every phrase stands whole in some part.
    """
    start, repeated, room = 0, 0, limit
    while len(text) - start > room:
        at = text.rfind(b"\n", start, start + room)
        if at > start:
            yield text[start:at], repeated
            start, repeated, room = at + 1, 0, limit
            continue
        part = text[start : start + room].rpartition(b" ")[0]
        words = part.split()
        if len(words) <= max(longest - 1, repeated):
            room *= 2
            continue
        yield part, repeated
        kept, back = b" ".join(words[len(words) - longest + 1 :]), start + len(part)
        repeated, room = longest - 1, limit
        text, start = (kept + b" " + text[back:] if repeated else text[back:]), 0
    yield text[start:], repeated


def _parts(batches: Batches, longest: int) -> Iterator[tuple[str, bytes, int]]:
    """Normalised texts of one language joined to about a chunk; a text of more than that comes in parts."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            raw = text.as_buffer().to_pybytes().translate(_NORMAL) if text.is_valid else b""
            if len(raw) > _CHUNK_BYTES:
                for part, repeated in _cut(raw, longest, _CHUNK_BYTES):
                    yield lang, part, repeated
                continue
            held.setdefault(lang, []).append(raw)
            size += len(raw)
            if size > _CHUNK_BYTES:
                for one, texts in held.items():
                    yield one, b"\n".join(texts), 0
                held, size = {}, 0
    for one, texts in held.items():
        yield one, b"\n".join(texts), 0


def _stripe_rows(lang: str, prefixes: pa.Array, following: pa.Array, counts: np.ndarray) -> Batches:
    bounds = np.append(np.arange(0, len(counts), _ROW_ENTRIES), len(counts)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(bounds), x) for x in (prefixes, following, pa.array(counts, pa.int64()))]
    langs = pa.array([lang] * (len(bounds) - 1), pa.string())
    rows = pa.RecordBatch.from_arrays([langs, *lists], ["lang", "prefix", "next", "counts"])
    for first in range(0, rows.num_rows, _BATCH_ROWS):
        yield rows.slice(first, _BATCH_ROWS)


class _Numbers(dict):
    """Numbers for words in the order they are met; a separator is -1, nothing -2."""

    def __init__(self):
        super().__init__({b"": -2, b"\n": -1})
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


def _count_phrases(orders: range, sieve: Sieve | None = None) -> Callable[[Batches], Batches]:
    """Stripes of all phrases of the given numbers of words, of those whose pairs are in the sieve.

    Words follow the empty prefix; an entry without a prefix counts all words of a language.
    """

    def run(batches: Batches) -> Batches:
        numbers, hashes = _Numbers(), np.zeros(0, _U)
        for lang, raw, repeated in _parts(batches, orders[-1]):
            if len(numbers.words) > _KNOWN_WORDS:
                numbers, hashes = _Numbers(), np.zeros(0, _U)
            tokens = raw.replace(b"\n ", b"\n").replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
            del tokens
            ids = np.append(ids[ids != -2], -1)
            words = pa.array(numbers.words, pa.binary()).cast(pa.string())
            if 1 in orders:
                counts = np.bincount(ids[repeated:][ids[repeated:] >= 0], minlength=1)
                found = np.flatnonzero(counts)
                prefixes = pa.array([None, ""], pa.string()).take(pa.array(np.append(0, np.ones(len(found), int))))
                spelled = pa.concat_arrays([pa.array([""]), words.take(pa.array(found))])
                yield from _stripe_rows(lang, prefixes, spelled, np.append(counts.sum(), counts[found]))
            pair = (ids[:-1] >= 0) & (ids[1:] >= 0)
            if sieve is not None:
                new = numbers.words[len(hashes) :]
                hashes = np.concatenate([hashes, np.fromiter(map(_word_hash, new), _U, len(new))])
                at = np.flatnonzero(pair)
                pair[at] = sieve(_fold(_seed(lang), [hashes[ids[at]], hashes[ids[at + 1]]]))
            # Where phrases of the order begin, and for each the number of its words but the last.
            begins, prefix = np.arange(len(pair)), ids[:-1]
            for order in range(2, orders[-1] + 1):
                holds = begins + order - 2 < len(pair)
                holds[holds] = pair[begins[holds] + order - 2]
                begins, prefix = begins[holds], prefix[holds]
                if not len(begins):
                    break
                keys, first, same, counts = np.unique(
                    prefix << 32 | ids[begins + order - 1], return_index=True, return_inverse=True, return_counts=True
                )
                prefix = same
                if order not in orders:
                    continue
                if repeated:  # what lies in the repeated words has been counted in the part before
                    counts = np.bincount(same[begins + order > repeated], minlength=len(keys))
                    first, counts = first[counts > 0], counts[counts > 0]
                spelled = [words.take(pa.array(ids[begins[first] + k])) for k in range(order)]
                prefixes = pc.binary_join_element_wise(*spelled[:-1], " ") if order > 2 else spelled[0]
                yield from _stripe_rows(lang, prefixes, spelled[-1], counts)

    return run


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes merged element by element: ``lang, prefix, next, f`` of the entries that occur often enough.

    An element, not a stripe, is the unit that is moved, so a prefix that a third of all words follow is no task's burden.
    """
    return (
        stripes.select("lang", F.explode(F.arrays_zip("prefix", "next", "counts")).alias("entry"))
        .groupBy("lang", F.col("entry.prefix").alias("prefix"), F.col("entry.next").alias("next"))
        .agg(F.sum("entry.counts").alias("f"))
        .filter((F.col("f") >= least) | F.col("prefix").isNull())
    )


def _without_first(phrase: str) -> Column:
    return F.expr(f"substr({phrase}, instr({phrase}, ' ') + 1)")


def _totals_of_parts(entries: DataFrame, shorter: DataFrame) -> DataFrame:
    """Entries of one order with the counts of everything they begin and end with.

    ``firsts`` are the counts of the first 1, 2, ... words, ``rests`` of what is left behind them. Both grow by one from the
    entries of the order before, which the prefix and the phrase without its first word are.
    """
    phrases = entries.withColumn("phrase", F.concat_ws(" ", "prefix", "next")).withColumn("rest", _without_first("phrase"))
    begin = shorter.select("lang", F.col("phrase").alias("prefix"), F.concat("firsts", F.array("f")).alias("firsts"))
    end = shorter.select("lang", F.col("phrase").alias("rest"), F.concat(F.array("f"), "rests").alias("rests"))
    return phrases.join(begin, ["lang", "prefix"]).join(end, ["lang", "rest"])


_SCORED = """
    array_min(transform(sequence(1, size(firsts)), k -> named_struct(
        'score', (cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0)))
                 div (cast(firsts[k - 1] as decimal(19,0)) * cast(rests[k - 1] as decimal(19,0))),
        'k', k, 'l', firsts[k - 1], 'r', rests[k - 1])))
"""


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the phrases of 2 to ``longest`` words that occur ``least`` times or more.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words at blanks; phrases do not
    reach beyond a piece. ``a`` counts the phrase, ``n`` all words of its language (null: ``und``), ``l`` and ``r`` what
    stands before and behind the cut with the lowest score ``floor(1000 a n / (l r))``, ties at the smallest cut. A phrase
    that only occurs inside one longer phrase is left out. ``rank`` orders a language's phrases by score, then ``a``, both
    falling, then by the bytes of the phrase; ``top`` ranks are returned, or all if it is None. Only ``lang`` and ``text`` are
    read. Null and empty texts hold no words; without a frequent phrase there are no rows. Runs jobs: the merged stripes
    of every order are written tables.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    short = range(1, min(longest, 2) + 1)
    counted = write_once(_merged(texts.mapInArrow(_count_phrases(short), _STRIPES), least), "phrases")
    totals = counted.filter("prefix is null").select("lang", F.col("f").alias("n"))
    empty = F.array().cast("array<bigint>")
    words = counted.filter("prefix = ''").select(
        "lang", F.col("next").alias("phrase"), "f", empty.alias("firsts"), empty.alias("rests")
    )
    by_order = [words]
    if longest >= 2:
        pairs = counted.filter("prefix <> ''")
        by_order.append(write_once(_totals_of_parts(pairs, words), "phrase-parts"))
    if longest >= 3:
        passing = _count_phrases(range(3, longest + 1), sieve_of(by_order[1]))
        longer = write_once(_merged(texts.mapInArrow(passing, _STRIPES), least), "phrases")
        for order in range(3, longest + 1):
            of_order = longer.filter(F.size(F.split("prefix", " ")) == order - 1)
            by_order.append(write_once(_totals_of_parts(of_order, by_order[-1]), "phrase-parts"))

    kept = None
    for phrases, extended in zip(by_order[1:], [*by_order[2:], None]):
        if extended is not None:
            # The largest entry of the stripe that follows the phrase, and of the stripes that hold it behind one word.
            most = (
                extended.select("lang", F.col("prefix").alias("phrase"), "f")
                .union(extended.select("lang", F.col("rest").alias("phrase"), "f"))
                .groupBy("lang", "phrase")
                .agg(F.max("f").alias("most"))
            )
            phrases = phrases.join(most, ["lang", "phrase"], "left").filter("most is null or most < f")
        part = phrases.select("lang", "phrase", "f", "firsts", "rests")
        kept = part if kept is None else kept.union(part)
    if kept is None:
        kept = words.filter("false").select("lang", "phrase", "f", "firsts", "rests")
    scored = kept.join(totals, "lang").withColumn("cut", F.expr(_SCORED))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("f").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
