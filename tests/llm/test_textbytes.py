import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm.textbytes import LOWER, SpanHasher, as_bytes, chunks, shingle_sets, window_hashes, words_of

TEXT = st.text(st.sampled_from(list(" \t\n\r\x0b\x0cabAB.é中\U0001f600 ")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12), st.integers(1, 60), st.integers(1, 5))
def test_chunks_and_words(texts, max_bytes, max_rows):
    """All rows come once and in order, and their words are those of the pattern on code points."""
    column = pa.array(texts, pa.string())
    seen = []
    for part in chunks(column, max_bytes, max_rows):
        assert part.first_row == len(seen) and 1 <= len(part) <= max_rows
        assert len(part) == 1 or len(part.data) <= max_bytes
        words = words_of(part)
        raw = part.data.tobytes()
        for i in range(len(part)):
            span = range(words.bounds[i], words.bounds[i + 1])
            seen.append([raw[words.starts[k] : words.ends[k]].decode() for k in span])
    assert seen == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(1, 5))
def test_equal_words_and_windows_have_equal_hashes_and_others_not(texts, width):
    (part,) = chunks(pa.array(texts, pa.string()))
    words = words_of(part)
    hashes = SpanHasher(part.data)(words.starts, words.ends)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    flat = [w for own in plain for w in own]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    values, first = window_hashes(hashes, words, width)
    windows = [tuple(own[i : i + width]) for own in plain for i in range(len(own) - width + 1)]
    assert len(values) == len(windows)
    assert [tuple(flat[f : f + width]) for f in first.tolist()] == windows
    assert len(set(zip(windows, values.tolist()))) == len(set(windows)) == len(set(values.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_shingle_sets_do_not_depend_on_the_chunk(texts):
    (part,) = chunks(pa.array(texts, pa.string()))
    values, bounds, _ = shingle_sets(part, 3)
    for i, text in enumerate(texts):
        (alone,) = chunks(pa.array([text], pa.string()))
        own, _, _ = shingle_sets(alone, 3)
        assert own.tolist() == values[bounds[i] : bounds[i + 1]].tolist()
        low = "".join(chr(LOWER[ord(c)]) if ord(c) < 128 else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        n = min(3, len(words))
        assert len(own) == (len({tuple(words[k : k + n]) for k in range(len(words) - n + 1)}) if words else 0)


def test_slices_nulls_and_types_of_columns():
    column = pa.array(["ab", None, "", "cde"], pa.string())
    for kind in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        data, offsets = as_bytes(column.cast(kind)[1:])
        assert [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])] == [b"", b"", b"cde"]
    assert [len(p) for p in chunks(pa.array([], pa.string()))] == []
    assert np.diff(as_bytes(pa.chunked_array([column, column]))[1]).tolist() == [2, 0, 0, 3] * 2


def thue_morse(n):
    """A string of a and b, and its complement: polynomials modulo a power of two hash both alike, whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_strings_made_to_collide_have_different_hashes():
    for n in (1024, 2048, 4096):
        one, other = thue_morse(n)
        data = np.frombuffer((one + other + one).encode(), np.uint8)
        hashes = SpanHasher(data)(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert hashes[0] == hashes[2] != hashes[1]
        values, bounds, _ = shingle_sets(next(chunks(pa.array([one, other]))), 4)
        assert values[0] != values[1] and bounds.tolist() == [0, 1, 2]


def test_hashes_tell_all_short_strings_apart():
    data = np.frombuffer(b"".join(bytes([a, b]) for a in range(256) for b in range(256)), np.uint8)
    starts = np.arange(0, len(data), 2)
    assert len(np.unique(SpanHasher(data)(starts, starts + 2))) == 65536
    ones = SpanHasher(np.zeros(1000, np.uint8))(np.zeros(1000, int), np.arange(1000))
    assert len(np.unique(ones)) == 1000
