import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import tokenfile
from shelfwise.llm.textbytes import chunks
from shelfwise.sources import storage
from shelfwise.sources.storage import shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
HARD = [
    "two  spaces   three\n\n\nlines \t tabs", " lead and trail ", "  nbsp  \n x", "  wide    y", "　   z\u0085 \u0085 q",
    "don't we'll I'm 'S it's\n's", "<|endoftext|> in <|endoftext|>text", "123 456,789 $%^ &*()", "中文 字\U0001f600 \U0001f600", "a\x1cb \x1d c", "\r\n\r\n x\x0b\x0c y",
]


def round_trip(docs):
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(docs, folder, VOCABULARY)
    return tokenfile.read_tokens(docs.sparkSession, folder, with_ids=True)


def check(docs):
    want = sorted(
        ((r["doc_id"] is not None, r["doc_id"], TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()),
        key=lambda r: (r[0], r[1] or 0, r[2]),
    )
    got = sorted(round_trip(docs).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert ids == sorted(ids)
    assert sorted(((r["doc_id"] is not None, r["doc_id"], r["ids"]) for r in got), key=lambda r: (r[0], r[1] or 0, r[2])) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_hard_texts(spark):
    check(spark.createDataFrame([(-i, t) for i, t in enumerate(HARD * 2)], "doc_id bigint, text string").repartition(3))


def test_documents(documents):
    check(documents)


def test_odd_and_no_documents(odd_documents, no_documents):
    check(odd_documents)
    assert round_trip(no_documents).count() == 0


@pytest.mark.parametrize("top", [1, 2**8, 2**16, 2**24, 2**32])
def test_coding_of_all_lengths(top):
    values = np.random.default_rng(top).integers(0, top, 1001).astype(np.uint32)
    values[:4] = [0, top - 1, top // 2, 0]
    for n in (0, 1, 3, 4, 1001):
        control, data = tokenfile.pack(values[:n])
        assert len(control) == -(-n // 4)
        assert (tokenfile.unpack(control, data, n) == values[:n]).all()


def test_blocks_and_a_full_memo(documents, monkeypatch):
    monkeypatch.setattr(tokenfile, "_BLOCK_TOKENS", 100)
    monkeypatch.setattr(tokenfile, "_MEMO_PIECES", 50)
    check(documents.limit(30))


def test_frequent_ids_are_short(spark, documents):
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(documents, folder, VOCABULARY)
    blocks = spark.read.parquet(f"{folder}/blocks").selectExpr("sum(n_values) n", "sum(length(data)) bytes").first()
    assert blocks["bytes"] < 1.6 * blocks["n"]
    ranks = [r["n"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    assert ranks == sorted(ranks, reverse=True)


def test_strings_made_to_collide(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    texts = [one, one.translate(str.maketrans("ab", "ba")), f"x {one} y"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1))


def encoded(encoder, texts):
    found = []
    for part in chunks(pa.array(texts), 1 << 20):
        ids, bounds = encoder(part)
        found += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return found


def wanted(texts):
    return [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_that_share_a_hash(monkeypatch, documents):
    """Within a chunk and with the memo, for any hash: at worst all pieces have the same."""
    texts = HARD + [r["text"] or "" for r in documents.limit(20).collect()]
    plain = tokenfile.piece_hashes
    for bits in (0, 3, 12, 20):
        cut = (lambda k, b=bits: plain(k) >> np.uint64(64 - b)) if bits else (lambda k: plain(k) * np.uint64(0))
        monkeypatch.setattr(tokenfile, "piece_hashes", cut)
        encoder = tokenfile.PieceEncoder(VOCABULARY)
        assert [encoded(encoder, [t])[0] for t in texts] == wanted(texts)


def test_keys_tell_short_pieces_apart():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 3000)
    lengths = rng.integers(1, tokenfile.SHORT + 1, 3000)
    pieces = [data[a : a + n].tobytes() for a, n in zip(starts, lengths)]
    keys = [tuple(k) for k in tokenfile.short_keys(data, starts, lengths).tolist()]
    assert len(set(zip(pieces, keys))) == len(set(pieces)) == len(set(keys))


def test_ids_that_do_not_tell_the_ends_of_pieces():
    encoder = tokenfile.PieceEncoder(VOCABULARY)
    encoder.bytes_of[:] = 1  # as if the vocabulary were another
    assert encoded(encoder, HARD) == wanted(HARD)


def test_pieces_of_the_memo_before_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(tokenfile, "_MEMO_PIECES", 20)
    encoder, seen = tokenfile.PieceEncoder(VOCABULARY), []
    encode = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: seen.extend(texts) or encode(texts))
    usual = " ".join(f"usual{i}" for i in range(10))
    for k in range(6):
        texts = [usual, " ".join(f"rare{k}x{i}" for i in range(12))]
        assert encoded(encoder, texts) == wanted(texts)
    assert "".join(seen).count("usual5") == 1


def test_workers_get_rows_by_their_size(spark, monkeypatch):
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    long = spark.range(200).coalesce(1).selectExpr("repeat('x', 10000) text")
    with tokenfile.small_batches(spark, 1 << 17):
        assert max(r["n"] for r in long.mapInArrow(sizes, "n bigint").collect()) <= 20
    found = []
    see = lambda label, df: found.append((label, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
    monkeypatch.setattr(storage, "OBSERVERS", [see])
    round_trip(long.selectExpr("1L doc_id", "text"))
    assert found == [("token-ids", str(tokenfile._BATCH_BYTES))]


def test_ids_on_the_way_take_two_bytes(spark, documents):
    encoder = tokenfile.PieceEncoder(VOCABULARY)
    assert encoder(next(chunks(pa.array(HARD))))[0].dtype == np.uint16
    first = next(tokenfile._encode_batches(VOCABULARY, 1 << 20)(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})])))
    assert np.frombuffer(first["ids"][0].as_py(), "<u4")[-1] == 1 << 20  # an end id that takes more
