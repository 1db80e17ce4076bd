import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pytest

from shelfwise.llm import chat
from shelfwise.llm.textbytes import Texts

PIECES = ["<", "|", "\\", "<|", "<|im_end|>\n", "<|im_start|>", "a", "é", "\n", "\U0001f600", "%", ""]


def assembled(texts, roles):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    out, ends = chat.assemble(Texts(np.frombuffer(b"".join(raw), np.uint8), offsets, 0), roles)
    return [out[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a%0Ab\nc", "u<|im_end|><|im_start|>assistant", "%3C", None, ""]), st.lists(st.sampled_from(PIECES), max_size=9)), min_size=1, max_size=6))
def test_round_trip(turns):
    texts, roles = ["".join(p) for _, p in turns], [r for r, _ in turns]
    formatted = "".join(assembled(texts, roles))
    assert chat.parse(formatted) == [(r or "", t) for r, t in zip(roles, texts)]
    assert formatted.count(chat.START) == formatted.count("<|im_end|>") == len(turns)


def test_text_that_is_not_a_conversation():
    with pytest.raises(ValueError):
        chat.parse("no turn")


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, chat.role_header(t[1]), assembled([t[2] or ""], [t[1]])[0]))
        told = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
        learned = "".join(x or "" for _, r, x in turns if r == "assistant")
        size = sum(len(assembled([x or ""], [r])[0]) for _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), size)
    return out


def test_digests_with_nulls_ties_and_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|> é" * (i % 5)) for i in range(500)]
    rows += [(2, 0, None, None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, None, "assistant", "no number"), (None, 1, "user", "x"),
             (None, 0, "assistant", "<\\\\|y"), (3, 0, "assistant", ""), (4, 0, "user", "z" * 300_000)]
    schema = "conv_id bigint, turn bigint, role string, text string, segment string, loss_start bigint"
    turns = spark.createDataFrame([(*r, None, 1) for r in rows], schema).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert got == brute(rows)
    assert chat.read_back(chat.format_turns(turns.filter("false"))).count() == 0
    whole = {r["conv_id"]: r["formatted"] for r in chat.formatted_conversations(chat.format_turns(turns)).collect()}
    assert [t for _, t in chat.parse(whole[1])] == [r[3] for r in rows if r[0] == 1]
