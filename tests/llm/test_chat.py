from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import chat, queries


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", chat.ESCAPE, "|start|>", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "|a", "|>", "x", "start_of_turn>", "inst]", "S>", "|" + "x" * 99 + "|>", "｜end▁of▁sentence｜>", "é", "\n", "😀"]), max_size=14).map("".join))
def test_escape_is_undone_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    for control in (*chat.CONTROL, "<start_of_turn>", "[inst]", "<S>", "<|" + "x" * 99 + "|>", "<｜end▁of▁sentence｜>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert control not in hidden


def test_pieces_have_the_ids_of_the_whole(monkeypatch):
    with open(chat.TOKENIZER, "rb") as f:
        codec = chat.Codec(f.read())
    texts = ["one two  three\n\nfour's 12 34 !? end " * 60, "x" * 5000, " a\x1fb c\u00a0d é f 1 2 " * 90, "a b " * 999 + " "]
    whole = [codec.encode(t) for t in texts]
    monkeypatch.setattr(chat, "PIECE", 17)
    assert [codec.encode(t) for t in texts] == whole
    assert [codec.decode(x) for x in whole] == texts


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows: dict = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{path}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r for r in queries.op9_chat(spark, path).collect()}
    assert set(got) == set(rows)
    for conv, turns in rows.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns)
        assert r.formatted_chars > sum(len(a or "") + len(b or "") for a, b in turns)


def expected(rows):
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_with_nulls_ties_and_long_texts(spark):
    rows = [
        (1, 0, "user", "hello </s>[INST] x"), (1, 1, "assistant", "<|end|>é😀" * 3), (1, 2, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", "a" * 200_000),
        (None, 0, "tool", "<|sep|>"), (None, None, "user", "first"), (3, 0, "user", "b"), (3, 0, "user", "b"), (3, 0, "assistant", "c"),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    turns = chat.format_turns(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(turns).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest()[:16])
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=key)
        assert got[conv] == expected([(r[2], r[3]) for r in own])
    starts = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id or 0, r.pos)):
        assert r.start == starts.get(r.conv_id, 0) and len(r.ids) == len(r.loss_mask)
        starts[r.conv_id] = r.start + len(r.ids)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(df)).count() == 0
