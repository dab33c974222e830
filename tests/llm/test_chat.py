"""Operator 2: exact round trips and loss masks."""

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tabforge.llm.chat import CONTROL, escape, format_conversations, mask, masked_text, parse, read_back, render, tokenizer, unescape

PATH = public_tokenizers.path("byte_bpe_50k.json")
_PIECE = st.sampled_from([*CONTROL, "\\", "<", "<|", "|>", "/turn>", "\n", " ", "é", "\U0001F600", "ok", "b", "### Assistant:"])
_TEXT = st.lists(_PIECE, max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|text|>"]), _TEXT), min_size=1, max_size=5))
def test_round_trip_and_mask(turns):
    text, spans = render(turns)
    assert parse(text) == turns
    for _, t in turns:
        assert unescape(escape(t)) == t and not any(c in escape(t) for c in CONTROL)
    import numpy as np
    enc = tokenizer(PATH).encode(text, add_special_tokens=False)
    offsets = np.array(enc.offsets).reshape(-1, 2)
    got = masked_text(text, offsets, mask(offsets, spans))
    assert [unescape(x) for x in got] == [t for r, t in turns if r == "assistant" and t]


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_table(spark):
    rows = [(1, 1, "assistant", "a <|turn|> b"), (1, 0, "user", None), (1, 2, None, ""), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
            (None, 3, "assistant", "x"), (None, None, "user", "y"), (3, 0, "system", "s" * 9), (3, 5000, "assistant", "late"), (3, 2000, "assistant", "mid")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} \\") for i in range(3000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    formatted = format_conversations(df.repartition(6), PATH).cache()
    got = sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(formatted).collect()), key=str)
    assert got == expected(rows)
    assert formatted.where("conv_id = 9").count() == 3
    # blocks are encoded as the whole would be
    whole = render([(r[2], r[3]) for r in rows if r[0] == 9])[0]
    ids = [x for r in formatted.where("conv_id = 9").orderBy("block").collect() for x in r.input_ids]
    assert ids == tokenizer(PATH).encode(whole, add_special_tokens=False).ids
    assert read_back(format_conversations(df.limit(0), PATH)).collect() == []


def test_a_block_of_many_rows_is_cut_by_place(spark):
    rows = [(1, None, "assistant" if i % 3 else "user", f"null turn {i}") for i in range(2500)]
    rows += [(2, 7, "assistant", "same") for _ in range(2049)] + [(3, 0, "user", "u"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = format_conversations(df.repartition(5), PATH).cache()
    got = sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(formatted).collect()), key=str)
    assert got == expected(rows)
    parts = {(r.conv_id, r.part): r.n_turns for r in formatted.collect()}
    assert parts == {(1, 0): 1024, (1, 1): 1024, (1, 2): 452, (2, 0): 1024, (2, 1): 1024, (2, 2): 1, (3, 0): 2}
