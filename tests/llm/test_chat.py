import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import chat
from tidewater.llm.pieces import model_path

CONVS = "conv_id long, turn long, role string, text string"
MESSY = st.text(alphabet=st.one_of(st.sampled_from(list("<>[]/\\sSYIRNTOLE ▁U+2581\n")), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(MESSY, st.sampled_from([*chat.MARKS, chat.SPACE_MARK, "\\", "<\\s>", "[\\\\INST]", "▁"])), max_size=6).map("".join))
def test_escaping_is_undone_and_leaves_no_mark(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(m in safe for m in chat.MARKS) and "▁" not in safe


@settings(max_examples=150, deadline=None)
@given(st.lists(MESSY, min_size=1, max_size=4))
def test_ids_give_the_text_back_and_are_never_reserved(texts):
    own = chat.codec(model_path())
    ids = own.encode(texts)
    assert [chat.unescape(t) for t in own.decode(ids)] == texts
    assert not any(len(own.reserved(np.array(i, np.int64))) for i in ids)


def plain(rows):
    """Rows of (conv_id, turn, role, text), each turn in its order."""
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        turns, loss, chars, n = out.get(conv, ("", "", 0, 0))
        role, text = role or "", text or ""
        around = {"user": "<s>[INST][/INST]", "assistant": "</s>", "system": "<<SYS>><</SYS>>"}.get(role, f"[ROLE]{chat.escape(role)}[/ROLE]</s>")
        out[conv] = (turns + f"{role}\n{text}\n", loss + text * (role == "assistant"), chars + len(chat.escape(text)) + len(around), n + 1)
    return {c: (n, hashlib.sha256(t.encode()).hexdigest(), len(x), hashlib.sha256(x.encode()).hexdigest(), k) for c, (t, x, k, n) in out.items()}


def odd_rows():
    long_text = "word [INST] ▁ </s> " * 30_000
    return [
        (1, 0, "system", "be <<SYS>> brief"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "two in a row"), (1, 4, "tool", "[ROLE]x[/ROLE]"),
        (2, None, "assistant", "first of all"), (2, 0, "user", "same"), (2, 0, "user", "same"), (None, 5, "user", "no id"), (None, 6, "assistant", "none </s>"),
        (3, 0, None, "no role"), (3, 1, "[INST]", "odd role"), (4, 0, "user", long_text), (4, 1, "assistant", long_text + "▁"), (5, 0, "assistant", "é中😀\x00 ﻿"),
    ]


@pytest.mark.parametrize("parts", [1, 7])
def test_read_back_equals_plain(spark, parts):
    rows = odd_rows() + [(9, i, "user" if i % 2 else "assistant", f"turn {i} <s>") for i in range(3000)]
    random.Random(3).shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        convs = spark.createDataFrame(rows, CONVS).withColumns({"ids": F.lit("clash"), "part": F.lit(1)})
        blocks = chat.format_conversations(convs).persist()
        got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(blocks).collect()}
        held = blocks.where("conv_id = 9").orderBy("first_token").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == plain(rows)
    assert max(len(r["ids"]) for r in held) <= chat.BLOCK
    places = [r["first_token"] for r in held]
    assert places == [0, *np.cumsum([len(r["ids"]) for r in held])[:-1].tolist()]


def test_mask_covers_assistants_and_their_end(spark):
    convs = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "tell me"), (1, 2, "user", "x")], CONVS)
    [block] = chat.format_conversations(convs).collect()
    own = chat.codec(model_path())
    under = [i for i, m in zip(block["ids"], block["loss"]) if m]
    assert under == [*own.encode(["tell me"])[0], own.ids[chat.EOS]]
    assert chat.format_conversations(spark.createDataFrame([], CONVS)).count() == 0
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], CONVS))).count() == 0
