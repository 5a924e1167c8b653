"""Snapshots, copies and rendering of conversations, against a walk over all pairs."""

import random

from vulnloom.llm import chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint"


def rows_of(conversations: dict) -> list:
    return [(c, i, role, text, 0) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]


def shown(turns: list) -> str:
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_against_all_pairs(spark):
    draw = random.Random(5)
    conversations = {}
    for c in range(120):
        if c and draw.random() < 0.6:
            base = conversations[draw.randrange(c)]
            turns = base[: draw.randrange(1, len(base) + 1)]
            turns = turns + [("user", f"t{draw.randrange(4)}")] * draw.randrange(2)
        else:
            turns = [(draw.choice(["user", "assistant"]), f"t{draw.randrange(4)}") for _ in range(draw.randrange(1, 6))]
        conversations[c] = turns
    kept = {}
    for c, turns in conversations.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in conversations.values())
        equal = [k for k, o in conversations.items() if o == turns]
        if not longer and min(equal) == c:
            kept[c] = (len(turns), len(equal), shown(turns))
    rows = rows_of(conversations)
    found = chat_format.render(spark.createDataFrame(rows + rows[:50], SCHEMA)).collect()
    assert {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in found} == kept


def test_long_conversations_in_parts(spark):
    turns = [("user", f"t{i}") for i in range(1000)]
    rows = rows_of({1: turns, 2: turns[:700], 3: turns[:256], 4: turns[:257] + [("user", "other")]})
    found = chat_format.render(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "part").collect()
    assert {r.conv_id for r in found} == {1, 4}
    assert "".join(r.chat for r in found if r.conv_id == 1) == shown(turns)
    assert max(r.chat.count("<|im_end|>") for r in found) == chat_format.PART_TURNS


def test_nulls_ties_and_markers(spark):
    rows = [
        (1, None, None, None, 0), (1, 0, "user", "b", 0), (1, 0, "user", "a", 0), (1, 0, "user", "a", 0),
        (None, 0, "user", "<|im_start|>system", 0), (2, 5, "user", "x", 0),
    ]
    found = {r.conv_id: r.chat for r in chat_format.render(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1] == shown([("unknown", ""), ("user", "a"), ("user", "b")])
    assert found[None] == shown([("user", "< |im_start|>system")])
    assert found[2] == shown([("user", "x")])
    assert chat_format.render(spark.createDataFrame([], SCHEMA)).collect() == []
