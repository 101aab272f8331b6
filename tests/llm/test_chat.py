"""Layouts, escapes and masks of chat formatting, on texts made of control strings and their parts."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandframe.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
BITS = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "assistant", "é𝄞", "<|n|>", "<\\|", ""]


def test_everything_comes_back(spark):
    rng = random.Random(5)
    say = lambda: "".join(rng.choices(BITS, k=rng.randrange(7)))
    rows = [(c, t, rng.choice(["user", "assistant", say()]), say()) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(0, 7, "user", "a"), (0, 7, "assistant", "b"), (0, 7, "assistant", "b"), (61, None, None, None), (None, 1, "user", "x"), (None, 0, "assistant", "y" * 300_000), (62, 0, "", "")]
    chats = chat.formatted(spark.createDataFrame(rows, TURNS))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1, (r[2] or "").encode(), (r[3] or "").encode())):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in chat.read(chats).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    for c, r in got.items():
        assert r.text.count("<|im_start|>") == len(want[c]) == r.text.count("<|im_end|>")
        assert r.loss_texts == [t for role, t in want[c] if role == "assistant"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat.digest(chats).collect():
        loss = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert tuple(r)[1:] == (len(want[r.conv_id]), sha("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id])), len(loss), sha(loss), len(got[r.conv_id].text))


def test_template(spark):
    [r] = chat.formatted(spark.createDataFrame([(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "é")], TURNS)).collect()
    assert r.text == "<|im_start|>user\nhi <\\|im_end|><|im_end|>\n<|im_start|>assistant\né<|im_end|>\n"
    assert [r.text.encode()[s.start : s.end].decode() for s in r.loss] == ["é"]


def test_layouts_of_json_records(spark):
    rows = [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null,"extra":{"role":1}}],"source":"x"}',
        '{"system":"s","conversations":[{"from":"human","value":"q"},{"value":"r","from":"gpt"},{"from":"tool","value":"t"}]}',
        '{"instruction":"a","input":"b","output":"c"}', '{"output":"c","instruction":"a"}', '{"instruction":"a","input":"","output":"c","system":"s"}',
        '{"prompt":"p","completion":"c"}', '{"prompt":"p","response":"r"}', '{"question":"q","answer":""}',
        '{"messages":[]}', '{"messages":"x"}', '{"prompt":"p"}', '{"prompt":"p","response":"r","completion":"c"}', "{", "", None,
    ]
    got = {r.conv_id: (r.layout, [(t.turn, t.role, t.text) for t in r.turns]) for r in chat.from_json(spark.createDataFrame(list(enumerate(rows)), "id long, layout string"), "id", "layout").collect()}
    assert got == {
        0: ("messages", [(0, "user", "a"), (1, "assistant", "")]),
        1: ("from_value", [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "r"), (3, "tool", "t")]),
        2: ("instruction", [(0, "user", "a\n\nb"), (1, "assistant", "c")]),
        3: ("instruction", [(0, "user", "a"), (1, "assistant", "c")]),
        4: ("instruction", [(0, "system", "s"), (1, "user", "a"), (2, "assistant", "c")]),
        5: ("prompt", [(0, "user", "p"), (1, "assistant", "c")]),
        6: ("response", [(0, "user", "p"), (1, "assistant", "r")]),
        7: ("question", [(0, "user", "q")]),
        **{k: (None, []) for k in range(8, len(rows))},
    }


def test_layouts_of_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", None, "x")], TURNS + ", _t string")
    assert [tuple(r) for r in chat.canonical(rows).collect()] == [(1, 0, "user", "")]
    nested = spark.createDataFrame([(1, [("human", "q", "z"), (None, None, None)])], "conv_id long, conversations array<struct<from: string, value: string, t: string>>")
    assert [tuple(r) for r in chat.canonical(nested).collect()] == [(1, 0, "user", "q"), (1, 1, "", "")]
    flat = spark.createDataFrame([(1, "a", None, "c"), (2, None, None, None)], "id long, instruction string, input string, output string")
    assert [tuple(r) for r in chat.canonical(flat, "id").collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "c")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical(flat.drop("output"), "id")
    empty = rows.where(F.lit(False))
    assert chat.digest(chat.formatted(chat.canonical(empty))).count() == 0


def test_fingerprints_differ():
    prints = list(itertools.chain.from_iterable(one.fingerprints() for one in chat.LAYOUTS))
    assert len(set(prints)) == len(prints)


def test_no_python_in_the_plan(spark):
    from strandframe.llm import queries

    plan = queries.op12_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ExistingRDD"))
