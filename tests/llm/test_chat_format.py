"""Operator 12: layouts, escapes and exact round trips."""
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from proflex.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    """conv -> (n_turns, turns_sha256, loss_chars, loss_sha256) straight from the rows."""
    out = {}
    for conv in {r[0] for r in rows} | {-1}:
        own = [(t, r or "", x or "") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        if conv == -1:
            own += [(0, "user", C.PROBE), (1, "assistant", C.PROBE)]
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.format_conversations(df).collect()}
    assert got == expected([tuple(r) for r in df.collect()])


def test_edges(spark):
    rng = random.Random(1)
    parts = ["\\", "<", "|", ">", "/", "s", "[INST]", "[/INST]", "</s>", "<s>", "<|", "|>", "<|>", "\\\\", "\n", "é", "😀", "a"]
    rows = [(1, i, rng.choice(["user", "assistant", "a|>b", "\\<|", "x|"]), "".join(rng.choices(parts, k=rng.randrange(9)))) for i in range(400)]
    rows += [(2, None, None, None), (2, 1, "assistant", None), (None, 0, "assistant", "</s>"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"),
             (4, 0, "assistant", "<|" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit(1)).withColumn("prompt", F.lit("p")).withColumn("place", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.format_conversations(df).collect()}
    assert got == expected(rows)
    parts = C.format_turns(C.canonical_turns(df.select("conv_id", "turn", "role", "text"))).collect()
    whole = {}
    for p in sorted(parts, key=lambda p: (p.conv is not None, p.conv or 0, p.place)):
        assert p.start == len(whole.get(p.conv, ""))
        whole[p.conv] = whole.get(p.conv, "") + p.formatted
    for p in parts:
        # nothing but the three marks is a control string
        body = p.formatted[2:-4].replace("|>", " ", 1)
        assert not any(c in body for c in C.CONTROL)
        if p.loss_start is not None:
            assert C.unescaped(whole[p.conv][p.loss_start:p.loss_end]) == C.read_turn(p.formatted)[1]


def test_empty(spark):
    rows = C.format_conversations(spark.createDataFrame([], SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in rows] == [(-1, 2, len(C.PROBE))]


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}, "messages"),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, "conversations"),
    ({"data": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}}, "nested messages"),
    ({"instruction": "q", "input": "", "output": "r"}, "instruction with input"),
    ({"instruction": "q", "output": "r"}, "instruction"),
    ({"prompt": "q", "response": "r", "lang": "en"}, "prompt, response"),
    ({"prompt": "q", "completion": "r"}, "prompt, completion"),
    ({"question": "q", "answer": "r"}, "question, answer"),
    ({"system_prompt": "", "question": "q", "response": "r"}, "system, question, response"),
]


@pytest.mark.parametrize("record,name", LAYOUTS)
def test_layouts_agree(spark, record, name):
    table = spark.read.json(spark.sparkContext.parallelize([json.dumps({"conv_id": 5, **record})]))
    assert C.select_mapping(C.schema_paths(table.schema)).name == name
    got = sorted((r.conv, r.turn, r.role, r.text) for r in C.canonical_turns(table).collect())
    lines = spark.createDataFrame([(5, json.dumps(record))], "conv_id long, line string")
    mixed = sorted((r.conv, r.turn, r.role, r.text) for r in C.canonical_records(lines, "conv_id", "line").collect())
    assert [g[2:] for g in got] == [m[2:] for m in mixed] == [("user", "q"), ("assistant", "r")]


def test_records_without_layout(spark):
    lines = spark.createDataFrame([(1, "no json"), (2, None), (3, "[1]"), (4, '{"x": 1}'), (5, '{"messages": []}'),
                                   (6, '{"messages": [{"role": "user", "content": "q", "extra": {"a": 1}}, {"role": "user", "content": [1]}]}')],
                                  "conv_id long, line string")
    got = [(r.conv, r.role, r.text, r.layout) for r in C.canonical_records(lines, "conv_id", "line").collect()]
    assert [g for g in got if g[0] < 6] == [(i, None, None, "-") for i in range(1, 6)]
    assert got[-2][1:] == ("user", "q", "messages")
    with pytest.raises(ValueError, match="no mapping"):
        C.canonical_turns(spark.range(1))


def test_every_mapping_has_its_own_fingerprint():
    assert len({C.fingerprint(m.paths) for m in C.MAPPINGS}) == len(C.MAPPINGS)
    assert all(C.select_mapping(m.paths) is m for m in C.MAPPINGS)
