import json

import pytest
from pyspark.sql import functions as F

from verdica.llm import op1_chat_layouts as op


def run(spark, records, **options):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r), "x") for i, r in enumerate(records)], "id long, record string, layout string")
    out = {}
    for r in op.canonical(df, "id", **options).collect():
        out.setdefault((r["id"], r["layout"]), []).append((r["turn"], r["role"], r["text"]))
    return {k: sorted(v, key=lambda t: (t[0] is None, t[0] or 0)) for k, v in out.items()}


def test_layouts(spark):
    got = run(
        spark,
        [
            {"messages": [{"role": "User", "content": "a"}, {"content": "b", "role": "assistant", "extra": {"x": [1]}}], "id": 7},
            {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"},
            {"instruction": "a", "input": "", "output": "b", "lang": "en"},
            {"instruction": "a", "input": "c", "output": "b"},
            {"prompt": "a", "completion": "b"},
            {"response": "b", "prompt": "a", "system": "s"},
            {"question": "a", "answer": 5},
            {"history": [["a", "b"], ["c", "d"]], "query": "e", "response": "f"},
            {"history": [], "query": "e", "response": "f"},
            {"dialog": [{"speaker": "bot", "text": "a"}]},
        ],
    )
    pair = [(0, "user", "a"), (1, "assistant", "b")]
    assert got == {
        (0, "messages"): pair,
        (1, "sharegpt"): [(0, "system", "s"), (1, "user", "a"), (2, "assistant", "b")],
        (2, "instruction"): pair,
        (3, "instruction"): [(0, "user", "a\n\nc"), (1, "assistant", "b")],
        (4, "completion"): pair,
        (5, "response"): [(0, "system", "s"), (1, "user", "a"), (2, "assistant", "b")],
        (6, "question"): [(0, "user", "a"), (1, "assistant", "5")],
        (7, "history"): [(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c"), (3, "assistant", "d"), (4, "user", "e"), (5, "assistant", "f")],
        (8, "history_empty"): [(0, "user", "e"), (1, "assistant", "f")],
        (9, "dialog"): [(0, "assistant", "a")],
    }


def test_odd_records_are_kept_and_named(spark):
    long = "w " * 200_000
    got = run(spark, [None, "", "not json", "[1, 2]", "5", {}, {"messages": "text"}, {"messages": []}, {"prompt": "  ", "completion": None}, {"prompt": long, "completion": "b"}, {"prompt": long, "completion": "b"}])
    nothing = [(None, None, None)]
    assert got[0, "null"] == got[1, "invalid"] == got[2, "invalid"] == got[3, "invalid"] == got[4, "invalid"] == nothing
    assert got[5, "unmapped"] == got[6, "unmapped"] == got[7, "unmapped"] == nothing
    assert got[8, "completion"] == nothing
    assert got[9, "completion"] == got[10, "completion"] == [(0, "user", long), (1, "assistant", "b")]


def test_no_records(spark):
    assert run(spark, [{}][:0]) == {}


def test_paths_ignore_order_and_unknown_fields(spark):
    a = '{"z": 1, "messages": [{"content": "x", "role": "y"}, {"role": "y", "content": null, "w": {"v": [[1]]}}]}'
    b = '{"messages": [{"role": "y", "content": "x"}]}'
    df = spark.createDataFrame([(a,), (b,)], "record string").withColumn("v", F.try_parse_json("record"))
    rows = df.select(op.field_paths(F.col("v")).alias("p"), op.fingerprint(op.field_paths(F.col("v")), op.MAPPINGS[0]).alias("f")).collect()
    assert rows[0]["p"] == ["messages", "messages[]", "messages[].content", "messages[].role", "messages[].w", "messages[].w.v", "messages[].w.v[]", "messages[].w.v[][]", "z"]
    assert rows[0]["f"] == rows[1]["f"]


def test_two_mappings_cannot_own_a_layout(spark):
    with pytest.raises(ValueError):
        op.registry(spark, (*op.MAPPINGS, op.Mapping("again", ("prompt", "completion"), ())))


def test_texts_in_parts(spark):
    image = {"type": "image_url", "image_url": {"url": "http://x"}}
    got = run(
        spark,
        [
            {"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, image, {"type": "text", "text": ""}, {"text": "b"}]}]},
            {"messages": [{"role": "user", "content": [image]}, {"role": "assistant", "content": "plain"}, {"role": "user", "content": [{"type": "text", "text": "part"}]}]},
            {"messages": [{"role": "user", "content": {"text": "an object"}}, {"role": "assistant", "content": ["x", "y"]}]},
            {"conversations": [{"from": "human", "value": ["x", {"text": "y"}, 5, None]}]},
            {"prompt": [{"text": "q"}], "completion": "a"},
        ],
    )
    assert got == {
        (0, "messages_parts"): [(0, "user", "hi"), (1, "assistant", "a\n\nb")],
        (1, "messages"): [(0, "assistant", "plain"), (1, "user", "part")],
        (2, "messages"): [(0, "assistant", "x\n\ny")],
        (3, "sharegpt"): [(0, "user", "x\n\ny")],
        (4, "completion"): [(0, "user", "q"), (1, "assistant", "a")],
    }


def test_the_most_specific_layout_is_taken(spark):
    messages = [{"role": "user", "content": "a"}]
    got = run(spark, [{"messages": messages, "prompt": "p"}, {"messages": messages, "prompt": "p", "completion": "c", "system": "s"}, {"prompt": "p", "completion": "c", "response": "r"}, {"instruction": "i", "output": "o", "question": "q", "answer": "x"}])
    assert got == {
        (0, "messages"): [(0, "user", "a")], (1, "messages"): [(0, "system", "s"), (1, "user", "a")],
        (2, "unmapped"): [(None, None, None)], (3, "unmapped"): [(None, None, None)],
    }
