"""Chat formatting: layouts chosen by fingerprint, reversible escapes, digests against SQL and plain Python."""

import hashlib
import json

import duckdb
import pandas as pd

from ledgerspan.llm import chat_format
from ledgerspan.llm.common import scratch_path

NASTY = ["</s>[INST] ok [/INST]", "\\[INST]", "\\\\</s>", "<<<SYS>>>", "<</SYS>><s>", "a\\", "x [/INST] y </s>", "\n<</SYS>>\n\n",
         "  spaced  ", "", "é" * 3000 + "<s>"]


def digests(turns):
    lines = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def turn_rows():
    rows = [(1, k, ["user", "assistant"][k % 2], text) for k, text in enumerate(NASTY)]
    rows += [(2, 0, "System", "be brief"), (2, 1, None, None), (2, 2, "GPT", "fine"), (2, None, "assistant", "last"),
             (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"),
             (None, 0, "user", "no key"), (4, 0, "tool", "out")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "clash", 0) for c, t, r, x in rows],
                                 "conv_id long, turn long, role string, text string, formatted string, __key int")


def oracle(rows):
    con = duckdb.connect()
    con.register("conv_df", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64", "conv_id": "Int64"}))
    return con.sql(chat_format.oracle_sql("conv_df")).df()


def test_turn_rows_against_sql(spark):
    rows = turn_rows()
    formatted = chat_format.format_chats(frame(spark, rows))
    path = scratch_path(spark, "chat-test")
    formatted.write.parquet(path)
    got = chat_format.read_back(spark.read.parquet(path)).toPandas()
    want = oracle(rows)
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key = lambda df: df[cols].astype(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(key(got.astype({"conv_id": "Int64"})), key(want.astype({"conv_id": "Int64"})))


def test_escape_round_trip_and_no_marker_inside(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    from pyspark.sql import functions as F
    out = df.select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("back", chat_format.unescape(F.col("e"))).collect()
    for row in out:
        assert row.back == row.t
        for marker in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
            assert marker not in row.e


def test_conversation_one_digests_by_hand(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], text) for k, text in enumerate(NASTY)]
    got = chat_format.read_back(chat_format.format_chats(frame(spark, rows))).collect()[0]
    turns = [(r, t or "") for _, _, r, t in rows]
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == digests(turns)


def test_layouts_chosen_per_row(spark, tmp_path):
    records = [
        {"id": 1, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"},
                               {"role": "assistant", "content": "a [/INST]"}]},
        {"id": 2, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"id": 3, "instruction": "add", "input": "1 2", "output": "3"},
        {"id": 4, "instruction": "say", "output": "x", "system": "sys"},
        {"id": 5, "prompt": "p", "response": "r"},
        {"id": 6, "prompt": "p", "completion": "c"},
        {"id": 7, "prompt": "p", "response": "r", "completion": "c"},
        {"id": 8, "messages": []},
    ]
    path = tmp_path / "mixed.json"
    path.write_text("\n".join(json.dumps(r) for r in records))
    df = spark.read.json(str(path))
    formatted = {r.id: r for r in chat_format.format_chats(df, key="id").collect()}
    back = {r.id: r for r in chat_format.read_back(chat_format.format_chats(df, key="id"), key="id").collect()}
    assert {k: formatted[k].layout for k in formatted} == {1: "messages", 2: "sharegpt", 3: "instruction", 4: "instruction",
                                                           5: "prompt_response", 6: "prompt_completion"}
    expected = {1: [("system", "s"), ("user", "q"), ("assistant", "a [/INST]")], 2: [("user", "hi"), ("assistant", "yo")],
                3: [("user", "add\n\n1 2"), ("assistant", "3")], 4: [("system", "sys"), ("user", "say"), ("assistant", "x")],
                5: [("user", "p"), ("assistant", "r")], 6: [("user", "p"), ("assistant", "c")]}
    for k, turns in expected.items():
        assert (back[k].n_turns, back[k].turns_sha256, back[k].loss_chars, back[k].loss_sha256) == digests(turns)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_chats(empty)).count() == 0
