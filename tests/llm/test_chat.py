import json
from collections import defaultdict

import pytest
from cases import sha
from hypothesis import given, settings
from hypothesis import strategies as st

from signalspark.llm import chat

HARD = ["", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "␛", "␛!", "␛␛!<|", "<<|", "<<SYS>> a <</SYS>>", "[INST", "plain", "日本\n語", "<s><s></s>", "a" * 200_000]


def digests(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((str(conv), len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)))
    return sorted(out)


def test_round_trip(spark):
    rows = [(i, k, ("user", "assistant", "system", "<|odd", None)[k % 5], HARD[(i + k) % len(HARD)]) for i in range(6) for k in range(13)]
    rows += [(7, 0, "user", None), (7, 1, "assistant", None), (8, None, "user", "first"), (8, 2, "assistant", "x"), (8, 2, "assistant", "x"), (8, 2, "assistant", "a"), (None, 0, "user", "no id")]
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    shaped = chat.formatted(chat.turns_of_rows(df))
    got = sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(chat.parsed(shaped)).collect())
    assert got == digests(rows)
    inner = shaped.selectExpr("substring(segment, 9, length(segment) - 15) AS s").collect()
    assert not any(c in r.s.replace("<|text|>", "", 1) for r in inner for c in chat.CONTROL)
    assert chat.conversation_digests(chat.parsed(chat.formatted(chat.turns_of_rows(df.limit(0))))).count() == 0


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "response": "a", "extra": {"role": 1}}, "prompt_response", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "completion": None}, "prompt_completion", [("user", "q"), ("assistant", "")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction_input", [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"system": "s", "prompt": "q", "response": "a"}, "system_prompt", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"turns": [{"speaker": "bot", "text": "</s>"}]}, "turns", [("assistant", "</s>")]),
        ({"nothing": "known"}, None, [("", json.dumps({"nothing": "known"}))]),
        ({"messages": []}, None, [("", json.dumps({"messages": []}))]),
    ]
    df = spark.createDataFrame([(i, json.dumps(body), "x") for i, (body, _, _) in enumerate(records)] + [(98, "not json", "x"), (99, None, "x")], "conv_id long, body string, layout string")
    got = defaultdict(list)
    for r in sorted(chat.turns_of_records(df).collect(), key=lambda r: (r.conv_id, r.turn)):
        got[r.conv_id].append((r.layout, r.role, r.text))
    for i, (_, layout, turns) in enumerate(records):
        assert got[i] == [(layout, *t) for t in turns]
    assert got[98] == [(None, "", "not json")] and got[99] == [(None, "", "")]


def test_fingerprints_select_mappings(spark):
    assert len({m.fingerprint() for m in chat.MAPPINGS}) == len(chat.MAPPINGS)
    df = spark.createDataFrame([(1, 2, "user", "t", "x")], "conv_id long, turn long, role string, text string, note string")
    assert chat.mapping_of(df.schema).name == "turn_rows"
    with pytest.raises(ValueError):
        chat.mapping_of(df.select("note").schema)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("<|s>/[INST]␛!ab", max_size=20), min_size=30, max_size=30))
def test_escaping_is_reversible(spark, strings):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for r in df.select("s", chat.escaped(F.col("s")).alias("e"), chat.unescaped(chat.escaped(F.col("s"))).alias("u")).collect():
        assert r.u == r.s and not any(c in r.e for c in chat.CONTROL)
