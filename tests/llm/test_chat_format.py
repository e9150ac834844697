import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import chat_format as X
from docspark.llm import oracles
from docspark.llm import queries as Q
from oracle import same


def test_query_equals_sql(spark):
    assert same(spark, Q.op7_chat_formatting, oracles.ORACLES["op7_chat_formatting"], "/root/testdata/sf0.001") > 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", Q.CONTROL_TEXT), (1, "assistant", Q.CONTROL_TEXT)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {r.conv_id: r for r in Q.op7_chat_formatting(spark, sf).collect()}
    assert set(rows) == set(turns)
    for k, v in turns.items():
        v.sort()
        learned = "".join(t for _, role, t in v if role == "assistant")
        r = rows[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(v), sha("".join(f"{a}\n{t}\n" for _, a, t in v)), len(learned), sha(learned))


TRICKY = ["<", "/", "s>", "</s>", "<s>", "[", "INST]", "[/INST]", "[INST]", "␛", "␛␛", "<␛/s>", "<<SYS>>", "<</SYS>>", "\n", "$1", "\\", "é", " "]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(TRICKY), max_size=8).map("".join), min_size=1, max_size=30))
def test_round_trip(spark, texts):
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else t, t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = X.parse(X.format_turns(X.canonical_rows(rows))).first()
    assert [(p.role, p.text) for p in got.parsed] == [("assistant" if i % 2 else t, t) for i, t in enumerate(texts)]
    assert [p.learned for p in got.parsed] == [t if i % 2 or t == "assistant" else None for i, t in enumerate(texts)]
    assert got.formatted.count("</s>") == len(texts) and got.formatted.count("[INST]") == len(texts)


def test_layouts_by_fingerprint(spark):
    given_ = {
        '{"messages":[{"content":"a","role":"user"},{"role":"assistant","content":null}]}': ("messages", [("user", "a"), ("assistant", None)]),
        '{"conversations":[{"from":"human","value":"v"},{"from":"gpt","value":"w"}]}': ("from_value", [("user", "v"), ("assistant", "w")]),
        '{"output":"o","instruction":"i"}': ("instruction", [("user", "i"), ("assistant", "o")]),
        '{"output":"o","instruction":"i","input":"x"}': ("instruction_input", [("user", "i\nx"), ("assistant", "o")]),
        '{"prompt":"p","completion":7}': ("prompt_completion", [("user", "p"), ("assistant", "7")]),
        '{"prompt":"p","response":"r"}': ("prompt_response", [("user", "p"), ("assistant", "r")]),
        '{"system":"s","prompt":"p","response":"r"}': ("system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        '{"question":"q","answer":"a"}': ("question_answer", [("user", "q"), ("assistant", "a")]),
        '{"messages":[]}': ("messages", []),
        '{"messages":[{"role":"user"}]}': (None, None),
        '{"x":{"prompt":"p","response":"r"}}': (None, None),
        "no json": (None, None),
        "": (None, None),
    }
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*given_, None])], "layout_id int, record string")
    got = [(r.layout, r.turns and [tuple(t) for t in r.turns] if r.turns is None or r.turns else []) for r in X.canonical_records(df).orderBy("layout_id").collect()]
    assert got == [*given_.values(), (None, None)]
    done = X.parse(X.format_turns(X.canonical_records(df))).orderBy("layout_id").collect()
    assert done[9].formatted is None and done[8].formatted == "<s>" and done[0].parsed[1].learned == ""


def test_further_keys_do_not_void_a_conversation(spark):
    given_ = {
        '{"id":7,"conversations":[{"from":"human","value":"v"},{"from":"gpt","value":"w"}]}': ("from_value", [("user", "v"), ("assistant", "w")]),
        '{"messages":[{"role":"user","content":"a","name":"Z","role_of":{"role":[]}},{"role":"assistant","content":"b"}]}': ("messages", [("user", "a"), ("assistant", "b")]),
        '{"prompt":"p","prompt_id":"q","messages":[{"role":"user","content":"a"}]}': ("messages", [("user", "a")]),
        '{"prompt":"p","response":null,"meta":{"prompt":{"x":1}},"tags":["a",1]}': ("prompt_response", [("user", "p"), ("assistant", None)]),
        '{"instruction":"i","input":"x","output":"o","source":"s"}': ("instruction_input", [("user", "i\nx"), ("assistant", "o")]),
        '{"turns":[],"id":1}': ("role_text", []),
        '{"messages":["a"]}': (None, None),
        '{"messages":[{"role":"user","content":["a"]}]}': (None, None),
        '{"prompt":{"x":1},"response":"r"}': (None, None),
        '{"conv_id":1,"turn":0,"role":"user","text":"t"}': (None, None),
    }
    df = spark.createDataFrame(list(enumerate(given_)), "layout_id int, record string")
    got = [(r.layout, r.turns if r.turns is None else [tuple(t) for t in r.turns]) for r in X.canonical_records(df).orderBy("layout_id").collect()]
    assert got == list(given_.values())


def test_tables_are_looked_up(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "x", [1])], "conv_id long, turn long, role string, text string, more array<int>")
    assert X.FINGERPRINTS[X.table_fingerprint(rows.schema, X.TURN_ROWS)] == "turn_rows"
    assert X.canonical_rows(rows).columns == ["conv_id", "turns"]
    for wrong in (rows.drop("text"), rows.drop("text").withColumnRenamed("more", "text")):
        with pytest.raises(ValueError):
            X.canonical_rows(wrong)
    # another mapping in the table is what the rows get
    monkeypatch.setitem(X.LAYOUTS, "turn_rows", (X.TURN_ROWS, lambda r: r.limit(0)))
    assert X.canonical_rows(rows).count() == 0


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None, "f"), (1, 0, "user", "x", "f"), (1, 0, "user", "x", "f"), (None, 3, "assistant", "y", "f")], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in X.parse(X.format_turns(X.canonical_rows(rows))).collect()}
    assert [(p.role, p.text) for p in got[1].parsed] == [("", ""), ("user", "x"), ("user", "x")] and got[None].parsed[0].learned == "y"
    assert X.canonical_rows(rows.limit(0)).count() == 0
