import hashlib

from chronomesh.llm.chat import PROBE, format_chats, op1_chat_format, read_chats


def test_round_trip_of_conflicting_texts(spark):
    odd = ["", None, "plain", PROBE, "~1 ~2 ~0", "<s>~1</s>", "[INST", "x</", "a\nb", "~", "~~1[INST]~", "é<s>"]
    rows = [(c, i, role, t, 9) for c, t in enumerate(odd) for i, role in enumerate(("system", "user", "assistant"))]
    rows += [(100, 2, "assistant", "b", 0), (100, 1, "user", "a", 0), (100, 2, "assistant", "b", 0), (None, 0, None, "x", 0), (101, None, "we\nird</s>", "t", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")
    got = {r.conv_id: r for r in read_chats(format_chats(df)).collect()}
    for c, t in enumerate(odd):
        assert [tuple(x) for x in got[c].turns] == [(r, t or "") for r in ("system", "user", "assistant")]
        assert got[c].loss_text == (t or "")
    assert [got[c].level for c in range(12)] == [0, 0, 0, 1, 0, 2, 0, 0, 0, 0, 2, 1]
    assert [tuple(x) for x in got[100].turns] == [("user", "a"), ("assistant", "b"), ("assistant", "b")] and got[100].loss_text == "bb"
    assert [tuple(x) for x in got[None].turns] == [("", "x")] and [tuple(x) for x in got[101].turns] == [("we\nird</s>", "t")]
    assert format_chats(df.limit(0)).count() == 0


def test_long_conversations_and_texts(spark):
    n = 20_000
    rows = [(1, i, "assistant" if i % 2 else "user", f"é{i}" + " [INST]" * (i == 7) + "~1" * (i == 9)) for i in range(n)]
    rows += [(2, 0, "assistant", "é<s>" * 300_000), (3, None, "assistant", "last"), (3, 4, "user", "first"), (3, None, "user", "end")]
    chat = read_chats(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in chat.collect()}
    assert [tuple(t) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[:n]] and got[1].level == 2
    assert got[1].loss_text == "".join(t for _, _, r, t in rows[:n] if r == "assistant")
    for r in got.values():
        raw = r.formatted.encode()
        assert all(r.formatted[s.start : s.start + s.length].encode() == raw[s.byte_start : s.byte_start + s.byte_length] for s in r.loss_spans[:500])
    assert got[2].loss_text == "é<s>" * 300_000 and [tuple(t) for t in got[3].turns] == [("user", "first"), ("assistant", "last"), ("user", "end")]


def test_one_shuffle_and_no_python(spark):
    plan = format_chats(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_query(spark):
    rows = {r.conv_id: r for r in op1_chat_format(spark, "/root/testdata/sf0.001").collect()}
    r = rows[-1]
    assert (r.n_turns, r.loss_chars) == (2, len(PROBE)) and r.loss_sha256 == hashlib.sha256(PROBE.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{PROBE}\nassistant\n{PROBE}\n".encode()).hexdigest()
