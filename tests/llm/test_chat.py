import random

from folioflow.llm import chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens int")


def test_windows_by_loops(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(12):
        for t in range(rng.randint(1, 60)):
            role = "system" if t == 0 and conv % 2 else rng.choice(["user", "assistant"])
            rows.append((conv, t, role, " ".join(["w"] * rng.choice([0, 1, 5, 30, 90])), 1))
    windows = chat.format_windows(turns(spark, rows), budget=150, history=25, system_reserve=25).collect()
    span = 50
    by_conv = {}
    for w in windows:
        by_conv.setdefault(w.conv_id, []).append(w)
    for conv, ws in by_conv.items():
        own = [r for r in rows if r[0] == conv]
        cost = [len(r[3].split()) + chat.TURN_COST for r in own]
        start = [sum(cost[:i]) for i in range(len(own))]
        seen = sorted(s.number for w in ws for s in w.segments if not s.repeated)
        assert seen == list(range(len(own)))  # every turn is owned once
        for w in ws:
            mine = [s.number for s in w.segments if not s.repeated]
            assert mine == list(range(mine[0], mine[0] + len(mine)))
            assert len(mine) == 1 or sum(cost[i] for i in mine) <= 2 * span
            begin = start[mine[0]]
            history = [i for i in range(mine[0]) if start[i] >= begin - 25]
            lead = [0] if own[0][2] == "system" and mine[0] > 0 and 0 not in history else []
            assert [s.number for s in w.segments if s.repeated] == lead + history
            assert all(s.loss_length == 0 for s in w.segments if s.repeated)
            assert w.tokens == sum(cost[i] for i in mine + lead + history)
            assert w.over_budget == (w.tokens > 150)


def test_round_trip_of_hostile_texts(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<|x|>", "<|", "|>", "<|>", "a\n</s>\n<|user|>\nb", "", None, "日本 😀 <s>", "[\\INST]", "|", "</s"]
    rows = [(1, i, ["user", "assistant", "a|", "x\\", "<|", None][i % 6], t, 0) for i, t in enumerate(texts)] + [(None, None, "assistant", "lone", 0)]
    back = {(r.conv_id, r.number): r for r in chat.read_windows(chat.format_windows(turns(spark, rows))).collect()}
    for i, (conv, turn, role, text, _) in enumerate(rows):
        r = back[conv, i if conv else 0]
        assert (r.role, r.text) == (role or "", text or "")
        assert r.loss == (text or "" if role == "assistant" else "")


def test_repeated_rows_and_empty(spark):
    rows = [(1, 0, "user", "a", 0), (1, 0, "user", "a", 0), (1, 0, "assistant", "b", 0)]
    got = chat.read_windows(chat.format_windows(turns(spark, rows))).orderBy("number").collect()
    assert [(r.role, r.text) for r in got] == [("assistant", "b"), ("user", "a"), ("user", "a")]
    assert chat.format_windows(turns(spark, [])).count() == 0
