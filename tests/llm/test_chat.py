import hashlib
import random

import pytest

from lodeseek.llm import chat, prefixes

from ..conftest import DATA
from ..support import assert_same, connect

SCHEMA = "conv_id long, turn long, role string, text string"
AWKWARD = [
    (1, 0, "system", "be kind"), (1, 1, "user", "<turn user>\nhi\n</turn>\n"), (1, 2, "assistant", "a\\b \\<turn </turn>\n\n"),
    (2, 0, "user", None), (2, None, "assistant", "null turn first"), (2, 0, None, "no role"), (2, 0, "user", None),
    (3, 5, "an odd role>\n</turn>", ""), (3, 6, "assistant", ""), (3, 7, "assistant", "\\"), (3, 7, "assistant", "é 日本 🙂"),
    (None, 0, "user", "x"), (None, 1, "assistant", "y"),
    (4, 0, "assistant", "word " * 5000), (4, 1, "user", "after"), (4, 2, "assistant", "more"),
    (5, 0, "system", "long " * 3000), (5, 1, "user", "q"), (5, 2, "assistant", "a"),
    (6, 0, "system", "alone"),
]


def plain(rows):
    """conv_id: n_turns, digest, loss, from the rows alone."""
    found = {}
    for c in {r[0] for r in rows}:
        key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found[c] = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    return found


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query_equals_its_sql(spark):
    got = chat.op11_chat_formatting(spark, DATA)
    assert_same(got, connect(DATA), chat.OP11_SQL)
    probe = digests(got)[-7]
    assert probe == plain([(-7, 0, "user", chat.PROBE_TEXT), (-7, 1, "assistant", chat.PROBE_TEXT)])[-7]


def test_awkward_turns_are_read_back(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    for name in ("stretch", "position", "text_hash", "cost", "at", "start", "new", "system"):
        df = df.selectExpr("*", f"'x' AS {name}")
    for budget, history in ((2048, 256), (40, 10), (12, 0)):
        assert digests(chat.conversation_digests(chat.format_windows(df, budget, history))) == plain(AWKWARD)
    assert chat.conversation_digests(chat.format_windows(df.filter("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.format_windows(df, 10, 5)


def long_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = rng.choice([1, 2, 5, 40, 400])
        system = rng.random() < 0.5
        for t in range(turns):
            role = "system" if system and t == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, " ".join(["word"] * rng.choice([0, 1, 3, 10, 30]))))
    return rows


def brute_windows(turns, budget, history, stretch):
    """(first turn, new turns, repeated places) by walking along a conversation; turns: role, cost."""
    at, total = [], 0
    for _, cost in turns:
        at.append(total)
        total += cost
    held = turns[0][1] if turns[0][0] == "system" and turns[0][1] <= budget // 2 else 0
    windows, i = [], 0
    while i < len(turns):
        room = budget if at[i] == 0 else budget - history - held
        j = i + 1
        while j < len(turns) and at[j] // stretch == at[i] // stretch and at[j] + turns[j][1] - at[i] <= room:
            j += 1
        before = [k for k in range(1 if held else 0, i) if at[i] - at[k] <= history]
        windows.append((i, list(range(i, j)), ([0] if held and i else []) + before))
        i = j
    return windows


def test_windows_are_budgeted_and_targets_are_masked_once(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 3)
    rows = long_conversations(1, 25)
    budget, history = 60, 15
    cost = lambda text: len(text.split()) + chat.MARKS
    got = {}
    for w in chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget, history).collect():
        got.setdefault(w.conv_id, []).append(w)
    shown = lambda r: f"<turn {r[2]}>\n{r[3]}\n</turn>\n"
    for c in {r[0] for r in rows}:
        turns = [r for r in rows if r[0] == c]
        want = brute_windows([(r[2], cost(r[3])) for r in turns], budget, history, budget * 3)
        found = sorted(got[c], key=lambda w: w.from_turn)
        assert [(w.from_turn, w.n_turns, w.n_repeated) for w in found] == [(i, len(new), len(old)) for i, new, old in want]
        for w, (_, new, old) in zip(found, want):
            assert w.text == "".join(shown(turns[i]) for i in old + new)
            assert w.n_tokens == sum(cost(turns[i][3]) for i in old + new)
            assert w.n_tokens <= budget
            assert [w.text[x.start : x.start + x.length] for x in w.loss] == [turns[i][3] for i in new if turns[i][2] == "assistant"]


def test_one_conversation_over_many_ranges(spark):
    """Running sums and xors do not depend on how rows are dealt."""
    from pyspark.sql import functions as F

    rows = [(c, t, "user", f"{c} {t}") for c, n in ((1, 3000), (2, 5), (None, 700)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.xxhash64("text"))
    got = prefixes.running(df, "conv_id", [F.col("turn")], [F.col("turn")], {"before": F.col("turn")}, {"mixed": F.col("v")}).collect()
    for c in (1, 2, None):
        total = mixed = 0
        for i, r in enumerate(sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)):
            assert (r.position, r.before, r.mixed) == (i, total, mixed)
            total, mixed = total + r.turn, mixed ^ r.v
    assert len(got) == len(rows)


def test_main_path_runs_no_python(spark):
    plan = chat.op11_chat_formatting(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
