import hashlib
import random
import zlib

from lodeseek.llm import trie

from ..conftest import DATA
from ..support import assert_same, connect

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    """conv_id: its turns (role, text) after rebuilding, by walking over the rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def plain(convs):
    """Rows of the trie of {conv_id: turns} by recursion."""
    out = []

    def walk(members, depth, parent):
        top = min(members)
        groups, ends = {}, sorted(c for c in members if len(convs[c]) == depth)
        for c in members:
            if len(convs[c]) > depth:
                groups.setdefault(convs[c][depth], []).append(c)
        below = [walk(g, depth + 1, top) for g in groups.values()]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + (len(members) - 1) * (len(convs[top][depth - 1][1]) if depth else 0)
        out.append((top, depth, parent, len(members), len(groups), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if convs:
        walk(list(convs), 0, None)
    return sorted(out, key=repr)


def got_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def write(spark, tmp_path, rows, extra=()):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in extra:
        df = df.selectExpr("*", f"'x' AS {name}")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_query_equals_its_sql(spark):
    assert_same(trie.op13_conversation_trie(spark, DATA), connect(DATA), trie.OP13_SQL)


def test_awkward_conversations(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", None, "assistant"]), rng.choice(["", None, "a", "b", "é🙂"])) for c in range(330) if not 200 <= c <= 210 for t in range(rng.choice([1, 2, 3, 9]))]
    rows += [(500 + i, 0, "user", "same") for i in range(40)] + [(None, 0, "user", "x"), (600, None, "user", "first"), (600, -3, "user", "second")]
    rows += [(601, t, "user", f"t{t}") for t in range(300)]  # a long chain
    data = write(spark, tmp_path, rows, ("depth", "position", "key_a", "chars", "base", "h"))
    assert got_rows(trie.op13_conversation_trie(spark, data)) == plain(rebuilt(rows))


def test_empty_and_alone(spark, tmp_path):
    assert trie.op13_conversation_trie(spark, write(spark, tmp_path / "a", [])).count() == 0
    # no base, fewer own turns than are taken from it: a conversation without turns
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    data = write(spark, tmp_path / "b", [(c, 0, "user", "x"), (c, 1, "user", "y")])
    assert got_rows(trie.op13_conversation_trie(spark, data)) == plain({c: []})


def test_deep_and_bushy_trees(spark):
    """Heavy paths that change their smallest member often, blocks shorter than paths, many light levels."""
    rng = random.Random(7)
    convs = {}
    for c in range(300):
        grown = list(rng.choice(list(convs.values())))[: rng.randint(0, 30)] if convs else []
        convs[c] = grown + [("u", rng.choice("abc")) for _ in range(rng.randint(0, 12))]
    turns = [(c, i, hash((r, t)) , hash((t, r, 1)), len(t)) for c, v in convs.items() for i, (r, t) in enumerate(v)]
    df = spark.createDataFrame(turns, "conv_id long, position long, turn_a long, turn_b long, chars long")
    members = spark.createDataFrame([(c, len(v)) for c, v in convs.items()], "conv_id long, n_turns long")
    assert got_rows(trie.with_ends(trie.build(df, members, block=4))) == plain(convs)
