"""Prefix trie of conversations, its subtree sums by heavy-path decomposition.

A node is the set of conversations that begin with the same turns; its key is the depth
and a 128-bit hash of those turns, a running xor of hashes of (place, turn), so that one
long conversation needs no single task. The heavy child of a node is the one with most
conversations. Heavy paths get their heads by pointer doubling; the light paths hang on
their parents' paths, and as a light child has at most half of its parent's conversations
the paths' totals are summed upwards in at most log2(conversations) rounds. Suffix sums
along each path, in blocks of bounded length, then give every node its subtree's sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, stage, text_of
from .prefixes import running

KEY = ["depth", "key_a", "key_b"]
#: Nodes of a path that are summed in one task.
BLOCK = 4096


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 0), turn_a, turn_b (hashes of role and text), chars of the turns of conversations (conv_id, turn, role, text).

    Turns stand by turn, null first, ties by hash; repeated rows are turns each; a null
    role or text is empty. Rows without a conv_id are left out: they have no number.
    """
    role, text = text_of("role"), text_of("text")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.xxhash64(role, text).alias("turn_a"), F.xxhash64(F.lit(1), role, text).alias("turn_b"), F.char_length(text).cast("long").alias("chars")
    )
    turn = F.col("turn").asc_nulls_first()
    return running(turns, "conv_id", [turn, F.col("turn_a"), F.col("turn_b")], [turn, F.col("turn_a")], {}, name="turns").drop("turn")


def rebuilt(placed: DataFrame, base_of: Callable[[Column], Column], share: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like their base: its first `share` turns (0 to most), then their own after as many.

    Returns turns like placed_turns', and conv_id with n_turns (0 too) of every conversation.
    """
    counted = stage(placed.groupBy("conv_id").agg((F.max("position") + 1).alias("n_own")), "conversations")
    heads = stage(placed.filter((F.col("position") < most) & (base_of(F.col("conv_id")) == F.col("conv_id"))), "heads")
    own = F.col("conv_id")
    wanted = counted.select("conv_id", "n_own", share(own).alias("h"), base_of(own).alias("base"))
    n_heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("n_base"))
    sized = wanted.join(n_heads, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    sized = stage(sized.select("conv_id", "base", "h", "n_head", (F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).cast("long").alias("n_turns")), "shares")
    taken = (
        heads.withColumnRenamed("conv_id", "base")
        .join(sized.select("conv_id", "base", "n_head"), "base")
        .filter("position < n_head")
        .select("conv_id", "position", "turn_a", "turn_b", "chars")
    )
    # share depends on the conv_id alone, so that no join is needed but for the turns that move up
    moved = placed.filter(F.col("position") >= share(own)).join(
        sized.filter("n_head < h").select(F.col("conv_id").alias("moved_id"), (F.col("h") - F.col("n_head")).alias("up")), F.col("conv_id") == F.col("moved_id"), "left"
    )
    kept = moved.select("conv_id", (F.col("position") - F.coalesce("up", F.lit(0))).alias("position"), "turn_a", "turn_b", "chars")
    return taken.unionByName(kept), sized.select("conv_id", "n_turns")


@dataclass
class Trie:
    """nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, key_a, key_b;
    ends: conv_id and the key (depth, key_a, key_b) of the node where it ends."""

    nodes: DataFrame
    ends: DataFrame


def _nodes(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their parents' keys (the root's: null), and where conversations end."""
    hashed = turns.select(
        "conv_id", "position", "chars", F.xxhash64("position", "turn_a", "turn_b").alias("own_a"), F.xxhash64(F.lit(2), "position", "turn_b", "turn_a").alias("own_b")
    ).withColumnRenamed("position", "at")
    at = F.col("at")
    keyed = running(hashed, "conv_id", [at], [at], {}, {"before_a": F.col("own_a"), "before_b": F.col("own_b")}, name="prefixes")
    keyed = keyed.select(
        "conv_id", (at + 1).alias("depth"), F.col("before_a").bitwiseXOR(F.col("own_a")).alias("key_a"), F.col("before_b").bitwiseXOR(F.col("own_b")).alias("key_b"),
        "before_a", "before_b", "chars",
    )
    grown = keyed.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("before_a", "before_b", "chars")])
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    nothing = F.lit(None).cast("long")
    top = root.select(zero.alias("depth"), zero.alias("key_a"), zero.alias("key_b"), "conv_id", "n_convs", nothing.alias("before_a"), nothing.alias("before_b"), zero.alias("chars"))
    last = keyed.join(members.select(F.col("conv_id").alias("member"), "n_turns"), (F.col("conv_id") == F.col("member")) & (F.col("depth") == F.col("n_turns")))
    ends = last.select("conv_id", *KEY).unionByName(members.filter("n_turns = 0").select("conv_id", zero.alias("depth"), zero.alias("key_a"), zero.alias("key_b")))
    return stage(grown.unionByName(top), "nodes"), ends


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_conv_id, n_children and whether each is its parent's heavy child: the one with most conversations, then the smallest conv_id."""
    family = (
        nodes.filter("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("before_a").alias("key_a"), F.col("before_b").alias("key_b"))
        .agg(F.count("*").alias("n_children"), F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    )
    parents = stage(nodes.join(family, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "parents")
    upper = parents.select((F.col("depth") + 1).alias("up_depth"), F.col("key_a").alias("up_a"), F.col("key_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    same = (F.col("depth") == F.col("up_depth")) & (F.col("before_a") == F.col("up_a")) & (F.col("before_b") == F.col("up_b"))
    joined = parents.join(upper, same, "left")
    return joined.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "chars", F.coalesce(F.col("conv_id") == F.col("chosen"), F.lit(False)).alias("is_heavy"))


def _heads(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, head_conv, head_depth: the head of each node's heavy path, by pointer doubling."""
    up = stage(
        nodes.select(
            "conv_id", "depth", F.when(F.col("is_heavy"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("head_conv"),
            F.when(F.col("is_heavy"), F.col("depth") - 1).otherwise(F.col("depth")).alias("head_depth"),
        ), "pointers",
    )
    # depths fall with each step, so their sum tells when nothing moves any more
    total = up.agg(F.sum("head_depth")).first()[0]
    while True:
        above = up.select(F.col("conv_id").alias("a_conv"), F.col("depth").alias("a_depth"), F.col("head_conv").alias("a_head"), F.col("head_depth").alias("a_head_depth"))
        new = up.join(above, (F.col("head_conv") == F.col("a_conv")) & (F.col("head_depth") == F.col("a_depth")))
        new = stage(new.select("conv_id", "depth", F.col("a_head").alias("head_conv"), F.col("a_head_depth").alias("head_depth")), "pointers")
        discard(up)
        up, before, total = new, total, new.agg(F.sum("head_depth")).first()[0]
        if total == before:
            return up


def _path_totals(paths: DataFrame) -> DataFrame:
    """head_conv, head_depth, leaves, saved: sums over each path and all paths below it, in rounds up the light edges.

    paths: head_conv, head_depth, on_conv, on_depth (head of the path it hangs on, null
    for the root's), leaves, saved (the path's own).
    """
    rounds = [paths.select("head_conv", "head_depth", "leaves", "saved")]
    links = paths.filter("on_conv IS NOT NULL").select("head_conv", "head_depth", "on_conv", "on_depth")
    while True:
        sent = rounds[-1].join(links, ["head_conv", "head_depth"]).groupBy("on_conv", "on_depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        got = stage(sent.select(F.col("on_conv").alias("head_conv"), F.col("on_depth").alias("head_depth"), "leaves", "saved"), "attached")
        if got.isEmpty():
            break
        rounds.append(got)
    every = rounds[0]
    for got in rounds[1:]:
        every = every.unionByName(got)
    return every.groupBy("head_conv", "head_depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _suffix_sums(nodes: DataFrame, block: int) -> DataFrame:
    """nodes with leaves and saved summed from the end of their path (head_conv, head_depth) to them."""
    path = ["head_conv", "head_depth"]
    cut = stage(nodes.withColumn("block", F.floor((F.col("depth") - F.col("head_depth")) / block)), "path-blocks")
    # blocks below a block: one row a block
    below = W.partitionBy(*path).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy(*path, "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    carried = sums.select(*path, "block", *[F.sum(c).over(below).alias(f"more_{c}") for c in ("leaves", "saved")]).filter("more_leaves IS NOT NULL")
    down = W.partitionBy(*path, "block").orderBy(F.desc("depth"))
    within = cut.select("*", *[F.sum(c).over(down).alias(f"sum_{c}") for c in ("leaves", "saved")])
    joined = within.join(carried, [*path, "block"], "left")
    return joined.select(
        *[c for c in nodes.columns if c not in ("leaves", "saved")], *[(F.col(f"sum_{c}") + F.coalesce(f"more_{c}", F.lit(0))).cast("long").alias(c) for c in ("leaves", "saved")]
    )


def build(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> Trie:
    """The trie of conversations. turns: conv_id, position (0, 1, ...), turn_a, turn_b (hashes), chars; members: conv_id, n_turns, each once.

    n_leaves counts childless nodes of the subtree, saved_tokens sums (n_convs - 1) * chars
    over it. Without conversations there is no node, not even the root.
    """
    bare, ends = _nodes(turns, members)
    nodes = stage(_linked(bare), "linked")
    heads = _heads(nodes)
    valued = stage(
        nodes.join(heads, ["conv_id", "depth"]).select(
            *nodes.columns, "head_conv", "head_depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
        ),
        "valued",
    )
    discard(heads)
    path = ["head_conv", "head_depth"]
    own = valued.groupBy(*path).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(F.col("depth") == F.col("head_depth"), F.col("parent_conv_id"))).alias("parent_conv_id")
    )
    where = valued.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("head_depth"), F.col("head_conv").alias("on_conv"), F.col("head_depth").alias("on_depth"))
    paths = stage(own.join(where, ["parent_conv_id", "head_depth"], "left"), "paths")
    totals = _path_totals(paths)
    hung = (
        totals.join(paths.select(*path, "parent_conv_id"), path)
        .filter("parent_conv_id IS NOT NULL")
        .groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("head_depth") - 1).alias("depth"))
        .agg(F.sum("leaves").alias("light_leaves"), F.sum("saved").alias("light_saved"))
    )
    with_light = valued.join(hung, ["conv_id", "depth"], "left").select(
        *[c for c in valued.columns if c not in ("leaves", "saved")], *[(F.col(c) + F.coalesce(f"light_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
    )
    summed = _suffix_sums(with_light, block)
    return Trie(
        summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "key_a", "key_b"), ends
    )


def with_ends(trie: Trie) -> DataFrame:
    """The nodes with ends_sha256: a digest of the conv_ids that end there, ascending, joined by commas.

    The digest of a list needs the list in one task, eight bytes a conversation; nothing
    else of the trie does.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    lists = trie.ends.groupBy(*KEY).agg(F.sha2(F.array_join(ids, ","), 256).alias("ends_sha256"))
    joined = trie.nodes.join(lists, KEY, "left")
    return joined.select(*[c for c in trie.nodes.columns if not c.startswith("key_")], F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: Rules of the query: conversations of a hundred share the first one's beginning, up to five turns.
HUNDRED, SHARES = 100, 6


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    turns, members = rebuilt(placed, lambda c: c - c % HUNDRED, lambda c: F.crc32(c.cast("string").cast("binary")) % SHARES, SHARES - 1)
    return with_ends(build(turns, members))


OP13_SQL = r"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS position
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, h FROM (
    SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                      lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM placed))
), moved AS (
  SELECT c.conv_id, p.position AS place, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.position < c.h
  UNION ALL
  SELECT c.conv_id, p.position, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.position >= c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, text,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS path
  FROM moved
), all_turns AS (
  SELECT conv_id, depth, length(text) AS chars, sha256(path::JSON::VARCHAR) AS key FROM turns
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
), nodes AS (
  SELECT depth, key, min(conv_id) AS node, count(*) AS n_convs, any_value(chars) AS chars FROM all_turns GROUP BY depth, key
), rows AS (
  SELECT a.conv_id, a.depth, n.node, n.n_convs, n.chars FROM all_turns a JOIN nodes n USING (depth, key)
), tree AS (
  SELECT n.depth, n.node, n.n_convs, n.chars, r.node AS parent FROM nodes n LEFT JOIN rows r ON r.conv_id = n.node AND r.depth = n.depth - 1
), children AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY ALL
), sized AS (
  SELECT t.*, coalesce(c.n_children, 0) AS n_children FROM tree t LEFT JOIN children c USING (node, depth)
), subtrees AS (
  SELECT r.node, r.depth, count(*) FILTER (WHERE s.n_children = 0) AS n_leaves, sum((s.n_convs - 1) * s.chars) AS saved_tokens
  FROM sized s JOIN rows r ON r.conv_id = s.node AND r.depth <= s.depth GROUP BY ALL
), ends AS (
  SELECT r.node, r.depth, string_agg(r.conv_id::VARCHAR, ',' ORDER BY r.conv_id) AS ids
  FROM rows r JOIN (SELECT conv_id, max(depth) AS depth FROM all_turns GROUP BY conv_id) l USING (conv_id, depth) GROUP BY ALL
)
SELECT s.node AS conv_id, s.depth::BIGINT AS depth, s.parent AS parent_conv_id, s.n_convs, s.n_children::BIGINT AS n_children,
       u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM sized s JOIN subtrees u USING (node, depth) LEFT JOIN ends e USING (node, depth)
"""
