"""Chat formatting in budgeted windows, DataFrame functions only.

Prefix sums of turn tokens lay each conversation on a line, which is cut into stretches of
a bounded number of tokens. Within a stretch windows are chosen greedily: whole turns, as
many as the budget leaves beside what is repeated, which is the system turn and a limited
history, the last turns before the window. Repeated targets are masked, so each target is
under the loss mask of one window.

A turn is written `<turn role>`, newline, text, newline, `</turn>`, newline. In a text a
backslash stands before each backslash and each `<turn` and `</turn` of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, text_of
from .prefixes import running

#: Pieces of at most six letters, at most three digits or one other character, counted as tokens.
PIECE = r"\p{L}{1,6}|\p{N}{1,3}|[^\p{L}\p{N}\x20\x09-\x0D]"
#: Tokens that a turn's marks count.
MARKS = 4
#: Token budgets of a window and of the history repeated in it; stretches hold so many windows' budgets.
BUDGET, HISTORY, STRETCH = 2048, 256, 16
HEAD, END = "<turn ", "\n</turn>\n"


def pieces(text: Column) -> Column:
    """The default count of tokens; any function of a text column that gives a number will do."""
    return F.regexp_count(text, F.lit(PIECE)).cast("long")


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<turn"), F.lit("\\<turn")), F.lit("</turn"), F.lit("\\</turn"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def role_mark(role: Column) -> Column:
    """The role, or = and its bytes in hexadecimal digits where it isn't a plain word."""
    return F.when(role.rlike(r"^[A-Za-z0-9_.-]+\z"), role).otherwise(F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8"))))


def marked_role(mark: Column) -> Column:
    return F.when(mark.startswith("="), F.decode(F.unhex(F.substring(mark, 2, 2**31 - 1)), "UTF-8")).otherwise(mark)


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = pieces, targets: str = "assistant", system: str = "system"
) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text; other columns are ignored).

    Returns conv_id, from_turn (the place, from 0, of the first turn that is new here),
    n_turns (new ones), n_repeated (turns before them: the system turn and history),
    n_tokens, text, loss: start and length, in code points, of each target in the text.

    Turns stand by turn, null first, ties by role, then text; repeated rows are turns each.
    A null role or text is empty. A null conv_id is a conversation. The first turn, if it
    has the system role and at most half the budget, is repeated in each later window. A
    window is over the budget only where one turn with what is repeated is: turns are never
    cut, however long. History is the whole turns just before, within its budget, so none
    where the last one is longer. An empty table gives no windows.
    """
    if not 0 <= history < budget // 2:
        raise ValueError("history must be less than half of the budget")
    role, text = text_of("role"), text_of("text")
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.select(
        "*", (tokens(F.col("text")) + MARKS).cast("long").alias("cost"), (F.char_length(role_mark(F.col("role"))) + len(HEAD) + 2).cast("long").alias("head")
    )
    turns = turns.withColumn("body", F.char_length(escape(F.col("text"))).cast("long"))
    ranges = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32)]
    width = F.col("head") + F.col("body") + len(END)
    placed = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ranges, {"at": F.col("cost"), "chars": width}, name="turns")
    written = F.concat(F.lit(HEAD), role_mark(F.col("role")), F.lit(">\n"), escape(F.col("text")), F.lit(END))
    stretch = F.floor(F.col("at") / (budget * STRETCH))
    lasts_into_next = F.col("at") >= (stretch + 1) * budget * STRETCH - history
    turn = F.struct("at", "position", "cost", "chars", "head", "body", (F.col("role") == targets).alias("target"), written.alias("written"))
    kept = (F.col("position") == 0) & (F.col("role") == system) & (F.col("cost") <= budget // 2)
    # a stretch has a bounded number of turns, as each costs MARKS at least
    stretches = (
        placed.select("conv_id", F.explode(F.when(lasts_into_next, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))).alias("stretch"), turn.alias("turn"))
        .groupBy("conv_id", "stretch")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    )
    systems = placed.filter(kept).select(F.col("conv_id").alias("of_conv"), F.struct(F.col("cost"), F.length(written).cast("long").alias("chars"), written.alias("written")).alias("system"))
    both = stretches.join(systems, F.col("conv_id").eqNullSafe(F.col("of_conv")), "left")

    held = F.coalesce("system.cost", F.lit(0))
    own = F.filter("turns", lambda t: t["at"] >= F.col("stretch") * budget * STRETCH)

    def room(start: Column) -> Column:
        return F.when(start == 0, F.lit(budget)).otherwise(F.lit(budget - history) - held)

    def starts(own: Column) -> Column:
        def step(found: Column, t: Column) -> Column:
            last = F.element_at(found, -1)
            return F.when((t["at"] > last) & (t["at"] + t["cost"] - last > room(last)), F.array_append(found, t["at"])).otherwise(found)

        return F.aggregate(own, F.array(F.get(own, F.lit(0))["at"]), step)

    cut = both.select("conv_id", "turns", "system", own.alias("own")).filter(F.size("own") > 0).select("*", starts(F.col("own")).alias("starts"))
    windows = cut.select("conv_id", "turns", "system", "own", "starts", F.posexplode("starts").alias("i", "start"))
    until = F.get("starts", F.col("i") + 1)
    new = F.filter("own", lambda t: (t["at"] >= F.col("start")) & (until.isNull() | (t["at"] < until)))
    repeats_system = F.col("system").isNotNull() & (F.col("start") > 0)
    before = F.filter(
        "turns", lambda t: (t["at"] < F.col("start")) & (t["at"] >= F.col("start") - history) & ((t["position"] > 0) | F.col("system").isNull())
    )
    windows = windows.select("conv_id", new.alias("new"), before.alias("before"), F.when(repeats_system, F.array("system")).alias("system"))
    first = F.get("new", F.lit(0))

    def total(turns: Column | str, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s + of(t))

    def written_of(turns: Column | str) -> Column:
        return F.array_join(F.transform(turns, lambda t: t["written"]), "")

    repeated_chars = total("before", lambda t: t["head"] + t["body"] + len(END)) + F.coalesce(F.get("system", F.lit(0))["chars"], F.lit(0))
    sized = windows.withColumn("shift", repeated_chars - first["chars"])
    loss = F.transform(
        F.filter("new", lambda t: t["target"]), lambda t: F.struct((t["chars"] + t["head"] + F.col("shift")).alias("start"), t["body"].alias("length"))
    )
    return sized.select(
        "conv_id",
        first["position"].alias("from_turn"),
        F.size("new").cast("long").alias("n_turns"),
        (F.size("before") + F.coalesce(F.size("system"), F.lit(0))).cast("long").alias("n_repeated"),
        (total("new", lambda t: t["cost"]) + total("before", lambda t: t["cost"]) + F.coalesce(F.get("system", F.lit(0))["cost"], F.lit(0))).alias("n_tokens"),
        F.concat(F.coalesce(F.get("system", F.lit(0))["written"], F.lit("")), written_of("before"), written_of("new")).alias("text"),
        loss.alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, from_turn, turns (role and text of those that are new), targets (texts under the loss mask), chars: read from the windows' text."""
    # the last piece is what follows the last end mark, nothing
    found = F.slice(F.split("text", END, -1), F.col("n_repeated").cast("int") + 1, F.col("n_turns").cast("int"))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">\n", 1)
        return let(
            head,
            lambda h: F.struct(
                marked_role(F.substring(h, len(HEAD) + 1, 2**31 - 1)).alias("role"), unescape(F.substr(piece, F.char_length(h) + 3)).alias("text")
            ),
        )

    targets = F.transform("loss", lambda x: unescape(F.substr(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return windows.select("conv_id", "from_turn", F.transform(found, turn).alias("turns"), targets.alias("targets"), F.char_length("text").cast("long").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Digests of each conversation as it is read back from its windows.

    A digest of a whole conversation needs the conversation in one task; the windows
    themselves never do.
    """
    joined = read_windows(windows).select(
        "conv_id",
        F.struct(
            "from_turn",
            F.size("turns").cast("long").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("text"),
            F.array_join("targets", "").alias("loss"),
            "chars",
        ).alias("w"),
    )
    whole = joined.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("w.n").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"))
    whole = whole.select("*", F.array_join("w.text", "").alias("text"), F.array_join("w.loss", "").alias("loss"), F.size("w").cast("long").alias("n_windows"))
    return whole.select(
        "conv_id", "n_turns", F.sha2("text", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )


#: The conversation that the query adds.
PROBE, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(PROBE).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return conversation_digests(format_windows(rows.unionByName(probe)))


OP11_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, row_number() OVER w - 1 AS position,
    (len(regexp_extract_all(text, '\p{L}{1,6}|\p{N}{1,3}|[^\p{L}\p{N}\x20\x09-\x0D]')) + 4)::BIGINT AS cost,
    17 + CASE WHEN regexp_full_match(role, '[A-Za-z0-9_.-]+') THEN length(role) ELSE 1 + 2 * strlen(role) END
      + length(replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn')) AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), placed AS (
  SELECT *, (sum(cost) OVER (PARTITION BY conv_id ORDER BY position) - cost)::BIGINT AS starts_at FROM turns
), systems AS (
  SELECT conv_id, cost, chars FROM placed WHERE position = 0 AND role = 'system' AND cost <= 1024
), laid AS (
  SELECT p.conv_id, p.position, p.starts_at, p.cost, p.chars, p.starts_at // 32768 AS stretch, coalesce(s.cost, 0) AS held, s.conv_id IS NOT NULL AS kept
  FROM placed p LEFT JOIN systems s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), starts AS (
  SELECT conv_id, stretch, held, min(starts_at) AS start FROM laid GROUP BY ALL
  UNION ALL
  SELECT s.conv_id, s.stretch, s.held, n.start FROM starts s, LATERAL (
    SELECT min(l.starts_at) AS start FROM laid l
    WHERE l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.stretch = s.stretch AND l.starts_at > s.start
      AND l.starts_at + l.cost - s.start > CASE WHEN s.start = 0 THEN 2048 ELSE 1792 - s.held END) n
  WHERE n.start IS NOT NULL
), repeated AS (
  SELECT s.conv_id, sum(l.chars) AS chars FROM starts s JOIN laid l ON l.conv_id IS NOT DISTINCT FROM s.conv_id
   AND s.start > 0 AND ((l.starts_at < s.start AND l.starts_at >= s.start - 256) OR (l.position = 0 AND l.kept)) GROUP BY s.conv_id
)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(t.chars) + coalesce(any_value(r.chars), 0))::BIGINT AS formatted_chars,
  (SELECT count(*) FROM starts s WHERE s.conv_id IS NOT DISTINCT FROM t.conv_id) AS n_windows
FROM placed t LEFT JOIN repeated r ON r.conv_id IS NOT DISTINCT FROM t.conv_id
GROUP BY t.conv_id
"""
