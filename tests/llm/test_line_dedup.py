import hashlib
from collections import defaultdict

from lodeseek.llm import line_dedup, queries
from lodeseek.llm.common import settings

from ..conftest import DATA
from ..support import assert_same, connect
from .fixtures import clashing, documents, empty, rows, sorted_rows

WS = " \t\n\x0b\x0c\r"


def brute(rows, min_docs=3):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [(i, [(line, line.strip(WS).translate(table)) for line in (t or "").split("\n")]) for i, t in rows]
    held = defaultdict(list)
    for i, lines in keys:
        for k in {k for _, k in lines if len(k) >= 20}:
            held[k].append(i)
    out = []
    for i, lines in keys:
        gone = lambda k: len(held.get(k, ())) >= min_docs and i != max((x for x in held[k] if x is not None), default=None)
        kept = [line for line, k in lines if not gone(k)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_awkward_rows_equal_brute_force(spark):
    want = brute([(r[0], r[1]) for r in rows()])
    for docs in (documents(spark), clashing(spark)):
        assert sorted_rows(line_dedup.dedup_lines(docs), "doc_id", "text", "n_lines", "n_dropped") == want
    assert sum(r[3] for r in want) > 0


def test_batches_and_compaction_do_not_change_the_result(spark):
    many = [(i, "\n".join(f"this is the shared line number {(i * k) % 7}" for k in range(1, 4))) for i in range(40)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    want = brute(many)
    for batches, fanout in ((1, 3), (5, 2), (7, 2)):
        got = line_dedup.dedup_lines(df, batches=batches, fanout=fanout)
        assert sorted_rows(got, "doc_id", "text", "n_lines", "n_dropped") == want


def test_runs_are_merged_without_shuffling_or_sorting_them(spark):
    runs = line_dedup.LineRuns(spark, fanout=9)
    lines = lambda k: spark.range(300).selectExpr(f"xxhash64(id % {k}) AS key_a", f"xxhash64(1, id % {k}) AS key_b", "id AS doc_id", "true AS first")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    try:
        for k in (200, 170, 290):
            runs.add(lines(k))
        with settings(spark, {line_dedup.IN_ORDER: "true"}):
            added, compacted = plan(runs.joined(lines(50))), plan(runs.compacted(runs._runs()))
        assert compacted.count("Exchange") == 0 and compacted.count("FileScan") == 3
        assert added.count("Exchange") == 1 and added.count("LeftAnti") == 3 and added.count("LeftOuter") == 3
        assert added.count("SortMergeJoin") == 6 and added.count("Sort [") == 1  # of the batch
        assert added.index("LeftAnti") < added.index("HashAggregate")  # joined once aggregated
        keys = runs.settled()
        assert keys.count() == keys.select("key_a", "key_b").distinct().count()
    finally:
        runs.close()
    assert runs.levels == [] and not [t for t in spark.catalog.listTables() if t.name.startswith("lodeseek_line_run")]


def test_empty_table_and_kept_columns(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    assert line_dedup.dedup_lines(documents(spark), keep=("lang",)).columns == ["doc_id", "text", "n_lines", "n_dropped", "lang"]


def test_query_equals_its_sql(spark):
    assert_same(line_dedup.op1_line_dedup(spark, DATA), connect(DATA), queries.oracle_sql()["op1_line_dedup"])
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_ids_of_other_types(spark):
    """Of string ids, by code point, the largest keeps the line; of dates the latest."""
    from datetime import date

    line = "a line that is long enough to be a key"
    ids = ["b", "a", "é", "aa", "", "zz" * 20, "zz" * 20 + "a"]
    df = spark.createDataFrame([(i, f"{line}\n{i}") for i in ids], "doc_id string, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).collect()}
    assert got == {i: int(i != max(ids)) for i in ids}
    days = [date(2020, 1, d) for d in range(1, 6)]
    df = spark.createDataFrame([(d, line) for d in days], "doc_id date, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).collect()} == {d: int(d != days[-1]) for d in days}
