"""A stored inverted index with block maxima, and a top k that skips blocks.

Postings are cut into blocks, one for each term and range of RANGE positions in a segment.
A block's head holds the number of its documents, their least id and, for each term frequency in it, the
least document length, from which follows the best score that it can give for any k1, b and
average length. A search reads the heads of its terms' blocks, adds up what each range can
give to each query at most, scores the most promising ranges first and then only those that
could still reach the k-th score found. Figures of the corpus are those of the live rows: the
hidden ones are counted from their rows and taken off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.catalog import Catalog, Manifest, Segment
from . import bm25, numbering, term_table
from .segment_index import SegmentIndex

#: A range has 2^RANGE_BITS positions; distinct terms of a batch that are pushed down to the scan.
RANGE_BITS, PUSHED_TERMS = 6, 2_000
POSTINGS = "term string, range long, n long, least_id long, best array<struct<tf: long, length: int>>, postings array<struct<_pos: long, id: long, tf: long, length: int>>"
STATS = "n_docs long, n_sized long, total_length long"
#: Scores are rounded to ten places; by so much more could a range give than the sum of its bounds, as sums round too.
SLACK = 1e-11


@dataclass
class Chosen:
    """What a search may read: `blocks` (query_id, w, range) of all ranges with a term of the query, with bound (what
    they can give) and needed (whether they are read); terms with their weights; the average length."""

    manifest: Manifest
    segments: list[Segment]
    terms: DataFrame
    blocks: DataFrame
    mean: float


class InvertedIndex(SegmentIndex):
    """Keyword search on a column of texts of a table of the store."""

    def __init__(self, catalog: Catalog, table: str = "documents", text: str = "full_text", analyze: bm25.Analyzer = T.tokens, name: str = "keyword"):
        super().__init__(catalog, table, name)
        self.text, self.analyze = text, analyze

    def _tokens(self, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*columns, self.analyze(F.col(self.text)).alias("tokens")).withColumn("length", F.size("tokens"))

    def build(self, segment: Segment, rows: DataFrame) -> None:
        tokens = self._tokens(rows, "_pos", F.col(self.key).alias("id"))
        counted = tokens.select("_pos", "id", "length", term_table.counted()("tokens").alias("found")).select("_pos", "id", "length", F.explode("found").alias("f"))
        # the only shuffle: ranges of terms and positions, so that blocks are made where they are written
        tf = counted.select("_pos", "id", "length", "f.term", "f.tf", F.shiftright("_pos", RANGE_BITS).alias("range")).repartitionByRange("term", "range")
        one = F.struct("_pos", "id", "tf", "length")
        blocks = tf.groupBy("term", "range").agg(F.array_sort(F.collect_list(one)).alias("postings"))  # 2^RANGE_BITS at most
        frequencies = F.array_distinct(F.transform("postings", lambda p: p["tf"]))
        best = F.transform(
            frequencies, lambda t: F.struct(t.alias("tf"), F.array_min(F.transform(F.filter("postings", lambda p: p["tf"] == t), lambda p: p["length"])).alias("length"))
        )
        headed = blocks.select("term", "range", F.size("postings").cast("long").alias("n"), F.array_min("postings.id").alias("least_id"), best.alias("best"), "postings")
        # in order, with short pages, so that a scan for some terms and ranges skips most of the rest
        self.put("postings", segment, headed.sortWithinPartitions("term", "range"), **{"parquet.page.row.count.limit": "1000"})
        self.put("stats", segment, self._totals(tokens).coalesce(1))

    @staticmethod
    def _totals(tokens: DataFrame) -> DataFrame:
        return tokens.agg(F.count("*").alias("n_docs"), F.count("length").alias("n_sized"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))

    def _choose(self, queries: DataFrame, k: int, k1: float, b: float, average: float | None) -> Chosen | None:
        manifest, segments = self.current()
        if not segments:
            return None
        terms = queries.select("query_id", F.explode(F.array_distinct(self.analyze(F.col("text")))).alias("term"))
        wanted = bm25.checked_queries(terms.select("term").distinct(), bm25.MAX_QUERIES * 10)
        heads = self._of_terms(self.read("postings", segments, POSTINGS), wanted).select("w", "term", "range", "n", "least_id", "best")
        figures = self.read("stats", segments, STATS).agg(F.sum("n_docs"), F.sum("n_sized"), F.sum("total_length")).first()
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        if manifest.deleted:
            gone = self._tokens(self.catalog.hidden_rows(self.table, manifest))
            figures = [a - c for a, c in zip(figures, self._totals(gone).first())]
            less = gone.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("less"))
            df = df.join(less, "term", "left").select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df"))
        n_docs, n_sized, total = figures
        mean = average if average is not None else (total / n_sized if n_sized else 1.0)
        idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = terms.join(F.broadcast(df.select("term", idf.alias("idf"))), "term")  # a row a term that was asked for
        weighed = numbering.kept(weighed)
        most = F.array_max(F.transform("best", lambda x: _part(F.col("idf"), x["tf"], x["length"], k1, b, mean)))
        upper = heads.join(bm25.checked_queries(weighed, bm25.MAX_QUERIES * 100), "term")
        upper = upper.groupBy("query_id", "w", "range").agg(F.sum(most).alias("bound"), F.min("least_id").alias("least_id"), F.count("*").alias("n_blocks"))
        upper = numbering.kept(upper)
        # the best of the 2 k most promising ranges give the score to reach; cut before the shuffle as well
        best_first = W.partitionBy("query_id").orderBy(F.desc("bound"), "w", "range")
        head = upper.withColumn("_i", F.row_number().over(best_first)).filter(F.col("_i") <= 2 * k)
        chosen = Chosen(manifest, segments, weighed, upper, mean)
        reached = bm25.top_k(self._scores(chosen, head.select("query_id", "w", "range"), k1, b), k).filter(F.col("rank") == k)
        least = F.broadcast(reached.select(F.col("query_id").alias("_query"), F.col("score").alias("_least"), F.col("id").alias("_last")))  # a row a query
        bound = F.round(F.col("bound") + SLACK, 10)
        # of equal scores the smaller id comes first
        needed = F.col("_least").isNull() | (bound > F.col("_least")) | ((bound == F.col("_least")) & (F.col("least_id") <= F.col("_last")))
        chosen.blocks = upper.join(least, F.col("query_id") == F.col("_query"), "left").select("query_id", "w", "range", "bound", "n_blocks", needed.alias("needed"))
        return chosen

    def _of_terms(self, postings: DataFrame, wanted: DataFrame) -> DataFrame:
        few = [r.term for r in wanted.limit(PUSHED_TERMS + 1).collect()]
        return postings.filter(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else postings.join(wanted, "term", "left_semi")

    def _scores(self, chosen: Chosen, ranges: DataFrame, k1: float, b: float) -> DataFrame:
        """query_id, id, score of the live documents in these ranges (query_id, w, range)."""
        wanted = bm25.checked_queries(chosen.terms.select("term").distinct(), bm25.MAX_QUERIES * 10)
        postings = self._of_terms(self.read("postings", chosen.segments, POSTINGS), wanted).select("w", "term", "range", "postings")
        asked = ranges.join(bm25.checked_queries(chosen.terms, bm25.MAX_QUERIES * 100), "query_id")
        asked = asked.groupBy("w", "range", "term").agg(F.collect_list(F.struct("query_id", "idf")).alias("asked"))  # a batch's queries at most
        # all blocks of a range meet in one task, and postings are dealt out to queries there: what is shuffled doesn't grow with the queries
        here = postings.join(asked, ["w", "range", "term"]).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "w", "range")
        met = here.select("w", "range", "postings", F.explode("asked").alias("q")).select("w", "range", "q.query_id", "q.idf", F.explode("postings").alias("p"))
        parts = met.select("query_id", "w", "range", F.col("p._pos").alias("_pos"), F.col("p.id").alias("id"), _part(F.col("idf"), F.col("p.tf"), F.col("p.length"), k1, b, chosen.mean).alias("part"))
        scored = parts.groupBy("query_id", "w", "range", "_pos", "id").agg(F.round(F.sum("part"), 10).alias("score"))
        return self.catalog.visible(self.table, chosen.manifest, scored).select("query_id", "id", "score")

    def search(self, queries: DataFrame, k: int, k1: float = bm25.K1, b: float = bm25.B, average: float | None = None) -> DataFrame:
        """query_id, id, score, rank: the same rows as bm25.search on the live rows. queries: query_id, text."""
        if k <= 0:
            raise ValueError("k must be positive")
        asked = bm25.alike(queries, self.analyze)  # queries with the same terms are searched once
        texts = queries.join(asked.filter("query_id = first").select("query_id"), "query_id", "left_semi").select("query_id", "text")
        chosen = self._choose(texts, k, k1, b, average)
        if chosen is None:
            return bm25.top_k(queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id long, score double"), k)
        found = bm25.top_k(self._scores(chosen, chosen.blocks.filter("needed").select("query_id", "w", "range"), k1, b), k)
        found = found.withColumnRenamed("query_id", "first")
        return asked.select("query_id", "first").join(found, "first").select("query_id", "id", "score", "rank")

    def blocks_read(self, queries: DataFrame, k: int, k1: float = bm25.K1, b: float = bm25.B, average: float | None = None) -> DataFrame:
        """query_id, blocks (of its terms), read (those that a search scores)."""
        chosen = self._choose(queries, k, k1, b, average)
        if chosen is None:
            return queries.select("query_id", F.lit(0).cast("long").alias("blocks"), F.lit(0).cast("long").alias("read"))
        return chosen.blocks.groupBy("query_id").agg(F.sum("n_blocks").alias("blocks"), F.coalesce(F.sum(F.when(F.col("needed"), F.col("n_blocks"))), F.lit(0)).alias("read"))


def _part(idf: Column, tf: Column, length: Column, k1: float, b: float, mean: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean)))
