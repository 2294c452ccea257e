"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept; all but the last return the columns of
documents. Texts that the line dedup changes have their n_chars set anew.

A stage's result is to be written, and the next called on what is read back: when a stage
begins, the temporary tables of the stages before that its input does not read are deleted.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import collected, discard, discard_unread, stage
from lodeseek.llm.line_dedup import dedup_lines
from lodeseek.llm.mixing import mix_sources, repeat_rows
from lodeseek.llm.packing import pack
from lodeseek.llm.quality import judge
from lodeseek.llm.simhash import one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Temporary tables of the stages that have run.
_left: list[str] = []


def _tidy(step):
    """A stage that deletes what the stages before have left."""

    @wraps(step)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_unread(spark, _left, docs)
        with collected(_left):
            return step(spark, docs, sf_dir)

    return tidied


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold.

    Null and empty texts go; a null lang has the largest threshold; repeated rows are judged
    alike; without a trusted label all other texts stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs.select(COLUMNS), labels).filter("keep").select(COLUMNS)


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that recur across documents; every row stays, its text can become empty.

    A null text becomes empty; of rows with equal largest doc_id all keep a line; a null
    doc_id sorts below all others; an empty table stays empty.
    """
    kept = dedup_lines(docs.select(COLUMNS), keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(COLUMNS)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 0.8 or more of shingles of five words shared.

    The one with the smallest doc_id, for ties the smallest hash of the text; a null doc_id
    only where a group has no other. Null, empty and wordless texts are one group; repeated
    rows are copies; an empty table stays empty.
    """
    return one_of_each(docs.select(COLUMNS))


@_tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, up to three times.

    A null source is a source, the last; null and empty texts have no size and weigh nothing
    but are drawn like others; rows that repeat a doc_id draw alike; an empty table stays empty.
    """
    return repeat_rows(mix_sources(docs.select(COLUMNS)), COLUMNS)


@_tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 ids.

    Each row is a document, null and empty texts an end alone; a null doc_id stays null; an
    empty table gives no piece.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("packing", packing),
]

#: SimHash components and a tokenizer's ids have no SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:  # nothing reads it now that this stage is written
            discard(before)
        before = docs
    discard_unread(spark, _left, docs)
    return docs
