"""What the operators share: the shared scratch folder, text keys, small helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space [\x20\x09-\x0D] and the ASCII letters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spark's setting to remove a query's shuffle files when it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_root: list[str] = []
_collecting: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, in local mode a folder of our own; on a cluster that is
    an error, as executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir isn't set: name a folder that the driver and the executors of {master or 'the cluster'} share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="lodeseek-"))
    return _own_root[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/lodeseek/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with settings(spark, {CLEAN_SHUFFLES: "true"}):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodeseek_path = path
    for paths in _collecting:
        paths.append(path)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that is never to be made by broadcasting: for tables that grow with the input.

    Spark sizes an explode or a Python function by its input's rows, and packed Parquet by
    its bytes, and so broadcasts through the driver what is many times its threshold.
    """
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    remove(df.sparkSession, df._lodeseek_path)


@contextmanager
def collected(paths: list[str]) -> Iterator[None]:
    """Add the paths of the tables that are staged inside."""
    _collecting.append(paths)
    try:
        yield
    finally:
        _collecting.pop()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside: write results before. Other queries' tables stay."""
    paths: list[str] = []
    try:
        with collected(paths):
            yield
    finally:
        for path in paths:
            remove(spark, path)


def paths_read(df: DataFrame) -> set[str]:
    """The folders and files that a plan scans."""
    found, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(k).toUri().getPath() for k in range(roots.size())}
    return found


def discard_unread(spark: SparkSession, paths: list[str], df: DataFrame) -> None:
    """Delete the tables at these paths that df does not read, and take them off the list."""
    read = paths_read(df)
    for path in [p for p in paths if re.sub(r"^\w+:(//[^/]*)?", "", p) not in read]:
        remove(spark, path)
        paths.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as it takes to be none of the columns (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is the fast way where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: Catalyst may copy an expression into a lambda, never a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that any operator has staged in the shared folder; results that weren't written yet are lost. See scratch() too."""
    remove(spark, f"{shared_root(spark)}/lodeseek")


@cache
def one_blas_thread() -> None:
    """Let numpy's matrix products use one thread in this process, as a task has one core.

    Spark sets OMP_NUM_THREADS to all cores of the executor; idle threads of many small
    products then spin beside those of the executor's other tasks. Nothing happens where
    numpy has no OpenBLAS that can be told so.
    """
    np.ones((2, 2)) @ np.ones((2, 2))  # loads the library
    try:
        with open("/proc/self/maps") as maps:
            found = {line.split(maxsplit=5)[5].strip() for line in maps if "openblas" in line}
    except OSError:
        return
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


@cache
def keep_temporaries(size: int = 8 << 20) -> None:
    """Let the C library keep freed memory of up to `size` bytes a piece in this process (tidy gives it back at a task's end).

    Otherwise every array of a few megabytes is mapped and zeroed anew, which costs steps
    that make many of them up to a quarter of their time. Nothing happens without glibc.
    """
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option:
        trim_threshold, mmap_threshold = -1, -3  # fixed values: the options' numbers in malloc.h
        set_option(mmap_threshold, size)
        set_option(trim_threshold, 1 << 30)


def give_back() -> None:
    """Give this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run):
    """A function of Arrow batches that gives its memory back to the system when a task ends.

    Python workers outlive their tasks; what they keep counts against the executor's
    memory in every later stage.
    """

    @wraps(run)
    def tidied(batches):
        one_blas_thread()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_cogroup(run):
    """The same for a function of the two tables of a cogroup, after each of them."""

    def tidied(left, right):
        one_blas_thread()
        try:
            return run(left, right)
        finally:
            give_back()

    return tidied
