"""The store: four tables under one root, each a log of appended Parquet segments and of hidden positions.

A write adds segments, folders that no reader looks at yet, and then commits them: it
writes a manifest, the list of all live segments, under a name of its own and gives it the
next number. Readers take the highest number. A job that dies before that leaves the table
as it was, after it, as it shall be; there is no moment without a table. A writer that finds
its number taken builds its commit again on the new manifest.

A segment's files are ranges of its keys, in order, each row with its position. The manifest
holds each file's range; a Bloom filter of the keys lies beside the files. A get opens only
files that can hold its keys. A delete looks its keys up in that way and appends bitmaps of
the positions they stand at; an upsert does the same for what it replaces. So a write costs
what its rows cost and the files that may hold their keys, and counts need no job. A scan
leaves the hidden positions out without shuffling. Where they are more than COMPACTION_RATIO
of all rows, the live ones are written anew.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import lifecycle

#: Rows of a bitmap; keys of a segment above which it has no Bloom filter (its files are short ranges then); false positives.
BLOCK_BITS, MAX_BLOOM_KEYS, FALSE_POSITIVES = 15, 4_000_000, 0.01
#: Keys asked of the Bloom filters one by one; keys that are broadcast to the files that may hold them.
FEW_KEYS, BROADCAST_KEYS = 1_000, 1_000_000
#: Hidden positions that become part of a scan's filter; blocks of bitmaps (4 KB each) that are broadcast. More are joined.
LITERAL_HIDDEN, BROADCAST_BLOCKS = 10_000, 16_384
BLOOM, TRIES = "_keys.bloom", 50


def temporary_root(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; without it, in local mode, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and the executors share")
        root = tempfile.mkdtemp(prefix="lodeseek-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends: a write's rows stand in the store then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Conflict(RuntimeError):
    """Another writer has committed in between."""


@dataclass
class Segment:
    """folder: seq=<commit>/w=<name>; files: of each its name, rows, least and largest key; bloom: whether there is a Bloom filter."""

    folder: str
    n: int
    files: list[list] = field(default_factory=list)
    bloom: bool = False

    @property
    def name(self) -> str:
        return self.folder.rsplit("w=", 1)[-1]


@dataclass
class Hidden:
    """The folder of a segment's bitmaps, how many rows they hide, and the number of bitmaps."""

    folder: str
    n: int
    blocks: int


@dataclass
class Manifest:
    """number: of the commit (0: no table yet); deleted: by the segment's name; next_id: the first id not reserved;
    batches: the last batch of each stream that has been written."""

    number: int = 0
    data: list[Segment] = field(default_factory=list)
    deleted: dict[str, Hidden] = field(default_factory=dict)
    next_id: int = 0
    batches: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def read(number: int, body: dict) -> Manifest:
        data, deleted = [Segment(**s) for s in body["data"]], {k: Hidden(**h) for k, h in body["deleted"].items()}
        return Manifest(number, data, deleted, body["next_id"], body["batches"])

    @property
    def rows(self) -> int:
        return sum(s.n for s in self.data)

    @property
    def hidden(self) -> int:
        return sum(h.n for h in self.deleted.values())


def _block() -> Column:
    return F.shiftright("_pos", BLOCK_BITS)


def _word() -> Column:
    return F.shiftright("_pos", 6).bitwiseAND(F.lit(2 ** (BLOCK_BITS - 6) - 1))


class Catalog:
    """Point and batch reads, scans, upserts and deletes on the tables of `schemas.TABLES`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._blooms: dict[str, object] = {}

    # files

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _log(self, table: str) -> str:
        return f"{self.root}/{table}/_log"

    def _numbers(self, table: str) -> list[int]:
        path, fs = self._path(self._log(table))
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _manifest(self, table: str, number: int | None = None) -> Manifest:
        numbers = self._numbers(table)
        if not numbers:
            return Manifest()
        number = numbers[-1] if number is None else number
        path, fs = self._path(f"{self._log(table)}/{number}.json")
        stream = fs.open(path)
        try:
            body = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest.read(number, json.loads(body))

    def _commit(self, table: str, manifest: Manifest) -> None:
        """The manifest's number is that of the commit that it builds on, plus one."""
        final, fs = self._path(f"{self._log(table)}/{manifest.number}.json")
        own, _ = self._path(f"{self._log(table)}/.{manifest.number}-{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps({k: v for k, v in asdict(manifest).items() if k != "number"}).encode()))
        out.close()
        if fs.getUri().getScheme() == "file":  # there a rename would replace
            try:
                os.link(own.toUri().getPath(), final.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
            fs.delete(own, False)
        else:
            done = not fs.exists(final) and fs.rename(own, final)
            if not done:
                fs.delete(own, False)
        if not done:
            raise Conflict(f"{table}: commit {manifest.number} exists")

    def _update(self, table: str, change: Callable[[Manifest], Manifest | None]) -> Manifest:
        """Commit what `change` makes of the manifest (None: nothing), again where another writer was first."""
        for left in reversed(range(TRIES)):
            old = self._manifest(table)
            new = change(old)
            if new is None:
                return old
            new.number = old.number + 1
            try:
                self._commit(table, new)
                return new
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def _write(self, table: str, number: int, rows: DataFrame) -> Segment:
        """rows as a segment: files of ranges of the key, sorted, with positions; figures are read from the key's column alone."""
        key, folder = schemas.KEYS[table], f"seq={number}/w={uuid.uuid4().hex}"
        path = f"{self.root}/{table}/data/{folder}"
        placed = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_pos", F.monotonically_increasing_id())
        with short_shuffles(self.spark):
            placed.write.parquet(path)
        written = self.spark.read.schema(placed.schema).parquet(path).select(key, F.col("_metadata.file_name").alias("file"))
        files = sorted(map(list, written.groupBy("file").agg(F.count("*"), F.min(key), F.max(key)).collect()))  # a row a file
        n = sum(f[1] for f in files)
        bloom = 0 < n <= MAX_BLOOM_KEYS
        if bloom:
            made = written.filter(F.col(key).isNotNull())._jdf.stat().bloomFilter(key, n, FALSE_POSITIVES)
            to, fs = self._path(f"{path}/{BLOOM}")
            out = fs.create(to, False)
            made.writeTo(out)
            out.close()
        return Segment(folder, n, files, bloom)

    def _might_contain(self, table: str, segment: Segment, keys: list) -> bool:
        if not segment.bloom:
            return True
        if segment.name not in self._blooms:
            path, fs = self._path(f"{self.root}/{table}/data/{segment.folder}/{BLOOM}")
            stream = fs.open(path)
            try:
                self._blooms[segment.name] = self.spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(stream)
            finally:
                stream.close()
        return any(self._blooms[segment.name].mightContain(k) for k in keys)

    def _may_hold(self, table: str, manifest: Manifest, keys: list | None, least=None, largest=None) -> list[tuple[Segment, list[str]]]:
        """Segments and their files that can hold one of the keys; without a list of them, keys from least to largest."""
        found = []
        for s in manifest.data:
            if keys is None:
                files = [f for f, _, lo, hi in s.files if lo is not None and not (hi < least or lo > largest)]
            else:
                able = [[k for k in keys if k is not None and lo is not None and lo <= k <= hi] for _, _, lo, hi in s.files]
                files = [f[0] for f, ks in zip(s.files, able) if ks and self._might_contain(table, s, ks)]
            if files:
                found.append((s, files))
        return found

    def candidates(self, table: str, keys: list) -> list[str]:
        """The files that a get of these keys opens."""
        return [f"{s.folder}/{f}" for s, files in self._may_hold(table, self._manifest(table), keys) for f in files]

    def _read(self, table: str, parts: list[tuple[Segment, list[str] | None]]) -> DataFrame:
        """Rows with _pos and w, the segment's name, of these segments or of some of their files."""
        folder = f"{self.root}/{table}/data"
        paths = [f"{folder}/{s.folder}/{f}" for s, files in parts for f in (files if files is not None else [""])]
        return self.spark.read.option("basePath", folder).schema(f"{schemas.TABLES[table]}, _pos long, seq long, w string").parquet(*paths).drop("seq")

    def _bitmaps(self, table: str, hidden: dict[str, Hidden]) -> DataFrame:
        """segment, block, words: the bitmaps of these segments; a folder can hold older ones of others."""
        paths = sorted({f"{self.root}/{table}/deleted/{h.folder}" for h in hidden.values()})
        read = self.spark.read.schema("segment string, folder string, block long, words array<long>").parquet(*paths)
        return read.filter(F.concat("segment", F.lit("@"), "folder").isin([f"{name}@{h.folder}" for name, h in hidden.items()])).drop("folder")

    def _live(self, table: str, manifest: Manifest, parts: list[tuple[Segment, list[str] | None]]) -> DataFrame:
        """Rows of these parts with _pos and w, without the hidden ones."""
        hidden = {s.name: manifest.deleted[s.name] for s, _ in parts if s.name in manifest.deleted}
        rows = [self._read(table, [p for p in parts if p[0].name not in hidden])] if len(hidden) < len({s.name for s, _ in parts}) else []
        if hidden:
            bitmaps = self._bitmaps(table, hidden)
            touched = [p for p in parts if p[0].name in hidden]
            if sum(h.n for h in hidden.values()) <= LITERAL_HIDDEN:
                gone: dict[str, list[int]] = {name: [] for name in hidden}
                words = bitmaps.select("segment", "block", F.posexplode("words").alias("i", "word")).filter("word <> 0")
                bits = F.expr(f"filter(transform(sequence(0, 63), b -> if(shiftright(word, b) & 1 = 1, block * {2**BLOCK_BITS} + i * 64 + b, NULL)), p -> p IS NOT NULL)")
                for name, place in words.select("segment", F.explode(bits)).collect():  # LITERAL_HIDDEN rows at most
                    gone[name].append(place)
                for part in touched:
                    places = gone[part[0].name]
                    rows.append(self._read(table, [part]).filter(~F.expr(f"_pos IN ({', '.join(f'{p}L' for p in places)})")))
            else:
                rows.append(self._by_bit(table, hidden, self._read(table, touched), 0))
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    def _by_bit(self, table: str, hidden: dict[str, Hidden], rows: DataFrame, bit: int) -> DataFrame:
        """The rows (with _pos and w) whose bit in these bitmaps is 0, or 1."""
        marked = self._bitmaps(table, hidden).select(F.col("segment").alias("_segment"), F.col("block").alias("_block"), "words")
        if sum(h.blocks for h in hidden.values()) <= BROADCAST_BLOCKS:
            marked = F.broadcast(marked)
        joined = rows.join(marked, (F.col("w") == F.col("_segment")) & (_block() == F.col("_block")), "inner" if bit else "left")
        found = F.expr("shiftright(get(words, cast(_place AS int)), cast(_pos & 63 AS int)) & 1")
        return joined.withColumn("_place", _word()).filter(F.coalesce(found, F.lit(0)) == bit).drop("_segment", "_block", "words", "_place")

    def visible(self, table: str, manifest: Manifest, rows: DataFrame) -> DataFrame:
        """Those of rows that stand for rows of the table (by w, the segment's name, and _pos) which aren't hidden."""
        return self._by_bit(table, manifest.deleted, rows, 0) if manifest.deleted else rows

    def hidden_rows(self, table: str, manifest: Manifest) -> DataFrame:
        """The hidden rows, as long as no compaction has removed them."""
        touched = [(s, None) for s in manifest.data if s.name in manifest.deleted]
        if not touched:
            return self.spark.createDataFrame([], schemas.TABLES[table])
        return self._by_bit(table, manifest.deleted, self._read(table, touched), 1).drop("_pos", "w")

    # reading

    def scan(self, table: str, number: int | None = None) -> DataFrame:
        """The rows of the table, as of its last commit or of the one with this number."""
        return self._scan(table, self._manifest(table, number))

    def _scan(self, table: str, manifest: Manifest) -> DataFrame:
        if not manifest.data:
            return self.spark.createDataFrame([], schemas.TABLES[table])
        return self._live(table, manifest, [(s, None) for s in manifest.data]).drop("_pos", "w")

    def get(self, table: str, key) -> DataFrame:
        """The row with this key, from the files that can hold it."""
        return lifecycle.point_get(self._holding(table, [key]), schemas.KEYS[table], key)

    def get_batch(self, table: str, keys: list) -> DataFrame:
        """Rows of these keys in their order, missing ones left out; column `position`."""
        return lifecycle.batch_get(self._holding(table, keys), schemas.KEYS[table], keys)

    def _holding(self, table: str, keys: list) -> DataFrame:
        manifest, known = self._manifest(table), [k for k in keys if k is not None]
        asked = known if len(known) <= FEW_KEYS else None
        parts = self._may_hold(table, manifest, asked, min(known), max(known)) if known else []
        return self._live(table, manifest, parts).drop("_pos", "w") if parts else self.spark.createDataFrame([], schemas.TABLES[table])

    def matching(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows with a key of `keys` (one column). Only files that can hold one are read; up to BROADCAST_KEYS keys none of the store is shuffled."""
        manifest = self._manifest(table)
        key = schemas.KEYS[table]
        found, parts = self._among(table, manifest, keys)
        return self._live(table, manifest, parts).drop("_pos", "w").join(found, key, "left_semi") if parts else self.spark.createDataFrame([], schemas.TABLES[table])

    def _among(self, table: str, manifest: Manifest, keys: DataFrame) -> tuple[DataFrame, list[tuple[Segment, list[str]]]]:
        """keys, broadcast where they are few enough, and the files that can hold them."""
        key = schemas.KEYS[table]
        keys = keys.toDF(key).filter(F.col(key).isNotNull())
        n, least, largest = keys.agg(F.count("*"), F.min(key), F.max(key)).first()
        if not n:
            return keys, []
        few = [r[0] for r in keys.distinct().collect()] if n <= FEW_KEYS else None
        return F.broadcast(keys) if n <= BROADCAST_KEYS else keys, self._may_hold(table, manifest, few, least, largest)

    def count(self, table: str) -> int:
        manifest = self._manifest(table)
        return manifest.rows - manifest.hidden

    def keys(self, table: str) -> DataFrame:
        return self.scan(table).select(schemas.KEYS[table])

    # writing

    def _typed(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], schemas.TABLES[table]).schema])

    def reserve(self, table: str, n: int) -> int:
        """The first of n ids in a row that no other reservation gets and no row has (for tables whose key is a number)."""
        taken: list[int] = []

        def change(old: Manifest) -> Manifest:
            first = max([old.next_id, *[hi + 1 for s in old.data for _, _, _, hi in s.files if hi is not None]])
            taken.append(first)
            return replace(old, next_id=first + n)

        self._update(table, change)
        return taken[-1]

    def seen(self, table: str, batch: tuple[str, int]) -> bool:
        """Whether a write with this batch (stream, number), or one after it, is committed."""
        return self._manifest(table).batches.get(batch[0], -1) >= batch[1]

    def _with(self, old: Manifest, batch: tuple[str, int] | None, **changes) -> Manifest:
        return replace(old, **changes, batches={**old.batches, batch[0]: batch[1]} if batch else old.batches)

    def append(self, table: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Rows with keys that the table does not hold. A batch that is committed already is not written again."""
        if batch and self.seen(table, batch):
            return
        segment = self._write(table, self._manifest(table).number + 1, self._typed(table, rows))
        self._update(table, lambda old: None if batch and old.batches.get(batch[0], -1) >= batch[1] else self._with(old, batch, data=[*old.data, segment]))

    def overwrite(self, table: str, rows: DataFrame) -> None:
        segment = self._write(table, self._manifest(table).number + 1, self._typed(table, rows))
        self._update(table, lambda old: self._with(old, None, data=[segment], deleted={}))

    def upsert(self, table: str, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> None:
        """Rows replace those with the same key; of repeated keys within rows the last by the column `order` wins.
        A batch that is committed already is not written again."""
        if batch and self.seen(table, batch):
            return
        key = schemas.KEYS[table]
        segment = self._write(table, self._manifest(table).number + 1, self._typed(table, lifecycle.newest_of(rows, key, order)))
        keys = self._read(table, [(segment, None)]).select(key)

        def change(old: Manifest) -> Manifest | None:
            if batch and old.batches.get(batch[0], -1) >= batch[1]:
                return None
            return self._with(old, batch, data=[*old.data, segment], deleted=self._hide(table, old, keys))

        self._update(table, change)
        self.compact(table)

    def delete(self, table: str, keys: DataFrame) -> None:
        """No error if a key is absent."""
        key, manifest = schemas.KEYS[table], self._manifest(table)
        if not manifest.data:
            return
        folder = f"{self.root}/{table}/keys/w={uuid.uuid4().hex}"
        keys.select(key).distinct().write.parquet(folder)
        wanted = self.spark.read.schema(keys.select(key).schema).parquet(folder)

        def change(old: Manifest) -> Manifest | None:
            deleted = self._hide(table, old, wanted)
            return None if deleted == old.deleted else self._with(old, None, deleted=deleted)

        self._update(table, change)
        path, fs = self._path(folder)
        fs.delete(path, True)
        self.compact(table)

    def _hide(self, table: str, manifest: Manifest, keys: DataFrame) -> dict[str, Hidden]:
        """The manifest's hidden positions and those of the rows with these keys; no job but where a file can hold one."""
        key = schemas.KEYS[table]
        found, parts = self._among(table, manifest, keys)
        if not parts:
            return manifest.deleted
        hits = self._read(table, parts).join(found, key, "left_semi").select(F.col("w").alias("segment"), _block().alias("block"), _word().alias("word"), F.expr("shiftleft(1L, cast(_pos & 63 AS int))").alias("bits"))
        before = {s.name: manifest.deleted[s.name] for s, _ in parts if s.name in manifest.deleted}
        if before:
            old = self._bitmaps(table, before)
            hits = hits.unionByName(old.select("segment", "block", F.posexplode("words").alias("word", "bits")).filter("bits <> 0"))
        words = hits.groupBy("segment", "block", "word").agg(F.bit_or("bits").alias("bits"))
        by_word = words.groupBy("segment", "block").agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").cast("int"), "bits"))).alias("found"))  # 512 at most
        places = F.sequence(F.lit(0), F.lit(2 ** (BLOCK_BITS - 6) - 1))
        folder = f"seq={manifest.number + 1}/w={uuid.uuid4().hex}"
        made = by_word.select("segment", F.lit(folder).alias("folder"), "block", F.transform(places, lambda i: F.coalesce(F.element_at("found", i), F.lit(0).cast("long"))).alias("words"))
        made.write.parquet(f"{self.root}/{table}/deleted/{folder}")
        n_bits = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))
        counted = self.spark.read.schema(made.schema).parquet(f"{self.root}/{table}/deleted/{folder}").groupBy("segment").agg(F.sum(n_bits), F.count("*")).collect()  # a row a segment
        return {**manifest.deleted, **{name: Hidden(folder, n, blocks) for name, n, blocks in counted}}

    def compact(self, table: str, force: bool = False) -> bool:
        """Write the live rows anew if the hidden ones are more than COMPACTION_RATIO of all, or with force if there are any.

        Not where another writer commits meanwhile: its rows come first.
        """
        manifest = self._manifest(table)
        if manifest.hidden <= (0 if force else lifecycle.COMPACTION_RATIO * manifest.rows):
            return False
        segment = self._write(table, manifest.number + 1, self._scan(table, manifest))
        try:
            self._commit(table, replace(manifest, number=manifest.number + 1, data=[segment], deleted={}))
        except Conflict:
            return False
        return True

    def vacuum(self, table: str, keep: int = 1) -> None:
        """Remove the manifests before the last `keep`, and the segments and bitmaps that no other lists; not while others write."""
        numbers = self._numbers(table)
        manifests = [self._manifest(table, n) for n in numbers[-keep:]]
        listed = {("data", s.folder) for m in manifests for s in m.data} | {("deleted", h.folder) for m in manifests for h in m.deleted.values()}
        for n in numbers[:-keep]:
            path, fs = self._path(f"{self._log(table)}/{n}.json")
            fs.delete(path, False)
        for kind in ("data", "deleted"):
            folder, fs = self._path(f"{self.root}/{table}/{kind}")
            for seq in fs.listStatus(folder) if fs.exists(folder) else []:
                for writer in fs.listStatus(seq.getPath()):
                    segment = f"{seq.getPath().getName()}/{writer.getPath().getName()}"
                    if (kind, segment) not in listed:
                        fs.delete(writer.getPath(), True)
        left, fs = self._path(f"{self.root}/{table}/keys")  # of deletes that died
        fs.delete(left, True)

    def clear(self) -> None:
        for table, schema in schemas.TABLES.items():
            self.overwrite(table, self.spark.createDataFrame([], schema))

    # sources

    def register(self, source_id: str, content_hash: str) -> None:
        self.upsert("sources", lifecycle.register(source_id, content_hash, self.spark))

    def complete(self, source_id: str) -> None:
        """An error if the source isn't registered."""
        self.upsert("sources", lifecycle.complete(self.get("sources", source_id), source_id))
