"""The store without files, for tests and small tables: the tables are DataFrames held by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import lifecycle, numbering
from .catalog import Catalog


class MemoryCatalog(Catalog):
    """The same methods as Catalog. An append keeps the new rows beside the others (see numbering.kept); an upsert or a delete keeps the table anew."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "")
        self.parts: dict[str, list[DataFrame]] = {}
        self.reserved: dict[str, int] = {}
        self.batches: dict[tuple[str, str], int] = {}

    def scan(self, table: str, number: int | None = None) -> DataFrame:
        if number is not None:
            raise ValueError("a store in memory has no older commits")
        parts = self.parts.get(table) or [self.spark.createDataFrame([], schemas.TABLES[table])]
        return reduce(DataFrame.unionByName, parts)

    def get(self, table: str, key) -> DataFrame:
        return lifecycle.point_get(self.scan(table), schemas.KEYS[table], key)

    def get_batch(self, table: str, keys: list) -> DataFrame:
        return lifecycle.batch_get(self.scan(table), schemas.KEYS[table], keys)

    def matching(self, table: str, keys: DataFrame) -> DataFrame:
        return self.scan(table).join(keys.toDF(schemas.KEYS[table]), schemas.KEYS[table], "left_semi")

    def count(self, table: str) -> int:
        return self.scan(table).count()

    def reserve(self, table: str, n: int) -> int:
        first = max(self.reserved.get(table, 0), self.scan(table).agg(F.coalesce(F.max(schemas.KEYS[table]), F.lit(-1))).first()[0] + 1)
        self.reserved[table] = first + n
        return first

    def seen(self, table: str, batch: tuple[str, int]) -> bool:
        return self.batches.get((table, batch[0]), -1) >= batch[1]

    def _done(self, table: str, batch: tuple[str, int] | None) -> bool:
        """Whether the batch was written before; from now on it was."""
        if not batch or not self.seen(table, batch):
            if batch:
                self.batches[table, batch[0]] = batch[1]
            return False
        return True

    def _kept(self, table: str, rows: DataFrame) -> DataFrame:
        kept = numbering.kept(self._typed(table, rows))
        kept.count()  # now, not when the rows that it reads may be gone
        return kept

    def overwrite(self, table: str, rows: DataFrame) -> None:
        self.parts[table] = [self._kept(table, rows)]

    def append(self, table: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        if not self._done(table, batch):
            self.parts.setdefault(table, []).append(self._kept(table, rows))

    def upsert(self, table: str, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> None:
        key = schemas.KEYS[table]
        if not self._done(table, batch):
            self.overwrite(table, lifecycle.upsert(self.scan(table), self._typed(table, lifecycle.newest_of(rows, key, order)), key))

    def delete(self, table: str, keys: DataFrame) -> None:
        self.overwrite(table, lifecycle.delete(self.scan(table), keys, schemas.KEYS[table]))

    def compact(self, table: str, force: bool = False) -> bool:
        """There are no hidden rows."""
        return False

    def vacuum(self, table: str, keep: int = 1) -> None:
        """There are no files."""
