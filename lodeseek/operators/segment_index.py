"""Indexes that stand beside a table of the store: one part for each of its segments.

An append makes a part for its segment alone; a delete changes no part, as entries name
their row by segment and position and the table's bitmaps hide it; a compaction's new
segment gets a part, `vacuum` removes those of segments that are gone. A part is whole when
its mark is written, so a build that dies is made again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schemas
from ..sources.catalog import Catalog, Manifest, Segment, short_shuffles


class SegmentIndex:
    """A subclass says what a part is: `build` writes tables with `put`, `read` gives one for all segments."""

    def __init__(self, catalog: Catalog, table: str, name: str):
        self.catalog, self.table, self.spark = catalog, table, catalog.spark
        self.key = schemas.KEYS[table]
        self.root = f"{catalog.root}/{table}/index-{name}"

    def build(self, segment: Segment, rows: DataFrame) -> None:
        """rows: those of the segment with _pos and w, hidden ones too."""
        raise NotImplementedError

    def put(self, kind: str, segment: Segment, rows: DataFrame, **options) -> None:
        with short_shuffles(self.spark):
            rows.write.mode("overwrite").options(**options).parquet(f"{self.root}/{kind}/w={segment.name}")

    def read(self, kind: str, segments: list[Segment], schema: str) -> DataFrame:
        """The rows of a kind, with w."""
        folder = f"{self.root}/{kind}"
        return self.spark.read.option("basePath", folder).schema(f"{schema}, w string").parquet(*[f"{folder}/w={s.name}" for s in segments])

    def _mark(self, segment: Segment):
        return self.catalog._path(f"{self.root}/built/{segment.name}")

    def refresh(self) -> list[str]:
        """Index the segments that have no part yet; their names."""
        return self._refresh(self.catalog._manifest(self.table))

    def _refresh(self, manifest: Manifest) -> list[str]:
        made = []
        for segment in manifest.data:
            mark, fs = self._mark(segment)
            if segment.n and not fs.exists(mark):
                self.build(segment, self.catalog._read(self.table, [(segment, None)]))
                fs.create(mark, True).close()
                made.append(segment.name)
        return made

    def current(self) -> tuple[Manifest, list[Segment]]:
        """The table's manifest, and its segments that have rows, all of them indexed."""
        manifest = self.catalog._manifest(self.table)
        self._refresh(manifest)
        return manifest, [s for s in manifest.data if s.n]

    def vacuum(self) -> None:
        """Remove the parts of segments that the last manifest doesn't list."""
        listed = {s.name for s in self.catalog._manifest(self.table).data}
        root, fs = self.catalog._path(self.root)
        for kind in fs.listStatus(root) if fs.exists(root) else []:
            for part in fs.listStatus(kind.getPath()):
                if part.getPath().getName().removeprefix("w=") not in listed:
                    fs.delete(part.getPath(), True)
