"""A stored table with one row per key, of which an update rewrites only the parts it touches.

Rows live in parts: a hash of the key, or ranges of a column that updates come close together in (time, packet number). Each
write makes a new generation of the touched parts, in a folder of its own, and then a manifest that names the newest generation of every
part; a reader takes the last manifest. So a write that fails or is repeated leaves the table as it was, and readers that
have begun keep the files they started with until ``vacuum``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.sources.sinks import upsert

HASH_PARTS = 64


class KeyedTable:
    """The table under ``root``. ``part`` gives the part of a row from its key columns; by default a hash of the keys."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], part: Column | None = None):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.part = F.pmod(F.xxhash64(*keys), F.lit(HASH_PARTS)) if part is None else part
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path

    # --- manifests: one small file per generation, (part, generation) of every part ---

    def _entries(self, folder: str) -> list[str]:
        path = self._fs_path(folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def generation(self) -> int:
        """The last one with a complete manifest, -1 for a new table."""
        found = [int(n.split("=")[1]) for n in self._entries(f"{self.root}/manifest") if n.startswith("generation=")]
        return max((g for g in found if "_SUCCESS" in self._entries(f"{self.root}/manifest/generation={g}")), default=-1)

    def layout(self) -> dict[int, int]:
        """Newest generation of each part; as many entries as the table has parts."""
        last = self.generation()
        if last < 0:
            return {}
        rows = self.spark.read.schema("part long, generation int").parquet(f"{self.root}/manifest/generation={last}")
        return {r.part: r.generation for r in rows.collect()}

    def _folder(self, part: int, generation: int) -> str:
        return f"{self.root}/rows/generation={generation}/part={part}"

    def read(self, parts: set[int] | None = None) -> DataFrame | None:
        """All rows, or those of some parts. None where there is nothing yet."""
        folders = [self._folder(p, g) for p, g in sorted(self.layout().items()) if parts is None or p in parts]
        return self.spark.read.parquet(*folders) if folders else None

    def _publish(self, rows: DataFrame, layout: dict[int, int]) -> set[int]:
        """Writes rows (with their part) as the next generation; returns its parts."""
        generation = self.generation() + 1
        order = ["part", *self.keys]
        laid_out = rows.repartitionByRange(*order).sortWithinPartitions(*order)  # a large part is several files
        laid_out.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/rows/generation={generation}")
        written = {int(n.split("=")[1]) for n in self._entries(f"{self.root}/rows/generation={generation}") if n.startswith("part=")}
        now = layout | dict.fromkeys(written, generation)
        manifest = self.spark.createDataFrame(list(now.items()), "part long, generation int").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.root}/manifest/generation={generation}")
        return written

    def create(self, rows: DataFrame) -> set[int]:
        """The whole table anew; keys must be unique. Returns the parts."""
        return self._publish(rows.withColumn("part", self.part.cast("long")), {})

    def upsert(self, updates: DataFrame, version: str) -> set[int]:
        """Puts updates over the rows of their keys; of updates with the same key the one of the highest ``version``
        counts. Reads and rewrites the touched parts only, and returns them."""
        updates = updates.withColumn("part", self.part.cast("long"))
        touched = {r.part for r in updates.select("part").distinct().collect()}  # at most as many as there are parts
        if not touched:
            return set()
        layout = self.layout()
        stored = self.read(touched)
        if stored is None:
            merged = upsert(updates.limit(0), updates, self.keys, version)
        else:
            merged = upsert(stored.withColumn("part", self.part.cast("long")), updates, self.keys, version)
            merged = merged.select("part", *stored.columns)
        return self._publish(merged, layout)

    def vacuum(self) -> list[str]:
        """Deletes the folders that the last manifest does not name."""
        layout, last = self.layout(), self.generation()
        kept = {self._folder(p, g) for p, g in layout.items()}
        gone = []
        for name in self._entries(f"{self.root}/rows"):
            parts = [n for n in self._entries(f"{self.root}/rows/{name}") if n.startswith("part=")]
            gone += [f for f in (f"{self.root}/rows/{name}/{p}" for p in parts) if f not in kept]
        gone += [f"{self.root}/manifest/{n}" for n in self._entries(f"{self.root}/manifest") if n != f"generation={last}"]
        for folder in gone:
            path = self._fs_path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return sorted(gone)


def ranges(column: str, width: int) -> Column:
    """Parts of ``width`` consecutive values of an integer column, for updates that come close together."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")
