"""Exports as changes: what was added, changed and removed since the last export.

    state/         key and hash of every row of the last export, in key buckets
    changes/<n>    the rows of export n that differ, with ``change``: added, changed or removed

Rows are compared by a hash of all their columns, so an export that changes little writes little.
The changes are written before the state, and the state takes an export once: a repeat of export n
rewrites the same changes. Replaying all changes in order gives the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegraph.sources.bucketed import BucketedTable


class ChangeExport:
    """Exports of one table below ``folder``; ``keys`` tell its rows apart and are never null."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = 64):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)
        schema = ", ".join([*[f"{k} {t}" for k, t in keys.items()], "hash BIGINT, hash2 BIGINT"])
        self.state = BucketedTable(spark, f"{self.folder}/state", schema, self.keys, buckets)

    def export(self, rows: DataFrame, number: int) -> DataFrame:
        """Write what differs from the last export and return it: the columns of ``rows`` and ``change``."""
        path, name = f"{self.folder}/changes/{number}", str(number)
        if not self.state.merged(name):
            # maps are hashed by their sorted entries
            plain = [F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(c) for c, t in rows.dtypes]
            now = rows.withColumn("hash", F.xxhash64(*plain)).withColumn("hash2", F.xxhash64(F.lit(1), *plain))
            before = self.state.read().select(*self.keys, F.struct("hash", "hash2").alias("before"))
            met = now.join(before, self.keys, "full_outer")
            change = F.when(F.col("before").isNull(), "added").when(F.col("hash").isNull(), "removed").when(
                F.struct("hash", "hash2") != F.col("before"), "changed")
            met.withColumn("change", change).where("change IS NOT NULL").drop("before").write.mode("overwrite").parquet(path)
            written = self.spark.read.parquet(path)
            self.state.merge(
                written.select(*self.keys, "hash", "hash2"),
                lambda held, new: held.join(new, self.keys, "left_anti").unionByName(new.where("hash IS NOT NULL")), name)
        return self.spark.read.parquet(path).drop("hash", "hash2")

    def replay(self, numbers: list[int]) -> DataFrame:
        """The whole table after the given exports: the last change of each key, unless it is a removal."""
        parts = [self.spark.read.parquet(f"{self.folder}/changes/{n}").withColumn("export", F.lit(n)) for n in numbers]
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        columns = [c for c in every.columns if c not in (*self.keys, "hash", "hash2", "export")]
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "export").alias("last"))
        return last.where("last.change <> 'removed'").select(*self.keys, *[f"last.{c}" for c in columns if c not in ("change",)])
