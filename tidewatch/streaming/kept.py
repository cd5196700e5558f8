"""Views kept up from batch to batch: one row per key, the greatest by an order.

A batch leaves one row per key in a folder of its own; reading merges the folders. The greatest of some rows does not
change when a row counts twice, so a repeated batch replaces or repeats its part without moving anything, and what
was merged already may stand beside its parts. Merging writes a new part out of all there are; the parts it was made
from go at the merge after, so that a reader that lists them meanwhile still finds them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expr import epoch_ms

LAST_SEEN = "station_id string, observed_at timestamp, seq long"
LATEST = "station_id string, observed_at timestamp, water_level_m double, rainfall_mm_per_hour double, seq long"
MERGE_AFTER = 64


class KeptView:
    """``key``: column that names a row; ``order``: the row with the greatest value stays."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: Column, merge_after: int = MERGE_AFTER):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.merge_after = merge_after

    def _parts(self) -> list[str]:
        """Names of the parts, finished writes only."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        found = [f.getPath() for f in store.listStatus(root)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName() for p in found if store.exists(done(p, "_SUCCESS")))

    def _rows(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def _greatest(self, rows: DataFrame) -> DataFrame:
        columns = self.spark.createDataFrame([], self.schema).columns
        best = F.max_by(F.struct(*columns), self.order).alias("row")
        return rows.groupBy(F.col(self.key).alias("_key")).agg(best).select("row.*")

    def add(self, rows: DataFrame, name: str) -> None:
        """Take in a batch's rows; ``name`` tells the batch from all others."""
        self._greatest(rows).write.mode("overwrite").parquet(f"{self.path}/batch-{name}")
        parts = self._parts()
        if len(parts) > self.merge_after:
            self.merge(parts)

    def merge(self, parts: list[str]) -> None:
        """One part out of all. Those that an earlier merge took in go now."""
        before = [p for p in parts if p.startswith("merged-")]
        taken = {r.part for p in before for r in self._taken(p)}
        name = f"merged-{uuid.uuid4().hex}"
        noted = self.spark.createDataFrame([(p,) for p in parts], "part string")
        noted.coalesce(1).write.parquet(f"{self.path}/{name}/_taken")
        self._greatest(self._rows(parts)).write.mode("append").parquet(f"{self.path}/{name}")
        for part in taken:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def _taken(self, merged: str) -> list:
        return self.spark.read.schema("part string").parquet(f"{self.path}/{merged}/_taken").collect()

    def read(self) -> DataFrame:
        return self._greatest(self._rows(self._parts()))


def last_seen_view(spark: SparkSession, path: str, merge_after: int = MERGE_AFTER) -> KeptView:
    """The event time of every station's last accepted arrival."""
    return KeptView(spark, path, LAST_SEEN, "station_id", F.col("seq"), merge_after)


def latest_view(spark: SparkSession, path: str, merge_after: int = MERGE_AFTER) -> KeptView:
    """Every station's newest reading, the first arrival on equal times."""
    order = F.struct(epoch_ms("observed_at"), -F.col("seq"))
    return KeptView(spark, path, LATEST, "station_id", order, merge_after)
