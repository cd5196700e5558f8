"""The alert table as a foreachBatch sink.

Rows live under ``data/version=<v>/bucket=<b>/``, placed by a hash of their id, the one field that never
changes; a manifest names the version that holds each bucket. A batch rewrites only the buckets of its events'
and commands' ids and then replaces the manifest in one rename, so readers see whole batches and a repeated
batch changes nothing. Batches are told apart by the run's name and their number: a new checkpoint is a new
run. Where a table format with MERGE is at hand, use that and ``operators.alerts``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.alerts import apply_commands, persistable, rejected, screen_events, upsert
from tidewatch.schemas import ALERT

BUCKET = "bucket"


class AlertTable:
    """``buckets`` counts for a new table; an existing one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """``committed``: last applied batch of every run; ``buckets``: bucket -> version; ``count``."""
        fs, file = self._fs(), self._path("manifest.json")
        if not fs.exists(file):
            return {"committed": {}, "buckets": {}, "count": self._buckets}
        stream = fs.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        fs, staged, file = self._fs(), self._path("manifest.next"), self._path("manifest.json")
        out = fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            staged.toUri() if staged.toUri().getScheme() else self._fs().getUri(),
            self.spark._jsc.hadoopConfiguration(),
        )
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(staged, file, options)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """Current rows, of the given buckets or of all."""
        versions = {int(b): v for b, v in self.manifest()["buckets"].items()}
        chosen = versions if buckets is None else {b: versions[b] for b in buckets if b in versions}
        if not chosen:
            return self.spark.createDataFrame([], ALERT)
        paths = [f"{self.path}/data/version={v}/{BUCKET}={b}" for b, v in sorted(chosen.items())]
        return self.spark.read.schema(ALERT).parquet(*paths)

    def apply(
        self,
        batch_id: int,
        events: DataFrame,
        stations: DataFrame,
        commands: DataFrame | None = None,
        audit: Callable[[DataFrame], None] | None = None,
        run: str = "",
        rejects: Callable[[DataFrame], None] | None = None,
    ) -> None:
        """Persist a batch's events, then its commands, in one commit.

        ``audit`` receives the verdict on every command and ``rejects`` the events turned away, both before the
        commit; a batch that is committed already is left alone, as the table now holds what it brought and would be
        judged against itself. Written versions are never changed: each attempt writes a new one, and what a
        failed attempt left is not referenced.
        """
        manifest = self.manifest()
        if batch_id <= manifest["committed"].get(run, -1):
            return
        ids = events.select("id")
        if commands is not None:
            ids = ids.union(commands.select(F.col("alert_id").alias("id")))
        # at most as many short numbers as there are buckets reach the driver
        found = ids.where("id IS NOT NULL").select(bucket_of("id", manifest["count"])).distinct().collect()
        touched = sorted(r[0] for r in found)
        stored = self.read(touched)
        screened = screen_events(events, stations, stored)
        if rejects is not None:
            rejects(rejected(screened))
        after = upsert(stored, persistable(screened))
        if commands is not None:
            after, verdicts = apply_commands(after, commands)
            if audit is not None:
                audit(verdicts)
        if touched:
            version = f"{batch_id:012d}-{uuid.uuid4().hex[:8]}"
            after.withColumn(BUCKET, bucket_of("id", manifest["count"])).repartition(BUCKET).write.partitionBy(
                BUCKET).parquet(f"{self.path}/data/version={version}")
            written = self._fs().listStatus(self._path(f"data/version={version}"))
            names = [w.getPath().getName() for w in written]
            manifest["buckets"].update({n.partition("=")[2]: version for n in names if n.startswith(f"{BUCKET}=")})
        manifest["committed"][run] = batch_id
        self._publish(manifest)


def bucket_of(column: str, count: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(count)).cast("int").alias(BUCKET)
