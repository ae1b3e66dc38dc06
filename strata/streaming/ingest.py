"""Continuous ingestion: new chunk files are merged by key, batch by batch; a repeated batch changes nothing.

The target is split into buckets by the hash of the key, each a folder of versions. A batch rewrites the buckets that hold one of its keys, no others; the
newest committed version of a bucket counts, and older ones are removed two batches later. The number of buckets belongs to the target and is chosen when it is made.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.functions.ids import point_id
from strata.operators.corpus import merge_by_key

SCHEMA = "record_id bigint, text string, ticker string, year int, section string, chunk_index int, filing_id string, ingested_at timestamp_ntz"


def keyed(chunks: DataFrame, buckets: int = 64) -> DataFrame:
    key = chunks.withColumn("point_id", point_id(F.col("filing_id"), F.col("section"), F.col("chunk_index")))
    return key.withColumn("bucket", F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int"))


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Committed versions of each bucket, ascending; the listing has one entry a bucket and version."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v=*/bucket=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    held: dict[int, list[int]] = {}
    for status in found:
        path = status.getPath()
        done = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), "_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            held.setdefault(int(path.getName().split("=")[1]), []).append(int(path.getParent().getName().split("=")[1]))
    return {b: sorted(v) for b, v in held.items()}


def read(spark: SparkSession, target: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest version of every bucket (of those named; of versions below `before`); None while there is none."""
    newest = {b: max(x for x in v if before is None or x < before) for b, v in _versions(spark, target).items() if any(before is None or x < before for x in v)}
    paths = [f"{target}/v={v}/bucket={b}" for b, v in sorted(newest.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def start(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: str = SCHEMA, files_per_batch: int = 16, buckets: int = 64) -> StreamingQuery:
    """Read parquet files as they land and upsert them into `target`; returns the running query (trigger: all that is there, then stop)."""

    def upsert(batch: DataFrame, epoch: int) -> None:
        new = keyed(batch, buckets).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if touched:
            held = read(batch.sparkSession, target, epoch, touched)
            plain = new.drop("bucket")
            merged = merge_by_key(plain.limit(0) if held is None else held, plain, "point_id", "record_id")
            placed = merged.withColumn("bucket", F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int"))
            placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={epoch}")
            _forget(batch.sparkSession, target, epoch)
        new.unpersist()

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, target: str, epoch: int) -> None:
    """Remove versions of a bucket that a newer one, at least two batches old, has replaced."""
    for bucket, versions in _versions(spark, target).items():
        settled = [v for v in versions if v <= epoch - 2]
        for old in settled[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={old}/bucket={bucket}")
            with contextlib.suppress(Exception):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
