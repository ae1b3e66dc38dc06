"""Session helpers: lineage cuts in shared storage, table loading, size-checked broadcast, blocks of queries."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only after it was measured and found to have at most this many rows and about this many bytes
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Queries go through the driver in blocks of this many
QUERY_BLOCK = 1024


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. One is chosen only where nothing is set and everything runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strata-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, so a lost executor costs no recomputation of the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        size = F.octet_length(F.array_join(c, "")) + 16 * F.size(c) if isinstance(kind.elementType, T.StringType) else 16 * F.size(c)
        return F.coalesce(F.greatest(size, F.lit(0)), F.lit(0)) + 24
    return F.lit(16)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it is measured to have at most `rows` rows and about `size` bytes, else `df` for a shuffled join. Measure cut or cheap plans only."""
    n, b = df.agg(F.count("*"), F.sum(sum((_bytes(f.name, f.dataType) for f in df.schema), F.lit(0)))).first()
    return F.broadcast(df) if n <= rows and (b or 0) <= size else df


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its input has too few splits for work that costs far more than moving the rows; as it is on inputs of many splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[list[Row]]:
    """The rows of a stated set of queries, a block at a time."""
    held: list[Row] = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def tasks_of(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
