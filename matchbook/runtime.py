"""Durable cuts for iterative jobs.

Loops write their state to the checkpoint folder of the session, a folder every
node can read, so that a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

# Settings for the session that runs these operators. The JVM leaves methods above
# 8000 bytes of code uncompiled, so wide projections run three times as fast when
# Spark splits them instead of fusing them into one such method.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Loops leave a checkpoint a round; this drops those nothing refers to any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """Folder that every node can reach: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a folder of this application below the warehouse, which
    the session's nodes share by definition.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/_scratch/{sc.applicationId}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the session's checkpoints at its shared folder unless they have one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Checkpoint ``df`` and return it with ``metrics`` taken in the same job."""
    ensure_checkpoint_dir(df.sparkSession)
    if not metrics:
        return df.checkpoint(eager=True), {}
    seen = Observation()
    named = [column.alias(name) for name, column in metrics.items()]
    return df.observe(seen, *named).checkpoint(eager=True), seen.get


#: Rows that are compressed together.
PACKED_ROWS = 50_000


def cut_batches(
    df: DataFrame,
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: StructType,
) -> DataFrame:
    """``df.mapInArrow(make, schema)``, checkpointed as compressed Arrow.

    A checkpoint of rows is not compressed: text that repeats takes several times the space
    that it takes in a shuffle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for made in make(batches):
            for at in range(0, made.num_rows, PACKED_ROWS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, made.schema, options=options) as out:
                    out.write_batch(made.slice(at, PACKED_ROWS))
                packed = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([packed], ["packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                with pa.ipc.open_stream(packed.as_buffer()) as made:
                    yield from made

    packed, _ = cut(df.mapInArrow(pack, "packed binary"))
    return packed.mapInArrow(unpack, schema)


def let_go(spark: SparkSession) -> None:
    """Have the files of shuffles deleted that nothing refers to any more.

    Spark deletes them once the driver's JVM has collected what referred to them, and a
    driver with memory to spare seldom collects. Called after a checkpoint, so that the
    shuffles before it don't lie on the executors' disks beside those to come.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def fixed_plans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside run as they are, in one job, and keep the partitioning they state.

    For loops that lay their tables out themselves. Adaptive execution runs a job for each
    shuffle and merges partitions as it goes, so a next round couldn't rely on the layout.
    """
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
