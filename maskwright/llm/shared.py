"""Session plumbing for the corpus operators: shared folders, safe batches, lineage cuts."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that one Arrow batch handed to a Python worker may take.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches, so that very long texts don't pile up in a worker, and let the shuffle files of
    a step go when the step is over: what later steps need is in the shared folder."""
    for key, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
    ):
        try:
            spark.conf.set(key, value)
        except Exception as why:  # a key that this Spark lacks
            if "CONFIG" not in str(why).upper():
                raise


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set here only where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="maskwright-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def persist(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that
    outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable) -> Callable:
    """``run``, a function over batches, whose worker gives its free memory back when the task is over: workers are
    kept for later tasks, and several lie idle beside those at work."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def reducers(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hash_limit(share: float) -> int:
    """The long below which a signed 64-bit hash falls with the given probability."""
    return min((1 << 63) - 1, int(min(1.0, share) * (1 << 64)) - (1 << 63))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Complete runs of equal ``key`` from batches sorted by it; a run may span batches."""
    held: list[pa.Table] = []
    current = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        values = table.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *((values[1:] != values[:-1]).nonzero()[0] + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if held and values[a] != current:
                yield pa.concat_tables(held)
                held = []
            current = values[a]
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)
