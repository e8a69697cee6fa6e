"""Session helpers: tables, batches and files that all executors can read."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine's only where that is unset and Spark is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage: written as Parquet to the shared folder, and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def done_with(*tables: DataFrame) -> None:
    """Delete what `stored` wrote for tables that nothing reads any more, and have the driver collect its garbage: executors keep shuffle files as long as the driver has a handle on them."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("quern-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
    gc.collect()
    SparkSession.active().sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that `column` holds `limit` bytes at most in each, or one row."""
    from . import _text

    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = _text.utf8(batch.column(batch.schema.get_field_index(column)))
        for a, b in _text.row_groups(offsets[1:] - offsets[:-1], limit):
            yield batch.slice(a, b - a)
    # a worker goes on to other tasks: what this one had is given back
    pa.default_memory_pool().release_unused()
