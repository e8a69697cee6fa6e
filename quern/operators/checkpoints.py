"""The folder that checkpoints are written to, and joins whose small side is counted first."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a checked side that are sent to all executors at most.
SMALL = 20_000


def ready(spark: SparkSession) -> None:
    """Leave spark.checkpoint.dir, or a folder set before, as it is. Only a local session without one, as in tests, gets a folder of this machine's."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
    context.setCheckpointDir(folder)


def sent_if_small(table: DataFrame, most: int = SMALL) -> DataFrame:
    """`table`, which has been checkpointed, to be joined with: marked for a broadcast if it has `most` rows or fewer, else left to a join that shuffles."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
