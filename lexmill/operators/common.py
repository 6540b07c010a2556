"""What the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most.
MOST_BROADCAST = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for broadcast where a count finds it under the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def settled(df: DataFrame) -> DataFrame:
    """df computed once for several uses: checkpointed in the shared folder, or, where none is set, as when Spark runs in one process, persisted."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None):
        if not context.getCheckpointDir():
            context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
        return df.checkpoint()
    return df.persist()
