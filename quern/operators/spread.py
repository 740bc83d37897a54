"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt out anew if it is small and, by its estimated size, has fewer input partitions than the session has cores.

    For work that is heavy per row, such as the analysis of texts. Beyond 32 MB an input stays as it is, whatever the cores.
    """
    state = df.sparkSession._jsparkSession.sessionState()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < min(SMALL_BYTES, cores * state.conf().filesMaxPartitionBytes()) else df
