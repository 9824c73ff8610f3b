"""Tables whose rows are work: dealt out over the cores where the files' layout would give them to a few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scans of more partitions a core than this aren't looked at: there is work for every core.
MANY = 4
#: Bytes of files that one task gets at most, where rows are dealt out.
SHARE = 16 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df, its rows spread over at least as many partitions as there are cores if fewer partitions of its scan have any.

    A Parquet file is split by bytes, but its rows go to the split in which their row group lies, so a file of one row group is one
    task's work. Which partitions have rows is asked of the files' footers alone: no column is read. Large tables have
    far more partitions than cores and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > MANY * cores:
        return df
    full = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().count()
    if not 0 < full < cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // SHARE)))
