"""Session settings that suit wide tables with heavy text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# HotSpot never compiles methods above 8000 bytes of bytecode; Spark then splits the expressions of a
# projection into small functions instead of fusing them into one that would be interpreted forever.
# Splits of 16 MB: the text rules cost far more than reading, so a task of the usual 128 MB would run for long and its sorts
# and tables would be large. After a shuffle, partitions are joined up to 8 MB for the same reason.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.files.maxPartitionBytes": str(16 << 20),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(8 << 20),
}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with these settings; everything else stays as the cluster has it."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the splits of the input do not spread them.

    Text rules cost far more than moving the raw rows once. A file is split by bytes, but all rows of one of its groups
    come with one split, so the rows of the splits are counted, which reads no column. Inputs whose rows lie in enough
    splits, none with many times its share, pass unchanged; others go to as many partitions as they have splits, one per
    core at least.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("split")).count().collect()]
    splits = df.rdd.getNumPartitions()
    even = len(sizes) >= cores and max(sizes) * len(sizes) <= 2 * sum(sizes)
    return df if even or not sizes else df.repartition(max(cores, splits))
