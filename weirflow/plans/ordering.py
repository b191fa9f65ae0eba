"""Global order without one task for all rows: ranges of an order, numbered."""

from __future__ import annotations

import re
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART, ROW = "__weir_part", "__weir_row"
#: Used where the session names no folder and everything runs on one machine.
FALLBACK_DIR = "/tmp/checkpoints/weirflow"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a final slash: spark.checkpoint.dir. Where it is unset, a local master
    gets a folder of this machine, and any other an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it names the folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, read again; the table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order_by: list[str], tag: str = "ordered") -> DataFrame:
    """df with PART and ROW: PART ascends with the order, and ROW numbers the rows of a part, from 0, in the order.

    It is written, as the bounds of ranges are sampled and may differ in a second run.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys that are NULL come first, as Spark sorts them.
    ranged = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return written(ranged.withColumn(PART, F.spark_partition_id()).withColumn(ROW, within), tag)


def part_lookup(parts: dict[int, object], kind: str) -> Column:
    """The value of each row's PART, from a driver-side map of one entry a part."""
    if not parts:
        return F.lit(None).cast(kind)
    last = max(parts)
    return F.get(F.array(*(F.lit(parts.get(i)).cast(kind) for i in range(last + 1))), F.col(PART))


def row_numbers(ranged: DataFrame) -> Column:
    """Each row's number in the whole order, from 0. One count for each part comes to the driver."""
    counts = {r[PART]: r["count"] for r in ranged.groupBy(PART).count().collect()}
    sizes = [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)]
    offsets = dict(enumerate([0, *accumulate(sizes)][: len(sizes)]))
    return part_lookup(offsets, "long") + F.col(ROW)
