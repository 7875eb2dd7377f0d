"""Tables that a job writes for itself in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only where the setting is absent and the master
    is local (tests, a laptop) a local folder is used; executors of a cluster share none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.tallyspark.fallback.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.tallyspark.fallback.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, later uses
    do not compute it again, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over spark.sql.shuffle.partitions tasks, for work that costs much a row: the rows of a
    small file would be worked on in a single one, and Spark would join tasks of few bytes again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds 1, 2, 3, ... in the given order, without bringing all rows to one task.

    Rows are dealt by ranges of the order and sorted; a range's first number is the sum of the
    sizes of those before it, and only these sizes, a row per range, meet in one window.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = rows.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    at = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_first") + 1
    return rows.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(name, at).drop("_at", "_part", "_first")
