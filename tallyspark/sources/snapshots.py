"""Tables that are replaced as a whole or part by part, in one step for their readers.

A table is a folder: data of each write in a folder of its own, and commits, small numbered
files that say which data each part of the table is made of. A write puts its data down first and
its commit last, under its final name in one rename; readers take the last commit. So they see a
table before a write or after it, also when a write fails half way. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The part of a table that has no parts.
WHOLE = "all"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _last_commit(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(number, part -> folder of its data); (0, {}) for a table that is not there yet."""
    where, store = _store(spark, f"{path}/commits")
    if not store.exists(where):
        return 0, {}
    numbers = [int(f.getPath().getName()) for f in store.listStatus(where) if f.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{path}/commits/{max(numbers):012d}", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def _commit(spark: SparkSession, path: str, number: int, parts: dict[str, str]) -> None:
    where, store = _store(spark, f"{path}/commits/_{uuid.uuid4().hex}")
    out = store.create(where)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    final, _ = _store(spark, f"{path}/commits/{number:012d}")
    if store.exists(final) or not store.rename(where, final):
        raise RuntimeError(f"another writer has committed {number} to {path}")


def replace_parts(df: DataFrame, path: str, by: str) -> None:
    """Replace the parts of the table (values of column `by`, few) that df has, and only those."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    number, parts = _last_commit(spark, path)
    df.write.partitionBy(by).parquet(f"{path}/data/{folder}")
    new = spark.read.schema(df.schema).parquet(f"{path}/data/{folder}").select(F.col(by).cast("string")).distinct().collect()
    _commit(spark, path, number + 1, parts | {r[0]: folder for r in new})


def replace_all(df: DataFrame, path: str) -> None:
    """Replace the whole table. df may be made of what the table held before."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    number, _ = _last_commit(spark, path)
    df.write.parquet(f"{path}/data/{folder}")
    _commit(spark, path, number + 1, {WHOLE: folder})


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The whole table of replace_all, as last committed; None if there is none."""
    _, parts = _last_commit(spark, path)
    return spark.read.parquet(f"{path}/data/{parts[WHOLE]}") if WHOLE in parts else None


def read_part(spark: SparkSession, path: str, by: str, part: str) -> DataFrame:
    """A part of the table of replace_parts, with its column `by`; other parts are not read."""
    _, parts = _last_commit(spark, path)
    if part not in parts:
        some = next(iter(parts.values()))
        return spark.read.parquet(f"{path}/data/{some}").limit(0)
    return spark.read.parquet(f"{path}/data/{parts[part]}").where(F.col(by).cast("string") == part)
