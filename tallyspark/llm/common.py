"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch for jobs that carry whole texts.
TEXT_BATCH_ROWS = 500


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder all executors share.

    Only where that setting is absent and the master is local (tests, a laptop) a local
    folder is used; a cluster without it is an error, since executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.tallyspark.fallback.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
            spark.conf.set("spark.tallyspark.fallback.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


#: Paths that the open scratch scopes remove at their ends.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Removes what shared_dir and written made inside, when it ends. Results must be
    written outside of it, by the caller, before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever store that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back."""
    return written_to(df, shared_dir(df.sparkSession, name), compression)


def written_to(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batch(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = TEXT_BATCH_ROWS
) -> DataFrame:
    """mapInArrow with small batches, so that long texts stay within memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A key for each row; fixed once the result is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Files whose names are sent to all tasks, at most; a frame over more files is copied once.
FEW_FILES = 100_000


def identified(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, which is the same however often it is read.

    Rows of files are named by their file and their place in it, so nothing is copied; other
    frames are written once.
    """
    spark, file, place = df.sparkSession, free_name(df, "_file"), free_name(df, "_place")
    try:
        own = free_name(df, "_metadata") == "_metadata"
        rows = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)) if own else None
    except AnalysisException:
        rows = None
    if rows is None or len(df.inputFiles()) > FEW_FILES:
        return written(with_row_id(df, name), "docs")
    files = sorted(r[0] for r in rows.select(file).distinct().collect())
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(files)), f"{name} long, {file} string"))
    return rows.join(numbers, file).select(*df.columns, (F.shiftleft(name, 40) + F.col(place)).alias(name))


def record(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], type=t) if not isinstance(columns[k], pa.Array) else columns[k].cast(t) for k, t in schema.items()],
        names=list(schema),
    )
