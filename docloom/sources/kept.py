"""Frames whose rows are computed once, in the folder that all executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one of our own if all executors are this machine, as in tests; else
    an error, since executors wouldn't see each other's files."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    """This application's folder."""
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}"


def kept(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """The same rows, written once as Parquet and read back: no lineage, so later plans stay small and read only the columns
    they need, and a lost executor costs no second call of a model. They stay until release() or their releasing() is over.
    file_rows: a file's rows at most, if not 0, for rows of megabytes, since a reader holds thousands of a file's rows at a time."""
    path = f"{_own(df.sparkSession)}/{'/'.join(_scopes)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def release(spark: SparkSession) -> None:
    """Deletes all that this application has kept: frames that read it can't be used any more."""
    _delete(spark, _own(spark))


_scopes: list[str] = []


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """What is kept inside goes at the end: for a long session that asks many questions, each of which is written or collected
    inside.

        with releasing(spark):
            engine.batch_query(questions).write.parquet(out)
    """
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    path = f"{_own(spark)}/{'/'.join(_scopes)}"
    try:
        yield
    finally:
        _scopes.pop()
        _delete(spark, path)
