"""Intermediate tables in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, one of our own if all executors are this machine, as in tests; else an
    error, since executors wouldn't see each other's files."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{KEY} has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one run. They cut the lineage and outlive an executor that is lost.

    What the returned frame still reads stays; drop() removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/docloom/{what}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            self.names.discard(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops all tables but these, which a returned frame reads."""
        self.drop(*(self.names - set(names)))
