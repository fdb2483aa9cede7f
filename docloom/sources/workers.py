"""What workers get: the package, and an even share of small tables."""

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def find_package(spark: SparkSession) -> SparkSession:
    """Elsewhere the cluster's own PYTHONPATH or the files given to spark-submit do that."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores if it comes in no more parts than there are: a small file with one row group is a single
    task otherwise. A larger table stays as its files are split, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
