"""Joins whose frequent keys don't gather in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most.
HOT_KEYS = 100_000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to keyed, which has one row per key and in its column n how many of the rows hold it.

    Of total rows, fewer than HOT_KEYS keys can hold more than a HOT_KEYS-th each. Those are broadcast, so their rows stay
    where they are; of the others none has rows enough to weigh on a task of the shuffle.
    """
    if total <= HOT_KEYS:
        return rows.join(F.broadcast(keyed), on, how)
    often = F.col("n") > total / HOT_KEYS
    marked = rows.join(F.broadcast(keyed.where(often).withColumn("_often", F.lit(True))), on, "left")
    found = marked.where("_often").drop("_often")
    rest = marked.where("_often is null").select(*rows.columns).join(keyed.where(~often), on, how)
    return found.unionByName(rest)
