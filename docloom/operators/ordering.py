"""Dense numbers over a whole table without one task that holds it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import kept


def running_offsets(counts: DataFrame, order: str, sums: dict[str, str], written: bool = False) -> DataFrame:
    """(order, *names): for each row the sums of its columns over the rows with a smaller order, a value that doesn't repeat.

    sums: name -> column of counts. Rows are dealt by ranges of the order; each range is summed by itself, and only the
    ranges' own sums, one row for each, meet in one task. Only these small columns are shuffled and written. written: counts
    are cheap to read again, as a kept table is.
    """
    columns = [F.col(c).cast("long").alias(f"_{name}") for name, c in sums.items()]
    # Finding ranges reads the rows once more, so they are written before.
    counts = counts.select(order, *columns)
    dealt = kept((counts if written else kept(counts)).repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before, whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), dealt.groupBy("_range").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    whole = whole.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = Window.partitionBy("_range").orderBy(order)
    dealt = dealt.select("*", *((F.sum(f"_{n}").over(own) - F.col(f"_{n}")).alias(f"_o_{n}") for n in sums))
    return dealt.join(whole, "_range").select(order, *((F.col(f"_o_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def carried(rows: DataFrame, group: str, order: str, values: dict[str, str]) -> DataFrame:
    """(group, order, *names): for each row the last value that isn't null among the rows of its group with a smaller order, null
    if there is none. An order doesn't repeat within a group. rows have to be cheap to read again, as a kept table is.

    values: name -> column. Dealt as in running_offsets, so a group that holds most of the rows is no task of its own.
    """
    marked = {n: F.when(F.col(c).isNotNull(), F.struct(F.col(group).alias("g"), F.col(c).alias("v"))).alias(f"_{n}") for n, c in values.items()}
    dealt = kept(rows.select(group, order, *marked.values()).repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()))
    at = lambda n: F.when(F.col(f"_{n}").isNotNull(), F.struct(group, order))
    ends = dealt.groupBy("_range").agg(*(F.max_by(f"_{n}", at(n)).alias(f"_{n}") for n in values))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_range", *(F.last(f"_{n}", True).over(earlier).alias(f"_e_{n}") for n in values))
    own = Window.partitionBy("_range").orderBy(group, order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("_range", group, order, *(F.last(f"_{n}", True).over(own).alias(f"_o_{n}") for n in values)).join(ends, "_range")
    last = {n: F.coalesce(f"_o_{n}", f"_e_{n}") for n in values}
    return dealt.select(group, order, *(F.when(c["g"] == F.col(group), c["v"]).alias(n) for n, c in last.items()))
