"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_counted
from .storage import Scratch


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges seen from u, with the least node of u and its neighbours there. The least is joined, never a list per node, and
    the centre of a large star is joined by broadcast."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    return join_counted(edges, least, ["u"], total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, total)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v")))


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of an edge table (u, v); component is the least node reachable.

    Null ends and loops are left out. Each step is written to the shared folder; the edges end as one star per
    component, which both steps leave as it is.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, step, before = scratch.write(edges, f"{name}-0"), 0, None
    total = edges.count()
    while True:
        step += 1
        # A large-star step gives as many edges as it takes.
        stars = _small_star(_large_star(edges, total), total).where("u > v").distinct()
        stars = scratch.write(stars, f"{name}-{step}")
        sums = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        if tuple(sums) == before:
            break
        edges, before, total = stars, tuple(sums), sums[0]
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
