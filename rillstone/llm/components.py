"""Connected components of a graph given as an edge table, in alternating star contractions.

Every round is two grouped minima and two windows over narrow rows, without a join: the
driver keeps the plan of each, so plans are small. Each round's edges are written to the
shared folder, so lineage stays short and a lost executor costs no more than the round.
The driver sees a few numbers per round, and the nodes with a large share of all edges
(under HOT_KEYS) with their minima, as the edges of such a node are dealt out to all tasks.

Defined results: edges with a null end are left out; loops and repeated edges are allowed; a
node with loops alone is in no row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.common import HOT_KEYS, materialise, partitions


def _lowest(edges: DataFrame, rows: int) -> tuple[bool, list]:
    """Whether edges (u, v), each in both directions, are stars; (u, m): nodes with a large share of the edges, with their smallest neighbour."""
    found = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("below"), F.count(F.lit(1)).alias("n"))
    apart = (F.col("m") < F.col("u")) & ((F.col("most") > F.col("u")) | (F.col("below") != F.col("m")))
    row = found.agg(F.count_if(apart), F.collect_list(F.when(F.col("n") * HOT_KEYS > rows, F.struct("u", "m")))).first()
    return not row[0], row[1]


def _with_lowest(edges: DataFrame, hot: list) -> DataFrame:
    """(u, v, m): the edges, each with the smallest neighbour of its u."""
    spark, kind = edges.sparkSession, edges.schema["u"].dataType.simpleString()
    salt = F.lit(0)
    if hot:
        edges = edges.join(F.broadcast(spark.createDataFrame([tuple(x) for x in hot], f"u {kind}, hot {kind}")), "u", "left")
        salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(partitions(spark)))).otherwise(0)
    found = edges.withColumn("salt", salt).withColumn("m", F.min("v").over(Window.partitionBy("u", "salt")))
    return found.select("u", "v", (F.coalesce("hot", "m") if hot else F.col("m")).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now = materialise(now, "component-edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        done, hot = _lowest(both, 2 * now.count())
        if done:
            break
        # Each node's larger neighbours go to its smallest one, or to itself where it is smaller.
        large = _with_lowest(both, hot).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialise(large.distinct(), "component-stars")
        # Each node and its smaller neighbours go to the smallest of these.
        low = _with_lowest(large, _lowest(large, large.count())[1])
        ends = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        now = materialise(low.select(ends.alias("u"), F.col("m").alias("v")).distinct(), "component-edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
