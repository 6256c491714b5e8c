"""Consolidating pairwise matches into groups: peel the giant component, label the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import discard, materialize_at


def star_edges(links: DataFrame, *, hub: str, member: str) -> DataFrame:
    """``(a, b)`` between members that share a hub: each with the hub's smallest member, never all pairs.

    The smallest member is a map-side combined minimum joined back on the hub;
    a hub with very many members is split by the engine's skew join.
    """
    pairs = links.select(F.col(hub).alias("hub"), F.col(member).alias("member")).where("hub is not null and member is not null").distinct()
    least = pairs.groupBy("hub").agg(F.min("member").alias("least"))
    return pairs.join(least, "hub").where("member <> least").select(F.col("least").alias("a"), F.col("member").alias("b")).distinct()


def _rounds(spark: SparkSession):
    """Writes tables one after another; ``drop`` removes those no longer read."""
    paths: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        out, path = materialize_at(df, label)
        paths.append(path)
        return out

    def drop(but: int) -> None:
        while len(paths) > but:
            discard(spark, paths.pop(0))

    return keep, drop


#: Least share of the vertices reached that a frontier must add for the search to go on; so hops grow with the logarithm of what is reached.
GROWTH = 0.25


def _core(both: DataFrame) -> DataFrame | None:
    """``v`` reached from the vertex with the highest degree by frontier joins, as long as the frontier grows with what is reached.

    Where one component holds most vertices that is all of it or nearly so;
    along a chain the search stops after a few hops.
    """
    spark = both.sparkSession
    top = both.groupBy("a").count().orderBy(F.desc("count"), "a").limit(1).collect()
    if not top:
        return None
    frontier, path = materialize_at(spark.createDataFrame([(top[0]["a"],)], "v bigint"), "core")
    reached, paths, n = frontier, [path], 1
    while True:
        step = both.join(frontier, both["a"] == frontier["v"], "left_semi").select(F.col("b").alias("v")).distinct()
        frontier, path = materialize_at(step.join(reached, "v", "left_anti"), "core")
        paths.append(path)
        added = frontier.count()
        n += added
        reached = spark.read.schema("v bigint").parquet(*paths)
        if added < GROWTH * n:
            return reached


def connected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(v, label)``: every vertex with the smallest vertex id of its component.

    ``edges``: ``a, b`` bigint, undirected, in any order, repeats allowed;
    ``vertices``: ``v``. A vertex without edges is its own component; null
    ends are ignored; empty inputs give no rows.

    First the core of the giant component is peeled off by breadth-first
    frontier joins from the vertex with the highest degree: every edge is read
    by frontiers that hold a vertex once, and the core takes no further part
    but as one vertex where it has edges left to others. The components that
    remain are labelled by minimum propagation; a smaller label is also told to
    the vertex that the larger one names, and a vertex takes the label of the
    vertex its own names, so long chains settle in a number of rounds that
    grows with the logarithm of their length. Every hop and round is a written
    table; only counts and the core's label reach the driver.
    """
    spark = edges.sparkSession
    one_way = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    keep, _ = _rounds(spark)
    both = keep(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    ids = vertices.where("v is not null").select("v").unionByName(both.select(F.col("a").alias("v"))).distinct()
    core = _core(both)
    if core is None:
        return ids.select("v", F.col("v").alias("label"))
    least = core.agg(F.min("v")).first()[0]
    inside = lambda end: core.select(F.col("v").alias(end), F.lit(least).cast("bigint").alias("c" + end))
    cut = both.join(inside("a"), "a", "left").join(inside("b"), "b", "left").where("ca is null or cb is null")
    rest = keep(cut.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct(), "rest")
    labels = _propagate(spark, rest)
    own = labels.where(F.col("v") == least).first()
    peeled = core.select("v", F.lit(own["label"] if own else least).cast("bigint").alias("label"))
    alone = ids.join(both.select(F.col("a").alias("v")).distinct(), "v", "left_anti").select("v", F.col("v").alias("label"))
    return peeled.unionByName(labels.where(F.col("v") != least)).unionByName(alone)


def _propagate(spark: SparkSession, both: DataFrame) -> DataFrame:
    keep, drop = _rounds(spark)
    labels = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("label")), "labels")
    while True:
        told = both.join(labels.select(F.col("v").alias("b"), "label"), "b").join(labels.select(F.col("v").alias("a"), F.col("label").alias("old")), "a").where("label < old")
        heard = told.select(F.explode(F.array("a", "old")).alias("v"), "label", F.lit(None).cast("bigint").alias("own"))
        rows = labels.select("v", "label", F.col("label").alias("own")).unionByName(heard)
        least = rows.groupBy("v").agg(F.min("label").alias("label"), F.max("own").alias("own"))
        hop = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        moved = least.join(hop, "label", "left").select("v", F.least("label", F.coalesce("further", "label")).alias("label"), "own")
        nxt = keep(moved, "labels")
        settled = nxt.where("label <> own").isEmpty()
        drop(1)
        labels = nxt.select("v", "label")
        if settled:
            return labels
