"""Connected components of a link table, by repeated star contraction, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.scratch import materialize

#: A node with more links than this, and than a thousandth of all, is joined by broadcast: there are at most 2,000.
HOT_LINKS = 1_000


def spread_join(rows: DataFrame, per_key: DataFrame, on: str, hot: DataFrame) -> DataFrame:
    """An inner join with a table that has at most one row per key; rows of the few ``hot`` keys stay where they are."""
    hot = F.broadcast(hot)
    few = F.broadcast(per_key.join(hot, on, "left_semi"))
    return rows.join(few, on).unionByName(rows.join(hot, on, "left_anti").join(per_key, on))


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links`` (``a, b``); comp is the least node of its component.

    Each round links every node's larger neighbours to the least node near it, then every node's
    smaller neighbours (Kiveris et al., 2014).  The least neighbour of a node is a sum that is taken before
    rows are dealt out; links of a node with very many meet it by broadcast.
    """
    edges = materialize(links.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    while True:
        ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up")))
        nodes = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("up").alias("ups"))
        no_star = (F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("n") > F.col("ups"))
        now = nodes.agg(F.count_if(no_star).alias("open"), F.max("n").alias("most"), F.sum("n").alias("total")).first()
        if not now["open"]:
            break
        limit = max(HOT_LINKS, now["total"] // 2000)
        hot = nodes.filter(F.col("n") > limit).select("node") if now["most"] > limit else None
        edges = materialize(_contract(edges, hot), "edges")
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
    return stars.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())


def _contract(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    def joined(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(least, "node") if hot is None else spread_join(rows, least, "node", hot)

    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
    least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
    large = joined(both.filter("near > node"), least).select(F.col("near").alias("node"), F.col("least").alias("lo")).filter("node <> lo").distinct()
    low = large.groupBy("node").agg(F.min("lo").alias("least"))
    small = joined(large, low).select(F.col("lo").alias("hi"), F.col("least").alias("lo")).filter("hi <> lo")
    return low.select(F.col("node").alias("hi"), F.col("least").alias("lo")).unionByName(small).distinct()
