"""Connected components over a table of links, for graphs that fit on no single machine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import scratch, spread_join, staged


#: Edges up to which one task joins them all (a third of a megabyte); beyond, stars are contracted and the nodes with the most edges are looked for.
FEW = 20_000


def _united(batches, names=("u", "v")):
    """The smallest node that each node of the edges (u, v) is joined to."""
    above: dict = {}

    def root(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist()):
            u, v = root(u), root(v)
            above[max(u, v)] = min(u, v)
    yield pd.DataFrame([(x, root(x)) for x in list(above)], columns=names, dtype="int64")


def _spread(edges: DataFrame, least: DataFrame, key: str = "u") -> DataFrame:
    """edges with what is known of their node; a star's centre may hold a large share of all edges."""
    return spread_join(edges, least, key) if edges.count() > FEW else edges.join(least.hint("merge"), key)


def smallest_reachable(links: DataFrame, values: DataFrame) -> DataFrame:
    """node, label: the smallest value that links (a, b) reach from each node with a link; values: node, value.

    Stars are contracted by turns: larger neighbours go to a node's smallest neighbour, then smaller ones do. The number
    of rounds grows with the logarithm of the longest chain; each ends in a written table. At most FEW links are joined by one task.
    """
    with scratch(links.sparkSession):
        return staged(_contracted(links, values), "labels", keep=True)


def _contracted(links: DataFrame, values: DataFrame) -> DataFrame:
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    n, before = edges.count(), None
    while n > FEW and (before is None or n < 0.7 * before):  # links that others imply go within tasks, while that makes them fewer
        part = edges.repartition(-(-n // FEW)).mapInPandas(_united, "u long, v long").where("u <> v")
        edges, before = staged(part, "fewer"), n
        n = edges.count()
    stars = edges.coalesce(1).mapInPandas(lambda b: _united(b, ["node", "centre"]), "node long, centre long") if n <= FEW else _stars(edges)
    valued = staged(stars.join(values.hint("merge"), "node"), "valued")
    label = valued.groupBy("centre").agg(F.min("value").alias("label"))
    return _spread(valued, label, "centre").select("node", "label")


def _stars(edges: DataFrame) -> DataFrame:
    """node, centre: every node of the edges (u, v), its component's smallest one."""
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _spread(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _spread(large, least)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    centres = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("centre")).union(centres.select(F.col("v").alias("node"), F.col("v").alias("centre")))
