"""Connected components of an edge table by randomised contraction.

Each round every node looks up the neighbour (or itself) that comes first in an order drawn anew for
the round, edges are rewritten to those nodes, and loops and repeats fall away; a constant share of
the nodes is expected to vanish per round whatever the graph's shape, so long chains and large stars
both end after about log(n) rounds.  All state is in written tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from counterpoise.llm.shared import Forest
from counterpoise.operators.skew import lookup
from counterpoise.session import cut_lineage


LAST = 5_000


def _finish(frames):
    """Every node of at most ``LAST`` edges with the smallest node that it is connected to."""
    edges = pd.concat(list(frames), ignore_index=True)
    ends = pd.concat([edges["a"], edges["b"]])
    names = ends.drop_duplicates().sort_values().to_numpy()
    place = names.searchsorted(edges.to_numpy())
    forest = Forest(len(names))
    for x, y in place.tolist():
        forest.join(x, y)
    yield pd.DataFrame({"node": names, "to": names[forest.roots()]})


def connected(edges: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges (a, b)``, both long.

    ``component`` is the smallest node that can be reached.  Rows with a null end are ignored; an edge
    from a node to itself makes the node known.  An empty table gives an empty result.
    """
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    live = cut_lineage(known.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    labels = None
    step = 0
    while (left := live.count()) or labels is None:
        step += 1
        both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).union(
            live.select(F.col("b").alias("node"), F.col("a").alias("near")))
        order = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("n"))
        if 0 < left <= LAST:
            picks = live.coalesce(1).mapInPandas(_finish, "node long, to long")
        else:
            picks = both.groupBy("node").agg(F.min(order("near")).alias("first")).select(
                "node", F.least(order("node"), "first").getField("n").alias("to"))
        picks = cut_lineage(picks)
        if labels is None:
            labels = picks.select("node", F.col("to").alias("label"))
        else:
            moved = lookup(labels, picks, {"label": "node"}, ["to"], stored=True)
            labels = cut_lineage(moved.select("node", F.coalesce("to", "label").alias("label")))
        if left <= LAST:
            break
        ends = lookup(live, picks, {"a": "node"}, ["to"], stored=True).select("b", F.col("to").alias("x"))
        ends = lookup(ends, picks, {"b": "node"}, ["to"], stored=True).select("x", F.col("to").alias("y"))
        live = cut_lineage(ends.where("x <> y").select(F.least("x", "y").alias("a"),
                                                       F.greatest("x", "y").alias("b")).distinct())
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return lookup(labels, least, ["label"], ["component"]).select("node", "component")
