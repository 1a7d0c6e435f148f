"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import in_few_tasks
from larder.session import materialise


def _least(edges: DataFrame) -> DataFrame:
    """Per u of directed edges (u, v): the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _state(pairs: DataFrame) -> tuple:
    """Number and sum of hashes of the edges: equal when a round changed nothing."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes of edges (a, b) with their component, the least node: (node, component).

    Each round is two grouped minima and two joins, in a logarithmic number of rounds;
    every round's edges are a stored table.
    """
    directed = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = materialise(in_few_tasks(directed.distinct(), edges.count()), "component-edges")
    state, before = _state(pairs), None
    while state[0] and state != before:
        before, rows = state, 2 * state[0]
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # larger neighbours point to the least of the neighbourhood
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
        large = in_few_tasks(large, rows)
        # smaller neighbours, and the node itself, point to the least of them
        small = in_few_tasks(large.join(_least(large), "u"), rows).select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        pairs = materialise(in_few_tasks(small.filter("u <> v").distinct(), rows), "component-edges")
        state = _state(pairs)
    rows = 2 * state[0]
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return materialise(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(in_few_tasks(roots, rows)), "components")
