"""Pairwise matches into groups: deterministic Boruvka hooking over written edge tables.

A round: every component selects its smallest outgoing edge, the selected edges
form trees, pointer doubling collapses each tree to its root, and the edges are
relabelled by root and deduplicated. Components at least halve each round, so
billions of pairs need a few dozen rounds at the very most; a chain of any
length costs the logarithm of its length in doublings.

Edges are ordered by their (smaller, larger) end. A component's smallest edge
then leads to its smallest neighbour, the two ends of a tree's smallest edge
select each other, and the smaller of them, the root, is the smallest id of the
tree: labels need no pass of their own.

No links, components or labels reach the driver, only one row count a step.
Every step ends in a table in the shared folder, so a lost executor costs the
running step. Minima and distinct edges combine before their shuffles. In the
joins by label the looked-up side has one row a key; a hub makes the other side
skewed, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import drop_settled, settle


def _ordered(u: Column, v: Column) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _smallest_edge(edges: DataFrame) -> DataFrame:
    """``c, p``: each component and the other end of its smallest edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("p")), F.struct(F.col("v").alias("c"), F.col("u").alias("p")))).alias("x"))
    return ends.select("x.c", "x.p").groupBy("c").agg(F.min("p").alias("p"))


def _doubled(tree: DataFrame) -> DataFrame:
    """Each pointer replaced by its target's pointer; a pair that points at each other gets its smaller member as root."""
    above = tree.select(F.col("c").alias("p"), F.col("p").alias("g"))
    step = tree.join(above, "p")
    root = F.when(F.col("g") == F.col("c"), F.least("c", "p")).otherwise(F.col("g"))
    return step.select("c", root.alias("p"), (root != F.col("p")).alias("moved"))


def _collapse(tree: DataFrame) -> DataFrame:
    """Pointer doubling until every component points at the root of its tree."""
    now = settle(_doubled(tree), "tree")
    while not now.where("moved").isEmpty():
        before, now = now, settle(_doubled(now.drop("moved")), "tree")
        drop_settled(before)
    return now.drop("moved")


def _relabelled(edges: DataFrame, tree: DataFrame) -> DataFrame:
    for end in ("u", "v"):
        edges = edges.join(tree.select(F.col("c").alias(end), F.col("p").alias(f"{end}_root")), end)
    u, v = F.col("u_root"), F.col("v_root")
    return edges.where(u != v).select(*_ordered(u, v)).distinct()


def group_matches(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``id, root`` for every id in a pair: the smallest id reachable over pairs.

    Pairs may come in either order and repeatedly. A pair with a null end links
    nothing and a null is no id; an id paired with itself alone is a group of
    one. An empty table gives an empty result. Ids of any ordered type will do;
    other columns are not read.
    """
    ends = pairs.select(pairs[a].alias("x"), pairs[b].alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    alone = ends.where(F.col("x") == F.col("y")).select(F.col("x").alias("id")).distinct()
    edges = settle(ends.where(F.col("x") != F.col("y")).select(*_ordered(F.col("x"), F.col("y"))).distinct(), "edges")
    trees: list[DataFrame] = []
    while not edges.isEmpty():
        selected = settle(_smallest_edge(edges), "selected")
        tree = _collapse(selected)
        trees.append(tree)
        before, edges = edges, settle(_relabelled(edges, tree), "edges")
        drop_settled(before, selected)
    drop_settled(edges)
    if not trees:
        return alone.select("id", F.col("id").alias("root"))
    # From the last round backwards, so that all but one of these joins are over shrunken tables.
    labels = trees.pop()
    while trees:
        later = labels.select(F.col("c").alias("p"), F.col("p").alias("top"))
        tree = trees.pop()
        before, labels = labels, settle(tree.join(later, "p", "left").select("c", F.coalesce("top", "p").alias("p")), "labels")
        drop_settled(before, tree)
    grouped = labels.select(F.col("c").alias("id"), F.col("p").alias("root"))
    single = alone.join(grouped.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"))
    return grouped.unionByName(single)
