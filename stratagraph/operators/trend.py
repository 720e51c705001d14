"""Metrics of a versioned graph at many revisions in one run: by events and running sums, and by masks with a bit for each revision.

Nodes and edges are sums of changes by revision. Orphans and cyclic edges are found for up to 62 revisions at once: each edge is one row with a mask of the revisions at which
it is there, whatever its versions, so the graph is searched once for all of them and not once for each (graph.cyclic_masks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def _events(rows: DataFrame, *key: str) -> DataFrame:
    """key, r, d: rows that come and go at a revision."""
    come = rows.select(*key, F.col("valid_from").alias("r"), F.lit(1).alias("d"))
    return come.unionByName(rows.where("valid_to is not null").select(*key, F.col("valid_to").alias("r"), F.lit(-1).alias("d"))).groupBy(*key, "r").agg(F.sum("d").alias("d"))


def running(events: DataFrame, revisions: DataFrame, name: str) -> DataFrame:
    """revision, name: the sum of the changes (r, d) up to each revision (0 before any). Windows run over a row a revision."""
    asked = revisions.select(F.col("revision").alias("r"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("asked")).distinct()
    steps = events.select("r", "d", F.lit(False).alias("asked")).unionByName(asked).groupBy("r").agg(F.sum("d").alias("d"), F.max("asked").alias("asked"))
    return steps.withColumn(name, F.sum("d").over(Window.orderBy("r"))).where("asked").select(F.col("r").alias("revision"), name)


#: Revisions that one mask holds.
BITS = 62


def _masked(rows: DataFrame, revisions: list[int], *key: str) -> DataFrame:
    """key, mask: at which of some revisions (in order, BITS at most) a row of that key is valid, a bit each; keys that are at none are left out."""
    asked = F.array(*(F.lit(r).cast("long") for r in revisions))
    before = lambda c: F.size(F.filter(asked, lambda r: r < F.col(c)))
    upto = F.coalesce(F.when(F.col("valid_to").isNotNull(), before("valid_to")), F.lit(len(revisions)))
    spans = rows.select(*key, before("valid_from").alias("i"), upto.alias("j")).where("i < j")
    return spans.groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, j) - shiftleft(1L, i)")).alias("mask"))


def _counted(masks: DataFrame, revisions: list[int], name: str) -> DataFrame:
    """revision, name: how many masks (mask) have its bit."""
    sums = F.array(*(F.coalesce(F.sum(F.expr(f"shiftright(mask, {i}) & 1L")), F.lit(0)) for i in range(len(revisions))))
    one = masks.agg(sums.alias("n")).select(F.posexplode("n").alias("i", name))
    return one.select(F.element_at(F.array(*(F.lit(r).cast("long") for r in revisions)), F.col("i") + 1).alias("revision"), name)


def orphan_masks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """mask of each node (node, mask) without the bits at which an edge (src, dst, mask) touches it."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("node"), "mask").groupBy("node").agg(F.bit_or("mask").alias("touched"))
    return nodes.join(touched, "node", "left").select(F.expr("mask & ~coalesce(touched, 0)").alias("mask"))


def metrics_trend(nodes: DataFrame, edges: DataFrame, revisions: DataFrame) -> DataFrame:
    """revision, nodes, edges, cyclic, orphans at each of some revisions (a row each): what scenes.metrics() says of the graph then. nodes: node, valid_from, valid_to (no two
    versions of a node at once); edges: src, dst, valid_from, valid_to. Cyclic are distinct edges within a strong component at the revision, or from a node to itself."""
    asked = sorted(r.revision for r in revisions.select("revision").distinct().collect())
    lo, hi = (asked[0], asked[-1]) if asked else (0, -1)
    edges = graph.settled(edges.where((F.col("valid_from") <= hi) & (F.col("valid_to").isNull() | (F.col("valid_to") > lo))).select("src", "dst", "valid_from", "valid_to"))
    revisions = edges.sparkSession.createDataFrame([(r,) for r in asked], "revision long")
    n = running(_events(nodes.select("valid_from", "valid_to")), revisions, "nodes")
    m = running(_events(edges.select("valid_from", "valid_to")), revisions, "edges")
    found = n.join(m, "revision")
    parts = []
    for start in range(0, len(asked), BITS):
        some = asked[start : start + BITS]
        masks = graph.settled(_masked(edges, some, "src", "dst"))
        orphans = _counted(orphan_masks(_masked(nodes, some, "node"), masks), some, "orphans")
        parts.append(orphans.join(_counted(graph.cyclic_masks(masks, len(some)), some, "cyclic"), "revision"))
    if not parts:
        return found.select("revision", "nodes", "edges", F.lit(0).cast("long").alias("cyclic"), F.lit(0).cast("long").alias("orphans"))
    return found.join(graph._together(parts), "revision").select("revision", "nodes", "edges", "cyclic", "orphans")
