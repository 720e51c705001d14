"""A generated graph of any size, and timings over it as a stored table: what a store's benchmark measures."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store, temporal
from ..operators.versioned import Change

ENTITIES, EDGES, REVISIONS, SEED = 50_000, 1_000_000, 100, 0xC5160000


def _draw(stream: int, bound: int):
    """A number below `bound`, the same for a row's id wherever and however often it is made."""
    return F.pmod(F.xxhash64(F.lit(SEED), F.lit(stream), F.col("id")), F.lit(bound))


def entities(spark: SparkSession, n: int = ENTITIES) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select((i + 1).alias("id"), F.concat(F.lit("swift:function:bench/M"), i % 500, F.lit(".f"), i).alias("stable_key"), F.lit("function").alias("kind"), F.lit(1).cast("long").alias("first_seen"))


def edges(spark: SparkSession, n: int = EDGES, nodes: int = ENTITIES, revisions: int = REVISIONS) -> DataFrame:
    """Imports between entities; about a fifth is retracted within twenty revisions."""
    start = _draw(3, revisions) + 1
    end = F.when(_draw(4, 5) == 0, F.least(start + 1 + _draw(5, 20), F.lit(revisions)))
    return spark.range(n).select("id", F.lit("imports").alias("kind"), (_draw(1, nodes) + 1).alias("source_id"), (_draw(2, nodes) + 1).alias("target_id"), F.lit("observed").alias("layer"), start.alias("valid_from"), end.alias("valid_to"), F.lit(None).cast("string").alias("properties"))


def bench(spark: SparkSession, folder: str, n: int = EDGES, nodes: int = ENTITIES) -> dict[str, float]:
    """Seconds of: insert (entities and edges with provenance into an empty store), count of current edges, neighbourhood of a node now and at a revision, and
    a commit that retracts and asserts n / 200 edges each through the store: ends and retracted edges are checked, history is kept, only deltas are written."""
    out: dict[str, float] = {}

    def timed(name: str, f):
        t = time.time()
        got = f()
        out[name] = round(time.time() - t, 3)
        return got

    graph = store.StoredGraph(spark, f"{folder}/store")

    def insert() -> None:
        at = graph.stored.head()
        rows = edges(spark, n, nodes)
        versions = entities(spark, nodes).select(F.col("id").alias("entity_id"), F.concat_ws("|", "kind", "stable_key").alias("state"), F.lit(1).cast("long").alias("valid_from"))
        links = rows.select(F.lit("edge").alias("fact_kind"), F.col("id").alias("fact_id"), F.col("id").alias("observation_id"), "valid_from")
        graph.stored.commit(at, {"versions": Change(versions), "edges": Change(rows), "links": Change(links)}, REVISIONS)

    timed("insert", insert)
    timed("compact", lambda: [graph.stored.compact(name) for name in ("versions", "edges", "links")])
    now = lambda keys=None: graph.stored.current("edges", keys)
    timed("current_count", lambda: now().count())
    timed("neighborhood_now", lambda: now().where("source_id = 7 or target_id = 7").count())
    timed("targets_now", lambda: now([7]).count())
    timed("neighborhood_as_of", lambda: temporal.as_of(graph.stored.rows("edges").where("source_id = 7 or target_id = 7"), REVISIONS // 2).count())
    some = max(1, n // 200)
    gone = now().where(F.col("id") % 200 == 0).select("id")
    new = spark.range(n, n + some).select((_draw(1, nodes) + 1).alias("source_id"), (_draw(2, nodes) + 1).alias("target_id"), F.lit("imports").alias("kind"), F.lit("observed").alias("layer"), F.lit(None).cast("string").alias("properties"))
    timed("commit", lambda: graph.commit(store.Changes(edges=new, closed=gone)))
    return out
