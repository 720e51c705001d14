"""Prefix search of entity names: postings of the terms of each version's name, dealt by how the term begins, ranked by BM25.

Postings carry the interval of the version that they are of, so a search at a revision reads the names as they were then. A query reads the postings
whose terms begin with one of its terms (stored by `head`, the files of those heads only); number and mean length of names come from a table of changes by
revision, not from the postings.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import search, temporal
from .versioned import Spec

HEAD = 2
#: How postings are stored: a version's are closed by its entity; a look-up names heads.
STORED = {
    "names": Spec("head string, term string, entity_id long, tf int, length int", ("entity_id",), "head"),
    "name_stats": Spec("revision long, n long, length long", ("revision",), "revision", 1),
}


def name_postings(versions: DataFrame) -> DataFrame:
    """head, term, entity_id, tf, length, valid_from, valid_to of versions (entity_id, name, valid_from, valid_to): a row a term and version."""
    rows = versions.select("entity_id", T.terms(F.col("name")).alias("t"), "valid_from", "valid_to").withColumn("length", F.size("t"))
    each = rows.select("*", F.explode(F.array_distinct("t")).alias("term"))
    found = each.withColumn("tf", F.size(F.filter("t", lambda x: x == F.col("term"))))  # counted within the row: nothing is grouped or shuffled
    return found.select(F.substring("term", 1, HEAD).alias("head"), "term", "entity_id", "tf", "length", "valid_from", "valid_to")


def name_stats(versions: DataFrame) -> DataFrame:
    """revision, n, length: by how much the number of names and their terms together change at a revision. A row a revision."""
    size = F.size(T.terms(F.col("name"))).cast("long")
    opened = versions.select(F.col("valid_from").alias("revision"), F.lit(1).alias("n"), size.alias("length"))
    closed = versions.where("valid_to is not null").select(F.col("valid_to").alias("revision"), F.lit(-1).alias("n"), (-size).alias("length"))
    return opened.unionByName(closed).groupBy("revision").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))


def query_heads(query: str) -> list[str] | None:
    """The heads whose postings a query reads; None where a term is shorter than a head, which then stands at the beginning of many."""
    parts = _parts(query)
    return None if any(len(p) < HEAD for p in parts) else sorted({p[:HEAD] for p in parts})


def _parts(query: str) -> list[str]:
    return sorted({p.lower() for p in query.replace('"', "").split()})


def search_names(postings: DataFrame, stats: DataFrame, query: str, revision: int | None = None) -> DataFrame:
    """entity_id, score of the entities whose name, at a revision, has for each query term one that begins with it. BM25: a query term occurs in a name as
    often as terms there begin with it. An empty query finds nothing."""
    parts = _parts(query)
    if not parts:
        return postings.select("entity_id", F.lit(0.0).alias("score")).limit(0)
    of = F.array_compact(F.array(*[F.when(F.col("term").startswith(p), F.lit(i)) for i, p in enumerate(parts)]))
    begins: Column = functools.reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in parts])
    heads = query_heads(query)
    rows = temporal.as_of(postings, revision).where(begins if heads is None else F.col("head").isin(heads) & begins)
    hits = rows.select("entity_id", "length", "tf", F.explode(of).alias("i")).groupBy("i", "entity_id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    df = hits.groupBy("i").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    upto = stats if revision is None else stats.where(F.col("revision") <= revision)
    size = upto.agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("average"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("length") / F.col("average")))
    scored = hits.join(F.broadcast(df), "i").crossJoin(F.broadcast(size)).groupBy("entity_id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("parts"))  # size is one row
    return scored.where(F.col("parts") == len(parts)).select("entity_id", "score")


def find_names(postings: DataFrame, stats: DataFrame, versions: DataFrame, entities: DataFrame, query: str, limit: int = 10, revision: int | None = None) -> DataFrame:
    """rank, entity_id, score, name, and the entity's columns (id, ...): the best matches at a revision, ties by id, with version and entity."""
    best = search.top(search_names(postings, stats, query, revision), limit, F.round("score", 9).desc(), F.col("entity_id"))
    version = temporal.as_of(versions, revision).select("entity_id", "name")
    return best.join(version, "entity_id").join(entities.withColumnRenamed("id", "entity_id"), "entity_id")
