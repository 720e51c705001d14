"""Lexical, name and vector search, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

K1, B = 1.2, 0.75
BODY, SPLIT = 1.0, 0.4
RRF = 60.0


def bm25(docs: DataFrame, key: list[str], query: list[str], body: str = "body", split: str | None = "split") -> DataFrame:
    """key columns and score of the docs that hold a query term, over two weighted columns.

    idf and the mean length run over all docs given; only rows with a term are aggregated, and no posting list is shuffled:
    counts of the query's terms are taken row by row. For many queries over the same texts, index.bm25 reads postings instead.
    """
    wanted = sorted({t.lower() for t in query})
    b, s = T.terms(F.col(body)), T.terms(F.col(split)) if split else F.array().cast("array<string>")
    def tf(t: str) -> Column:
        return BODY * F.size(F.filter("_b", lambda x: x == t)) + SPLIT * F.size(F.filter("_s", lambda x: x == t))
    counted = docs.select(*key, b.alias("_b"), s.alias("_s")).select(*key, (F.size("_b") + F.size("_s")).alias("_len"), *[tf(t).alias(f"_tf{i}") for i, t in enumerate(wanted)])
    counted = graph.settled(counted)  # a few numbers a row, instead of tokenising twice
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))])
    hit = F.lit(False)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        hit = hit | (F.col(f"_tf{i}") > 0)
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return counted.where(hit).join(F.broadcast(stats)).select(*key, score.alias("score"))  # stats is one row


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows, with their rank from 1."""
    first = rows.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def lexical_search(windows: DataFrame, query: list[str], limit: int = 10) -> DataFrame:
    """rank, path, line, score, snippet: windows (path, ordinal, start_line, body) by BM25, over-fetched three times, the first
    matching line of each, one hit a path and line."""
    scored = bm25(windows.withColumn("split", T.split_text(F.col("body"))), ["path", "ordinal"], query)
    best = top(scored, limit * 3, F.round("score", 9).desc(), F.col("path"), F.col("ordinal")).withColumnRenamed("rank", "_rank")
    ls = T.lines(F.col("body"))
    hits = best.join(windows, ["path", "ordinal"]).withColumn("_lines", ls).withColumn("_at", T.matching_line(F.col("_lines"), query)).where("_at is not null")
    hits = hits.select("path", (F.col("start_line") + F.col("_at") - 1).alias("line"), "score", T.snippet(F.col("_lines"), F.col("_at")).alias("snippet"), "_rank")
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy("path", "line").orderBy("_rank"))).where("_n = 1")
    return top(once.drop("_n"), limit, F.col("_rank")).drop("_rank")


def name_search(entities: DataFrame, query: str, limit: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """Entities (key, name, kind, decl_path) whose name has a token for every query term as a prefix; exact names first, then exact
    tails of the declaration path, then the shorter name and key."""
    parts = [p.lower() for p in query.replace('"', "").split()]
    tokens = T.terms(F.col("name"))
    match = F.lit(True)
    def has_prefix(p: str) -> Column:
        return F.exists(tokens, lambda t: t.startswith(p))
    for p in parts:
        match = match & has_prefix(p)
    rows = entities.where(match) if kinds is None else entities.where(match & F.col("kind").isin(kinds))
    tier = F.when(F.lower("name") == query.lower(), 0).when(F.lower(F.element_at(F.split("decl_path", r"\."), -1)) == query.lower(), 1).otherwise(2)
    return top(rows.withColumn("tier", tier), limit, F.col("tier"), F.length("name"), F.col("key"))


def vector_top(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, score, rank: the k greatest dot products with a query vector (cosine of normalised ones); ties by key. Exact, one scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(vectors.select(key, T.dot(F.col(column), q).alias("score")), k, F.round("score", 9).desc(), F.col(key))


def fuse(lists: DataFrame, limit: int, boost: Column | None = None, bucket: int = T.WINDOW_LINES) -> DataFrame:
    """Reciprocal rank fusion of lists (list, rank, path, line, resolution, boost columns): path, bucket, score, line, resolution.

    Hits in one window of a path are one finding, kept with its strongest evidence.
    """
    strength = F.array_position(F.array(*map(F.lit, ("compiler", "syntactic", "lexical", "semantic"))), F.col("resolution"))
    keyed = lists.withColumn("bucket", F.floor((F.col("line") - 1) / bucket))
    best = F.min_by(F.struct("line", "resolution"), F.struct(strength, "list", "rank"))
    fused = keyed.groupBy("path", "bucket").agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"), best.alias("b"), *([F.max(boost).alias("boost")] if boost is not None else []))
    score = F.col("score") + (F.col("boost") if boost is not None else 0)
    return top(fused.select("path", "bucket", score.alias("score"), "b.line", "b.resolution"), limit, F.round("score", 12).desc(), F.col("path"), F.col("line"))


def adjacency_boost(edges: DataFrame, focus: DataFrame, ranks: DataFrame, near: float = 0.010, central: float = 0.005) -> DataFrame:
    """path, boost: `near` for files next to a focus file (or in focus), and `central` times the rank over the greatest rank."""
    around = edges.join(focus.select(F.col("path").alias("src")), "src").select(F.col("dst").alias("path")).unionByName(edges.join(focus.select(F.col("path").alias("dst")), "dst").select(F.col("src").alias("path"))).unionByName(focus.select("path")).distinct().withColumn("n", F.lit(near))
    most = F.broadcast(ranks.agg(F.max("rank").alias("most")))  # one row
    return ranks.join(most).join(around, "path", "left").select("path", (F.coalesce("n", F.lit(0.0)) + central * F.col("rank") / F.col("most")).alias("boost"))
