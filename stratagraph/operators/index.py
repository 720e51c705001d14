"""The retrieval index as tables: windows, postings, chunks and vectors of blobs, written once a blob; lexical, semantic and hybrid search over them.

Files of a snapshot are rows (snapshot_id, path, blob_hash); snapshots (repo, snapshot_id); contents (blob_hash, text).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import render
from ..functions import text as T
from . import layout, search, temporal

SNIPPET_LINES, IMPORT_LINES, BATCH, MOST_WORK = 21, 12, 32, 5000
TERM_BUCKETS = 64


# ---- inserts: nothing is indexed twice


def absent(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table does not have yet, each key once: INSERT OR IGNORE."""
    return rows.dropDuplicates(key).join(table.select(*key).distinct(), key, "left_anti")


def new_windows(contents: DataFrame, windows: DataFrame) -> DataFrame:
    """blob_hash, ordinal, start_line, body, split of contents that the windows table does not hold."""
    fresh = absent(contents.select("blob_hash", "text"), windows, ["blob_hash"])
    w = fresh.select("blob_hash", F.explode(T.windows(F.col("text"))).alias("w")).select("blob_hash", "w.*")
    return w.withColumn("split", T.split_text(F.col("body")))


def postings(windows: DataFrame) -> DataFrame:
    """term, blob_hash, ordinal, tf (weighted over both columns), length (terms of both) and bucket of every term of windows.

    Written by `bucket`, a query reads the files of its terms' buckets only. A window's terms are counted within its row (a window has one), so nothing is shuffled.
    """
    named = lambda c, kind: F.transform(T.terms(F.col(c)), lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))
    rows = windows.select("blob_hash", "ordinal", F.sort_array(F.concat(named("body", 0), named("split", 1))).alias("all")).withColumn("length", F.size("all"))

    def counted(places: Column) -> Column:  # where in the sorted terms each one begins -> the term and its weight
        def one(at: Column, i: Column) -> Column:
            n = F.coalesce(F.get(places, i + 1), F.col("length")) - at
            split = F.size(F.filter(F.slice("all", at + 1, n), lambda x: x["kind"] == 1))
            return F.struct(F.get("all", at)["term"].alias("term"), (search.BODY * (n - split) + search.SPLIT * split).alias("tf"))
        return F.transform(places, one)

    begins = F.filter(F.slice(F.sequence(F.lit(0), F.col("length")), 1, F.col("length")), lambda i: (i == 0) | (F.get("all", i)["term"] != F.get("all", i - 1)["term"]))
    found = rows.select("blob_hash", "ordinal", "length", F.explode(T.let(begins, counted)).alias("t")).select("t.term", "blob_hash", "ordinal", "t.tf", "length")
    return found.withColumn("bucket", term_bucket(F.col("term")))


def term_bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(TERM_BUCKETS)).cast("int")


def write_postings(posts: DataFrame, folder: str) -> None:
    """The postings in one folder a bucket. Each task keeps a file of every bucket open, so postings are neither sorted nor shuffled."""
    spark, writers = posts.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, TERM_BUCKETS)
    try:
        posts.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    finally:
        spark.conf.set(writers, before)


def window_stats(windows: DataFrame) -> DataFrame:
    """One row: n, average length of windows in terms. Kept beside the postings, so a query reads no text."""
    return windows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.terms(F.col("body"))) + F.size(T.terms(F.col("split")))).alias("average"))


def new_chunks(contents: DataFrame, declarations: DataFrame, locations: DataFrame, imports: DataFrame, chunks: DataFrame, repo: str) -> DataFrame:
    """blob_hash, ordinal, start_line, end_line, decl_key, context of contents that the chunks table does not hold.

    declarations: blob_hash, key, start, end; locations: path, blob_hash (the first path of a blob names it); imports: blob_hash, module (the least
    IMPORT_LINES of a blob).
    """
    fresh = absent(contents.select("blob_hash", "text"), chunks, ["blob_hash"])
    plan = layout.plan_chunks(fresh, declarations).withColumnsRenamed({"start": "start_line", "end": "end_line"})
    path = locations.groupBy("blob_hash").agg(F.min("path").alias("path"))
    used = imports.groupBy("blob_hash").agg(F.slice(F.array_sort(F.collect_set("module")), 1, IMPORT_LINES).alias("imports"))
    d = declarations.select("blob_hash", F.col("key").alias("decl_key"), F.col("start").alias("ds"), F.col("end").alias("de"))
    own = plan.select("blob_hash", "ordinal", "start_line", "end_line", F.col("decl_key").alias("own"))
    over = own.join(d, "blob_hash").where("ds <= start_line and end_line <= de and (own is null or decl_key <> own)")
    enclosing = over.groupBy("blob_hash", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("ds", "decl_key"))), lambda x: x["decl_key"]).alias("enclosing"))
    named = d.select("blob_hash", "decl_key").distinct().groupBy("blob_hash").agg(F.slice(F.array_sort(F.collect_set("decl_key")), 1, 9).alias("names"))
    rows = plan.join(path, "blob_hash", "left").join(used, "blob_hash", "left").join(enclosing, ["blob_hash", "ordinal"], "left").join(named, "blob_hash", "left")
    none = F.array().cast("array<string>")
    siblings = F.filter(F.coalesce("names", none), lambda x: ~x.eqNullSafe(F.col("decl_key")))
    context = render.context_prefix(F.lit(repo), F.coalesce("path", F.lit("")), F.coalesce("imports", none), F.coalesce("enclosing", none), siblings)
    return rows.select("blob_hash", "ordinal", "start_line", "end_line", "decl_key", context.alias("context"))


def chunk_bodies(chunks: DataFrame, contents: DataFrame) -> DataFrame:
    """chunks with body: their lines of the blob."""
    body = F.array_join(F.slice(T.lines(F.col("text")), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return chunks.join(contents.select("blob_hash", "text"), "blob_hash").withColumn("body", body).drop("text")


def work_list(chunks: DataFrame, vectors: DataFrame, model: str, most: int = MOST_WORK) -> DataFrame:
    """Chunks without a vector of the model, `most` of them at a time, with the batch of BATCH chunks that each is embedded in."""
    key = ["blob_hash", "ordinal"]
    rows = chunks.join(vectors.where(F.col("model") == model).select(*key), key, "left_anti").orderBy(*key).limit(most)
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*key)) - 1) / BATCH).cast("int"))  # `most` rows


def put_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """The vectors (blob_hash, ordinal, model, embedding) after INSERT OR REPLACE by chunk and model."""
    both = vectors.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return temporal.upsert_latest(both, ["blob_hash", "ordinal", "model"], F.col("_new")).drop("_new")


def encode_vector(vector: Column) -> Column:
    """32-bit little-endian floats, one after another."""
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes()), "binary")(vector)


def decode_vector(data: Column, dimension: int) -> Column:
    """The inverse; null where the length is not that of `dimension` floats."""
    def one(b: bytes | None) -> list[float] | None:
        return None if b is None or len(b) != 4 * dimension else np.frombuffer(b, "<f4").tolist()
    return F.pandas_udf(lambda s: s.map(one), "array<float>")(data)


# ---- reads


def current_files(files: DataFrame, snapshots: DataFrame, commits: DataFrame) -> DataFrame:
    """repo, path, blob_hash of the newest committed snapshot of each repository: a row a path, also where paths share a blob."""
    newest = temporal.latest_snapshot(snapshots.withColumnRenamed("repo", "repository_id"), commits).withColumnRenamed("repository_id", "repo")
    return files.join(newest, "snapshot_id").select("repo", "path", "blob_hash")


def blob_of_path(files: DataFrame, snapshots: DataFrame, commits: DataFrame) -> DataFrame:
    """repo, path, blob_hash: for every path that any committed snapshot has, the blob of the newest of those."""
    known = snapshots.join(commits.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    return files.join(known, "snapshot_id").groupBy("repo", "path").agg(F.max_by("blob_hash", "snapshot_id").alias("blob_hash"))


def counts(windows: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: blobs and windows indexed, chunks, vectors."""
    a = windows.agg(F.count_distinct("blob_hash").alias("blobs"), F.count(F.lit(1)).alias("windows"))
    return a.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(vectors.agg(F.count(F.lit(1)).alias("vectors")))  # one row each


def bm25(posts: DataFrame, stats: DataFrame, query: list[str]) -> DataFrame:
    """blob_hash, ordinal, score of the windows that hold a query term: only the postings of the terms are read."""
    terms = sorted({t.lower() for t in query})
    hits = posts.where(F.col("bucket").isin(sorted({_bucket(t) for t in terms})) & F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("length") / F.col("average")))
    return hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("blob_hash", "ordinal").agg(F.sum(part).alias("score"))  # stats is one row


def term_buckets(terms: list[str]) -> list[int]:
    """The buckets whose postings a query of these terms reads."""
    return sorted({_bucket(t.lower()) for t in terms})


def _bucket(term: str) -> int:
    import zlib

    return zlib.crc32(term.encode()) % TERM_BUCKETS


def lexical(windows: DataFrame, posts: DataFrame, stats: DataFrame, locations: DataFrame, query: list[str], limit: int = 10, repo: str | None = None, prefix: str | None = None) -> DataFrame:
    """rank, repo, path, line, score, snippet, resolution: current windows by BM25, three times the limit of them, the first matching line of each,
    once a repo, path and line. Statistics run over the whole index, the filters come after scoring."""
    where = F.lit(True) if repo is None else F.col("repo") == repo
    where = where if prefix is None else where & F.col("path").startswith(prefix)
    placed = bm25(posts, stats, query).join(locations.where(where), "blob_hash")
    best = search.top(placed, limit * 3, F.round("score", 9).desc(), F.col("repo"), F.col("path"), F.col("ordinal")).withColumnRenamed("rank", "_rank")
    hits = windows.select("blob_hash", "ordinal", "start_line", "body").join(F.broadcast(best), ["blob_hash", "ordinal"]).withColumn("_lines", T.lines(F.col("body"))).withColumn("_at", T.matching_line(F.col("_lines"), query)).where("_at is not null")
    hits = hits.select("repo", "path", (F.col("start_line") + F.col("_at") - 1).alias("line"), "score", T.snippet(F.col("_lines"), F.col("_at")).alias("snippet"), F.lit("lexical").alias("resolution"), "_rank")
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy("repo", "path", "line").orderBy("_rank"))).where("_n = 1")
    return search.top(once.drop("_n"), limit, F.col("_rank")).drop("_rank")


def semantic(vectors: DataFrame, chunks: DataFrame, locations: DataFrame, contents: DataFrame, model: str, query: list[float], limit: int = 10, repo: str | None = None) -> DataFrame:
    """rank, repo, path, line, score, snippet, resolution: chunks of current blobs by the dot product of stored vectors of one model with a query
    vector; a blob at several paths is cited by the first. Snippets have SNIPPET_LINES lines at most."""
    here = (locations if repo is None else locations.where(F.col("repo") == repo)).groupBy("blob_hash").agg(F.min_by(F.struct("repo", "path"), F.struct("path", "repo")).alias("at"))
    mine = vectors.where((F.col("model") == model) & (F.size("embedding") == len(query))).join(here, "blob_hash")
    scored = mine.select("blob_hash", "ordinal", "at", T.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    best = search.top(scored, limit, F.round("score", 9).desc(), F.col("blob_hash"), F.col("ordinal"))
    best = chunks.select("blob_hash", "ordinal", "start_line", "end_line").join(F.broadcast(best), ["blob_hash", "ordinal"])  # `limit` rows; texts stay where they are
    rows = contents.select("blob_hash", "text").join(F.broadcast(best), "blob_hash").dropDuplicates(["blob_hash", "ordinal"])
    length = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(SNIPPET_LINES))
    return rows.select("rank", "at.repo", "at.path", F.col("start_line").alias("line"), "score", F.array_join(F.slice(T.lines(F.col("text")), F.col("start_line"), length), "\n").alias("snippet"), F.lit("semantic").alias("resolution"))


def hybrid(lexical_hits: Callable[[int], DataFrame], semantic_hits: Callable[[int], DataFrame] | None, mode: str = "hybrid", limit: int = 10, prefix: str | None = None, boost: DataFrame | None = None) -> tuple[DataFrame, str, str | None]:
    """(hits, mode used, note): lexical, semantic or both lists fused, each asked for twice the limit. Without an embedder (semantic_hits None) the
    lexical list answers and the note says so. boost: path, boost (added to a finding's fused score)."""
    if mode == "lexical" or semantic_hits is None:
        note = None if mode == "lexical" else "no embedding model installed: semantic search is not available, ran lexical only"
        return lexical_hits(limit), "lexical", note
    if mode == "semantic":
        return semantic_hits(limit * 2).where(F.col("rank") <= limit), "semantic", None
    near = semantic_hits(limit * 2)
    near = near if prefix is None else near.where(F.col("path").startswith(prefix))
    cols = [F.concat_ws(":", "repo", "path").alias("at"), "path", "rank", "line", "resolution"]
    lists = lexical_hits(limit * 2).select(F.lit(1).alias("list"), *cols).unionByName(near.select(F.lit(2).alias("list"), *cols))
    if boost is not None:
        lists = lists.join(boost, "path", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    fused = search.fuse(lists.drop("path").withColumnRenamed("at", "path"), limit, F.col("boost") if boost is not None else None)
    return fused.withColumnRenamed("path", "at"), "hybrid", None


def embedded(chunks: DataFrame, embed: Callable[[Column], Column], model: str) -> DataFrame:
    """Vectors (blob_hash, ordinal, model, embedding) of chunks (with context and body) by an embedder, which is a column function."""
    return chunks.select("blob_hash", "ordinal", F.lit(model).alias("model"), embed(F.concat("context", "body")).alias("embedding"))


def hashed_words(text: Column) -> Column:
    """The embedder of tests, in numpy: a 256-d bag of lower-cased words by FNV-1a, at length 1. Words are hashed once a batch."""
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for words in texts.fillna("").str.lower().str.findall(r"[^\W_]+"):
            v = np.zeros(256, np.float32)
            for w in words:
                if w not in known:
                    h = 0xCBF29CE484222325
                    for b in w.encode():
                        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
                    known[w] = h % 256
                v[known[w]] += 1
            out.append(v / (np.linalg.norm(v) or 1))
        return pd.Series(out)

    return F.pandas_udf(run, "array<float>")(text)
