"""A trained embedder of texts: term vectors by random indexing, texts as weighted sums of them.

Each context (a chunk) has a sparse seeded sign vector, drawn from the MD5 of its key. A term's vector is the sum of the sign vectors of the contexts that hold it,
so terms that share contexts point the same way; reflections do the same with what the contexts' terms say. Terms are hashed into BUCKETS buckets: a model has at most that many rows of DIMENSIONS small integers
whatever the corpus is, which bounds what is broadcast (some 4 MB) and what a map task sends while training. All sums are of integers, so a model and a text's
vector are the same however the rows were split, and after a lost executor.

Nulls count as empty texts; a text without known terms has the zero vector; repeated rows of a context count once a term.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

BUCKETS, DIMENSIONS, SIGNS, SCALE = 1 << 16, 64, 8, 127
MODEL = "bucket int, weight int, vector array<tinyint>"


def bucket(term: Column) -> Column:
    """The first 16 bits of a term's MD5."""
    return F.conv(F.substring(F.md5(term), 1, 4), 16, 10).cast("int")


def _buckets(text: Column) -> Column:
    return F.transform(T.terms(F.coalesce(text, F.lit(""))), bucket)


def signs(key: Column) -> Column:
    """array<int> of SIGNS entries of a context's vector: 1 + dimension, negative where the sign is. Each takes 12 bits of the key's MD5; entries may meet."""
    def entry(i: Column) -> Column:
        return T.let(F.conv(F.substr(F.md5(key), i * 3 + 1, F.lit(3)), 16, 10).cast("int"), lambda n: F.when(F.floor(n / DIMENSIONS) % 2 == 0, n % DIMENSIONS + 1).otherwise(-(n % DIMENSIONS) - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(SIGNS - 1)), entry)


def train(contexts: DataFrame, reflections: int = 1) -> DataFrame:
    """The model (bucket, weight, vector) of contexts (key, text). weight: 16 times the root of contexts per context with the term, rounded down; vector: the
    term's sum at length SCALE, rounded. Buckets whose sum is zero are left out.

    A reflection makes contexts the weighted sums of their terms' vectors and terms the sums of their contexts again: terms that never meet come near if they
    meet the same ones. One shuffle brings the terms of a context together (each once, 4 bytes), which are kept in the shared folder for the readings that follow; others sum at
    most BUCKETS rows of DIMENSIONS numbers a map task.
    """
    rows = contexts.select(F.col("key").cast("string").alias("key"), F.explode_outer(F.transform(F.array_distinct(T.terms(F.coalesce("text", F.lit("")))), bucket)).alias("bucket"))
    kept = graph.settled(rows.groupBy("key").agg(F.collect_set("bucket").alias("buckets")))  # texts are cut once; BUCKETS numbers a context at most
    n = kept.agg(F.count(F.lit(1)).alias("n"))
    model = _at_length(_gathered(kept.select("buckets", signs(F.col("key")).alias("s")).where("s is not null"), _signed), ["bucket"])
    weight = F.floor(16 * F.sqrt(F.col("n") / F.col("rows"))).cast("int").alias("weight")
    model = graph.settled(model.join(F.broadcast(n)).select("bucket", weight, "vector"))  # n is one row; a reflection reads the model twice
    for _ in range(reflections):
        again = _at_length(_gathered(kept.where("key is not null").select("buckets"), _saying(_sent(model))), ["bucket"]).drop("rows")
        model = graph.settled(again.join(F.broadcast(model.select("bucket", "weight")), "bucket").select("bucket", "weight", "vector"))
    return model


def _signed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for s in batch.column("s").to_pylist():
        v, at = np.zeros(DIMENSIONS, np.int64), np.asarray(s)
        np.add.at(v, np.abs(at) - 1, np.sign(at))
        yield v


def _saying(sent: Broadcast) -> Callable[[pa.RecordBatch], Iterator[np.ndarray | None]]:
    """What contexts' terms say at length SCALE, rounded; None where it is nothing."""
    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
        for found in batch.column("buckets"):
            v = sent.value[found.values.to_numpy()].sum(0, dtype=np.int64)
            norm = np.sqrt(float((v * v).sum()))
            yield np.floor(v * SCALE / norm + 0.5).astype(np.int64) if norm > 0 else None
    return of


def _gathered(rows: DataFrame, vectors: Callable[[pa.RecordBatch], Iterator[np.ndarray | None]]) -> DataFrame:
    """bucket, rows, v: for each bucket the number and the sum of the vectors of rows (buckets, each once). A task sums in a table of BUCKETS rows."""
    dims = [f"d{d}" for d in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = np.zeros((BUCKETS, DIMENSIONS), np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for found, v in zip(batch.column("buckets"), vectors(batch), strict=True):
                if v is not None:
                    at = found.values.to_numpy()
                    table[at] += v
                    rows[at] += 1
        for at in np.array_split(np.flatnonzero(rows), 16):
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(rows[at]), *(pa.array(np.ascontiguousarray(table[at, d])) for d in range(DIMENSIONS))], ["bucket", "rows", *dims])

    sums = rows.mapInArrow(run, f"bucket int, rows long, {', '.join(f'{d} long' for d in dims)}")
    return sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["rows", *dims]]).select("bucket", "rows", F.array(*dims).alias("v"))


def _at_length(sums: DataFrame, key: list[str]) -> DataFrame:
    sized = sums.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x))).where("norm > 0")
    return sized.select(*key, "rows", F.transform("v", lambda x: F.floor(x * SCALE / F.col("norm") + 0.5).cast("tinyint")).alias("vector"))


def embed(texts: DataFrame, model: DataFrame, key: list[str]) -> DataFrame:
    """key and embedding (array<float>, length 1 or zero) of texts (key, text), inside the JVM. The model is broadcast, as it has BUCKETS rows at most; what is
    shuffled is a row of sums for each text and map task."""
    known = model.select("bucket", *[(F.get("vector", F.lit(d)) * F.col("weight").cast("bigint")).alias(f"d{d}") for d in range(DIMENSIONS)])
    terms = texts.select(*key, F.explode_outer(_buckets(F.col("text"))).alias("bucket"))
    sums = terms.join(F.broadcast(known), "bucket", "left").groupBy(*key).agg(*[F.coalesce(F.sum(f"d{d}"), F.lit(0)).alias(f"d{d}") for d in range(DIMENSIONS)])
    v = F.array(*[F.col(f"d{d}") for d in range(DIMENSIONS)])
    return sums.select(*key, T.let(v, _unit).alias("embedding"))


def _unit(v: Column) -> Column:
    return T.let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x)), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float")))


def identity(model: DataFrame, name: str = "terms") -> str:
    """name@revision of a model, its revision a digest of all its rows: vectors of different models are never compared."""
    line = F.concat_ws(" ", "bucket", "weight", F.array_join(F.col("vector").cast("array<string>"), ","))
    rows = model.select("bucket", line.alias("line")).agg(F.sort_array(F.collect_list(F.struct("bucket", "line"))).alias("r"))  # BUCKETS rows at most
    digest = rows.select(F.sha2(F.array_join(F.transform("r", lambda x: x["line"]), "\n"), 256)).first()[0]
    return f"{name}@{digest[:12]}"


def _sent(model: DataFrame) -> Broadcast:
    """The model as a table of BUCKETS rows, vectors times weights."""
    held = model.select("bucket", "weight", "vector").toPandas()
    table = np.zeros((BUCKETS, DIMENSIONS), np.int32)
    if len(held):
        table[held["bucket"].to_numpy()] = np.stack(held["vector"].to_numpy()).astype(np.int32) * held["weight"].to_numpy()[:, None]
    return model.sparkSession.sparkContext.broadcast(table)


def column(model: DataFrame) -> Callable[[Column], Column]:
    """The embedder as a column function, which gives what embed() gives. The model (BUCKETS rows at most) is held by the driver and sent to each
    executor once; a worker unpacks it once for all batches of its task. Terms are cut and hashed in the JVM."""
    sent = _sent(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = sent.value
        for batch in batches:
            out = []
            for found in batch:
                ids, times = np.unique(np.asarray(found, np.int64), return_counts=True)
                v = (rows[ids].astype(np.int64) * times[:, None]).sum(0)
                norm = np.sqrt((v.astype(float) ** 2).sum())
                out.append((v / norm if norm > 0 else v).astype(np.float32))
            yield pd.Series(out)

    of = F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)
    return lambda text: of(_buckets(text))


def revision(rows: list[tuple[int, int, list[int]]]) -> str:
    """The digest that identity() takes, of rows at hand."""
    return hashlib.sha256("\n".join(f"{b} {w} {','.join(map(str, v))}" for b, w, v in sorted(rows)).encode()).hexdigest()[:12]
