"""Registered queries of the trained embedder: its model, and search by meaning from texts to hits in one path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import embedding, graph, index
from .fixtures import Tables, files, with_
from .queries import query


def _scaled_sql(src: str, key: str) -> str:
    return f"SELECT {key}, d, CAST(floor(127 * v / norm + 0.5) AS BIGINT) AS q FROM (SELECT *, sqrt(CAST(sum(v * v) OVER (PARTITION BY {key}) AS DOUBLE)) AS norm FROM {src}) WHERE norm > 0"


def _terms_sql(text: str) -> str:
    return rf"unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_$]+'))"


#: Contexts `c` (key, text) to the model `m1` (bucket, d, q) with weights `wt`.
_MODEL = rf"""held AS (SELECT DISTINCT key, CAST('0x' || substr(md5(term), 1, 4) AS INT) AS bucket FROM (SELECT key, {_terms_sql('text')} AS term FROM c)),
sg AS (SELECT key, CAST('0x' || substr(md5(key), CAST(3 * i + 1 AS INT), 3) AS INT) AS x FROM (SELECT key, unnest(range(8)) AS i FROM (SELECT DISTINCT key FROM c))),
s0 AS (SELECT bucket, x % 64 AS d, sum(CASE WHEN x // 64 % 2 = 0 THEN 1 ELSE -1 END) AS v FROM held JOIN sg USING (key) GROUP BY 1, 2), m0 AS ({_scaled_sql('s0', 'bucket')}),
wt AS (SELECT bucket, CAST(floor(16 * sqrt((SELECT count(DISTINCT key) FROM c) / count(*))) AS INT) AS weight FROM held GROUP BY bucket),
c1 AS (SELECT key, d, sum(q * weight) AS v FROM held JOIN m0 USING (bucket) JOIN wt USING (bucket) GROUP BY 1, 2), k1 AS ({_scaled_sql('c1', 'key')}),
r1 AS (SELECT bucket, d, sum(q) AS v FROM held JOIN k1 USING (key) WHERE bucket IN (SELECT bucket FROM m0) GROUP BY 1, 2), m1 AS ({_scaled_sql('r1', 'bucket')})"""


@query(f"WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS key, text FROM documents), {_MODEL} SELECT bucket, weight, string_agg(d || ':' || q, ' ' ORDER BY d) FILTER (q <> 0) AS vector FROM m1 JOIN wt USING (bucket) GROUP BY bucket, weight")
def embedding_model(t: Tables) -> DataFrame:
    """The model that documents train, a row a bucket of terms, its vector without zeros."""
    model = embedding.train(t.documents.select(F.col("doc_id").alias("key"), "text"))
    shown = F.array_join(F.transform("vector", lambda x, i: F.when(x != 0, F.concat(i, F.lit(":"), x))), " ")
    return model.select("bucket", "weight", shown.alias("vector"))


_ASKED = "ershan thble onrean"


def _chunks(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with body, contents, locations) of all documents as files without declarations."""
    f = files(t)
    contents = f.select("blob_hash", "text").dropDuplicates(["blob_hash"])
    none = lambda schema: t.spark.createDataFrame([], schema)
    chunks = index.new_chunks(contents, none("blob_hash string, key string, start int, end int"), f.select("path", "blob_hash"), none("blob_hash string, module string"), none("blob_hash string"), "r")
    return index.chunk_bodies(chunks, contents), contents, f.select(F.lit("r").alias("repo"), "path", "blob_hash")


@query(rf"""{with_('files')}, ls AS (SELECT blob_hash, min(path) AS path, any_value(CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END) AS ls FROM files WHERE text <> '' GROUP BY blob_hash),
ch AS (SELECT blob_hash, path, i AS ordinal, 'repo: r | file: ' || path || chr(10) || '---' || chr(10) || array_to_string(list_transform(list_slice(ls, i * 60 + 1, i * 60 + 60), lambda x: regexp_replace(x, '\r$', '')), chr(10)) AS text FROM (SELECT *, unnest(range(CAST(ceil(len(ls) / 60) AS BIGINT))) AS i FROM ls)),
c AS (SELECT blob_hash || ':' || ordinal AS key, text FROM ch), {_MODEL},
every AS (SELECT blob_hash, ordinal, text FROM ch UNION ALL SELECT '', -1, '{_ASKED}'),
raw AS (SELECT blob_hash, ordinal, d, sum(q * weight) AS v FROM (SELECT blob_hash, ordinal, CAST('0x' || substr(md5(term), 1, 4) AS INT) AS bucket FROM (SELECT blob_hash, ordinal, {_terms_sql('text')} AS term FROM every)) JOIN m1 USING (bucket) JOIN wt USING (bucket) GROUP BY 1, 2, 3),
unit AS (SELECT blob_hash, ordinal, d, CAST(CAST(CAST(v AS DOUBLE) / norm AS FLOAT) AS DOUBLE) AS u FROM (SELECT *, sqrt(sum(CAST(v AS DOUBLE) * v) OVER (PARTITION BY blob_hash, ordinal)) AS norm FROM raw) WHERE norm > 0),
sc AS (SELECT e.blob_hash, e.ordinal, sum(e.u * a.u) AS s FROM unit e JOIN unit a ON e.d = a.d AND a.ordinal = -1 WHERE e.ordinal >= 0 GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY round(s, 9) DESC, blob_hash, ordinal) AS INT) AS rank, path, CAST(ordinal * 60 + 1 AS INT) AS line, round(s, 6) AS score FROM sc JOIN ch USING (blob_hash, ordinal) ORDER BY rank LIMIT 12""")
def trained_search(t: Tables) -> DataFrame:
    """Chunks of all documents, the model that they train, their vectors, and the hits of a question that the same model embeds."""
    chunks, contents, locations = _chunks(t)
    chunks = graph.settled(chunks.withColumn("text", F.concat("context", "body")))
    model = embedding.train(chunks.select(F.concat_ws(":", "blob_hash", "ordinal").alias("key"), "text"))
    name = embedding.identity(model)
    vectors = chunks.select("blob_hash", "ordinal", embedding.column(model)(F.col("text")).alias("embedding"), F.lit(name).alias("model"))
    asked = embedding.embed(t.spark.range(1).select("id", F.lit(_ASKED).alias("text")), model, ["id"]).first()["embedding"]
    hits = index.semantic(vectors, chunks, locations, contents, name, list(asked), 12)
    return hits.select("rank", "path", "line", F.round("score", 6).alias("score"))
