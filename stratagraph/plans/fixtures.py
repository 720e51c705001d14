"""The relational test tables seen as a knowledge graph. Each view here has the same name and columns in FIXTURE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tasks(self, name: str, rows: int = 500_000) -> int | None:
        """Tasks to deal a table's rows to, so that one's memory does not grow with the table: one for so many rows; None, the session's, if there are cores enough."""
        n = -(-getattr(self, name).count() // rows)
        return n if n > self.spark.sparkContext.defaultParallelism else None


def _month(c: str):
    return ((F.year(c) - 1992) * 12 + F.month(c)).cast("long")


def rel(t: Tables) -> DataFrame:
    """Interval-versioned edges: an order is an edge from its customer to the next customer of its month."""
    ends = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"), F.max((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")).alias("is_open"))
    kind = F.element_at(F.array(*map(F.lit, ("imports", "references", "refersToSymbol", "builds", "declares"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    o = t.orders.withColumn("m", _month("o_orderdate"))
    o = o.withColumn("target_id", F.lead("o_custkey").over(Window.partitionBy("m").orderBy("o_orderdate", "o_orderkey")))
    j = o.join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left").where("target_id is not null")
    return j.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.col("o_custkey").alias("source_id"), "target_id", F.when(F.col("o_orderstatus") == "F", "observed").when(F.col("o_orderstatus") == "O", "derived").otherwise("inferred").alias("layer"), F.col("m").alias("valid_from"), F.when(~F.coalesce("is_open", F.lit(True)), F.greatest(_month("s"), F.col("m") + 1)).alias("valid_to"), (F.col("o_orderkey") % 7 + 1).alias("weight"))


def ver(t: Tables) -> DataFrame:
    """Entity versions: an order opens a new version of its customer; the next one closes it."""
    o = t.orders.withColumn("m", _month("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("entity_id"), F.col("m").alias("valid_from"), F.lead("m").over(w).alias("valid_to"), F.col("o_orderpriority").alias("name"))


def refs(t: Tables) -> DataFrame:
    """Directed references between customers: src, dst, references, calls."""
    r = rel(t).join(t.orders.select("o_orderkey", "o_orderstatus"), F.col("id") == F.col("o_orderkey"))
    return r.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("o_orderstatus") == "F").alias("calls"))


def imports(t: Tables) -> DataFrame:
    """File (customer) imports module (brand): path, module, observation_id."""
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    path = F.concat(F.lit("r"), F.col("c_nationkey") % 5, F.lit("/n"), F.col("c_nationkey"), F.lit("/f"), F.col("c_custkey"))
    return j.groupBy(path.alias("path"), F.col("p_brand").alias("module")).agg(F.min(F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("observation_id"))


def files(t: Tables) -> DataFrame:
    """Documents as blobs of a snapshot: path, blob_hash, size, text."""
    return t.documents.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md"))).alias("path"), F.sha2("text", 256).alias("blob_hash"), F.octet_length("text").cast("long").alias("size"), "text")


def touches(t: Tables) -> DataFrame:
    """Commits: part = file, nation of the supplier = person."""
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.concat(F.lit("p"), "l_partkey").alias("path"), F.concat(F.lit("n"), "s_nationkey").alias("person"), F.col("s_name").alias("name"), F.col("l_shipdate").alias("at"))


def symbols(t: Tables) -> DataFrame:
    """Customers as entities: node, key, kind, name, repo, path, line."""
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "type").when(F.col("c_mktsegment") == "BUILDING", "function").when(F.col("c_mktsegment") == "HOUSEHOLD", "interface").when(F.col("c_mktsegment") == "MACHINERY", "file").otherwise("variable")
    repo = F.concat(F.lit("r"), F.col("c_nationkey") % 5)
    path = F.concat(F.lit("src/n"), "c_nationkey", F.lit("/f"), F.col("c_custkey") % 40, F.lit(".swift"))
    return t.customer.select(F.col("c_custkey").alias("node"), F.concat(F.lit("swift:decl:"), repo, F.lit("/"), path, F.lit("#"), "c_name").alias("key"), kind.alias("kind"), F.col("c_name").alias("name"), repo.alias("repo"), path.alias("path"), (F.col("c_custkey") * 7 % 400 + 1).cast("int").alias("line"))


def symbol_edges(t: Tables) -> DataFrame:
    """Current edges between them: id, kind, src, dst, refs, calls."""
    return rel(t).where("valid_to is null").select("id", "kind", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("weight").alias("refs"), (F.col("weight") % 3).alias("calls"))


_M = "((year({0}) - 1992) * 12 + month({0}))"

FIXTURE_SQL = {
    "rel": f"""rel AS (SELECT o_orderkey AS id, ['imports','references','refersToSymbol','builds','declares'][CAST(substr(o_orderpriority,1,1) AS INT)] AS kind,
  o_custkey AS source_id, target_id, CASE o_orderstatus WHEN 'F' THEN 'observed' WHEN 'O' THEN 'derived' ELSE 'inferred' END AS layer, m AS valid_from,
  CASE WHEN NOT coalesce(is_open, true) THEN greatest({_M.format('s')}, m + 1) END AS valid_to, o_orderkey % 7 + 1 AS weight
  FROM (SELECT *, {_M.format('o_orderdate')} AS m, lead(o_custkey) OVER (PARTITION BY {_M.format('o_orderdate')} ORDER BY o_orderdate, o_orderkey) AS target_id FROM orders) o
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS s, bool_or(l_linestatus = 'O' AND l_returnflag = 'N') AS is_open FROM lineitem GROUP BY l_orderkey) e ON o_orderkey = l_orderkey WHERE target_id IS NOT NULL)""",
    "ver": f"""ver AS (SELECT o_orderkey AS version_id, o_custkey AS entity_id, {_M.format('o_orderdate')} AS valid_from,
  lead({_M.format('o_orderdate')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, o_orderpriority AS name FROM orders)""",
    "refs": "refs AS (SELECT source_id AS src, target_id AS dst, count(*) AS refs, count(*) FILTER (o_orderstatus = 'F') AS calls FROM rel JOIN orders ON id = o_orderkey GROUP BY 1, 2)",
    "imports": """imports AS (SELECT 'r' || (c_nationkey % 5) || '/n' || c_nationkey || '/f' || c_custkey AS path, p_brand AS module, min(o_orderkey * 10 + l_linenumber) AS observation_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
    "files": "files AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.md' AS path, sha256(text) AS blob_hash, CAST(strlen(text) AS BIGINT) AS size, text FROM documents)",
    "touches": "touches AS (SELECT 'p' || l_partkey AS path, 'n' || s_nationkey AS person, s_name AS name, l_shipdate AS seen FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
    "symbols": """symbols AS (SELECT c_custkey AS node, 'swift:decl:' || repo || '/' || path || '#' || c_name AS key, kind, c_name AS name, repo, path, CAST(c_custkey * 7 % 400 + 1 AS INT) AS line
  FROM (SELECT *, 'r' || (c_nationkey % 5) AS repo, 'src/n' || c_nationkey || '/f' || (c_custkey % 40) || '.swift' AS path,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'type' WHEN 'BUILDING' THEN 'function' WHEN 'HOUSEHOLD' THEN 'interface' WHEN 'MACHINERY' THEN 'file' ELSE 'variable' END AS kind FROM customer))""",
    "symbol_edges": "symbol_edges AS (SELECT id, kind, source_id AS src, target_id AS dst, weight AS refs, weight % 3 AS calls FROM rel WHERE valid_to IS NULL)",
}


def with_(*names: str, recursive: bool = False) -> str:
    """The WITH clause of some fixture views, in their order."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(FIXTURE_SQL[n] for n in names)
