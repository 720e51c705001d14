"""Queries over stored tables and scoped re-derivation: what a commit of deltas and a derivation of dirty paths leave equals a full one."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import derive, graph, incremental, names, store, temporal, trend
from ..operators.versioned import Change, VersionedTables
from ..streaming import builds
from .fixtures import Tables, imports, rel, ver, with_
from .queries import ORACLE, query


_made: list[VersionedTables] = []


def _tables(t: Tables) -> VersionedTables:
    _made.append(VersionedTables(t.spark, f"{graph.shared_folder(t.spark)}/stores/{uuid.uuid4().hex}", store.STORED))
    return _made[-1]


@atexit.register
def _drop_made() -> None:
    """Delete the stores of this process's queries."""
    for tables in _made:
        try:
            tables.delete("")
        except Exception:  # the session is gone already; a cluster's own clean-up takes the folder
            return


@query(ORACLE["scd2_commit"])
def stored_versions(t: Tables) -> DataFrame:
    """Entity versions in a stored table, compacted, then one commit of asserted and retracted entities: only its deltas are written."""
    tables = _tables(t)
    tables.commit(tables.head(), {"versions": Change(ver(t).select("entity_id", F.col("name").alias("state"), "valid_from", "valid_to"))}, 199)
    at = tables.compact("versions")
    current = tables.current("versions", at=at)
    known = current.select(F.col("entity_id").alias("c"), "state")
    asserted = t.customer.where("c_custkey % 2 = 0").join(known, F.col("c_custkey") == F.col("c"), "left").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 3 == 0, F.coalesce("state", F.lit("x"))).otherwise(F.col("c_mktsegment")).alias("state"))
    gone = t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("entity_id"))
    tables.commit(at, {"versions": Change(*temporal.entity_changes(current, asserted, gone, 200))})
    return tables.rows("versions")


@query(ORACLE["edge_commit"])
def stored_edges(t: Tables) -> DataFrame:
    """Edges in a stored table, compacted, then one commit that asserts, retracts, and closes the edges of retracted entities."""
    tables = _tables(t)
    tables.commit(tables.head(), {"edges": Change(rel(t).withColumn("properties", F.col("weight").cast("string")))}, 199)
    at = tables.compact("edges")
    e = tables.rows("edges", at=at)
    back = e.where("id % 4 = 0").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "kind", "layer", "properties")
    asserted = back.unionByName(e.where("id % 4 = 1").select("source_id", "target_id", "kind", "layer", "properties"))
    gone = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("entity_id"))
    tables.commit(at, {"edges": Change(*temporal.edge_changes(tables.current("edges", at=at), asserted, e.where("id % 11 = 0"), gone, 200))})
    return tables.rows("edges").select("source_id", "target_id", "kind", "valid_from", "valid_to")


@query(f"""{with_('rel')} SELECT source_id, target_id, kind, valid_from, CASE WHEN valid_to <= 72 THEN valid_to END AS valid_to FROM rel WHERE valid_from <= 72""")
def stored_as_it_was(t: Tables) -> DataFrame:
    """The edge table as it stood after a revision, although later commits are in the store."""
    tables = _tables(t)
    e = rel(t).withColumn("properties", F.col("weight").cast("string"))
    opened = e.withColumn("valid_to", F.when(F.col("valid_to") <= 60, F.col("valid_to")))
    at = tables.commit(tables.head(), {"edges": Change(opened.where("valid_from <= 60"))}, 60)
    closed = e.where("valid_from <= 60 and valid_to > 60").select("id", "valid_from", "valid_to")
    tables.commit(at, {"edges": Change(e.where("valid_from > 60"), closed)}, 200)
    return tables.as_it_was("edges", 72).select("source_id", "target_id", "kind", "valid_from", "valid_to")


_EDITED = f"""{with_('imports')}, edited AS (SELECT * FROM imports WHERE CAST(regexp_extract(path, '[0-9]+$') AS BIGINT) % 10 <> 0 OR (CAST(regexp_extract(path, '[0-9]+$') AS BIGINT) % 20 <> 0 AND observation_id % 3 <> 0)),
up AS (SELECT 0 AS old, path, module, list_aggregate(list_slice(string_split(path, '/'), 1, n), 'string_agg', '/') AS d FROM imports, range(0, 3) r(n)
       UNION ALL SELECT 1, path, module, list_aggregate(list_slice(string_split(path, '/'), 1, n), 'string_agg', '/') FROM edited, range(0, 3) r(n)),
f AS (SELECT old, 'dependsOn|q|' || coalesce(d, '') || '|' || module AS stable_key, CAST(count(DISTINCT path) AS VARCHAR) AS state FROM up GROUP BY old, stable_key)
"""


@query(_EDITED + """SELECT coalesce(a.stable_key, b.stable_key) AS stable_key, a.state AS old_state, b.state AS state
FROM (SELECT * FROM f WHERE old = 0) a FULL JOIN (SELECT * FROM f WHERE old = 1) b ON a.stable_key = b.stable_key WHERE a.state IS DISTINCT FROM b.state""")
def scoped_rollup(t: Tables) -> DataFrame:
    """The facts that move when a tenth of the files changes: half of those files go, the others lose a third of their imports. Only dirty paths are derived
    again; the SQL derives everything before and after."""
    i = imports(t)
    number = F.regexp_extract("path", r"([0-9]+)$", 1).cast("long")
    dirty = i.where(number % 10 == 0)
    edited = dirty.where((number % 20 != 0) & (F.col("observation_id") % 3 != 0))
    now = incremental.facts(incremental.import_supports(i, "q"))
    moved = incremental.support_changes(incremental.import_supports(dirty, "q"), incremental.import_supports(edited, "q"))
    return incremental.fact_changes(moved, now, now).where("not (state <=> old_state)").select("stable_key", "old_state", "state")


@query(f"""WITH b AS (SELECT DISTINCT 'mk' || (o_custkey % 300) || '/Makefile' AS path, 'f' || (o_orderkey * 7) % 400 || '.c' AS dependency FROM orders),
d AS (SELECT DISTINCT 'mk' || (s_suppkey % 300) || '/f' || (s_suppkey * 3) % 400 || '.c' AS path FROM supplier UNION SELECT DISTINCT 'f' || (s_suppkey * 5) % 400 || '.c' FROM supplier WHERE s_suppkey % 2 = 0)
SELECT path FROM d UNION SELECT b.path FROM b JOIN d ON d.path = replace(b.path, 'Makefile', '') || b.dependency OR d.path = b.dependency""")
def dirty_paths(t: Tables) -> DataFrame:
    """Changed files, and the build files whose dependencies they are, beside them or from the root."""
    o = t.orders
    build = o.select(F.concat(F.lit("mk"), F.col("o_custkey") % 300, F.lit("/Makefile")).alias("path"), F.lit("make").alias("tool"), F.lit("all").alias("target"), F.concat(F.lit("f"), F.col("o_orderkey") * 7 % 400, F.lit(".c")).alias("dependency"), F.lit(False).alias("pattern"))
    s = t.supplier
    near = s.select(F.concat(F.lit("mk"), F.col("s_suppkey") % 300, F.lit("/f"), F.col("s_suppkey") * 3 % 400, F.lit(".c")).alias("path"), F.lit("added").alias("change"))
    root = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("f"), F.col("s_suppkey") * 5 % 400, F.lit(".c")).alias("path"), F.lit("removed").alias("change"))
    return incremental.dirty_paths(near.unionByName(root).distinct(), build)


def _named(t: Tables) -> DataFrame:
    """Parts as entities: every third one is renamed ten revisions after it came."""
    p = t.part.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).where("n = 0 or p_partkey % 3 = 0")
    name = F.when(F.col("n") == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.concat_ws(" ", "p_name", "p_type", "p_name"))
    born = F.col("p_size").cast("long")
    return p.select(F.col("p_partkey").alias("entity_id"), name.alias("name"), F.when(F.col("n") == 0, born).otherwise(born + 10).alias("valid_from"), F.when((F.col("n") == 0) & (F.col("p_partkey") % 3 == 0), born + 10).alias("valid_to"))


_NAMED = """named AS (SELECT p_partkey AS entity_id, CASE n WHEN 0 THEN concat_ws(' ', p_name, p_brand) ELSE concat_ws(' ', p_name, p_type, p_name) END AS name, CAST(p_size + n * 10 AS BIGINT) AS valid_from,
  CASE WHEN n = 0 AND p_partkey % 3 = 0 THEN p_size + 10 END AS valid_to FROM part, range(2) r(n) WHERE n = 0 OR p_partkey % 3 = 0)"""


def _names_sql(terms: list[str], revision: int, limit: int) -> str:
    values = ", ".join(f"({i}, '{p}')" for i, p in enumerate(terms))
    return f"""WITH {_NAMED}, v AS (SELECT *, regexp_extract_all(lower(name), '{X.TERM}') AS t FROM named WHERE valid_from <= {revision} AND (valid_to IS NULL OR valid_to > {revision})),
s AS (SELECT count(*) AS n, avg(len(t)) AS average FROM v), q(i, p) AS (VALUES {values}),
h AS (SELECT entity_id, name, len(t) AS length, i, len(list_filter(t, lambda x: starts_with(x, p))) AS tf FROM v, q WHERE len(list_filter(t, lambda x: starts_with(x, p))) > 0),
d AS (SELECT i, count(*) AS df FROM h GROUP BY i),
c AS (SELECT entity_id, name, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score FROM h JOIN d USING (i), s GROUP BY entity_id, name HAVING count(*) = {len(terms)})
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, entity_id) AS INT) AS rank, entity_id, name, round(score, 6) AS score, p_retailprice AS price FROM c JOIN part ON p_partkey = entity_id QUALIFY rank <= {limit}"""


def _found(t: Tables, query_text: str, revision: int, limit: int, stored: bool) -> DataFrame:
    versions = _named(t)
    posts, stats = names.name_postings(versions), names.name_stats(versions)
    if stored:
        tables = VersionedTables(t.spark, _tables(t).root, names.STORED)
        tables.commit(tables.head(), {"names": Change(posts), "name_stats": Change(stats.withColumn("valid_from", F.col("revision")))}, 60)
        at = tables.compact("names")
        posts, stats = tables.rows("names", names.query_heads(query_text), at), tables.rows("name_stats", at=at).select("revision", "n", "length")
    found = names.find_names(posts, stats, versions, t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), query_text, limit, revision)
    return found.select("rank", "entity_id", "name", F.round("score", 6).alias("score"), "price")


@query(_names_sql(["br", "sm"], 30, 40))
def name_prefixes(t: Tables) -> DataFrame:
    """Names at a revision by prefixes that all must match, ranked by BM25, from postings in a stored table of which the heads of the query are read."""
    return _found(t, "sm Br", 30, 40, True)


@query(_names_sql(["1", "ring"], 45, 25))
def name_prefixes_short(t: Tables) -> DataFrame:
    """The same with a prefix shorter than the heads, which all postings are sought for."""
    return _found(t, "ring 1", 45, 25, False)


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, ts, event_type FROM events),
r(user_id, i, frontier, target, ts) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), ts FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, CAST(t + 1 AS BIGINT), CAST(t AS BIGINT), e.ts FROM (SELECT r.*, e.i AS ei, e.event_type, e.ts AS ets, r.frontier + coalesce(nullif(list_position(list_slice(['view', 'click', 'signup', 'purchase', 'error'], r.frontier + 1, 5), e.event_type), 0), 1) - 1 AS t
    FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1 WHERE r.frontier < 5) x JOIN e ON e.user_id = x.user_id AND e.i = x.ei)
SELECT user_id AS run, 's' || target AS node, epoch_us(ts) AS "at" FROM r WHERE NOT (i = 1 AND target = 0)""")
def flow_tracker(t: Tables) -> DataFrame:
    """When each step of a flow became active, of events as the log lines of a run each, by the tracker in event time; a last run's line closes the stream."""
    spark = t.spark
    flow = [("t", "push", 0, "entry"), ("g0", "a", 0, "group"), ("s0", "view", 0, "step"), ("s1", "click", 0, "step"), ("g1", "b", 1, "group"), ("s2", "signup", 1, "step"), ("s3", "purchase", 1, "step"), ("s4", "error", 1, "step")]
    shape = lambda rows: rows.select(F.col("user_id").cast("string").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("number"), F.concat("event_type", F.lit(" now")).alias("line"), F.lit(None).cast("int").alias("exit"))
    at = f"{_tables(t).root}/log"
    shape(t.events).repartition("number").write.parquet(at)  # in no order
    end = spark.createDataFrame([("~", 0, "end", 0)], "run string, number long, line string, exit int").join(t.events.agg((F.max("ts") + F.expr("interval 400 days")).cast("timestamp").alias("ts")))  # one row
    end.select("run", "ts", "number", "line", "exit").write.mode("append").parquet(at)
    stream = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
    out, store_of = f"{at}-out", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store_of)
    spark.conf.set(store_of, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = builds.track_flow(stream, "365 days", flow).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(store_of, before)
    q.awaitTermination()
    steps = spark.read.parquet(out).where("state = 'active' and node like 's%' and run <> '~'")
    return steps.select(F.col("run").cast("long").alias("run"), "node", F.unix_micros("at").alias("at"))


@query(ORACLE["import_rollup"])
def tree_rollup(t: Tables) -> DataFrame:
    """The import rollup over containment edges: the closure of the folders' edges by doubling, not path strings."""
    i = imports(t)
    up = i.select("path").distinct().select(F.explode(F.concat(F.filter(derive.path_ancestors(F.col("path")), lambda p: p != ""), F.array("path"))).alias("child")).distinct()
    parents = up.select("child", F.regexp_extract("child", r"^(.*)/[^/]*$", 1).alias("parent"))
    return derive.tree_rollup(i.select(F.col("path").alias("node"), "module"), graph.containment(parents)).select(F.col("ancestor").alias("directory"), "module", "import_count")


@query("""WITH RECURSIVE p AS (SELECT o_custkey AS child, max(o_orderkey) AS k FROM orders GROUP BY o_custkey),
e AS (SELECT child, k % (SELECT count(*) FROM customer) AS parent FROM p WHERE k % (SELECT count(*) FROM customer) < child),
c(node, ancestor, hops) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT c.node, e.parent, hops + 1 FROM c JOIN e ON c.ancestor = e.child)
SELECT ancestor, node, CAST(hops AS INT) AS hops FROM c""")
def containment_closure(t: Tables) -> DataFrame:
    """All pairs of a forest of customers: everyone is held by the customer that their last order's number names, if that comes before."""
    last = t.orders.groupBy(F.col("o_custkey").alias("child")).agg(F.max("o_orderkey").alias("k")).join(t.customer.agg(F.count(F.lit(1)).alias("n")))  # one row
    return graph.containment(last.select("child", (F.col("k") % F.col("n")).alias("parent")).where("parent < child"))


@query(f"""{with_('rel')}, n AS (SELECT c_custkey AS node, CAST(1 + c_custkey % 60 AS BIGINT) AS valid_from, CASE WHEN c_custkey % 9 = 0 THEN CAST(60 + c_custkey % 50 AS BIGINT) END AS valid_to FROM customer),
last AS (SELECT DISTINCT valid_from AS r FROM rel ORDER BY r DESC LIMIT 20),
e AS MATERIALIZED (SELECT DISTINCT r, source_id AS src, target_id AS dst FROM rel JOIN last ON valid_from <= r AND (valid_to IS NULL OR valid_to > r)),
p AS (WITH RECURSIVE q(r, a, b) AS (SELECT r, src, dst FROM e UNION SELECT q.r, q.a, e.dst FROM q JOIN e ON q.r = e.r AND q.b = e.src) SELECT * FROM q)
SELECT r AS revision, (SELECT count(*) FROM n WHERE valid_from <= r AND (valid_to IS NULL OR valid_to > r)) AS nodes, (SELECT count(*) FROM rel WHERE valid_from <= r AND (valid_to IS NULL OR valid_to > r)) AS edges,
  (SELECT count(*) FROM e WHERE e.r = last.r AND (src = dst OR EXISTS (SELECT 1 FROM p WHERE p.r = e.r AND p.a = e.dst AND p.b = e.src))) AS cyclic,
  (SELECT count(*) FROM n WHERE valid_from <= r AND (valid_to IS NULL OR valid_to > r) AND NOT EXISTS (SELECT 1 FROM e WHERE e.r = last.r AND (src = node OR dst = node))) AS orphans FROM last""")
def metrics_trend(t: Tables) -> DataFrame:
    """Nodes, edges, cyclic edges and orphans of the graph at its last twenty revisions, in one run."""
    c = F.col("c_custkey")
    nodes = t.customer.select(c.alias("node"), (1 + c % 60).alias("valid_from"), F.when(c % 9 == 0, 60 + c % 50).alias("valid_to"))
    edges = rel(t).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "valid_from", "valid_to")
    last = edges.select(F.col("valid_from").alias("revision")).distinct().orderBy(F.desc("revision")).limit(20)
    return trend.metrics_trend(nodes, edges, last)
