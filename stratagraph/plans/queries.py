"""The registered queries: each applies operators to whole test tables; ORACLE has the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget, derive, graph, lookups, manifest, scenes, search, temporal
from .fixtures import Tables, files, imports, refs, rel, touches, ver, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
REVISION = 70


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


# ---- revisions


@query(f"""{with_('rel', 'ver')}
SELECT id, kind, layer, source_id, v.name AS source_name, target_id, u.name AS target_name FROM rel
JOIN ver v ON source_id = v.entity_id AND v.valid_from <= {REVISION} AND (v.valid_to IS NULL OR v.valid_to > {REVISION})
JOIN ver u ON target_id = u.entity_id AND u.valid_from <= {REVISION} AND (u.valid_to IS NULL OR u.valid_to > {REVISION})
WHERE rel.valid_from <= {REVISION} AND (rel.valid_to IS NULL OR rel.valid_to > {REVISION})""")
def asof_edges(t: Tables) -> DataFrame:
    state = temporal.as_of(ver(t), REVISION).select("entity_id", "name")
    e = temporal.as_of(rel(t), REVISION)
    e = e.join(state.withColumnsRenamed({"entity_id": "source_id", "name": "source_name"}), "source_id").join(state.withColumnsRenamed({"entity_id": "target_id", "name": "target_name"}), "target_id")
    return e.select("id", "kind", "layer", "source_id", "source_name", "target_id", "target_name")


@query(f"{with_('rel')} SELECT kind, layer, count(*) AS n FROM rel WHERE valid_to IS NULL GROUP BY kind, layer")
def current_edges(t: Tables) -> DataFrame:
    return temporal.as_of(rel(t)).groupBy("kind", "layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"{with_('ver')} SELECT entity_id, version_id, name FROM ver WHERE valid_from <= {REVISION} AND (valid_to IS NULL OR valid_to > {REVISION}) AND name LIKE '1%'")
def entities_at_revision(t: Tables) -> DataFrame:
    return temporal.as_of(ver(t), REVISION).where(F.col("name").startswith("1")).select("entity_id", "version_id", "name")


@query(f"""{with_('rel')} SELECT id, kind, 'asserted' AS change FROM rel WHERE valid_from > 60 AND valid_from <= 72
UNION ALL SELECT id, kind, 'retracted' FROM rel WHERE valid_to > 60 AND valid_to <= 72""")
def revision_diff(t: Tables) -> DataFrame:
    return temporal.revision_diff(rel(t), 60, 72).select("id", "kind", "change")


@query(f"""{with_('ver')} SELECT entity_id, CASE WHEN bool_or(a) AND bool_or(r) THEN 'changed' WHEN bool_or(a) THEN 'added' ELSE 'removed' END AS delta
FROM (SELECT entity_id, valid_from > 60 AND valid_from <= 72 AS a, coalesce(valid_to > 60 AND valid_to <= 72, false) AS r FROM ver) WHERE a OR r GROUP BY entity_id""")
def node_delta(t: Tables) -> DataFrame:
    return temporal.node_delta(ver(t), 60, 72)


@query(f"""{with_('ver')}, cur AS (SELECT entity_id, name FROM ver WHERE valid_to IS NULL),
a AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN coalesce(name, 'x') ELSE c_mktsegment END AS state FROM customer LEFT JOIN cur ON c_custkey = entity_id WHERE c_custkey % 2 = 0),
g AS (SELECT c_custkey AS entity_id FROM customer WHERE c_custkey % 5 = 0),
ch AS (SELECT a.entity_id AS aid, c.entity_id AS cid, g.entity_id AS gid, coalesce(a.entity_id, c.entity_id, g.entity_id) AS entity_id, a.state, a.entity_id IS NOT NULL AND (c.entity_id IS NULL OR a.state IS DISTINCT FROM c.name) AS opens
       FROM a FULL JOIN cur c ON a.entity_id = c.entity_id FULL JOIN g ON coalesce(a.entity_id, c.entity_id) = g.entity_id)
SELECT v.entity_id, v.name AS state, v.valid_from, CASE WHEN v.valid_to IS NULL AND ch.cid IS NOT NULL AND (opens OR gid IS NOT NULL) THEN 200 ELSE v.valid_to END AS valid_to FROM ver v LEFT JOIN ch ON v.entity_id = ch.entity_id
UNION ALL SELECT entity_id, state, 200, CASE WHEN gid IS NOT NULL THEN 200 END FROM ch WHERE opens""")
def scd2_commit(t: Tables) -> DataFrame:
    versions = ver(t).select("entity_id", F.col("name").alias("state"), "valid_from", "valid_to")
    current = versions.where("valid_to is null").select(F.col("entity_id").alias("c"), "state")
    asserted = t.customer.where("c_custkey % 2 = 0").join(current, F.col("c_custkey") == F.col("c"), "left").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 3 == 0, F.coalesce("state", F.lit("x"))).otherwise(F.col("c_mktsegment")).alias("state"))
    return temporal.commit_entities(versions, asserted, t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("entity_id")), 200)


@query(f"""{with_('rel')}, g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 0),
c AS (SELECT id FROM rel WHERE source_id IN (SELECT k FROM g) OR target_id IN (SELECT k FROM g) UNION SELECT id FROM rel WHERE id % 11 = 0),
old AS (SELECT * FROM rel WHERE valid_to IS NULL AND source_id NOT IN (SELECT k FROM g) AND target_id NOT IN (SELECT k FROM g)),
a AS (SELECT DISTINCT target_id AS source_id, source_id AS target_id, kind, layer, weight AS properties FROM rel WHERE id % 4 = 0 UNION SELECT DISTINCT source_id, target_id, kind, layer, weight FROM rel WHERE id % 4 = 1)
SELECT source_id, target_id, kind, valid_from, CASE WHEN valid_to IS NULL AND id IN (SELECT id FROM c) THEN 200 ELSE valid_to END AS valid_to FROM rel
UNION ALL SELECT source_id, target_id, kind, 200, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source_id = a.source_id AND o.target_id = a.target_id AND o.kind = a.kind AND o.layer = a.layer AND o.weight = a.properties)""")
def edge_commit(t: Tables) -> DataFrame:
    e = rel(t).withColumnRenamed("weight", "properties")
    back = e.where("id % 4 = 0").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "kind", "layer", "properties")
    asserted = back.unionByName(e.where("id % 4 = 1").select("source_id", "target_id", "kind", "layer", "properties"))
    after = temporal.commit_edges(e, asserted, e.where("id % 11 = 0"), t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("entity_id")), 200)
    return after.select("source_id", "target_id", "kind", "valid_from", "valid_to")


@query("SELECT DISTINCT l_partkey AS fact_id, l_orderkey AS observation_id FROM lineitem")
def provenance_why(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.lit("relationship").alias("fact_kind"), F.col("l_partkey").alias("fact_id"), F.col("l_orderkey").alias("observation_id"))
    return temporal.why(temporal.link_provenance(links, links), "relationship")


@query("SELECT o_custkey AS repository_id, max(o_orderkey) AS snapshot_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY o_custkey")
def latest_snapshot_per_repo(t: Tables) -> DataFrame:
    snapshots = t.orders.select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("snapshot_id"))
    return temporal.latest_snapshot(snapshots, t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("snapshot_id")))


@query(f"""{with_('rel')} SELECT r AS revision, count(*) AS edges, count(DISTINCT source_id) AS sources FROM rel JOIN (SELECT unnest(range(40, 120)) AS r) ON valid_from <= r AND (valid_to IS NULL OR valid_to > r) GROUP BY r""")
def graph_trend(t: Tables) -> DataFrame:
    revisions = t.spark.range(40, 120).select(F.col("id").alias("revision"))
    edges, sources = scenes.degree_trend(rel(t), revisions), scenes.distinct_trend(rel(t), "source_id", revisions)
    return edges.join(sources.withColumnRenamed("n", "sources"), "revision").where("edges > 0")


# ---- manifests

_OLD_NEW = """old AS (SELECT path, blob_hash, size FROM files WHERE doc_id % 3 <> 0),
new AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(blob_hash) ELSE blob_hash END AS blob_hash, size FROM files WHERE doc_id % 4 <> 0),
diff AS (SELECT coalesce(n.path, o.path) AS path, coalesce(n.blob_hash, o.blob_hash) AS blob_hash, coalesce(n.size, o.size) AS size,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM old o FULL JOIN new n ON o.path = n.path WHERE o.blob_hash IS DISTINCT FROM n.blob_hash)"""


def _manifests(t: Tables) -> tuple[DataFrame, DataFrame]:
    f = files(t)
    moved = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    edited = F.when(F.col("doc_id") % 5 == 0, F.sha2("blob_hash", 256)).otherwise(F.col("blob_hash"))
    return f.where("doc_id % 3 <> 0").select("path", "blob_hash", "size"), f.where("doc_id % 4 <> 0").select(moved.alias("path"), edited.alias("blob_hash"), "size")


@query(f"{with_('files')}, {_OLD_NEW} SELECT * FROM diff")
def manifest_diff(t: Tables) -> DataFrame:
    return manifest.manifest_diff(*_manifests(t))


@query(f"""{with_('files')}, {_OLD_NEW},
r AS (SELECT path AS old_path, blob_hash, size, split_part(path, '/', -1) AS name, count(*) OVER (PARTITION BY blob_hash, size > 0) AS n FROM diff WHERE change = 'removed'),
a AS (SELECT path AS new_path, blob_hash, split_part(path, '/', -1) AS name, count(*) OVER (PARTITION BY blob_hash) AS n FROM diff WHERE change = 'added'),
x AS (SELECT old_path, new_path FROM r JOIN a ON r.blob_hash = a.blob_hash WHERE r.n = 1 AND a.n = 1 AND size > 0),
r2 AS (SELECT *, count(*) OVER (PARTITION BY name) AS k FROM r WHERE old_path NOT IN (SELECT old_path FROM x)),
a2 AS (SELECT *, count(*) OVER (PARTITION BY name) AS k FROM a WHERE new_path NOT IN (SELECT new_path FROM x))
SELECT old_path, new_path, true AS exact FROM x UNION ALL SELECT old_path, new_path, false FROM r2 JOIN a2 ON r2.name = a2.name WHERE r2.k = 1 AND a2.k = 1 AND old_path <> new_path""")
def rename_detect(t: Tables) -> DataFrame:
    return manifest.renames(manifest.manifest_diff(*_manifests(t)))


@query(f"{with_('files')}, {_OLD_NEW} SELECT path FROM diff WHERE change IN ('removed', 'modified')")
def retracted_paths(t: Tables) -> DataFrame:
    return manifest.retracted_paths(manifest.manifest_diff(*_manifests(t)))


@query(f"{with_('files')}, {_OLD_NEW} SELECT doc_id, blob_hash FROM files WHERE blob_hash IN (SELECT blob_hash FROM new)")
def orphan_prune(t: Tables) -> DataFrame:
    return manifest.prune(files(t).select("doc_id", "blob_hash"), _manifests(t)[1])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 0)")
def missing_vectors(t: Tables) -> DataFrame:
    return manifest.missing(t.documents.select("doc_id"), t.embeddings.where("label <> 0").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query(f"{with_('files')} SELECT DISTINCT blob_hash, path FROM files")
def blob_paths(t: Tables) -> DataFrame:
    return manifest.paths_of_blobs(files(t))


@query(f"""{with_('files')}, {_OLD_NEW}, a AS (SELECT path || '@' || blob_hash AS fact FROM new), b AS (SELECT path || '@' || blob_hash AS fact FROM old)
SELECT fact, 'missing' AS problem FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT fact, 'stale' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def verify_symdiff(t: Tables) -> DataFrame:
    old, new = _manifests(t)
    fact = F.concat_ws("@", "path", "blob_hash").alias("fact")
    return manifest.verify(new.select(fact), old.select(fact))


# ---- derived layers

_UP = "up AS (SELECT i.*, d AS directory FROM (SELECT *, string_split(path, '/') AS p FROM imports) i, LATERAL (SELECT unnest(list_transform(range(len(p)), lambda n: array_to_string(list_slice(p, 1, n), '/'))) AS d))"


@query(f"{with_('imports')}, {_UP} SELECT directory, module, count(DISTINCT path) AS import_count FROM up GROUP BY directory, module")
def import_rollup(t: Tables) -> DataFrame:
    return derive.import_rollup(imports(t))


@query(f"{with_('imports')}, {_UP} SELECT DISTINCT directory, module, observation_id FROM up")
def rollup_provenance(t: Tables) -> DataFrame:
    return derive.rollup_provenance(imports(t))


@query(f"""{with_('imports')}, {_UP}, r AS (SELECT directory, module, count(DISTINCT path) AS import_count FROM up GROUP BY 1, 2), s AS (SELECT directory, module, count(DISTINCT path) AS import_count FROM up WHERE observation_id % 3 <> 0 GROUP BY 1, 2)
SELECT * FROM r EXCEPT SELECT * FROM s""")
def rollup_stale(t: Tables) -> DataFrame:
    i, key = imports(t), ["directory", "module", "import_count"]
    return derive.stale(derive.import_rollup(i).select(*key), derive.import_rollup(i.where("observation_id % 3 <> 0")), key)


@query("""WITH o AS (SELECT 'c' || o_custkey AS from_path, 'p' || l_partkey % 50 AS to_path, o_orderkey AS observation_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT from_path, to_path, count(*) AS reference_count, list_slice(list_sort(list(observation_id)), 1, 200) AS observations FROM o GROUP BY 1, 2""")
def reference_pairs(t: Tables) -> DataFrame:
    n = t.tasks("lineitem")
    o, li = derive.dealt(t.orders.select("o_orderkey", "o_custkey"), n, "o_orderkey"), derive.dealt(t.lineitem.select("l_orderkey", "l_partkey"), n, "l_orderkey")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return derive.reference_pairs(j.select(F.concat(F.lit("c"), "o_custkey").alias("from_path"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("to_path"), F.col("o_orderkey").alias("observation_id")), tasks=n)


_SPANS = """spans AS (SELECT 'p' || p_partkey % 40 AS path, CAST(p_size * 7 AS BIGINT) AS s, CAST(p_size * 7 + p_partkey % 90 AS BIGINT) AS e, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END AS rank, p_partkey AS key FROM part),
points AS (SELECT 'p' || l_partkey % 40 AS path, CAST(l_quantity * 8 AS BIGINT) AS line, l_orderkey * 10 + l_linenumber AS point_id, l_returnflag AS f FROM lineitem),
hit AS (SELECT point_id, path, line, f, key, s, e, row_number() OVER (PARTITION BY point_id, path, line ORDER BY e - s, rank, key) AS n FROM points JOIN spans USING (path) WHERE s <= line AND line <= e)"""


def _spans_points(t: Tables) -> tuple[DataFrame, DataFrame]:
    p, li = t.part, t.lineitem
    spans = p.select(F.concat(F.lit("p"), F.col("p_partkey") % 40).alias("path"), (F.col("p_size") * 7).cast("long").alias("start"), (F.col("p_size") * 7 + F.col("p_partkey") % 90).cast("long").alias("end"), F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).otherwise(2).alias("rank"), F.col("p_partkey").alias("key"))
    points = li.select(F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("path"), (F.col("l_quantity") * 8).cast("long").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"))
    return spans, points.distinct()


@query(f'WITH {_SPANS} SELECT DISTINCT path, line, point_id, key, s AS "start", e AS "end" FROM hit WHERE n = 1')
def innermost_span(t: Tables) -> DataFrame:
    spans, points = _spans_points(t)
    return derive.innermost(points, spans)


@query(f"""WITH {_SPANS}, one AS (SELECT DISTINCT path, line, point_id, key FROM hit WHERE n = 1)
SELECT a.key AS from_key, b.key AS to_key, count(*) AS reference_count, count(*) FILTER (a.point_id % 2 = 0) AS call_count
FROM one a JOIN one b ON a.point_id + 1 = b.point_id WHERE a.key <> b.key GROUP BY 1, 2""")
def symbol_pairs(t: Tables) -> DataFrame:
    spans, points = _spans_points(t)
    at = derive.innermost(points, spans)
    nxt = at.select((F.col("point_id") - 1).alias("point_id"), F.col("key").alias("to_key"))
    return derive.symbol_pairs(at.withColumnRenamed("key", "from_key").join(nxt, "point_id").withColumn("is_call", F.col("point_id") % 2 == 0))


_AUTHORS = "authors AS (SELECT path, person, count(*) AS commits, max(seen) AS last_touched, max_by(name, seen::VARCHAR || name) AS name FROM touches GROUP BY path, person), last AS (SELECT person, max(seen) AS last_commit FROM touches GROUP BY person)"


@query(f"{with_('touches')}, {_AUTHORS} SELECT path, person, commits, last_touched, name FROM authors")
def authorship(t: Tables) -> DataFrame:
    return derive.authorship(touches(t))


@query(f"{with_('touches')}, {_AUTHORS} SELECT person, last_commit FROM last")
def last_commits(t: Tables) -> DataFrame:
    return derive.last_commits(touches(t))


_OWNERS = "owners AS (SELECT path, person, share FROM (SELECT path, person, commits / sum(commits) OVER (PARTITION BY path) AS share, row_number() OVER (PARTITION BY path ORDER BY commits DESC, person) AS n FROM authors) WHERE n = 1 AND share >= 0.2)"


@query(f"{with_('touches')}, {_AUTHORS}, {_OWNERS} SELECT path, person, round(share, 6) AS share FROM owners")
def dominant_owner(t: Tables) -> DataFrame:
    return derive.dominant_owners(derive.authorship(touches(t)), 0.2).withColumn("share", F.round("share", 6))


@query(f"""{with_('touches')}, {_AUTHORS}, {_OWNERS}, gone AS (SELECT path, bool_and(last_commit < TIMESTAMP '2001-11-20') AS stranded FROM authors JOIN last USING (person) GROUP BY path)
SELECT 'p' || p_partkey AS path, CASE WHEN stranded IS NULL THEN 'Unowned' WHEN stranded THEN 'Stranded' ELSE coalesce(person, 'Shared') END AS label
FROM part LEFT JOIN gone ON path = 'p' || p_partkey LEFT JOIN owners USING (path)""")
def owner_labels(t: Tables) -> DataFrame:
    authors = derive.authorship(touches(t))
    return derive.owner_labels(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("path")), authors, derive.dominant_owners(authors, 0.2), derive.last_commits(touches(t)), F.lit("2001-11-20").cast("timestamp"))


@query(f"""{with_('imports')} SELECT path, CASE WHEN o AND n THEN 'Straddling' WHEN n THEN 'Migrated' ELSE 'Not migrated' END AS state
FROM (SELECT path, bool_or(module = 'Brand#2') AS o, bool_or(module = 'Brand#17') AS n FROM imports GROUP BY path) WHERE o OR n""")
def migration_front(t: Tables) -> DataFrame:
    return derive.migration_front(imports(t), F.col("module") == "Brand#2", F.col("module") == "Brand#17")


@query("""WITH f AS (SELECT l_partkey AS path, l_suppkey AS function, min(l_linenumber) AS s, max(l_linenumber + 3) AS e, count(*) FILTER (l_quantity > 25) / count(*) AS fraction FROM lineitem GROUP BY 1, 2)
SELECT path, s AS "start", e AS "end", round(max(fraction), 6) AS fraction FROM (SELECT path, s, e, fraction FROM f UNION ALL SELECT path, s, e, 0.5 FROM f WHERE function % 2 = 0) GROUP BY path, s, e""")
def coverage_fold(t: Tables) -> DataFrame:
    regions = t.lineitem.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("function"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 3).alias("end"), (F.col("l_quantity") > 25).cast("int").alias("hits"))
    n = t.tasks("lineitem")
    one = derive.coverage_functions(regions, n)
    other = one.where("function % 2 = 0").withColumn("fraction", F.lit(0.5))
    cols = ["path", "start", "end", "fraction"]
    return derive.coverage_merge(one.select(*cols), other.select(*cols), tasks=n).withColumn("fraction", F.round("fraction", 6))


@query("SELECT round((SELECT count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) / count(*), 9) AS coverage FROM part")
def reference_coverage(t: Tables) -> DataFrame:
    touched = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("path"))
    return derive.reference_coverage(t.part.select(F.col("p_partkey").alias("path")), touched).select(F.round("coverage", 9).alias("coverage"))


# ---- graph


def _edges(t: Tables) -> DataFrame:
    return refs(t).select("src", "dst", F.col("refs").cast("double").alias("weight"), "calls")


@query(f"{with_('rel', 'refs')} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM refs UNION ALL SELECT dst FROM refs) GROUP BY node")
def degree(t: Tables) -> DataFrame:
    return graph.degrees(_edges(t))


_ROLES = "roles AS (SELECT coalesce(i.node, o.node) AS node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT dst AS node, count(DISTINCT src) AS fan_in FROM refs WHERE src <> dst GROUP BY 1) i FULL JOIN (SELECT src AS node, count(DISTINCT dst) AS fan_out FROM refs WHERE src <> dst GROUP BY 1) o ON i.node = o.node), r AS (SELECT *, CASE WHEN fan_in >= 10 AND fan_out >= 10 THEN 'Hub' WHEN fan_in >= 10 THEN 'Core' WHEN fan_out >= 10 THEN 'Entry' ELSE 'Leaf' END AS role FROM roles)"


@query(f"{with_('rel', 'refs')}, {_ROLES} SELECT * FROM r")
def structural_roles(t: Tables) -> DataFrame:
    return graph.roles(_edges(t), 10)


@query(f"""{with_('rel', 'refs')}, {_ROLES}, n AS (SELECT c_custkey AS node, CASE c_mktsegment WHEN 'BUILDING' THEN 'Services' WHEN 'MACHINERY' THEN 'Views' WHEN 'HOUSEHOLD' THEN 'Models' WHEN 'AUTOMOBILE' THEN 'ViewModels' ELSE 'Other' END AS named FROM customer)
SELECT node, named, role AS structural FROM n JOIN r USING (node) WHERE (named = 'Services' AND role NOT IN ('Core', 'Hub')) OR (named = 'Models' AND role NOT IN ('Core', 'Hub', 'Leaf')) OR (named = 'Views' AND role NOT IN ('Entry', 'Hub', 'Leaf')) OR (named = 'ViewModels' AND role NOT IN ('Entry', 'Hub'))""")
def role_disagreements(t: Tables) -> DataFrame:
    ending = {"BUILDING": "FooService", "MACHINERY": "FooView", "HOUSEHOLD": "FooModel", "AUTOMOBILE": "FooViewModel"}
    stem = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ending.items() for x in kv]), F.col("c_mktsegment")), F.lit("Foo"))
    named = X.pattern_role(F.concat(F.lit("Sources/App/"), stem, F.lit(".swift")), F.lit("file"))
    return lookups.role_disagreements(t.customer.select(F.col("c_custkey").alias("node"), named.alias("named")), graph.roles(_edges(t), 10))


_BOTH = "b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM refs UNION ALL SELECT dst, src FROM refs))"


@query(f"""{with_('rel', 'refs')}, {_BOTH}, l1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 0 AND dst <> 0), l2 AS (SELECT DISTINCT dst AS node FROM b JOIN l1 ON src = node WHERE dst <> 0 AND dst NOT IN (SELECT node FROM l1))
SELECT CAST(0 AS BIGINT) AS node, 0 AS distance UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def neighborhood_d2(t: Tables) -> DataFrame:
    origin = t.spark.range(1).select(F.col("id").alias("node"))
    return graph.neighborhood(_edges(t), origin, 2)


def _pagerank_sql(seed: str) -> str:
    steps = ["p0 AS (SELECT node, restart AS rank FROM base)"]
    for i in range(20):
        steps.append(f"p{i + 1} AS (SELECT b.node, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM p{i} WHERE node NOT IN (SELECT src FROM refs))) * b.restart + 0.85 * coalesce(g.got, 0) AS rank FROM base b LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM p{i} JOIN e ON node = src GROUP BY dst) g ON b.node = g.dst)")
    return f"""{with_('rel', 'refs')}, n AS (SELECT DISTINCT node FROM (SELECT src AS node FROM refs UNION ALL SELECT dst FROM refs)),
base AS MATERIALIZED (SELECT node, CASE WHEN {seed} THEN 1.0 / (SELECT count(*) FROM n WHERE {seed}) ELSE 0.0 END::DOUBLE AS restart FROM n),
e AS MATERIALIZED (SELECT src, dst, refs::DOUBLE / sum(refs) OVER (PARTITION BY src) AS share FROM refs), {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)} SELECT node, round(rank, 9) AS rank FROM p20"""


@query(_pagerank_sql("true"))
def pagerank(t: Tables) -> DataFrame:
    e = graph.settled(_edges(t).select("src", "dst", "weight"))
    return graph.pagerank(e.select(F.explode(F.array("src", "dst")).alias("node")), e).select("node", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql("node = 7"))
def personalized_pagerank(t: Tables) -> DataFrame:
    e = graph.settled(_edges(t).select("src", "dst", "weight"))
    return graph.pagerank(e.select(F.explode(F.array("src", "dst")).alias("node")), e, seeds=t.spark.range(7, 8).select(F.col("id").alias("node"))).select("node", F.round("rank", 9).alias("rank"))


_ONEWAY = "e AS MATERIALIZED (SELECT DISTINCT source_id AS src, target_id AS dst FROM rel)"


def _all_edges(t: Tables) -> DataFrame:
    return rel(t).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()


@query(f"""{with_('rel', recursive=True)}, {_ONEWAY}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
s AS (SELECT x.a AS node, min(x.b) AS m FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT node, least(node, coalesce(m, node)) AS component FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN s USING (node)""")
def scc(t: Tables) -> DataFrame:
    return graph.strong_components(graph.settled(_all_edges(t)))


@query(f"""{with_('rel', recursive=True)}, {_ONEWAY}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src) SELECT src, dst FROM e WHERE src = dst OR EXISTS (SELECT 1 FROM r WHERE a = dst AND b = src)""")
def cyclic_edges(t: Tables) -> DataFrame:
    e = graph.settled(_all_edges(t))
    return graph.cyclic_edges(e, graph.strong_components(e))


@query(f"""{with_('rel', 'refs', recursive=True)}, f(node, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, d + 1 FROM f JOIN refs ON node = src WHERE d < 6), g(node, d) AS (SELECT CAST(33 AS BIGINT), 0 UNION SELECT src, d + 1 FROM g JOIN refs ON node = dst WHERE d < 6),
fm AS (SELECT node, min(d) AS d FROM f GROUP BY node), gm AS (SELECT node, min(d) AS d FROM g GROUP BY node), tot AS (SELECT d FROM fm WHERE node = 33)
SELECT src, dst, fm.d AS position FROM refs JOIN fm ON src = fm.node JOIN gm ON dst = gm.node, tot WHERE fm.d + 1 + gm.d = tot.d ORDER BY position, src, dst LIMIT 500""")
def all_shortest_paths(t: Tables) -> DataFrame:
    return graph.shortest_path_edges(graph.settled(_edges(t)), 0, 33)


@query(f"""{with_('rel', 'refs')}, ty AS (SELECT c_custkey AS node, c_nationkey AS parent FROM customer)
SELECT a.parent AS from_type, b.parent AS to_type, sum(refs) AS weight FROM refs JOIN ty a ON src = a.node JOIN ty b ON dst = b.node WHERE a.parent <> b.parent GROUP BY 1, 2""")
def class_callers(t: Tables) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    parents = t.customer.select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent"))
    up = graph.ancestor_of(parents, F.col("node").startswith("n"))
    e = refs(t).select(key("c", "src").alias("s"), key("c", "dst").alias("d"), "refs")
    j = e.join(up.withColumnsRenamed({"node": "s", "ancestor": "a"}), "s").join(up.withColumnsRenamed({"node": "d", "ancestor": "b"}), "d").where("a <> b")
    number = lambda c: F.substring(c, 2, 10).cast("int")
    return j.groupBy(number("a").alias("from_type"), number("b").alias("to_type")).agg(F.sum("refs").alias("weight"))


@query("""SELECT 'r' || r_regionkey AS node, NULL AS parent, 0 AS depth, r_name AS path FROM region UNION ALL
SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
SELECT 'c' || c_custkey, 'n' || c_nationkey, 2, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def contains_tree(t: Tables) -> DataFrame:
    k = lambda p, c: F.concat(F.lit(p), F.col(c))
    parents = t.nation.select(k("n", "n_nationkey").alias("child"), k("r", "n_regionkey").alias("parent")).unionByName(t.customer.select(k("c", "c_custkey").alias("child"), k("n", "c_nationkey").alias("parent")))
    labels = t.region.select(k("r", "r_regionkey").alias("node"), F.col("r_name").alias("label")).unionByName(t.nation.select(k("n", "n_nationkey").alias("node"), F.col("n_name").alias("label"))).unionByName(t.customer.select(k("c", "c_custkey").alias("node"), F.col("c_name").alias("label")))
    return graph.tree_rows(parents, labels).withColumn("path", F.array_join("path", "/"))


@query(f"""{with_('rel', 'refs')}
SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(refs) AS refs FROM refs WHERE src <> dst AND (src = 7 OR dst = 7) GROUP BY 1, 2""")
def bonds_of(t: Tables) -> DataFrame:
    """Undirected bonds of a node's neighbourhood, each once, without self bonds."""
    near = graph.neighborhood(_edges(t), t.spark.range(7, 8).select(F.col("id").alias("node")), 1)
    inner = graph.touched_edges(refs(t), near, 1).where("src <> dst")
    return inner.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("refs").alias("refs"))


# ---- text and retrieval


@query(r"""WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents),
w AS (SELECT doc_id, i AS ordinal, ls FROM (SELECT doc_id, ls, unnest(range(CAST(ceil(len(ls) / 60) AS BIGINT))) AS i FROM l))
SELECT doc_id, CAST(ordinal AS INT) AS ordinal, CAST(ordinal * 60 + 1 AS INT) AS start_line, md5(array_to_string(list_transform(list_slice(ls, ordinal * 60 + 1, ordinal * 60 + 60), lambda x: regexp_replace(x, '\r$', '')), chr(10))) AS body_md5 FROM w""")
def windows(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(X.windows(F.col("text"))).alias("w")).select("doc_id", "w.ordinal", "w.start_line", F.md5("w.body").alias("body_md5"))


@query("""SELECT p_partkey, regexp_extract_all(id, '[A-Z]?[a-z]+|[0-9]+') AS parts FROM (SELECT p_partkey, string_split(p_name, ' ')[1] || upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2) || p_size || '_' || lower(p_type) AS id FROM part)""")
def identifier_split(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    ident = F.concat(words[0], F.initcap(words[1]), F.col("p_size"), F.lit("_"), F.lower("p_type"))
    return t.part.select("p_partkey", X.identifier_parts(ident).alias("parts"))


_Q = ["ershan", "thble", "onrean"]


def _bm25_sql(src: str, key: str, limit: int) -> str:
    cols = ", ".join(f"CAST(len(list_filter(b, lambda x: x = '{q}')) AS DOUBLE) AS t{i}" for i, q in enumerate(sorted(_Q)))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(_Q)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(_Q)))
    hit = " OR ".join(f"t{i} > 0" for i in range(len(_Q)))
    return f"""tok AS (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_$]+') AS b FROM {src}), c AS (SELECT {key}, len(b) AS len, {cols} FROM tok), st AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM c),
sc AS (SELECT {key}, {score} AS score FROM c, st WHERE {hit}), tp AS (SELECT {key}, score, row_number() OVER (ORDER BY round(score, 9) DESC, {key}) AS rank FROM sc ORDER BY rank LIMIT {limit})"""


@query(f"WITH {_bm25_sql('documents', 'doc_id', 20)} SELECT doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM tp")
def bm25_search(t: Tables) -> DataFrame:
    scored = search.bm25(t.documents, ["doc_id"], _Q, body="text", split=None)
    return search.top(scored, 20, F.round("score", 9).desc(), F.col("doc_id")).withColumn("score", F.round("score", 6))


@query(f"""WITH {_bm25_sql('documents', 'doc_id', 20)}, m AS (SELECT doc_id, rank, string_split(text, chr(10)) AS ls FROM tp JOIN documents USING (doc_id)),
f AS (SELECT doc_id, rank, ls, list_position(list_transform(ls, lambda x: {" OR ".join(f"contains(lower(x), '{q}')" for q in _Q)}), true) AS line FROM m)
SELECT doc_id, CAST(rank AS INT) AS rank, CAST(line AS INT) AS line, array_to_string(list_slice(ls, greatest(1, line - 2), line + 2), chr(10)) AS snippet FROM f""")
def matching_snippets(t: Tables) -> DataFrame:
    scored = search.bm25(t.documents, ["doc_id"], _Q, body="text", split=None)
    best = search.top(scored, 20, F.round("score", 9).desc(), F.col("doc_id")).join(t.documents, "doc_id")
    at = best.withColumn("ls", F.split("text", "\n")).withColumn("line", X.matching_line(F.col("ls"), _Q))
    return at.select("doc_id", "rank", "line", X.snippet(F.col("ls"), F.col("line")).alias("snippet"))


_VQ = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _first_vector(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 0").first()["embedding"]


@query(f"""WITH {_VQ} SELECT vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT vec_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM
(SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) AS score FROM embeddings, q)) WHERE rank <= 15""")
def vector_topk(t: Tables) -> DataFrame:
    return search.vector_top(t.embeddings, _first_vector(t), 15).withColumn("score", F.round("score", 6))


@query(f"""WITH {_bm25_sql('documents', 'doc_id', 30)}, {_VQ}, v AS (SELECT vec_id, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS rank FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) AS s FROM embeddings, q)),
ls AS (SELECT 'd' || doc_id AS path, rank, 'lexical' AS resolution FROM tp UNION ALL SELECT 'd' || vec_id, rank, 'semantic' FROM v WHERE rank <= 30),
fu AS (SELECT path, sum(1 / (60.0::DOUBLE + rank)) AS score, min(resolution) AS resolution FROM ls GROUP BY path)
SELECT path, round(score, 9) AS score, resolution, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, path) AS rank FROM fu) WHERE rank <= 10""")
def rrf_fusion(t: Tables) -> DataFrame:
    scored = search.bm25(t.documents, ["doc_id"], _Q, body="text", split=None)
    lex = search.top(scored, 30, F.round("score", 9).desc(), F.col("doc_id")).select(F.lit(1).alias("list"), "rank", F.concat(F.lit("d"), "doc_id").alias("path"), F.lit(1).alias("line"), F.lit("lexical").alias("resolution"))
    sem = search.vector_top(t.embeddings, _first_vector(t), 30).select(F.lit(2).alias("list"), "rank", F.concat(F.lit("d"), "vec_id").alias("path"), F.lit(1).alias("line"), F.lit("semantic").alias("resolution"))
    return search.fuse(lex.unionByName(sem), 10).select("path", F.round("score", 9).alias("score"), "resolution", "rank")


@query("""SELECT p_partkey AS key, CAST(tier AS INT) AS tier, CAST(rank AS INT) AS rank FROM (SELECT p_partkey, tier, row_number() OVER (ORDER BY tier, length(p_name), p_partkey) AS rank FROM (SELECT p_partkey, p_name, CASE WHEN p_name = 'red widget' THEN 0 ELSE 2 END AS tier FROM part WHERE regexp_matches(p_name, '(^| )red') AND regexp_matches(p_name, '(^| )wid') OR p_name = 'red widget')) WHERE rank <= 25""")
def definitions(t: Tables) -> DataFrame:
    e = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.lit("").alias("decl_path"))
    return search.name_search(e, "red widget", 25, ["function"]).select("key", F.col("tier").cast("int").alias("tier"), "rank")


@query(r"""SELECT conv_id, turn, cost, spent FROM (SELECT conv_id, turn, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS spent FROM (SELECT *, CAST(greatest(1, ceil(strlen(text) / 3)) AS BIGINT) AS cost FROM conversations)) WHERE spent <= 960""")
def token_budget(t: Tables) -> DataFrame:
    c = t.conversations.withColumn("cost", X.token_estimate(F.col("text")))
    return budget.prefix_admit(c, ["conv_id"], [F.col("turn"), F.col("text")], F.col("cost"), 1000).select("conv_id", "turn", "cost", F.col("spent").cast("decimal(38,0)").cast("long").alias("spent"))


@query()
def budget_elide(t: Tables) -> DataFrame:
    c = t.conversations
    return budget.admit_with_citations(c, ["conv_id"], F.col("turn"), F.concat_ws(":", "role", "turn"), F.col("text"), 600)


@query("""SELECT path, kind, name, line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN kind = 'type' THEN 0 WHEN kind = 'function' THEN 1 ELSE 2 END, line, name) AS n FROM
(SELECT p_brand AS path, CASE p_type WHEN 'ECONOMY' THEN 'type' WHEN 'SMALL' THEN 'function' ELSE 'variable' END AS kind, p_name || p_partkey AS name, p_size AS line FROM part)) WHERE n <= 6""")
def headline_decls(t: Tables) -> DataFrame:
    return budget.headline_declarations(_decls(t))


def _decls(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_type") == "ECONOMY", "type").when(F.col("p_type") == "SMALL", "function").otherwise("variable")
    return t.part.select(F.col("p_brand").alias("path"), kind.alias("kind"), F.concat("p_name", "p_partkey").alias("name"), F.col("p_size").alias("line"))


@query(f"""{_pagerank_sql("true").rsplit(" SELECT node, round", 1)[0]}, r AS (SELECT 's' || (node % 9) || '/f' || node AS path, 's' || (node % 9) AS directory, 'f' || node AS file, round(rank, 9) AS r FROM p20),
d AS (SELECT 's1/f' || p_size AS path, p_size AS line, p_name || p_partkey AS name, row_number() OVER (PARTITION BY p_size ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END, p_name || p_partkey) AS n FROM part),
h AS (SELECT path, string_agg(name, ', ' ORDER BY line, name) AS names FROM d WHERE n <= 6 GROUP BY path),
l AS (SELECT directory, path, '  ' || file || coalesce(': ' || names, '') AS text, r, max(r) OVER (PARTITION BY directory) AS top FROM r LEFT JOIN h USING (path)),
o AS (SELECT *, row_number() OVER (ORDER BY top DESC, directory, r DESC, path) AS position FROM l)
SELECT CAST(position AS INT) AS position, directory, path, text FROM (SELECT *, sum(greatest(1, ceil(strlen(text) / 3))) OVER (ORDER BY position) AS spent FROM o) WHERE spent <= 2960""")
def repo_map(t: Tables) -> DataFrame:
    e = refs(t).select(F.concat(F.lit("s"), F.col("src") % 9, F.lit("/f"), "src").alias("src"), F.concat(F.lit("s"), F.col("dst") % 9, F.lit("/f"), "dst").alias("dst"), F.col("refs").cast("double").alias("weight"))
    e = graph.settled(e)
    ranks = graph.pagerank(e.select(F.explode(F.array("src", "dst")).alias("node")), e).withColumnRenamed("node", "path")
    return budget.repo_map(ranks, _decls(t).withColumn("path", F.concat(F.lit("s1/f"), F.col("line"))))


@query(r"""WITH l AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents WHERE text <> ''),
s AS (SELECT doc_id, ls, least(3, len(ls)) AS a, least(9, len(ls)) AS b FROM l) SELECT doc_id, CAST(a AS INT) AS "start", CAST(b AS INT) AS "end", CAST(len(ls) AS INT) AS total, md5(array_to_string(list_slice(ls, a, b), chr(10))) AS body_md5 FROM s""")
def read_span(t: Tables) -> DataFrame:
    return t.documents.where("text <> ''").select("doc_id", X.read_span(F.col("text"), F.lit(3), F.lit(9)).alias("s")).select("doc_id", "s.start", "s.end", "s.total", F.md5("s.body").alias("body_md5"))


@query("""SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_debounce(t: Tables) -> DataFrame:
    from ..streaming.watch import debounced

    return debounced(t.events.withColumnRenamed("user_id", "key"), "2 hours").select(F.col("key").alias("user_id"), "first", "last", "n")


@query("""SELECT source, lang, language_hint, test, n FROM (SELECT source, lang, 'markdown' AS language_hint, source IN ('src1') AND false AS test, count(*) AS n FROM documents GROUP BY source, lang)""")
def classify_paths(t: Tables) -> DataFrame:
    return files(t).join(t.documents.select("doc_id", "source", "lang"), "doc_id").groupBy("source", "lang", X.language(F.col("path")).alias("language_hint"), X.is_test(F.col("path")).alias("test")).agg(F.count(F.lit(1)).alias("n"))


# ---- files, builds, geometry, streams


@query("""WITH e(position, alternates) AS (VALUES (0, ['src0', 'src1']), (1, ['none', 'src2']), (2, ['none'])), f AS (SELECT source AS path, max(CASE WHEN lang = 'en' THEN text END) AS text FROM documents GROUP BY source),
c AS (SELECT position, unnest(alternates) AS path, unnest(range(len(alternates))) AS choice FROM e), b AS (SELECT position, arg_min(path, choice) AS path FROM c JOIN f USING (path) GROUP BY position)
SELECT CAST(e.position AS INT) AS position, coalesce(b.path, alternates[1]) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN f.text IS NULL OR contains(f.text, 'License') THEN 'stub' ELSE 'real' END AS state FROM e LEFT JOIN b USING (position) LEFT JOIN f ON b.path = f.path""")
def factory_audit(t: Tables) -> DataFrame:
    from ..sources import readers

    f = t.documents.groupBy(F.col("source").alias("path")).agg(F.max(F.when(F.col("lang") == "en", F.col("text"))).alias("text"))
    expected = t.spark.createDataFrame([(0, ["src0", "src1"]), (1, ["none", "src2"]), (2, ["none"])], "position int, alternates array<string>")
    return readers.factory_audit(f, expected, ["License"]).select("position", "path", "state")


@query()
def chunk_plan(t: Tables) -> DataFrame:
    from ..operators import layout

    f = files(t).select(F.col("path").alias("blob_hash"), "text", F.size(X.lines(F.col("text"))).alias("n"))
    decls = f.where("n > 12").select("blob_hash", F.explode(F.array(F.struct(F.lit("outer").alias("key"), F.lit(3).alias("start"), F.col("n").alias("end")), F.struct(F.lit("inner").alias("key"), F.lit(6).alias("start"), F.lit(11).alias("end")))).alias("d")).select("blob_hash", "d.*")
    return layout.plan_chunks(f, decls)


@query()
def cluster_hulls(t: Tables) -> DataFrame:
    from ..operators import layout

    e = t.embeddings.select(F.col("label").alias("cluster"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return layout.cluster_hulls(e)


@query("""WITH c AS (SELECT DISTINCT 'c' || conv_id || '/Makefile' AS path, role || '_' || turn AS node, turn FROM conversations),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY node) - 1 AS INT) AS "row" FROM c),
p AS (SELECT path, list_filter(['system_0', 'user_0'], lambda x: list_contains(list(node), x)) AS deps, max(turn) > 0 AS later FROM c GROUP BY path)
SELECT path, node, 1 AS "column", "row", 'target' AS kind, CASE WHEN turn > 0 THEN deps ELSE [] END AS needs FROM t JOIN p USING (path)
UNION ALL SELECT path, 'echo step', 2, "row", 'step', [] FROM t
UNION ALL SELECT path, 'trigger:' || node, 0, "row", 'trigger', [] FROM t JOIN p USING (path) WHERE NOT (later AND node IN ('system_0', 'user_0'))""")
def ci_flow(t: Tables) -> DataFrame:
    from ..operators import layout
    from ..sources import parsers

    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.lit("_"), x["turn"], F.lit(": "), F.when(x["turn"] > 0, F.lit("system_0 user_0")).otherwise(""), F.lit("\n\techo step"))))
    made = t.conversations.groupBy(F.concat(F.lit("c"), "conv_id", F.lit("/Makefile")).alias("path")).agg(text.alias("text"))
    return layout.ci_flow(parsers.build_observations(made))


@query("""WITH l AS (SELECT user_id, epoch_us(ts) AS t, event_type || '-' || event_id AS step, lead(epoch_us(ts)) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_type || '-' || event_id))
SELECT user_id AS run, step, 'active' AS state, t AS "at" FROM l UNION ALL SELECT user_id, step, 'done', later FROM l WHERE later IS NOT NULL""")
def build_tracker(t: Tables) -> DataFrame:
    """The stateful tracker over events as a stream of log lines, run until all is taken: every transition of every step."""
    import uuid

    from ..streaming.watch import track_builds

    spark, name = t.spark, f"builds_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events.parquet*")
    log = stream.select(F.col("user_id").cast("string").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.concat(F.lit("> "), "event_type", F.lit("-"), "event_id").alias("line"))
    out = f"{graph.shared_folder(spark)}/stratagraph/{name}"
    q = track_builds(log).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.col("run").cast("long").alias("run"), "step", "state", "at")
