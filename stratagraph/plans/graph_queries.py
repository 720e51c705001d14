"""Registered queries over the graph: lookups, references, blast radius, scenes, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import derive, graph, index, lookups, scenes, search, temporal
from .fixtures import Tables, imports, refs, rel, symbol_edges, symbols, touches, with_
from .queries import _AUTHORS, _OWNERS, _bm25_sql, _edges, _first_vector, _Q, _SPANS, _spans_points, _VQ, query

def _key_of(t: Tables, node: int) -> str:
    return symbols(t).where(F.col("node") == node).first()["key"]


@query(f"{with_('symbols')} SELECT node, key, kind, name FROM symbols WHERE node = 7")
def entity_by_key(t: Tables) -> DataFrame:
    return lookups.by_key(symbols(t), _key_of(t, 7)).select("node", "key", "kind", "name")


@query(f"{with_('symbols')} SELECT node, key FROM symbols WHERE kind IN ('type', 'interface')")
def entities_by_kind(t: Tables) -> DataFrame:
    return lookups.by_kind(symbols(t), "type", "interface").select("node", "key")


@query(f"{with_('symbols')} SELECT node, name FROM symbols WHERE node IN (SELECT s_suppkey FROM supplier)")
def entities_by_ids(t: Tables) -> DataFrame:
    return lookups.by_ids(symbols(t), t.supplier.select(F.col("s_suppkey").alias("node"))).select("node", "name")


@query(f"{with_('rel', 'symbol_edges')} SELECT id, kind, src, dst, 'from' AS side FROM symbol_edges WHERE src = 7 UNION ALL SELECT id, kind, src, dst, 'to' FROM symbol_edges WHERE dst = 7 AND kind = 'imports'")
def relationships_of(t: Tables) -> DataFrame:
    e = symbol_edges(t)
    cols = ["id", "kind", "src", "dst"]
    return lookups.relationships(e, source=7).select(*cols, F.lit("from").alias("side")).unionByName(lookups.relationships(e, target=7, kind="imports").select(*cols, F.lit("to").alias("side")))


@query(f"{with_('symbols')} SELECT repo, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind <> 'file') AS declarations FROM symbols GROUP BY repo")
def list_repositories(t: Tables) -> DataFrame:
    return lookups.repositories(symbols(t))


@query("""SELECT revision, strftime("at", '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT o_orderkey AS revision, coalesce(try_cast(o_orderpriority AS TIMESTAMP), TIMESTAMP '0001-01-02') AS at FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 10 <> 0)""")
def revision_list(t: Tables) -> DataFrame:
    created = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderdate").cast("string"))
    found = lookups.revisions(t.orders.select(F.col("o_orderkey").alias("revision"), created.alias("created")))
    return found.select("revision", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))  # as text: the year 1 is out of bounds of pandas


@query(f"{with_('ver')} SELECT version_id, entity_id FROM ver WHERE valid_to IS NULL AND entity_id % 40 = 3")
def anchored_in_path(t: Tables) -> DataFrame:
    from .fixtures import ver

    path = lambda n: F.struct(F.concat(F.lit("f"), F.col("entity_id") % n).alias("path"))
    v = ver(t).withColumn("anchors", F.array(F.struct(F.lit("x").alias("path")), path(40)))
    return lookups.anchored_in(v, "f3").select("version_id", "entity_id")


@query(f"{with_('symbols')} SELECT node, line, CAST(row_number() OVER (ORDER BY line, key) AS INT) AS position FROM symbols WHERE path = (SELECT path FROM symbols WHERE node = 7) AND kind <> 'file'")
def symbols_in_file(t: Tables) -> DataFrame:
    path = symbols(t).where("node = 7").first()["path"]
    return lookups.symbols_in_file(symbols(t), path).select("node", "line", "position")


def _references_sql(test: str, order: str) -> str:
    return f"""{with_('rel', 'symbols', 'symbol_edges')}, target AS (SELECT * FROM symbols WHERE node = (SELECT min(dst) FROM symbol_edges WHERE kind = 'refersToSymbol' AND calls > 0)),
c AS (SELECT count(*) AS n FROM symbol_edges e JOIN symbols s ON e.src = s.node JOIN target t ON s.repo = t.repo WHERE e.kind = 'refersToSymbol')
SELECT CAST(row_number() OVER (ORDER BY {order} DESC, s.key) AS INT) AS position, s.key, e.refs, e.calls, CASE WHEN n > 0 THEN 'compiler' ELSE 'unavailable' END AS evidence
FROM symbol_edges e JOIN target t ON e.dst = t.node JOIN symbols s ON e.src = s.node, c WHERE e.kind = 'refersToSymbol' {test}"""


def _referenced(t: Tables) -> str:
    return _key_of(t, symbol_edges(t).where("kind = 'refersToSymbol' and calls > 0").agg(F.min("dst")).first()[0])


@query(_references_sql("", "refs"))
def references_to(t: Tables) -> DataFrame:
    return lookups.references(symbols(t), symbol_edges(t), _referenced(t)).select("position", "key", "refs", "calls", "evidence")


@query(_references_sql("AND calls > 0", "calls"))
def callers_of(t: Tables) -> DataFrame:
    return lookups.references(symbols(t), symbol_edges(t), _referenced(t), calls_only=True).select("position", "key", "refs", "calls", "evidence")


def _blast_sql() -> str:
    steps = ["p0 AS MATERIALIZED (SELECT node, restart AS rank FROM base)"]
    for i in range(20):
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT b.node, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM p{i} WHERE node NOT IN (SELECT src FROM sh))) * b.restart + 0.85 * coalesce(g.got, 0) AS rank FROM base b LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM p{i} JOIN sh ON node = src GROUP BY dst) g ON b.node = g.dst)")
    return f"""{with_('rel', 'symbol_edges')}, e AS MATERIALIZED (SELECT src, dst, refs FROM symbol_edges WHERE kind IN ('refersToSymbol', 'references', 'imports', 'declares')),
b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)),
l1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 7 AND dst <> 7), l2 AS (SELECT DISTINCT dst AS node FROM b JOIN l1 ON src = node WHERE dst <> 7 AND dst NOT IN (SELECT node FROM l1)),
near AS MATERIALIZED (SELECT CAST(7 AS BIGINT) AS node, 0 AS distance UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2),
t AS (SELECT DISTINCT id, src, dst, refs FROM symbol_edges WHERE kind IN ('refersToSymbol', 'references', 'imports', 'declares') AND (src IN (SELECT node FROM near WHERE distance < 2) OR dst IN (SELECT node FROM near WHERE distance < 2))),
w AS (SELECT src, dst, sum(refs + 1) AS w FROM t GROUP BY src, dst), sh AS MATERIALIZED (SELECT src, dst, w::DOUBLE / sum(w) OVER (PARTITION BY src) AS share FROM w),
base AS MATERIALIZED (SELECT node, CASE WHEN node = 7 THEN 1.0 ELSE 0.0 END::DOUBLE AS restart FROM near), {", ".join(steps)} SELECT node, distance, round(rank, 9) AS rank FROM near JOIN p20 USING (node)"""


@query(_blast_sql())
def blast_radius(t: Tables) -> DataFrame:
    near = lookups.blast_radius(symbols(t), symbol_edges(t), _key_of(t, 7), 2)
    return near.select("node", "distance", F.round("rank", 9).alias("rank"))


@query(f"{with_('symbols')} SELECT node, name FROM symbols WHERE contains(lower(name), 'r#0000000') ORDER BY node LIMIT 12")
def label_search(t: Tables) -> DataFrame:
    found = lookups.label_search(symbols(t).select("node", F.col("name").alias("label")), " R#0000000 ", 12)
    return found.select("node", F.col("label").alias("name"))


_LABEL = "CASE p_partkey % 4 WHEN 0 THEN p_name || p_size WHEN 1 THEN upper(p_name) || '0' || p_size WHEN 2 THEN replace(p_name, 'e', 'é') ELSE p_name || ' ' || p_partkey END"


@query(rf"""WITH l AS (SELECT p_partkey, p_brand, {_LABEL} AS label FROM part),
k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(label, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\1')) AS VARCHAR), 10, '0') || regexp_replace(x, '^0+([0-9])', '\1') ELSE x END), '') AS sortable FROM l)
SELECT p_partkey, label, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY sortable COLLATE en, label, p_partkey) AS INT) AS position FROM k""")
def labels_in_order(t: Tables) -> DataFrame:
    """Labels with capitals, accents and numbers in the order of a reader, within each brand."""
    return lookups.in_label_order(t.part.select("p_partkey", "p_brand", F.expr(_LABEL).alias("label")), ["p_brand"], "label", "p_partkey").select("p_partkey", "label", "position")


@query("""SELECT event_id, map_from_entries(list_filter([{'k': 'core:buildOrder', 'v': CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END}, {'k': 'core:buildPhony', 'v': CASE WHEN event_id % 3 = 0 THEN 'true' END}, {'k': 'core:buildSteps', 'v': event_type || chr(31) || user_id}], lambda x: x.v IS NOT NULL)) AS attributes FROM events""")
def chart_attributes(t: Tables) -> DataFrame:
    bag = F.concat(F.lit('{"other":1,"core:buildOrder":'), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise('"text"'), F.lit(',"core:buildPhony":'), F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), F.lit(',"core:buildSteps":["'), "event_type", F.lit('","'), "user_id", F.lit('",7]}'))
    return t.events.select("event_id", lookups.projected_attributes(F.parse_json(bag)).alias("attributes"))


@query(f"""{with_('rel', 'symbols', 'symbol_edges')} SELECT node, kind FROM symbols WHERE node IN (SELECT src FROM symbol_edges WHERE kind = 'refersToSymbol' UNION SELECT dst FROM symbol_edges WHERE kind = 'refersToSymbol')""")
def symbol_scene(t: Tables) -> DataFrame:
    return scenes.symbol_scene(symbol_edges(t), symbols(t))[0].select("node", "kind")


@query(f"""{with_('rel', 'symbols', 'symbol_edges')} SELECT node, kind FROM symbols WHERE kind = 'file' OR node IN (SELECT src FROM symbol_edges WHERE kind = 'builds' UNION SELECT dst FROM symbol_edges WHERE kind = 'builds')""")
def build_scene(t: Tables) -> DataFrame:
    nodes = symbols(t).withColumn("kind", F.when(F.col("kind") == "file", "buildTarget").otherwise(F.col("kind")))
    shown = scenes.build_scene(symbol_edges(t), nodes)[0]
    return shown.select("node", F.when(F.col("kind") == "buildTarget", "file").otherwise(F.col("kind")).alias("kind"))


@query(f"""{with_('rel')}, e AS (SELECT * FROM rel WHERE kind IN ('imports', 'references') AND valid_to IS NULL) SELECT source_id AS src, target_id AS dst, kind, weight FROM e JOIN customer a ON source_id = a.c_custkey JOIN customer b ON target_id = b.c_custkey WHERE a.c_mktsegment <> 'MACHINERY' AND b.c_mktsegment <> 'MACHINERY'""")
def dependency_scene(t: Tables) -> DataFrame:
    charted = t.customer.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("node"))
    e = temporal.as_of(rel(t)).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "kind", "weight")
    return scenes.dependency_scene(e, charted)


@query(f"""{with_('rel', 'symbols', 'symbol_edges')} SELECT e.src, e.dst, e.kind, CAST(coalesce(CASE WHEN e.kind = 'references' THEN refs END, CASE WHEN e.kind = 'imports' THEN calls END, 1) AS BIGINT) AS weight
FROM symbol_edges e JOIN symbols s ON e.src = s.node WHERE s.repo = 'r2'""")
def shown_edges(t: Tables) -> DataFrame:
    e = symbol_edges(t).select("src", "dst", "kind", F.when(F.col("kind") == "references", F.col("refs")).alias("refs"), F.when(F.col("kind") == "imports", F.col("calls")).alias("commits"))
    return scenes.shown_edges(e, symbols(t), "r2")


_ALL_CYCLES = "r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)"


@query(f"""{with_('rel', recursive=True)}, e AS MATERIALIZED (SELECT DISTINCT source_id AS src, target_id AS dst FROM rel), {_ALL_CYCLES}
SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE src = dst OR EXISTS (SELECT 1 FROM r WHERE a = dst AND b = src)) AS cyclic,
(SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)) AS orphans""")
def graph_metrics(t: Tables) -> DataFrame:
    e = rel(t).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    return scenes.metrics(t.customer.select(F.col("c_custkey").alias("node")), e)


@query(f"""{with_('rel')} SELECT CAST(r AS BIGINT) AS revision, count(*) AS edges FROM rel JOIN (SELECT unnest(range(40, 120)) AS r) ON valid_from <= r AND (valid_to IS NULL OR valid_to > r) GROUP BY r""")
def edge_trend(t: Tables) -> DataFrame:
    return scenes.degree_trend(rel(t), t.spark.range(40, 120).select(F.col("id").alias("revision")))


@query(f"""{with_('rel')}, last AS (SELECT DISTINCT valid_from AS r FROM rel ORDER BY r DESC LIMIT 20) SELECT r AS revision, count(*) AS edges FROM rel JOIN last ON valid_from <= r AND (valid_to IS NULL OR valid_to > r) GROUP BY r""")
def last_revisions_trend(t: Tables) -> DataFrame:
    last = rel(t).select(F.col("valid_from").alias("revision")).distinct().orderBy(F.desc("revision")).limit(20)
    return scenes.degree_trend(rel(t), last)


@query(f"""{with_('rel', 'symbols', 'symbol_edges')}, i AS (SELECT e.* FROM symbol_edges e JOIN symbols a ON src = a.node JOIN symbols b ON dst = b.node), d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM i UNION ALL SELECT dst FROM i) GROUP BY node)
SELECT node, kind AS molecule, round(0.5 * (1 + 0.55 * pow(coalesce(degree, 0), 1.0 / 3)), 9) AS radius FROM symbols LEFT JOIN d USING (node)""")
def scene_atoms(t: Tables) -> DataFrame:
    atoms, _, _ = scenes.molecules(symbols(t).select("node", F.col("kind").alias("cluster")), symbol_edges(t).select("src", "dst"))
    return atoms.withColumn("radius", F.round("radius", 9))


@query(f"""{with_('rel', 'symbols', 'symbol_edges')}, m AS (SELECT kind AS molecule, count(*) AS atoms FROM symbols GROUP BY kind), p AS (SELECT *, row_number() OVER (ORDER BY molecule) - 1 AS i, count(*) OVER () AS n FROM m), q AS (SELECT *, CASE WHEN n > 1 THEN 1 - 2 * (i + 0.5) / n ELSE 0 END AS u FROM p)
SELECT molecule, atoms, round(cos(i * pi() * (3 - sqrt(5))) * sqrt(1 - u * u) * 14 * cbrt(n), 6) AS x, round(u * 14 * cbrt(n), 6) AS y, round(sin(i * pi() * (3 - sqrt(5))) * sqrt(1 - u * u) * 14 * cbrt(n), 6) AS z FROM q""")
def scene_molecules(t: Tables) -> DataFrame:
    _, _, found = scenes.molecules(symbols(t).select("node", F.col("kind").alias("cluster")), symbol_edges(t).select("src", "dst"))
    return found.select("molecule", "atoms", *[F.round(c, 6).alias(c) for c in "xyz"])


_LABELS = f"""{with_('touches')}, {_AUTHORS}, {_OWNERS}, gone AS (SELECT path, bool_and(last_commit < TIMESTAMP '2001-11-20') AS stranded FROM authors JOIN last USING (person) GROUP BY path),
labels_ AS (SELECT 'p' || p_partkey AS path, CASE WHEN stranded IS NULL THEN 'Unowned' WHEN stranded THEN 'Stranded' ELSE coalesce(person, 'Shared') END AS label FROM part LEFT JOIN gone ON path = 'p' || p_partkey LEFT JOIN owners USING (path))"""


def _labels(t: Tables) -> DataFrame:
    authors = derive.authorship(touches(t))
    return derive.owner_labels(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("path")), authors, derive.dominant_owners(authors, 0.2), derive.last_commits(touches(t)), F.lit("2001-11-20").cast("timestamp"))


@query(f"{_LABELS} SELECT path FROM labels_ WHERE label = 'Stranded'")
def stranded_files(t: Tables) -> DataFrame:
    return derive.stranded_files(_labels(t))


@query(f"{_LABELS} SELECT path, label FROM labels_ WHERE label IN ('Stranded', 'Unowned')")
def responsibility_gaps(t: Tables) -> DataFrame:
    return derive.responsibility_gaps(_labels(t))


@query(f"""{with_('imports')}, f AS (SELECT bool_or(module = 'Brand#2') AS o, bool_or(module = 'Brand#17') AS n FROM imports GROUP BY path)
SELECT count(*) FILTER (n AND NOT o) AS migrated, count(*) FILTER (o AND NOT n) AS not_migrated, count(*) FILTER (o AND n) AS straddling, round(count(*) FILTER (n AND NOT o) / count(*), 9) AS progress FROM f WHERE o OR n""")
def migration_progress(t: Tables) -> DataFrame:
    front = derive.migration_front(imports(t), F.col("module") == "Brand#2", F.col("module") == "Brand#17")
    return derive.migration_progress(front).withColumn("progress", F.round("progress", 9))


@query(f"{with_('imports')} SELECT module, count(*) AS importers FROM imports GROUP BY module")
def migratable_modules(t: Tables) -> DataFrame:
    return derive.migratable_modules(imports(t))


@query(f"""WITH {_SPANS}, one AS (SELECT DISTINCT path, line, point_id, key FROM hit WHERE n = 1) SELECT point_id, path, line, key AS function, round(p_retailprice, 3) AS fraction FROM one JOIN part ON key = p_partkey""")
def coverage_locate(t: Tables) -> DataFrame:
    spans, points = _spans_points(t)
    functions = spans.join(t.part.select(F.col("p_partkey").alias("key"), F.round("p_retailprice", 3).alias("fraction")), "key").select("path", "start", "end", "rank", F.col("key").alias("function"), "fraction")
    best = derive.innermost(points, functions.withColumn("key", F.struct("function", "fraction")))
    return best.select("point_id", "path", "line", "key.function", "key.fraction")


_TEST_RUNS = "runs AS (SELECT user_id AS run, count(*) FILTER (event_type IN ('view', 'click')) AS passed, count(*) FILTER (event_type = 'purchase') AS failed, CAST(user_id % 2 AS INT) AS code FROM events GROUP BY user_id)"


def _test_runs(t: Tables) -> DataFrame:
    verdict = F.when(F.col("event_type").isin("view", "click"), "passed").when(F.col("event_type") == "purchase", "failed")
    line = F.when(verdict.isNotNull(), F.concat(F.lit("✔ Test e"), F.col("event_id") % 7, F.lit(" "), verdict, F.lit(" after 0.1 s"))).otherwise("other output")
    listed = t.events.groupBy(F.col("user_id").alias("run")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).alias("ls"))
    return listed.select("run", F.array_join("ls.l", "\n").alias("transcript"), (F.col("run") % 2).cast("int").alias("exit_code"))


@query(f"WITH {_TEST_RUNS} SELECT run, CASE WHEN failed = 0 THEN CASE WHEN code = 0 THEN 'passed' WHEN passed > 0 THEN 'partial' ELSE 'failed' END WHEN passed > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM runs")
def test_outcomes(t: Tables) -> DataFrame:
    return derive.run_outcomes(_test_runs(t))


@query("SELECT user_id AS run, 'e' || (event_id % 7) AS method, arg_max(CASE WHEN event_type = 'purchase' THEN 'failed' ELSE 'passed' END, event_id) AS outcome FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2")
def test_methods(t: Tables) -> DataFrame:
    return derive.method_outcomes(_test_runs(t))


@query(f"""{with_('rel', 'refs', recursive=True)}, up(node, anc, d) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT node, anc // 3, d + 1 FROM up WHERE anc % 4 <> 0 AND anc > 0 AND d < 64), ty AS (SELECT node, anc AS ancestor FROM up WHERE anc % 4 = 0)
SELECT node, ancestor FROM ty""")
def enclosing_types(t: Tables) -> DataFrame:
    """Nearest ancestor that is a type, over chains of many steps: a node's parent is a third of its number, and every fourth number is a type."""
    n = t.customer.select(F.col("c_custkey").alias("child"))
    parents = n.where("child > 0").select("child", F.floor(F.col("child") / 3).alias("parent"))
    return graph.ancestor_of(parents, F.col("node") % 4 == 0).join(n.withColumnRenamed("child", "node"), "node", "left_semi")


@query("""WITH RECURSIVE d(node, parent, depth) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0 UNION ALL SELECT c_custkey, node, depth + 1 FROM d JOIN customer ON c_custkey // 2 = node AND c_custkey > 0) SELECT * FROM d""")
def deep_tree(t: Tables) -> DataFrame:
    """A tree whose depth grows with its size."""
    n = t.customer.select(F.col("c_custkey").alias("node")).where("node >= 0").unionByName(t.spark.range(1).select(F.col("id").alias("node"))).distinct()
    parents = n.where("node > 0").select(F.col("node").alias("child"), F.floor(F.col("node") / 2).alias("parent"))
    return graph.tree_rows(parents, n.withColumn("label", F.col("node").cast("string"))).select("node", "parent", "depth")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 0),
d(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT child, depth + 1 FROM d JOIN e ON parent = node), m AS (SELECT node, min(depth) AS depth FROM d GROUP BY node)
SELECT DISTINCT parent AS node, child FROM e JOIN m a ON parent = a.node JOIN m b ON child = b.node WHERE b.depth > a.depth""")
def outline_graph(t: Tables) -> DataFrame:
    n = t.customer.select(F.col("c_custkey").alias("node")).unionByName(t.spark.range(1).select(F.col("id").alias("node"))).distinct()
    up = lambda k: n.where("node > 0").select(F.col("node").alias("child"), F.floor(F.col("node") / k).alias("parent"))
    return graph.outline(up(2).unionByName(up(3)).distinct(), n.withColumn("label", F.col("node").cast("string"))).select("node", "child")


@query("""WITH RECURSIVE f(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT o FROM f JOIN (SELECT c_custkey AS a, c_custkey // 3 AS o FROM customer UNION SELECT c_custkey // 3, c_custkey FROM customer) ON a = node) SELECT node FROM f""")
def neighborhood_all(t: Tables) -> DataFrame:
    e = t.customer.select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 3).alias("dst"))
    return graph.neighborhood(e, t.spark.range(1, 2).select(F.col("id").alias("node")), None).select("node")


# ---- retrieval index


def _index(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(contents, windows, postings, locations) of the documents as blobs; the index is written once and read back."""
    from .fixtures import files

    f = files(t)
    contents = f.select("blob_hash", "text").where("text is not null")
    spark = t.spark
    out = f"{graph.shared_folder(spark)}/stratagraph/index-{abs(hash(t.dir))}-{spark.sparkContext.applicationId}"
    index.new_windows(contents, spark.createDataFrame([], "blob_hash string")).write.mode("overwrite").parquet(f"{out}/windows")
    windows = spark.read.parquet(f"{out}/windows")
    index.write_postings(index.postings(windows), f"{out}/postings")
    posts = spark.read.parquet(f"{out}/postings")
    return contents, windows, posts, f.select(F.lit("r").alias("repo"), "path", "blob_hash")


def _split_sql(x: str) -> str:
    once = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '(\\p{{N}})([^\\p{{N}} ])', '\\1 \\2', 'g'), '([^\\p{{N}} ])(\\p{{N}})', '\\1 \\2', 'g')"
    return once


def _windows_sql(most: int) -> str:
    cols = ", ".join(f"(len(list_filter(b, lambda x: x = '{q}')) + 0.4::DOUBLE * len(list_filter(s, lambda x: x = '{q}'))) AS t{i}" for i, q in enumerate(sorted(_Q)))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(_Q)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * length / average))" for i in range(len(_Q)))
    hit = " OR ".join(f"t{i} > 0" for i in range(len(_Q)))
    return f"""bl AS (SELECT DISTINCT blob_hash, text FROM files), li AS (SELECT blob_hash, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM bl),
wi AS (SELECT blob_hash, ordinal, array_to_string(list_transform(list_slice(ls, ordinal * 60 + 1, ordinal * 60 + 60), lambda x: regexp_replace(x, '\\r$', '')), chr(10)) AS body FROM (SELECT blob_hash, ls, unnest(range(CAST(ceil(len(ls) / 60) AS BIGINT))) AS ordinal FROM li)),
tk AS (SELECT blob_hash, ordinal, body, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_$]+') AS b, list_filter(list_transform(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}]+'), lambda x: {_split_sql(_split_sql('x'))}), lambda x: contains(x, ' ')) AS parts FROM wi),
sp AS (SELECT blob_hash, ordinal, body, b, regexp_extract_all(lower(array_to_string(parts, ' ')), '[\\p{{L}}\\p{{N}}_$]+') AS s FROM tk),
ct AS (SELECT blob_hash, ordinal, body, len(b) + len(s) AS length, {cols} FROM sp), st AS (SELECT count(*) AS n, avg(length) AS average, {df} FROM ct),
sc AS (SELECT blob_hash, ordinal, body, {score} AS score FROM ct, st WHERE {hit}),
lx AS (SELECT path, ordinal, body, score, row_number() OVER (ORDER BY round(score, 9) DESC, path, ordinal) AS rank FROM sc JOIN files USING (blob_hash) ORDER BY rank LIMIT {most}),
found AS (SELECT *, string_split(body, chr(10)) AS ls, list_position(list_transform(string_split(body, chr(10)), lambda x: {" OR ".join(f"contains(lower(x), '{q}')" for q in _Q)}), true) AS p FROM lx),
hits AS (SELECT path, ordinal * 60 + p AS line, score, array_to_string(list_slice(ls, greatest(1, p - 2), p + 2), chr(10)) AS snippet, row_number() OVER (ORDER BY rank) AS rank FROM found WHERE p > 0)"""


@query(f"""{with_('files')}, {_windows_sql(30)} SELECT CAST(rank AS INT) AS rank, path, CAST(line AS INT) AS line, round(score, 6) AS score, snippet FROM hits WHERE rank <= 10""")
def lexical_search(t: Tables) -> DataFrame:
    _, windows, posts, locations = _index(t)
    hits = index.lexical(windows, posts, index.window_stats(windows), locations, _Q, 10)
    return hits.select("rank", "path", "line", F.round("score", 6).alias("score"), "snippet")


_SEM = """sv AS (SELECT blob_hash, row_number() OVER (ORDER BY round(s, 9) DESC, blob_hash) AS rank FROM (SELECT blob_hash, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) AS s FROM (SELECT blob_hash, arg_min(embedding, vec_id) AS embedding FROM embeddings JOIN files ON vec_id = doc_id WHERE text <> '' GROUP BY blob_hash), q) ORDER BY rank LIMIT {n}),
se AS (SELECT rank, min(path) AS path FROM sv JOIN files USING (blob_hash) GROUP BY rank)"""


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(vectors, chunks): a document's vector is that of its only chunk."""
    from .fixtures import files

    f = files(t).where("text <> ''")
    v = f.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).groupBy("blob_hash").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    vectors = v.select("blob_hash", F.lit(0).alias("ordinal"), F.lit("m@1").alias("model"), "embedding")
    return vectors, v.select("blob_hash", F.lit(0).alias("ordinal"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))


@query(f"""{with_('files')}, {_VQ}, {_SEM.format(n=12)} SELECT CAST(rank AS INT) AS rank, path, 1 AS line FROM se""")
def semantic_search(t: Tables) -> DataFrame:
    from .fixtures import files

    vectors, chunks = _vectors(t)
    f = files(t)
    contents = f.select("blob_hash", "text").dropDuplicates(["blob_hash"])
    hits = index.semantic(vectors, chunks, f.select(F.lit("r").alias("repo"), "path", "blob_hash"), contents, "m@1", _first_vector(t), 12)
    return hits.select("rank", "path", "line")


@query(f"""{with_('files')}, {_windows_sql(60)}, {_VQ}, {_SEM.format(n=20)}, both_ AS (SELECT path, line, rank, 'lexical' AS resolution FROM hits WHERE rank <= 20 UNION ALL SELECT path, 1, rank, 'semantic' FROM se),
fu AS (SELECT path, (line - 1) // 60 AS bucket, sum(1 / (60.0::DOUBLE + rank)) AS score, arg_min(line, CASE WHEN resolution = 'lexical' THEN rank ELSE 1000 + rank END) AS line FROM both_ GROUP BY 1, 2)
SELECT CAST(rank AS INT) AS rank, 'r:' || path AS path, round(score, 9) AS score, CAST(line AS INT) AS line FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, path, line) AS rank FROM fu) WHERE rank <= 10""")
def hybrid_search(t: Tables) -> DataFrame:
    contents, windows, posts, locations = _index(t)
    vectors, chunks = _vectors(t)
    stats, q = index.window_stats(windows), _first_vector(t)
    found, _, _ = index.hybrid(lambda n: index.lexical(windows, posts, stats, locations, _Q, n), lambda n: index.semantic(vectors, chunks, locations, contents, "m@1", q, n), limit=10)
    return found.select("rank", F.col("at").alias("path"), F.round("score", 9).alias("score"), F.col("line").cast("int").alias("line"))


@query(f"""{with_('files')} SELECT doc_id % 3 AS repo, path, arg_max(blob_hash, doc_id % 10) AS blob_hash FROM (SELECT doc_id, 'p' || (doc_id // 30) AS path, blob_hash FROM files) WHERE doc_id % 10 IN (2, 5, 7) GROUP BY 1, 2""")
def blob_of_path(t: Tables) -> DataFrame:
    from .fixtures import files

    f = files(t).select((F.col("doc_id") % 3 * 10 + F.col("doc_id") % 10).alias("snapshot_id"), F.concat(F.lit("p"), F.floor(F.col("doc_id") / 30)).alias("path"), "blob_hash")
    snapshots = t.spark.range(30).select(F.floor(F.col("id") / 10).alias("repo"), F.col("id").alias("snapshot_id"))
    return index.blob_of_path(f, snapshots, snapshots.where("snapshot_id % 10 in (2, 5, 7)"))


@query(f"""{with_('files')} SELECT DISTINCT r AS repo, path, blob_hash FROM (SELECT doc_id % 3 AS r, doc_id % 10 AS s, path, blob_hash FROM files) JOIN (SELECT * FROM (VALUES (0, 7), (1, 7), (2, 7)) AS v(r, s)) USING (r, s)""")
def current_files(t: Tables) -> DataFrame:
    from .fixtures import files

    f = files(t).select((F.col("doc_id") % 3 * 10 + F.col("doc_id") % 10).alias("snapshot_id"), "path", "blob_hash")
    snapshots = t.spark.range(30).select(F.floor(F.col("id") / 10).alias("repo"), F.col("id").alias("snapshot_id"))
    return index.current_files(f, snapshots, snapshots.where("snapshot_id % 10 in (2, 5, 7)"))


@query(f"""{with_('files')}, have AS (SELECT DISTINCT blob_hash FROM files WHERE doc_id % 2 = 0) SELECT blob_hash, count(*) AS windows FROM (SELECT blob_hash, unnest(range(CAST(ceil(len(CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END) / 60) AS BIGINT))) AS o
FROM (SELECT DISTINCT blob_hash, text FROM files WHERE blob_hash NOT IN (SELECT blob_hash FROM have) AND text <> '')) GROUP BY blob_hash""")
def new_windows(t: Tables) -> DataFrame:
    from .fixtures import files

    f = files(t)
    w = index.new_windows(f.select("blob_hash", "text"), f.where("doc_id % 2 = 0").select("blob_hash"))
    return w.groupBy("blob_hash").agg(F.count(F.lit(1)).alias("windows"))


@query(f"""{with_('files')}, w AS (SELECT blob_hash, row_number() OVER (ORDER BY blob_hash) - 1 AS i FROM (SELECT DISTINCT blob_hash FROM files WHERE blob_hash NOT IN (SELECT blob_hash FROM files WHERE doc_id % 3 = 0))) SELECT blob_hash, CAST(i // 32 AS INT) AS batch FROM w WHERE i < 5000""")
def embedding_work(t: Tables) -> DataFrame:
    from .fixtures import files

    f = files(t)
    chunk = lambda d: d.select("blob_hash", F.lit(0).alias("ordinal")).distinct()
    return index.work_list(chunk(f), chunk(f.where("doc_id % 3 = 0")).withColumn("model", F.lit("m@1")), "m@1").select("blob_hash", "batch")


@query("SELECT vec_id AS blob_hash, CASE WHEN label = 0 THEN 'new' ELSE 'old' END AS embedding FROM embeddings WHERE label <= 5")
def put_vectors(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("blob_hash"), F.lit(0).alias("ordinal"), F.lit("m").alias("model"), "label")
    old, new = v.where("label between 1 and 5 or label = 0 and blob_hash % 2 = 0"), v.where("label = 0")
    both = index.put_vectors(old.select("blob_hash", "ordinal", "model", F.lit("old").alias("embedding")), new.select("blob_hash", "ordinal", "model", F.lit("new").alias("embedding")))
    return both.select("blob_hash", "embedding")
