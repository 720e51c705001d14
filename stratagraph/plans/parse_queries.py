"""Registered queries over parsers, resolvers and scalar functions: texts of code and builds are made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import render
from ..functions import text as X
from ..operators import layout, resolve
from ..sources import documents, parsers, readers
from .fixtures import Tables, files, with_
from .queries import query


def _code(t: Tables, lang: str, text: Column, ext: str) -> DataFrame:
    return t.part.select(F.col("p_partkey").cast("string").alias("blob_hash"), F.concat(F.lit("src/p"), "p_partkey", F.lit(f".{ext}")).alias("path"), F.lit(lang).alias("lang"), text.alias("text"))


def _seen(blobs: DataFrame) -> DataFrame:
    return parsers.extract(blobs).select(F.col("blob_hash").cast("long").alias("part"), "kind", "name", "decl_kind", "decl_path", "start", "end")


_WIDE = 'SELECT p_partkey AS part, k AS kind, n AS name, dk AS decl_kind, dp AS decl_path, CAST(a AS INT) AS start, CAST(b AS INT) AS "end" FROM part, LATERAL (VALUES {rows}) AS v(k, n, dk, dp, a, b)'


@query(_WIDE.format(rows="""('importStatement', 'm' || p_size, NULL, NULL, 1, 1), ('importStatement', 'pkg.q', NULL, NULL, 2, 2), ('declaration', 'C' || p_partkey, 'type', 'C' || p_partkey, 4, 6), ('declaration', 'run', 'function', 'C' || p_partkey || '.run', 5, 6), ('declaration', 'last', 'function', 'last', 9, 9)"""))
def python_extract(t: Tables) -> DataFrame:
    """Every file has a broken line before its last function."""
    text = F.concat(F.lit("import m"), "p_size", F.lit("\nfrom pkg.q import r\n\nclass C"), "p_partkey", F.lit(":\n    def run(self):\n        return 1\n\nthis is (no python\ndef last(): pass\n"))
    return _seen(_code(t, "python", text, "py"))


@query(_WIDE.format(rows="""('importStatement', 'Kit' || p_size, NULL, NULL, 1, 1), ('declaration', 'S' || p_partkey, 'type', 'S' || p_partkey, 2, 6), ('declaration', 'x', 'variable', 'S' || p_partkey || '.x', 3, 3), ('declaration', 'f(a:_:)', 'function', 'S' || p_partkey || '.f(a:_:)', 4, 5), ('declaration', 'g()', 'function', 'S' || p_partkey || '.g()', 7, 7)"""))
def swift_extract(t: Tables) -> DataFrame:
    text = F.concat(F.lit("import Kit"), "p_size", F.lit("\nstruct S"), "p_partkey", F.lit(" {\n  var x: Int\n  func f(a: Int, _ b: Int) {\n    let y = \"}\" }\n}\nextension S"), "p_partkey", F.lit(" { func g() {} }\n"))
    return _seen(_code(t, "swift", text, "swift"))


@query(_WIDE.format(rows="""('importStatement', 'stdio.h', NULL, NULL, 1, 1), ('importStatement', 'p' || p_size || '.h', NULL, NULL, 2, 2), ('declaration', 's' || p_partkey, 'type', 's' || p_partkey, 3, 3), ('declaration', 'main', 'function', 'main', 4, 6)"""))
def c_extract(t: Tables) -> DataFrame:
    text = F.concat(F.lit('#include <stdio.h>\n#include "p'), "p_size", F.lit('.h"\nstruct s'), "p_partkey", F.lit(" { int a; };\nint main(void) {\n  if (1) { return 0; }\n}\n"))
    return _seen(_code(t, "c", text, "c"))


@query(_WIDE.format(rows="""('importStatement', 'std::io', NULL, NULL, 1, 1), ('declaration', 'm' || p_partkey, 'type', 'm' || p_partkey, 2, 4), ('declaration', 'f', 'function', 'm' || p_partkey || '.f', 3, 3), ('declaration', 'T', 'interface', 'T', 5, 5)"""))
def rust_extract(t: Tables) -> DataFrame:
    text = F.concat(F.lit("use std::io;\nmod m"), "p_partkey", F.lit(" {\n  pub fn f() { let x = \"{\"; }\n}\npub trait T {}\n"))
    return _seen(_code(t, "rust", text, "rs"))


def _makefiles(t: Tables) -> DataFrame:
    """A Makefile a nation: a target a customer, which needs its half and a file."""
    line = F.concat(F.lit("c"), "c_custkey", F.lit(": c"), F.floor(F.col("c_custkey") / 2), F.lit(" $(SRC) x"), "c_custkey", F.lit("\n\t@echo "), "c_name")
    rows = t.customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    return rows.select(F.concat(F.lit("n"), "c_nationkey", F.lit("/Makefile")).alias("path"), F.concat(F.lit("SRC = a.c \\\n  b.c\n.PHONY: c1\n"), "b", F.lit("\n")).alias("text"))


@query("""SELECT 'n' || c_nationkey || '/Makefile' AS path, 'c' || c_custkey AS target, d AS dependency, CAST(i AS INT) AS position, c_custkey = 1 AS phony, ['echo ' || c_name] AS steps
FROM customer, LATERAL (VALUES (NULL, 0), ('c' || c_custkey // 2, 1), ('a.c', 2), ('b.c', 3), ('x' || c_custkey, 4)) AS v(d, i)""")
def make_rules(t: Tables) -> DataFrame:
    return parsers.build_observations(_makefiles(t)).select("path", "target", "dependency", "position", "phony", "steps")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, 'build:target:r/n' || c_nationkey || '/Makefile#c' AS k FROM customer)
SELECT k || c.c_custkey AS source_key, 'build:target:r/n' || c.c_nationkey || '/Makefile#c' || h.c_custkey AS target_key FROM c JOIN customer h ON h.c_custkey = c.c_custkey // 2 AND h.c_nationkey = c.c_nationkey
UNION ALL SELECT k || c_custkey, 'phys:file:r/n' || c_nationkey || '/a.c' FROM c UNION ALL SELECT k || c_custkey, 'phys:file:r/b.c' FROM c""")
def build_dependencies(t: Tables) -> DataFrame:
    """A sibling target, a file beside the Makefile, a file at the root, or nothing."""
    there = t.nation.select(F.concat(F.lit("n"), "n_nationkey", F.lit("/a.c")).alias("path")).unionByName(t.region.select(F.lit("b.c").alias("path")).distinct())
    return resolve.build_edges(parsers.build_observations(_makefiles(t)), there, "r")[1].select("source_key", "target_key")


@query("""SELECT 'phys:file:r/.github/workflows/w' || c_nationkey || '.yml' AS source_key, 'build:target:r/fastlane/Fastfile#l' || max(c_custkey % 7) AS target_key FROM (SELECT c_nationkey, c_custkey FROM customer) GROUP BY c_nationkey, c_custkey""".replace("GROUP BY c_nationkey, c_custkey", "GROUP BY c_nationkey, c_custkey % 7"))
def lane_invocations(t: Tables) -> DataFrame:
    fast = t.region.limit(1).select(F.lit("fastlane/Fastfile").alias("path"), F.lit("".join(f"lane :l{i} do\n  build\nend\n" for i in range(7))).alias("text"))
    line = F.concat(F.lit("      run: bundle exec fastlane l0 --then l"), F.col("c_custkey") % 7)
    flows = t.customer.groupBy("c_nationkey").agg(F.array_join(F.collect_list(line), "\n").alias("b")).select(F.concat(F.lit(".github/workflows/w"), "c_nationkey", F.lit(".yml")).alias("path"), F.concat(F.lit("# fastlane l1\n"), "b").alias("text"))
    return resolve.invoked_lanes(parsers.build_observations(flows.unionByName(fast)), "r").select("source_key", "target_key")


_TREE = "t AS (SELECT doc_id, source, lang, path FROM (SELECT f.doc_id, d.source, d.lang, f.path FROM files f JOIN documents d USING (doc_id)))"


@query(f"""{with_('files')}, {_TREE} SELECT DISTINCT 'phys:repo:r' AS source_key, 'phys:dir:r/' || source AS target_key FROM t UNION ALL SELECT DISTINCT 'phys:dir:r/' || source, 'phys:dir:r/' || source || '/' || lang FROM t UNION ALL SELECT 'phys:dir:r/' || source || '/' || lang, 'phys:file:r/' || path FROM t""")
def physical_tree(t: Tables) -> DataFrame:
    return resolve.physical_tree(files(t).select("path"), "r")[1].select("source_key", "target_key")


def _declared(t: Tables) -> DataFrame:
    """Three declarations a part: A, A.b and A.b.c of parts with an even number; the middle one is missing for the others."""
    one = lambda p, n: t.part.select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.lit("swift").alias("lang"), F.lit("declaration").alias("kind"), F.lit(n).alias("name"), F.lit("type").alias("decl_kind"), F.lit(p).alias("decl_path"), F.lit(1).alias("start"), "p_partkey")
    return one("A", "A").unionByName(one("A.b", "b").where("p_partkey % 2 = 0")).unionByName(one("A.b.c", "c")).drop("p_partkey")


@query("""WITH k AS (SELECT p_partkey, 'swift:decl:r/f' || p_partkey || '#' AS k FROM part) SELECT 'phys:file:r/f' || p_partkey AS source_key, k || 'A' AS target_key FROM k
UNION ALL SELECT k || 'A', k || 'A.b' FROM k WHERE p_partkey % 2 = 0 UNION ALL SELECT k || CASE WHEN p_partkey % 2 = 0 THEN 'A.b' ELSE 'A' END, k || 'A.b.c' FROM k""")
def lexical_parents(t: Tables) -> DataFrame:
    return resolve.declarations(_declared(t), "r")[1].select("source_key", "target_key")


@query("SELECT DISTINCT 'phys:file:r/c' || o_custkey AS source_key, 'python:module:m' || l_partkey % 50 AS target_key FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def import_edges(t: Tables) -> DataFrame:
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    seen = j.select(F.concat(F.lit("c"), "o_custkey").alias("path"), F.lit("python").alias("lang"), F.lit("importStatement").alias("kind"), F.concat(F.lit("m"), F.col("l_partkey") % 50).alias("name"))
    return resolve.import_edges(seen, "r")[1].select("source_key", "target_key")


@query("""SELECT 'f' || p_partkey AS path, p_size / 100.0::DOUBLE AS fraction FROM part""")
def coverage_files(t: Tables) -> DataFrame:
    return readers.coverage(_coverage_json(t))[0].select("path", F.round("fraction", 9).alias("fraction"))


def _coverage_json(t: Tables) -> DataFrame:
    """Coverage exports: a report of every 500 parts, as a test target exports its own files. A report is one text, so larger tables have more of them, not larger ones."""
    report = lambda key: F.floor(F.col(key) / 500).alias("report")
    one = F.to_json(F.struct(F.concat(F.lit("f"), "p_partkey").alias("filename"), F.struct(F.struct(F.col("p_size").cast("double").alias("percent")).alias("lines")).alias("summary")))
    region = F.array(F.col("l_linenumber"), F.lit(1), F.col("l_linenumber") + 3, F.lit(2), (F.col("l_quantity") > 25).cast("int"))
    fn = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.to_json(F.struct(F.array(F.concat(F.lit("f"), F.first("l_partkey"))).alias("filenames"), F.concat(F.lit("g"), F.first("l_suppkey")).alias("name"), F.collect_list(region).alias("regions"))).alias("j"))
    a = t.part.groupBy(report("p_partkey")).agg(F.array_join(F.collect_list(one), ",").alias("a"))
    b = fn.groupBy(report("l_partkey")).agg(F.array_join(F.collect_list("j"), ",").alias("b"))
    none = F.lit("")
    return a.join(b, "report", "full").select(F.concat(F.lit('{"data":[{"files":['), F.coalesce("a", none), F.lit('],"functions":['), F.coalesce("b", none), F.lit("]}]}")).alias("json"))


@query("SELECT 'f' || l_partkey AS path, 'g' || l_suppkey AS function, count(*) AS regions, sum(l_linenumber + 3) AS ends, count(*) FILTER (l_quantity > 25) AS covered FROM lineitem GROUP BY 1, 2")
def coverage_regions(t: Tables) -> DataFrame:
    return readers.coverage(_coverage_json(t))[1].groupBy("path", "function").agg(F.count(F.lit(1)).alias("regions"), F.sum("end").alias("ends"), F.count_if(F.col("hits") > 0).alias("covered"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'o' || s_nationkey || '/' || replace(s_name, '#', '-') END AS slug, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) || '@x.org' ELSE s_name END AS identity,
'src/n' || s_nationkey || '/x.c' AS normal, 'src/n' || s_nationkey AS area, 'tool' || s_suppkey AS program, s_suppkey % 4 = 0 AS prose, 'phys:file:r/a' || s_suppkey AS key, 'a' || s_suppkey AS path FROM supplier""")
def path_functions(t: Tables) -> DataFrame:
    url = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("git@github.com:o"), "s_nationkey", F.lit("/"), F.translate("s_name", "#", "-"), F.lit(".git"))).otherwise("https://example.org/a/b")
    email = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), "s_name", F.lit("@X.org"))).otherwise("  ")
    raw = F.concat(F.lit("./src/y/../n"), "s_nationkey", F.lit("/./x.c"))
    command = F.concat(F.lit("A=1 B_2=x /usr/bin/tool"), "s_suppkey", F.lit(" -x"))
    line = F.when(F.col("s_suppkey") % 4 == 0, "   // note").otherwise("x = 1  // note")
    key = model.file_key(F.lit("r"), F.concat(F.lit("a"), "s_suppkey"))
    return t.supplier.select("s_suppkey", documents.remote_slug(url).alias("slug"), model.identity(email, F.col("s_name")).alias("identity"), X.normalised_path(raw).alias("normal"), X.area(X.normalised_path(raw)).alias("area"), X.program_of(command).alias("program"), X.is_prose(line).alias("prose"), key.alias("key"), model.path_of_key(key, "r").alias("path"))


@query("""SELECT s_suppkey, 'r/p' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ':5-9' ELSE ':5' END AS citation, 'p' || s_suppkey || ':5  ' || s_name || '  derived/compiler  ' || s_nationkey || ' reference(s), 2 call(s)' AS reference, '{"a":"1","b":"' || s_nationkey || '"}' AS json,
CASE WHEN s_suppkey % 2 = 0 THEN '— shown 1 of 2 (truncated).' ELSE '' END AS footer, round(0.5 * (1 + 0.55 * pow(s_nationkey, 1.0 / 3)), 9) AS radius FROM supplier""")
def rendered_lines(t: Tables) -> DataFrame:
    from ..operators import budget

    path, end = F.concat(F.lit("p"), "s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, 9).otherwise(5)
    bag = F.create_map(F.lit("b"), F.col("s_nationkey").cast("string"), F.lit("a"), F.lit("1"))
    return t.supplier.select("s_suppkey", render.citation(F.lit("r"), path, F.lit(5), end).alias("citation"), render.reference(path, F.lit(5), F.col("s_name"), F.col("s_nationkey"), F.lit(2)).alias("reference"), model.canonical_json(bag).alias("json"), budget.footer(F.lit(1), F.when(F.col("s_suppkey") % 2 == 0, 2).otherwise(1)).alias("footer"), F.round(layout.node_radius(F.col("s_nationkey")), 9).alias("radius"))


@query("""SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding, CAST(NULL AS INT) AS short FROM embeddings""")
def vector_codec(t: Tables) -> DataFrame:
    from ..operators import index

    data = t.embeddings.select("vec_id", index.encode_vector(F.col("embedding")).alias("data"))
    return data.select("vec_id", F.transform(index.decode_vector(F.col("data"), 64), lambda x: x.cast("double")).alias("embedding"), F.size(F.nullif(index.decode_vector(F.col("data"), 63), F.array().cast("array<float>"))).cast("int").alias("s")).select("vec_id", "embedding", F.when(F.col("s") > 0, F.col("s")).alias("short"))


@query("""SELECT source AS repo, doc_id % 5 AS fingerprint, doc_id AS snapshot_id FROM documents WHERE doc_id % 3 <> 0""")
def stale_enrichments(t: Tables) -> DataFrame:
    from ..streaming.watch import stale_enrichments as stale

    w = t.documents.select(F.col("source").alias("repo"), (F.col("doc_id") % 5).alias("fingerprint"), F.col("doc_id").alias("snapshot_id"))
    return stale(w, w.where("snapshot_id % 3 = 0"))
