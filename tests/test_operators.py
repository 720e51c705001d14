"""Invariants of the knowledge-graph operators on small graphs."""

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.operators import budget, derive, graph, manifest, search, temporal

VERSIONS = "entity_id long, state string, valid_from long, valid_to long"
EDGES = "id long, source_id long, target_id long, kind string, layer string, properties string, valid_from long, valid_to long"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_interval_is_half_open(spark):
    v = spark.createDataFrame([(1, "a", 1, 3), (1, "b", 3, None)], VERSIONS)
    assert [[r.state for r in temporal.as_of(v, x).collect()] for x in (0, 1, 2, 3, 9)] == [[], ["a"], ["a"], ["b"], ["b"]]
    assert [r.state for r in temporal.as_of(v).collect()] == ["b"]


def test_commit_is_idempotent_and_keeps_history(spark):
    v = spark.createDataFrame([(1, "loc=10", 1, None), (2, "x", 1, None), (3, "y", 1, 2)], VERSIONS)
    again = temporal.commit_entities(v, spark.createDataFrame([(1, "loc=10")], "entity_id long, state string"), v.limit(0), 5)
    assert rows(again, "entity_id") == rows(v, "entity_id")
    asserted = spark.createDataFrame([(1, "loc=99"), (3, "z"), (4, "n")], "entity_id long, state string")
    after = temporal.commit_entities(v, asserted, spark.createDataFrame([(2,)], "entity_id long"), 5)
    assert set(rows(after)) == {(1, "loc=10", 1, 5), (1, "loc=99", 5, None), (2, "x", 1, 5), (3, "y", 1, 2), (3, "z", 5, None), (4, "n", 5, None)}
    assert rows(temporal.as_of(after, 1).select("entity_id", "state"), "entity_id") == [(1, "loc=10"), (2, "x"), (3, "y")]


def test_edges_dedupe_and_close_with_their_ends(spark):
    e = spark.createDataFrame([(1, 10, 20, "imports", "observed", "", 1, None), (2, 10, 30, "imports", "observed", "", 1, None), (3, 20, 30, "builds", "observed", "", 1, None)], EDGES)
    asserted = e.where("id = 1").select(*temporal.EDGE_KEY).unionByName(spark.createDataFrame([(10, 20, "imports", "derived", "")], ", ".join(f"{c} {t}" for c, t in zip(temporal.EDGE_KEY, ("long", "long", "string", "string", "string")))))
    after = temporal.commit_edges(e, asserted, e.where("id = 2"), spark.createDataFrame([(30,)], "entity_id long"), 4)
    assert rows(after.where("id in (1, 2, 3)").select("id", "valid_to"), "id") == [(1, None), (2, 4), (3, 4)]
    assert rows(after.where("id not in (1, 2, 3)").select("layer", "valid_from", "valid_to")) == [("derived", 4, None)]
    bad = temporal.unknown_endpoints(asserted, spark.createDataFrame([(10,)], "id long"))
    assert bad.count() == 2


def test_diff_and_delta(spark):
    v = spark.createDataFrame([(1, "a", 1, 3), (1, "b", 3, None), (2, "c", 4, None), (3, "d", 1, 4), (4, "e", 9, None)], VERSIONS)
    assert rows(temporal.node_delta(v, 2, 5), "entity_id") == [(1, "changed"), (2, "added"), (3, "removed")]


def test_renames(spark):
    old = spark.createDataFrame([("a/x.py", "h1", 5), ("a/y.py", "h2", 5), ("a/e1", "h0", 0), ("b/k.py", "h3", 5), ("b/same.py", "h4", 1)], "path string, blob_hash string, size long")
    new = spark.createDataFrame([("b/x2.py", "h1", 5), ("c/y.py", "h9", 5), ("a/e2", "h0", 0), ("b/k.py", "h7", 5), ("b/same.py", "h4", 1)], "path string, blob_hash string, size long")
    d = manifest.manifest_diff(old, new)
    assert rows(d.select("path", "change"), "path") == [("a/e1", "removed"), ("a/e2", "added"), ("a/x.py", "removed"), ("a/y.py", "removed"), ("b/k.py", "modified"), ("b/x2.py", "added"), ("c/y.py", "added")]
    assert rows(manifest.renames(d), "old_path") == [("a/x.py", "b/x2.py", True), ("a/y.py", "c/y.py", False)]


def test_import_rollup_counts_files_of_every_folder(spark):
    i = spark.createDataFrame([("A/One", "Graphs", 1), ("A/B/Three", "Graphs", 2), ("A/Two", "Foundation", 3)], "path string, module string, observation_id long")
    assert rows(derive.import_rollup(i), "directory", "module") == [("", "Foundation", 1), ("", "Graphs", 2), ("A", "Foundation", 1), ("A", "Graphs", 2), ("A/B", "Graphs", 1)]
    assert rows(derive.rollup_provenance(i), "directory", "module", "observation_id") == [("", "Foundation", 3), ("", "Graphs", 1), ("", "Graphs", 2), ("A", "Foundation", 3), ("A", "Graphs", 1), ("A", "Graphs", 2), ("A/B", "Graphs", 2)]


def test_innermost_span(spark):
    spans = spark.createDataFrame([("f", 1, 200, 0, "outer"), ("f", 60, 70, 0, "inner"), ("f", 60, 70, 1, "later"), ("g", 1, 2, 0, "other")], "path string, start long, end long, rank int, key string")
    points = spark.createDataFrame([("f", 60, 1), ("f", 70, 2), ("f", 71, 3), ("f", 201, 4), ("g", 2, 5)], "path string, line long, point_id long")
    assert rows(derive.innermost(points, spans).select("point_id", "key"), "point_id") == [(1, "inner"), (2, "inner"), (3, "outer"), (5, "other")]


def test_owners(spark):
    t = spark.createDataFrame([("Ada.swift", "ada", "Ada", 1)] * 3 + [("Shared.swift", "ada", "Ada", 2), ("Shared.swift", "grace", "Grace", 3)], "path string, person string, name string, at long")
    a = derive.authorship(t)
    owners = derive.dominant_owners(a)
    assert rows(owners.select("path", "person")) == [("Ada.swift", "ada")]
    files = spark.createDataFrame([("Ada.swift",), ("Shared.swift",), ("New.swift",)], "path string")
    assert rows(derive.owner_labels(files, a, owners, derive.last_commits(t), F.lit(0)), "path") == [("Ada.swift", "ada"), ("New.swift", "Unowned"), ("Shared.swift", "Shared")]
    assert rows(derive.owner_labels(files, a, owners, derive.last_commits(t), F.lit(3)), "path")[0][1] == "Stranded"


@pytest.fixture(scope="module")
def ring(spark):
    return spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 2.0), ("d", "e", 1.0), ("e", "e", 1.0)], "src string, dst string, weight double")


def test_neighborhood(spark, ring):
    one = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.neighborhood(ring, one, 0)) == [("a", 0)]
    assert rows(graph.neighborhood(ring, one, 1), "node") == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(graph.neighborhood(ring, one, None), "node") == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]


def test_pagerank_keeps_its_mass(spark, ring):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    r = dict(rows(graph.pagerank(nodes, ring)))
    assert abs(sum(r.values()) - 1) < 1e-9 and r["e"] > r["d"] > r["f"]
    p = dict(rows(graph.pagerank(nodes, ring, seeds=spark.createDataFrame([("d",)], "node string"))))
    assert p["f"] == 0 and p["a"] == 0 and abs(sum(p.values()) - 1) < 1e-9


def test_strong_components_and_cycles(spark, ring):
    c = graph.strong_components(ring)
    assert rows(c, "node") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")]
    assert rows(graph.cyclic_edges(ring, c), "src", "dst") == [("a", "b"), ("b", "c"), ("c", "a"), ("e", "e")]


def test_shortest_paths_against_a_plain_search(spark):
    import random

    rng = random.Random(5)
    for n, m in ((12, 20), (30, 45), (25, 90)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        df = graph.settled(spark.createDataFrame(sorted(pairs) + sorted(pairs)[:3], "src int, dst int"))

        def far(start, edges):
            dist, front = {start: 0}, [start]
            for x in front:
                for y in sorted(b for a, b in edges if a == x and b not in dist):
                    dist[y] = dist[x] + 1
                    front.append(y)
            return dist

        for start, goal in ((0, n - 1), (1, n // 2)):
            a, b = far(start, pairs), far(goal, {(y, x) for x, y in pairs})
            plain = [] if goal not in a else sorted(((x, y, a[x]) for x, y in pairs if x in a and y in b and a[x] + 1 + b[y] == a[goal]), key=lambda r: (r[2], r[0], r[1]))
            assert [tuple(r) for r in graph.shortest_path_edges(df, start, goal).orderBy("position", "src", "dst").collect()] == plain


def test_shortest_paths(spark, ring):
    two = ring.unionByName(spark.createDataFrame([("a", "x", 1.0), ("x", "c", 1.0)], ring.schema))
    assert rows(graph.shortest_path_edges(two, "a", "d")) == [("a", "b", 0), ("a", "x", 0), ("b", "c", 1), ("x", "c", 1), ("c", "d", 2)]
    assert rows(graph.shortest_path_edges(two, "e", "a")) == [] and rows(graph.shortest_path_edges(two, "a", "a")) == []


def test_roles(spark, ring):
    assert dict((n, r) for n, _, _, r in rows(graph.roles(ring, 1))) == {"a": "Hub", "b": "Hub", "c": "Hub", "d": "Hub", "e": "Core"}


@pytest.mark.parametrize("name,parts", [("HTTPClient", ["HTTP", "Client"]), ("json2string", ["json", "2", "string"]), ("snake_case$x", ["snake", "case", "x"]), ("camelCaseURL", ["camel", "Case", "URL"])])
def test_identifier_parts(spark, name, parts):
    assert spark.createDataFrame([(name,)], "x string").select(X.identifier_parts(F.col("x"))).first()[0] == parts


def test_text_functions(spark):
    df = spark.createDataFrame([("one\r\ntwo\n", "./a/../b//c"), ("", "x"), ("a\n\n", "..")], "t string, p string")
    assert [r[0] for r in df.select(X.lines(F.col("t"))).collect()] == [["one", "two"], [], ["a", ""]]
    assert [r[0] for r in df.select(X.normalised_path(F.col("p"))).collect()] == ["b/c", "x", ""]
    q = spark.range(1).select(X.query_terms(F.lit("fetchUser user HTTPClient")).alias("q"), X.token_estimate(F.lit("ééé")).alias("n"), X.program_of(F.lit("A=1 $(CC) -c x")).alias("p"), X.program_of(F.lit("/usr/bin/swift test")).alias("s")).first()
    assert (q.q, q.n, q.p, q.s) == (["fetchUser", "fetch", "User", "HTTPClient", "HTTP", "Client"], 2, "CC", "swift")
    w = spark.createDataFrame([("\n".join(map(str, range(1, 131))),)], "t string").select(F.explode(X.windows(F.col("t"))).alias("w")).select("w.ordinal", "w.start_line")
    assert rows(w) == [(0, 1), (1, 61), (2, 121)]
    span = spark.range(1).select(X.read_span(F.lit("a\nb\nc"), F.lit(2), F.lit(9)).alias("s")).first().s
    assert (span.start, span.end, span.total, span.body) == (2, 3, 3, "b\nc")


def test_paths_by_name(spark):
    df = spark.createDataFrame([("Sources/App/FooViewModel.swift",), ("Tests/X/FooTests.swift",), ("lib/UserStore.py",), ("a/Views/x.swift",), ("main.c",)], "p string")
    assert [r[0] for r in df.select(X.pattern_role(F.col("p"), F.lit("file"))).collect()] == ["ViewModels", "Tests", "Stores", "Views", "Other"]
    assert [r[0] for r in df.select(X.language(F.col("p"))).collect()] == ["swift", "swift", "python", "swift", "c"]
    assert [r[0] for r in df.select(X.area(F.col("p"))).collect()] == ["Sources/App", "Tests/X", "lib", "a", ""]


def test_bm25_prefers_rare_terms(spark):
    d = spark.createDataFrame([(1, "alpha beta common"), (2, "common common"), (3, "beta common"), (4, "nothing here")], "id long, body string")
    got = search.top(search.bm25(d, ["id"], ["alpha", "beta"], split=None), 5, F.desc("score"), F.col("id"))
    assert [r.id for r in got.orderBy("rank").collect()] == [1, 3]


def test_fusion_merges_hits_of_one_window(spark):
    lists = spark.createDataFrame([(1, 1, "a", 10, "lexical"), (1, 2, "b", 1, "lexical"), (2, 1, "a", 55, "semantic"), (2, 2, "c", 1, "semantic")], "list int, rank int, path string, line int, resolution string")
    got = search.fuse(lists, 10).orderBy("rank").collect()
    assert [(r.path, r.line, r.resolution) for r in got] == [("a", 10, "lexical"), ("b", 1, "lexical"), ("c", 1, "semantic")] and abs(got[0].score - 2 / 61) < 1e-12


def test_budgets_hold(spark):
    c = spark.createDataFrame([(1, i, "x" * 30 * (1 + i % 3)) for i in range(20)], "g long, i int, body string")
    for most in (60, 100, 200, 1000):
        kept = budget.prefix_admit(c, ["g"], [F.col("i")], X.token_estimate(F.col("body")), most)
        assert (kept.agg(F.coalesce(F.max("spent"), F.lit(0))).first()[0]) <= most - budget.RESERVE
        shown = budget.admit_with_citations(c, ["g"], F.col("i"), F.lit("cite:1"), F.col("body"), most).first().shown
        assert sum(2 + (len(s.body) // 3 if s.body else 0) for s in shown) <= most - budget.RESERVE


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, 3.0])], "vec_id long, embedding array<double>").withColumn("embedding", X.normalised(F.col("embedding")))
    got = search.vector_top(v, [0.6, 0.8], 2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3] and abs(got[0].score - 1) < 1e-12


def test_innermost_spans_of_any_length_and_place(spark):
    """Long spans and many of them at one line: a span has a few rows however long it is, and a line meets only the best span of each block."""
    import random

    rng = random.Random(7)
    spans = [("f", s := rng.randint(-300, 300), s + rng.randint(-2, 200), rng.randint(0, 2), k) for k in range(120)] + [("g", 1, 10**12, 0, 500), ("g", 5, 10**12, 0, 501), ("g", 7, 7, 9, 502)]
    points = [("f", rng.randint(-320, 520), i) for i in range(300)] + [("g", 7, 900), ("g", 10**12, 901), ("g", 4, 902), ("g", 4, 902), ("g", 0, 903)]
    want = {}
    for path, line, i in points:
        best = min(((e - s, rank, key, s, e) for p, s, e, rank, key in spans if p == path and s <= line <= e), default=None)
        if best:
            want[path, line, i] = best[2:]
    got = derive.innermost(spark.createDataFrame(points, "path string, line long, point_id long"), spark.createDataFrame(spans, "path string, start long, end long, rank int, key long")).collect()
    assert len(got) == len(want) and {(r.path, r.line, r.point_id): (r.key, r.start, r.end) for r in got} == want


def test_reach_and_outline_of_deep_graphs(spark):
    """Reach over chains longer than what is read as one table; the outline's plan doesn't grow with the depth."""
    import random

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(24)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(90)] + [(5, 100)]
    df = spark.createDataFrame(edges, "src long, dst long")
    for directed in (True, False):
        near, front, step = {0: 0, 110: 0}, {0, 110}, 0
        while front:
            step += 1
            front = {d for s, d in (edges if directed else edges + [(d, s) for s, d in edges]) if s in front} - near.keys()
            near |= dict.fromkeys(front, step)
        got = graph.neighborhood(df, spark.createDataFrame([(0,), (110,), (110,)], "node long"), None, directed).collect()
        assert len(got) == len(near) and {r.node: r.distance for r in got} == near
    labels = spark.createDataFrame([(i, str(i)) for i in range(25)], "node long, label string")
    shown = graph.outline(spark.createDataFrame([(i + 1, i) for i in range(24)] + [(3, 9)], "child long, parent long"), labels)
    assert sorted((r.node, r.child) for r in shown.collect()) == [(i, i + 1) for i in range(24)]
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") < 12
    rows = graph.tree_rows(spark.createDataFrame([(i + 1, i) for i in range(24)], "child long, parent long"), labels).collect()
    assert {r.node: (r.parent, r.depth, r.path) for r in rows} == {i: (i - 1 if i else None, i, [str(x) for x in range(i + 1)]) for i in range(25)}


def test_components_by_groups_are_those_without(spark):
    import random

    rng = random.Random(5)
    edges = [(g, g * 100 + rng.randrange(25), g * 100 + rng.randrange(25)) for g in range(5) for _ in range(12 * g)]
    df = spark.createDataFrame(edges, "g long, src long, dst long")
    nodes = {x for _, s, d in edges for x in (s, d)}
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for _, s, d in edges:
            for x in nodes:
                if s in reach[x]:
                    reach[x].add(d)
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in nodes}
    for found in (graph.strong_components(df.select("src", "dst")), graph.strong_components(df, "g")):
        got = found.collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_rollup_supports_are_neither_shuffled_nor_sorted(spark):
    from stratagraph.operators import incremental

    seen = spark.createDataFrame([("/x", "M"), ("/x", "M"), ("a/b/c", "M"), ("a/b/d", "M"), (None, "M")], "path string, module string")
    rows = incremental.import_supports(seen, "q")
    assert sorted(r.stable_key for r in rows.where("path = '/x'").collect()) == ["dependsOn|q||M"]
    found = incremental.facts(rows)
    assert {(r.stable_key, r.state, r.n) for r in found.collect()} == {("dependsOn|q||M", "3", 3), ("dependsOn|q|a|M", "2", 2), ("dependsOn|q|a/b|M", "2", 2)}
    said = spark.createDataFrame([("p", "k", "b"), ("r", "k", "a"), ("s", "k", None)], "path string, stable_key string, state string")
    changes = incremental.support_changes(said.where("path <> 'p'"), said.where("path = 'p'"))
    assert [tuple(r) for r in changes.collect()] == [("k", -1, "b")]
    above = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0].count("Aggregate [")
    assert above(rows) == 0 and above(found) == 2  # by key and state, then the few rows by key


def _tasks(df, *keys):
    """Numbers of tasks that a plan deals its rows to by these keys."""
    import re

    return [int(n) for n in re.findall(", ".join(rf"{k}#\d+L?" for k in keys) + r", (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]


def test_a_table_of_many_rows_is_dealt_to_more_tasks(spark, tmp_path):
    from stratagraph.plans.fixtures import Tables

    spark.range(101).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    assert [t.tasks("lineitem", n) for n in (10, 25, 26, 1000)] == [11, 5, None, None]  # on 4 cores


def test_reference_pairs_are_read_once_and_dealt_to_tasks(spark):
    seen = [("a", "x", i % 5) for i in range(12)] + [("a", "y", 9), (None, "y", 7), (None, "y", 3)]
    df = spark.createDataFrame(seen, "from_path string, to_path string, observation_id long")
    want = [(None, "y", 2, [3, 7]), ("a", "x", 12, [0, 0, 0, 1]), ("a", "y", 1, [9])]
    for tasks in (None, 7):
        got = derive.reference_pairs(df, 4, tasks)
        assert rows(got, "from_path", "to_path") == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and _tasks(got, "from_path", "to_path") == [7]  # one branch, no count joined to a list


def test_coverage_is_dealt_to_tasks(spark):
    seen = [(1, 1, 1, 4, 1), (1, 1, 2, 5, 0), (1, 2, 1, 5, 1), (2, 1, 1, 4, 0), (None, 1, 1, 4, 1)]
    df = spark.createDataFrame(seen, "path long, function long, start long, end long, hits long")
    for tasks in (None, 7):
        one = derive.coverage_functions(df, tasks)
        got = derive.coverage_merge(one.drop("function"), one.drop("function").where("path = 2").withColumn("fraction", F.lit(0.25)), tasks=tasks)
        assert rows(got, "path") == [(None, 1, 4, 1.0), (1, 1, 5, 1.0), (2, 1, 4, 0.25)]
    assert _tasks(got, "path", "function") == [7, 7] and _tasks(got, "path", "start", "end") == [7]  # no exchange by the session's number
