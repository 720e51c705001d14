"""The store, lookups, the retrieval index, tools and document sources."""

import pytest
from pyspark.sql import functions as F

from stratagraph import cli
from stratagraph.operators import graph, index, lookups, scenes, store
from stratagraph.plans import generator, tools
from stratagraph.plans.workspace import Workspace
from stratagraph.sources import documents, parsers
from stratagraph.streaming import watch


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _edge(spark, *ends):
    return _rows(spark, [(a, b, "imports", "observed", "{}") for a, b in ends], "source_id long, target_id long, kind string, layer string, properties string")


def test_commit_is_all_or_nothing(spark):
    s = store.MemoryStore(spark)
    s.commit(store.Changes(entities=_rows(spark, [(1, "A", 0), (1, "later", 1), (2, "B", 0)], "entity_id long, state string, position int"), edges=_edge(spark, (1, 2))))
    assert {(r.entity_id, r.state) for r in s.tables().versions.collect()} == {(1, "A"), (2, "B")}
    with pytest.raises(store.UnknownEntity):
        s.commit(store.Changes(edges=_edge(spark, (1, 9))))
    with pytest.raises(store.UnknownEntity):
        s.commit(store.Changes(gone=_rows(spark, [(9,)], "entity_id long")))
    with pytest.raises(store.UnknownRelationship):
        s.commit(store.Changes(closed=_rows(spark, [(12345,)], "id long")))
    assert s.revision() == 1
    s.commit(store.Changes(gone=_rows(spark, [(2,)], "entity_id long")))
    assert s.tables().edges.where("valid_to is null").count() == 0 and s.tables(1).edges.where("valid_to is null").count() == 1
    with pytest.raises(store.UnknownEntity):  # an edge to an entity that is gone
        s.commit(store.Changes(edges=_edge(spark, (1, 2))))


def test_derivers_and_repositories(spark):
    s = store.MemoryStore(spark)
    s.commit(store.Changes(entities=_rows(spark, [(1, "A")], "entity_id long, state string")))

    @store.deriver("twice")
    def _(tables, revision):
        return store.Changes(entities=tables.versions.where("valid_to is null").select((F.col("entity_id") * 2).alias("entity_id"), "state"))

    assert store.derive_all(s) == 2 and {r.entity_id for r in s.tables().versions.collect()} == {1, 2}
    store.DERIVERS.clear()
    t = store.upsert_repository(store.empty(spark), _rows(spark, [("r", "Old")], "repo string, display_name string"))
    t = store.upsert_repository(t, _rows(spark, [("r", "New"), ("q", "Q")], "repo string, display_name string"))
    assert {tuple(r) for r in t.repositories.collect()} == {("r", "New"), ("q", "Q")}
    assert lookups.resolve_repository(t.repositories, "New") == "r" == lookups.resolve_repository(t.repositories, "r")
    with pytest.raises(lookups.UnknownRepository):
        lookups.resolve_repository(t.repositories, "none")
    seen = _rows(spark, [("a", "k", "x"), ("a", "k", "x"), ("b", "k", None)], "path string, kind string, payload string")
    t, _ = store.record_observations(t, seen)
    t, _ = store.record_observations(t, seen)
    assert t.observations.count() == 2


def test_workspace_is_retried_after_a_crash(spark, tmp_path, monkeypatch):
    code = tmp_path / "c++(x)"
    code.mkdir()
    (code / "a.py").write_text("import os\ndef f(): pass\n")
    w = Workspace(spark, f"file://{tmp_path}/ws")
    with monkeypatch.context() as m:
        m.setattr(Workspace, "_facts", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            w.index("r", f"file://{code}")
    assert w.revision() == 0 and w.index("r", f"file://{code}") == 1
    asked = []
    real = parsers.extract
    monkeypatch.setattr(parsers, "extract", lambda files: asked.append([r.path for r in files.collect()]) or real(files))
    (code / "b.py").write_text("class B: pass\n")
    assert w.index("r", f"file://{code}") == 2 and asked == [["b.py"]]
    assert w.verify("r", f"file://{code}").count() == 0
    assert {"python:decl:r/a.py#f", "python:decl:r/b.py#B"} <= {r.stable_key for r in w.facts().collect()}


def test_tracker_keeps_all_transitions(spark, tmp_path):
    rows = [("r", i, f"> s{i}") for i in range(500)] + [("r", 500, "error: no")]
    spark.createDataFrame(rows, "run string, at long, line string").write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("run string, at long, line string").parquet(f"{tmp_path}/log")
    q = watch.track_builds(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in got} == {"active": 500, "done": 499, "failed": 1}


def test_deep_trees_and_shared_parts(spark):
    chain = [(i + 1, i) for i in range(40)]
    labels = spark.range(41).select(F.col("id").alias("node"), F.col("id").cast("string").alias("label"))
    rows = graph.tree_rows(_rows(spark, chain, "child long, parent long"), labels)
    assert rows.agg(F.max("depth")).first()[0] == 40 and rows.count() == 41
    diamonds = [(2 * i + k, 2 * i - j) for i in range(1, 15) for k in (0, 1) for j in (1, 2)] + [(3, 29)]  # each level twice, and an edge back up
    some = spark.range(1, 30).select(F.col("id").alias("node"), F.col("id").cast("string").alias("label")).where("node > 0")
    dag = _rows(spark, [(c, p) for c, p in diamonds if p > 0], "child long, parent long")
    assert graph.tree_rows(dag, some).count() == 29 and graph.outline(dag, some).count() <= len(diamonds)


def _graph(spark):
    e = _rows(spark, [(1, "k:a", "function", "alpha", "r", "s/a.c", 3), (2, "k:b", "function", "beta", "r", "s/b.c", 5), (3, "k:c", "type", "gamma", "q", "s/a.c", 1)], "node long, key string, kind string, name string, repo string, path string, line int")
    d = _rows(spark, [(1, "refersToSymbol", 2, 1, 3, 0), (2, "refersToSymbol", 3, 1, 2, 2), (3, "imports", 1, 3, None, None)], "id long, kind string, src long, dst long, refs int, calls int")
    return e.withColumn("decl_path", F.col("name")), d


def test_references_have_three_answers(spark):
    e, d = _graph(spark)
    assert [(r.position, r.key, r.evidence) for r in lookups.references(e, d, "k:a").orderBy("position").collect()] == [(1, "k:b", "compiler"), (2, "k:c", "compiler")]
    assert [r.key for r in lookups.references(e, d, "k:a", calls_only=True).collect()] == ["k:c"]
    assert lookups.references(e, d, "k:b").count() == 0 and lookups.evidence(e, d, "k:b").first()[0] == "compiler"
    assert lookups.evidence(e, d.where("id = 3"), "k:b").first()[0] == "unavailable" == lookups.evidence(e, d, "none").first()[0]
    assert {r.key for r in lookups.blast_radius(e, d, "k:b", 1).collect()} == {"k:b", "k:a"} and lookups.blast_radius(e, d, "none").count() == 0
    assert scenes.metrics(e, d.select("src", "dst")).first().asDict() == {"nodes": 3, "edges": 3, "cyclic": 2, "orphans": 0}


def test_tools_keep_their_budgets(spark):
    e, d = _graph(spark)
    text = lambda df: [r.text for r in df.orderBy("position").collect()]
    assert text(tools.find_references(e, d, "alpha")) == ["k:a: references", "s/b.c:5  beta  derived/compiler  3 reference(s), 0 call(s)", "s/a.c:1  gamma  derived/compiler  2 reference(s), 2 call(s)"]
    assert text(tools.callers_of(e, d, "k:b")) == ["k:b: no callers"] and "unavailable" in text(tools.callers_of(e, d.where("id = 3"), "k:b"))[0]
    assert len(text(tools.list_symbols(e, "s/a.c"))) == 2 and text(tools.find_definition(e, "gam"))[0].startswith("s/a.c:1  gamma [type]")
    assert text(tools.blast_radius(e, d, "k:a"))[0] == "k:a: within 2 hops"
    many = spark.range(300).select(F.concat(F.lit("d/f"), "id", F.lit(".c")).alias("path"), (1 / (F.col("id") + 1)).alias("rank"))
    decls = _rows(spark, [("d/f0.c", "function", "g", 7), ("d/f0.c", "type", "T", 2)], "path string, kind string, name string, line int")
    page = text(tools.repo_map("r", many, decls, False, ["g"], 300))
    assert page[0].startswith("r — 300 files, ranked by centrality, focused on g\n(no compiler") and page[1:3] == ["d/", "  f0.c  T:2 g:7"] and page[-1].startswith("— shown") and page[-1].endswith("of 300 (truncated).")
    assert sum(max(1, -(-len(x.encode()) // 3)) for x in page[:-1]) <= 300
    files = _rows(spark, [("r", "a/b.txt", "h1", "one\ntwo\nthree\n"), ("r", "x", "h", "1"), ("q", "x", "h", "1")], "repo string, path string, blob_hash string, text string")
    assert text(tools.read_span(files, "a/./b.txt", 2, 9, "h0")) == ["a/./b.txt:2-3 of 3  (stale: the file has changed)", "    2  two", "    3  three"]
    for bad in ("none", "x"):
        with pytest.raises(LookupError):
            tools.read_span(files, bad, 1, 2)
    assert text(tools.status(_rows(spark, [("r", 3, 4, True)], "repo string, files long, declarations long, compiled boolean")))[1] == "r: 3 files, 4 declarations, references: compiler"
    d = _rows(spark, [("D1", "2024-01-02", "keep alpha", "accepted", "", None), ("D2", "2025-01-01", "drop", "refused", "alpha", "why\nnot")], "id string, date string, summary string, status string, evidence string, detail string")
    assert text(tools.prior_decisions(d, "Alpha of")) == ["D2  2025-01-01  [refused]  drop\n    why\n    not", "D1  2024-01-02  [accepted]  keep alpha"]
    charter = [("agents/MISSION.md", "x"), ("CLAUDE.md", "x"), ("FACTORY.md", "x")]
    audit = lambda more: text(tools.factory_audit(_rows(spark, charter + more, "path string, text string")))
    assert audit([])[0] == "operational" and not any("FIRST_RUN" in x for x in audit([]))
    assert audit([("FIRST_RUN.md", "y")])[0] == "not operational" and audit([("FIRST_RUN.md", "y")])[-1].startswith("stub  FIRST_RUN.md")
    assert any(x.startswith("stub  PROGRESS.md  marker: unreadable") for x in audit([("PROGRESS.md", None)])) and any("marker: [invariant]" in x for x in audit([("METRICS.md", "an [invariant]")]))
    hits = _rows(spark, [(1, "r", "a.c", 3, 0.5, "body", "lexical")], "rank int, repo string, path string, line int, score double, snippet string, resolution string")
    assert text(tools.search_page(hits, "note")) == ["note", "1. r/a.c:3  [lexical 0.5000]\nbody"]


def test_index_writes_nothing_twice_and_searches(spark):
    contents = _rows(spark, [("h1", "func fetchUser() {\n  return user\n}\n"), ("h2", "nothing here\n"), ("h2", "nothing here\n")], "blob_hash string, text string")
    none = _rows(spark, [], "blob_hash string")
    w = index.new_windows(contents, none)
    assert w.count() == 2 and index.new_windows(contents, w).count() == 0
    places = _rows(spark, [("r", "b.swift", "h1"), ("r", "a.swift", "h1"), ("q", "z", "h2")], "repo string, path string, blob_hash string")
    posts, stats = index.postings(w), index.window_stats(w)
    hits = index.lexical(w, posts, stats, places, ["fetch", "user"])
    assert [(r.path, r.line) for r in hits.orderBy("rank").collect()] == [("a.swift", 1), ("b.swift", 1)]
    assert index.lexical(w, posts, stats, places, ["user"], prefix="b").count() == 1 and index.lexical(w, posts, stats, places, ["user"], repo="q").count() == 0
    decls = _rows(spark, [("h1", "F", 1, 3)], "blob_hash string, key string, start int, end int")
    uses = _rows(spark, [("h1", "Kit")], "blob_hash string, module string")
    chunks = index.new_chunks(contents, decls, places, uses, none, "r")
    assert index.new_chunks(contents, decls, places, uses, chunks, "r").count() == 0
    bodies = index.chunk_bodies(chunks, contents.dropDuplicates())
    first = bodies.where("blob_hash = 'h1'").first()
    assert first.body == "func fetchUser() {\n  return user\n}" and first.context.startswith("repo: r | file: a.swift\nimports: Kit") and first.context.endswith("---\n")
    v = index.embedded(bodies, index.hashed_words, "m@1")
    assert index.work_list(chunks, v, "m@1").count() == 0 and index.work_list(chunks, v, "m@2").count() == 2
    q = [float(x) for x in spark.createDataFrame([("return the user",)], "t string").select(index.hashed_words(F.col("t")).alias("v")).first().v]
    near = index.semantic(v, chunks, places, contents.dropDuplicates(), "m@1", q, 5)
    assert [(r.path, r.line) for r in near.where("rank = 1").collect()] == [("a.swift", 1)]
    lex = lambda n: index.lexical(w, posts, stats, places, ["user"], n)
    sem = lambda n: index.semantic(v, chunks, places, contents.dropDuplicates(), "m@1", q, n)
    both, mode, note = index.hybrid(lex, sem, prefix="a", boost=_rows(spark, [("a.swift", 0.01)], "path string, boost double"))
    assert (mode, note) == ("hybrid", None) and both.orderBy("rank").first()["at"] == "r:a.swift" and both.where("at like '%z'").count() == 0
    _, mode, note = index.hybrid(lex, None)
    assert mode == "lexical" and "no embedding model" in note
    assert index.hybrid(lex, sem, "semantic")[1] == "semantic" and index.counts(w, chunks, v).first().asDict() == {"blobs": 2, "windows": 2, "chunks": 2, "vectors": 2}


def test_python_blocks(spark):
    text = "import os\nfrom . import x\nclass A:\n    def m(self): pass\n    def bad(:\n        pass\n    def n(self): pass\n@d\ndef f():\n    return 1\n"
    got = [(o["name"], o["start"]) for o in parsers.python_observations(text)]
    assert got == [("os", 1), (".x", 2), ("A", 3), ("m", 4), ("n", 7), ("f", 9)]
    large = "struct S {\n" + "  func f() { if x { y() } }\n" * 20000 + "}\n"
    assert len(parsers.swift_observations(large)) == 20001


def test_documents(spark, tmp_path):
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git" / "packed-refs").write_text("# pack\nabc123 refs/heads/main\n")
    assert documents.head_commit(spark, f"file://{tmp_path}") == "abc123" and documents.head_commit(spark, f"file://{tmp_path}/none") is None
    (tmp_path / "codecov").mkdir()
    (tmp_path / "codecov" / "a.json").write_text("{}")
    assert documents.newest_artifact(spark, f"file://{tmp_path}").first().path.endswith("codecov/a.json")
    md = _rows(spark, [(1, "# T\n\ntext\n```\n# no\n\n```\n- a\n> q\n---\n| x |\n")], "doc_id long, text string")
    assert [(r.block, r.level) for r in documents.markdown_blocks(md).orderBy("position").collect()] == [("heading", 1), ("text", 0), *[("fence", 0)] * 4, ("item", 0), ("quote", 0), ("rule", 0), ("table", 0)]


def test_skip_ledger_previews_and_progress(spark, tmp_path):
    want = _rows(spark, [("r", None, 1), ("r", "f", 2)], "repo string, fingerprint string, snapshot_id long")
    assert watch.stale_enrichments(want, want.limit(1)).count() == 1 and watch.stale_enrichments(want, want).count() == 0
    spark.range(3).select(F.lit("p").alias("path"), F.col("id").cast("string").alias("blob_hash"), F.timestamp_seconds("id").alias("ts")).write.parquet(f"{tmp_path}/f")
    told, shown = [], []
    listener = watch.Progress(lambda *a: told.append(a))
    spark.streams.addListener(listener)
    q = watch.previews(spark.readStream.schema("path string, blob_hash string, ts timestamp").parquet(f"{tmp_path}/f"), lambda b: shown.extend(b.collect()), f"file://{tmp_path}/cp", every="100 milliseconds")
    q.processAllAvailable()
    q.stop()
    spark.streams.removeListener(listener)
    assert [(r.path, r.blob_hash) for r in shown] == [("p", "2")] and any(x[1] == "started" for x in told)


def test_generated_graph(spark, tmp_path):
    e = generator.edges(spark, 2000, 100)
    assert e.count() == 2000 and sorted(e.collect()) == sorted(generator.edges(spark, 2000, 100).repartition(7).collect())
    assert 0.1 < e.where("valid_to is not null").count() / 2000 < 0.3 and generator.entities(spark, 10).count() == 10
    assert set(generator.bench(spark, f"file://{tmp_path}/b", 2000, 100)) == {"insert", "compact", "current_count", "neighborhood_now", "targets_now", "neighborhood_as_of", "commit"}


def test_command_line(spark, tmp_path):
    code = tmp_path / "src"
    (code / "lib").mkdir(parents=True)
    (code / "lib" / "a.py").write_text("import os\n\nclass Graph:\n    def walkEdges(self):\n        return 1\n")
    (code / "b.py").write_text("import lib.a\n\ndef main():\n    pass\n")
    ask = lambda *a: cli.run(spark, [f"file://{tmp_path}/ws", *a])
    ask("register", "r", f"file://{tmp_path}/none")
    ask("register", "r", f"file://{code}")
    assert [__import__("json").loads(x) for x in ask("repos")] == [{"repo": "r", "folder": f"file://{code}"}]
    assert ask("index") == ["revision 1"] == ask("index", "r")
    assert ask("def", "walkEdges")[0].startswith("lib/a.py:4  walkEdges [function]")
    assert [x.split("  ")[1] for x in ask("symbols", "lib/a.py")] == ["Graph [type]", "walkEdges [function]"]
    assert ask("span", "b.py", "3", "9") == ["b.py:3-4 of 4", "    3  def main():", "    4      pass"]
    assert ask("search", "edges")[0].startswith("1. r/lib/a.py:4  [lexical")
    assert "unavailable" in ask("refs", "main")[0] and "unavailable" in ask("callers", "main")[0]
    assert ask("radius", "python:decl:r/b.py#main")[0].endswith("within 2 hops") and len(ask("contains", "phys:repo:r")) == 2
    assert any("python:module:os" in x for x in ask("deps", "phys:file:r/lib/a.py"))
    page = ask("map", "r", "--focus", "Graph")
    assert page[0].startswith("r — 2 files") and "lib/" in page and "  a.py  Graph:3 walkEdges:4" in page
    assert ask("status")[1] == "r: 2 files, 3 declarations, references: syntactic" and ask("verify", "r") == []
    (code / "c.py").write_text("def new(): pass\n")
    assert ask("index", "r") == ["revision 2"] and ask("revisions") == ["2"] and any("c.py#new" in x for x in ask("diff", "1", "2"))
    assert "nodes" in ask("metrics")[0]
    with pytest.raises(lookups.UnknownRepository):
        ask("index", "q")


def test_postings_are_counted_in_place_and_written_by_bucket(spark, tmp_path):
    """Terms are counted within a window's row: no shuffle; texts of duplicates are not shuffled for the hits either."""
    w = _rows(spark, [("h1", 0, 1, "b A b cD\nb", "c D"), ("h2", 0, 1, "", ""), ("h2", 1, 61, "a", "")], "blob_hash string, ordinal int, start_line int, body string, split string")
    posts = index.postings(w)
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()
    at = f"file://{tmp_path}/posts"
    index.write_postings(posts, at)
    got = {(r.term, r.blob_hash, r.ordinal): (round(r.tf, 9), r.length, r.bucket) for r in spark.read.parquet(at).collect()}
    assert {k: v[:2] for k, v in got.items()} == {("b", "h1", 0): (3.0, 7), ("a", "h1", 0): (1.0, 7), ("cd", "h1", 0): (1.0, 7), ("c", "h1", 0): (0.4, 7), ("d", "h1", 0): (0.4, 7), ("a", "h2", 1): (1.0, 1)}
    assert all([v[2]] == index.term_buckets([k[0]]) for k, v in got.items())
