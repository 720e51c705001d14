"""Parsers, readers, the workspace and the streams."""

import datetime as dt
import os

from pyspark.sql import functions as F

from stratagraph.operators import layout
from stratagraph.plans.workspace import Workspace
from stratagraph.sources import documents, parsers, readers
from stratagraph.streaming import watch

MAKE = "CC=gcc\nOBJS := a.o \\\n  b.o\nOBJS += c.o\n.PHONY: all\nall: $(OBJS) | dir\n\t@$(CC) -o x $^\n%.o: %.c\n\tcc $<\nall: more\n"


def test_makefile():
    all_, pattern = parsers.make_rules(MAKE)
    assert all_["prerequisites"] == ["a.o", "b.o", "c.o", "dir", "more"] and all_["recipe"] == ["gcc -o x $^"] and all_["phony"] and pattern["pattern"]


def test_fastfile_and_ci():
    lanes = parsers.fastlane_lanes("lane :beta do\n  build_app\n  if true\n    helper\n  end\n  upload(lane: :helper)\nend\nprivate_lane :helper do\n  puts 1\nend\n")
    assert [(x["name"], x["private"], x["calls"]) for x in lanes] == [("beta", False, ["helper"]), ("helper", True, [])] and "if" not in lanes[0]["steps"]
    assert parsers.ci_commands("run: bundle exec fastlane beta\n# fastlane no\n") == ["bundle exec fastlane beta"]
    assert [parsers.build_kind(p) for p in ("a/Makefile", "x.mk", "fastlane/Fastfile", ".github/workflows/ci.yml", "b.py")] == ["make", "make", "fastlane", "github-actions", None]


def test_extractors_tolerate_errors():
    assert [o["decl_path"] for o in parsers.python_observations("class A:\n    def run(self): pass\n\ndef broken(:\n") if o["kind"] == "declaration"] == ["A", "A.run"]
    assert parsers.rust_observations("fn main() { let x = \"}\"; }\nstruct S;") and parsers.c_observations("") == []
    swift = {o["decl_path"]: (o["start"], o["end"]) for o in parsers.swift_observations("struct G {\n  func add(a: Int, _ b: Int) {\n    let y = 1\n  }\n}\n") if o["kind"] == "declaration"}
    assert swift == {"G": (1, 5), "G.add(a:_:)": (2, 4)}


def test_chunks_cover_every_line():
    plan = parsers.chunk_plan(400, [{"key": "T", "start": 10, "end": 390}, {"key": "f", "start": 40, "end": 300}, {"key": "g", "start": 310, "end": 311}], {39, 38})
    covered = {i for c in plan for i in range(c["start"], c["end"] + 1)}
    assert covered == set(range(1, 401)) and all(c["end"] - c["start"] < 120 for c in plan)
    assert [c["start"] for c in plan] == sorted(c["start"] for c in plan) and plan[1] == {"ordinal": 1, "start": 10, "end": 29, "decl_key": "T"}


def test_documents():
    md = "| ID | Date | Summary | Status | Evidence | Supersedes |\n|---|---|---|---|---|---|\n| D1 | 2024-01-02 | keep | Accepted | tests | — |\n| D2 | x | an example | y | z |\n\n## D1 — keep\nbecause\n"
    assert [(d["id"], d["status"], d["supersedes"], d["detail"]) for d in parsers.decisions(md)] == [("D1", "accepted", None, "because")]
    assert len(parsers.table_rows(md)) == 2
    assert parsers.frontmatter("---\ntitle: A: b\n---\nx") == {"title": "A: b"} and parsers.wiki_links("[[A|b]] [[C d]]") == [("A", "b"), ("C d", None)] and parsers.slug("My_Page.md") == "my-page"
    log = "\x1eabc\x1fAda\x1fADA@x.org\x1f2024-01-02\na.swift\nb.swift\x1ebad\x1fx"
    assert parsers.git_log(log) == [{"sha": "abc", "author": "Ada", "email": "ADA@x.org", "date": "2024-01-02", "paths": ["a.swift", "b.swift"]}]
    assert parsers.remote_repository("git@github.com:a/b.git") == "a/b" and parsers.remote_repository("https://example.org/a") is None


def test_coverage_and_ledger(spark):
    json = '{"data":[{"files":[{"filename":"a.c","summary":{"lines":{"percent":50.0}}}],"functions":[{"filenames":["a.c"],"name":"f","regions":[[3,1,5,2,1],[6,1,9,2,0]]}]}]}'
    files, regions = readers.coverage(spark.createDataFrame([(json,)], "json string"))
    assert [tuple(r) for r in files.collect()] == [("a.c", 0.5)] and [tuple(r) for r in regions.orderBy("start").collect()] == [("a.c", "f", 3, 5, 1), ("a.c", "f", 6, 9, 0)]
    cells = spark.createDataFrame([(["c1", "2024-01-01", "m", "1,000", "2", "x", "4", "$1.50", "sum", "more"],)], "cells array<string>")
    r = readers.ledger(cells).first()
    assert (r.input, r.cache_read, r.cost, r.summary) == (1000, None, 1.5, "sum | more")


def _tree(root):
    files = {"Sources/Graph.swift": "import Foundation\nstruct Graph {\n  func add() {}\n}\n", "ingest.py": "import os\ndef main(): pass\n", "src/io.c": "#include <stdio.h>\nint main(void) {\n return 0;\n}\n", "Makefile": "all: src/io.c lib\nlib:\n\techo x\n", ".git/config": "x", ".hidden": "y", "node_modules/a.js": "z"}
    for p, t in files.items():
        os.makedirs(os.path.dirname(f"{root}/{p}") or root, exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(t)


def test_workspace_indexes_incrementally(spark, tmp_path):
    tree, store = tmp_path / "tree", tmp_path / "store"
    _tree(tree)
    w = Workspace(spark, str(store))
    assert w.index("r", str(tree)) == 1 and w.index("r", str(tree)) == 1
    keys = {r.stable_key for r in w.facts().collect()}
    assert {"phys:repo:r", "phys:dir:r/Sources", "phys:file:r/src/io.c", "swift:decl:r/Sources/Graph.swift#Graph.add()", "python:module:os", "build:target:r/Makefile#all"} <= keys
    assert "builds|build:target:r/Makefile#all|phys:file:r/src/io.c" in keys and "builds|build:target:r/Makefile#all|build:target:r/Makefile#lib" in keys
    assert "declares|swift:decl:r/Sources/Graph.swift#Graph|swift:decl:r/Sources/Graph.swift#Graph.add()" in keys and not any(".git" in k or "node_modules" in k for k in keys)
    assert w.verify("r", str(tree)).count() == 0
    os.remove(tree / "src" / "io.c")
    (tree / "ingest.py").write_text("import sys\n")
    assert w.index("r", str(tree)) == 2 and w.verify("r", str(tree)).count() == 0
    now = {r.stable_key for r in w.facts().collect()}
    assert "phys:dir:r/src" not in now and "python:module:os" not in now and "python:module:sys" in now
    assert {r.stable_key for r in w.facts(1).collect()} == keys
    s = w.status().first()
    assert (s.files, s.declarations) == (3, 2)


def test_streams(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("r", t0), ("r", t0 + dt.timedelta(milliseconds=300)), ("r", t0 + dt.timedelta(seconds=2)), ("q", t0)], "key string, ts timestamp").write.parquet(src)
    batch = watch.debounced(spark.read.parquet(src)).orderBy("key", "first").collect()
    assert [(r.key, r.n) for r in batch] == [("q", 1), ("r", 2), ("r", 1)]
    seen = []
    q = watch.watch(spark.readStream.schema("key string, ts timestamp").parquet(src), lambda df, i: seen.append((i, df.count())), state)
    q.awaitTermination()
    assert sum(n for _, n in seen) == 4
    log = str(tmp_path / "log")
    spark.createDataFrame([("1", 1, "> build"), ("1", 2, "> test"), ("1", 3, "error: no"), ("2", 1, "> build"), ("2", 2, "** end")], "run string, at long, line string").write.parquet(log)
    q = watch.track_builds(spark.readStream.schema("run string, at long, line string").parquet(log)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{state}2").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.run, r.step): r.state for r in spark.read.parquet(out).orderBy("at").collect() if r.state != "active"}
    assert got == {("1", "build"): "done", ("1", "test"): "failed", ("2", "build"): "done"}


def test_geometry(spark):
    square = spark.createDataFrame([(1, float(x), float(y)) for x in range(4) for y in range(4)], "cluster int, x double, y double")
    assert [(r.x, r.y) for r in layout.cluster_hulls(square).orderBy("corner").collect()] == [(0, 0), (3, 0), (3, 3), (0, 3)]
    a, b = (layout.force_layout(["a", "b", "c"], [("a", "b")]) for _ in range(2))
    assert a == b and set(a) == {"a", "b", "c"}
    assert layout.layouts(spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "scene int, src string, dst string"), dims=3).count() == 3
    v = {p: i for i, p in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", ",", "cafe"])}
    assert layout.wordpiece("Playing, café zzz", v, 8) == [2, 4, 5, 6, 7, 1, 3, 0]
    near = spark.createDataFrame([("alpha beta",), ("beta ALPHA",)], "t string").select(layout.hashed_embedding(F.col("t")).alias("v")).collect()
    assert near[0].v == near[1].v


def test_flow(spark):
    flow = layout.ci_flow(parsers.build_observations(spark.createDataFrame([("Makefile", "all: lib\n\trun\nlib:\n\techo\n")], "path string, text string")))
    assert {(r.node, r.column, r.kind) for r in flow.collect()} == {("all", 1, "target"), ("lib", 1, "target"), ("run", 2, "step"), ("echo", 2, "step"), ("trigger:all", 0, "trigger")}


def test_coverage_reports_are_many_not_large(spark):
    """A larger table has more reports; one report, which is one text, doesn't grow with it."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from stratagraph.plans import parse_queries

    def lengths(n: int) -> list[int]:
        part = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit(50).alias("p_size"))
        lines = spark.range(n).select(F.col("id").alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(30.0).alias("l_quantity"))
        reports = parse_queries._coverage_json(SimpleNamespace(part=part, lineitem=lines))
        assert [d.count() for d in readers.coverage(reports)] == [n, n]
        return [r[0] for r in reports.select(F.length("json")).collect()]

    assert max(lengths(4000)) < 1.5 * max(lengths(1000))


def test_lanes_of_a_long_fastfile(spark):
    """Platforms hold until the next one, a description is that of the next lane only; lanes are not gathered in a growing array."""
    text = 'desc "lost"\nlane :a do\nend\nplatform :ios do\n  desc "one"\n  desc "two"\n  private_lane :b do\n  end\n  lane :c do\n  end\nend\nplatform :android do\ndesc "left"\n' + "lane :d do\nend\n" * 2
    files = spark.createDataFrame([("F", text), ("G", 'lane :x do\nend\ndesc "y"\n'), ("H", None)], "path string, text string")
    found = documents.lanes(files, spark.createDataFrame([("fastlane c",)], "command string"))
    got = {(r.path, r.lane, r.platform, r.description, r.in_ci) for r in found.collect()}
    assert got == {("F", "a", None, "lost", False), ("F", "b", "ios", "two", False), ("F", "c", "ios", None, True), ("F", "d", "android", "left", False), ("F", "d", "android", None, False), ("G", "x", None, None, False)}
    assert "array_append" not in found._jdf.queryExecution().optimizedPlan().toString()
