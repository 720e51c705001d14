"""The workspace: scoped re-derivation over random edits, enrichments, provenance, renames."""

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import index
from stratagraph.operators.versioned import Conflict
from stratagraph.plans import tools
from stratagraph.plans.workspace import Workspace


def _write(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def _edit(rng, root):
    """One to three random edits: files come, go, move, change; make dependencies and lanes that come and go with them."""
    names = ["a/x.py", "a/b/y.py", "a/b/z.py", "c/w.py", "c/Makefile", "Makefile", "fastlane/Fastfile", ".github/workflows/ci.yml", "c/v.c"]
    for path in rng.sample(names, rng.randint(1, 3)):
        file = root / path
        if file.exists() and rng.random() < 0.4:
            file.unlink()
        elif path.endswith(".py"):
            _write(root, path, "".join(f"import {m}\n" for m in rng.sample(["os", "sys", "re", "json"], 2)) + "".join(f"class C{i}:\n    def m{rng.randint(0, 2)}(self): pass\n" for i in range(rng.randint(0, 3))))
        elif path.endswith("Makefile"):
            _write(root, path, f"all: {rng.choice(['v.c', 'a/x.py', 'lib', 'w.py', 'c/w.py'])} lib\nlib:\n\techo {rng.random()}\n")
        elif path.endswith("Fastfile"):
            _write(root, path, "".join(f"lane :{n} do\n  build\nend\n" for n in rng.sample(["beta", "test", "ship"], 2)))
        elif path.endswith(".yml"):
            _write(root, path, f"jobs:\n  x:\n    steps:\n      - run: bundle exec fastlane {rng.choice(['beta', 'test'])}\n")
        else:
            _write(root, path, f"int f{rng.randint(0, 9)}(void) {{\n return 0;\n}}\n")


def test_random_edits_leave_nothing_to_verify(spark, tmp_path):
    rng, code = random.Random(2), tmp_path / "code"
    for i in range(3):
        _write(code, f"many/m{i}.py", "import os\n" + "".join(f"def f{j}(): pass\n" for j in range(20)))
    w = Workspace(spark, f"file://{tmp_path}/ws")
    for _ in range(4):
        _edit(rng, code)
        before = w.revision()
        after = w.index("r", f"file://{code}")
        assert w.verify("r", f"file://{code}").collect() == []
        if before and after > before:  # what stays in place is not written again
            deltas = {name: s["deltas"][-1] for name, s in w.tables.head()["tables"].items() if s["deltas"]}
            assert deltas["observations"]["opened"] < 60 and deltas["facts"]["opened"] + deltas["facts"]["closed"] < 60
    assert w.index("r", f"file://{code}") == w.revision()


def test_enrichments_provenance_and_renames(spark, tmp_path):
    code = tmp_path / "code"
    _write(code, "lib/a.py", "import os\nclass A:\n    def go(self):\n        return 1\n")
    _write(code, "lib/b.py", "import os\ndef use():\n    return A().go()\n")
    w = Workspace(spark, f"file://{tmp_path}/ws")
    assert w.index("r", f"file://{code}") == 1
    text = lambda df: [r.text for r in df.orderBy("position").collect()]
    assert "unavailable" in text(tools.callers_of(w.entities(), w.edges(), "go"))[0]
    use = [("u1", "go", "lib/a.py", 3, 8, "definition"), ("u1", "go", "lib/b.py", 3, 15, "call"), ("u2", "A", "lib/a.py", 2, 6, "definition"), ("u2", "A", "lib/b.py", 3, 11, "reference"), ("u3", "gone", "no/where.py", 1, 1, "definition")]
    occurrences = spark.createDataFrame(use, "usr string, name string, path string, line int, column int, role string")
    assert w.enrich_references("r", occurrences) == 2 == w.enrich_references("r", occurrences)
    assert text(tools.callers_of(w.entities(), w.edges(), "go"))[1:] == ["lib/b.py:2  use  derived/compiler  1 call(s)"]
    pairs = {(r.kind, r.refs, r.calls) for r in w.edges().where("refs is not null").collect()}
    assert pairs == {("references", 2, 1), ("refersToSymbol", 1, 1), ("refersToSymbol", 1, 0)} and w.status().first().compiled
    commits = lambda *rows: spark.createDataFrame([(p, who, who.title(), at) for p, who, at in rows], "path string, person string, name string, at int")
    assert w.enrich_ownership("r", commits(("lib/a.py", "ann", 1), ("lib/a.py", "ann", 2), ("lib/b.py", "ann", 1), ("lib/b.py", "bob", 2), ("not/there.py", "eve", 1))) == 3
    keys = lambda kind: {r.stable_key for r in w.facts().where(F.col("stable_key").startswith(kind)).collect()}
    assert keys("ownedBy|") == {"ownedBy|phys:file:r/lib/a.py|person:ann"} and keys("person:") == {"person:ann", "person:bob"}
    assert w.enrich_ownership("r", commits(("lib/a.py", "ann", 1), ("lib/a.py", "ann", 2), ("lib/b.py", "ann", 1), ("lib/b.py", "ann", 2))) == 4
    assert keys("person:") == {"person:ann"} and len(keys("ownedBy|")) == 2 and w.verify("r", f"file://{code}").count() == 0
    assert [tuple(r) for r in w.why("dependsOn|r|lib|python:module:os").orderBy("path").collect()] == [("r", "lib/a.py", 1), ("r", "lib/b.py", 1)]
    (code / "lib" / "a.py").rename(code / "lib" / "c.py")
    assert w.index("r", f"file://{code}") == 5
    assert [tuple(r) for r in w.origins("r").collect()] == [("lib/a.py", "lib/c.py", True, 5)]
    assert {r.path for r in w.why("python:module:os").collect()} == {"lib/b.py", "lib/c.py"}
    assert "python:decl:r/lib/c.py#A.go" in keys("python:decl") and "python:decl:r/lib/a.py#A" not in keys("python:decl")
    head = w.tables.head()
    w.register("q", "file:///nowhere")
    with pytest.raises(Conflict):
        w.tables.commit(head, {})
    assert w.build_index() > 0 == w.build_index()
    assert [(r.path, r.line) for r in w.search("class").collect()] == [("lib/c.py", 2)]


def test_hybrid_search_with_a_focus(spark, tmp_path):
    code = tmp_path / "code"
    _write(code, "a.py", "import os\n\ndef open_store(path):\n    return path\n")
    _write(code, "b.py", "import os\n\ndef close_store(path):\n    return path\n")
    _write(code, "c.txt", "nothing of the kind\n")
    w = Workspace(spark, f"file://{tmp_path}/ws", ("words@1", index.hashed_words))
    w.index("r", f"file://{code}")
    assert w.build_index() == 3 and w.build_index() == 0
    assert w.tables.current("vectors").count() == w.tables.current("chunks").count() > 0
    hits, mode, note = w.find("store path", mode="hybrid")
    rows = hits.orderBy("rank").collect()
    assert (mode, note) == ("hybrid", None) and [r.path for r in rows][:2] == ["a.py", "b.py"] and "def open_store" in rows[0].snippet
    plain = {r.path: r.score for r in rows}
    near = {r.path: r.score for r in w.find("store path", mode="hybrid", repo="r", focus=["close_store"])[0].collect()}
    assert near["b.py"] - plain["b.py"] > near["a.py"] - plain["a.py"] >= 0
    lexical = Workspace(spark, w.root)
    assert lexical.find("store", mode="hybrid")[1:] == ("lexical", "no embedding model installed: semantic search is not available, ran lexical only")
    assert w.find("store", mode="semantic")[1] == "semantic"


def test_a_learned_embedder(spark, tmp_path):
    code = tmp_path / "code"
    for i in range(6):
        _write(code, f"pet{i}.txt", f"{('cat', 'kitten')[i % 2]} mouse fur\n")
        _write(code, f"bank{i}.txt", f"{('stock', 'bond')[i % 2]} yield price\n")
    w = Workspace(spark, f"file://{tmp_path}/ws")
    w.index("r", f"file://{code}")
    w.build_index()
    assert w.tables.current("vectors").count() == 0
    name = w.learn()
    assert name.startswith("terms@") and name == w.learn()
    w.build_index()
    assert {r.model for r in w.tables.current("vectors").collect()} == {name} and w.tables.current("vectors").count() == 4  # twelve files of four texts
    hits, mode, _ = w.find("kitten", limit=2, mode="semantic")
    assert mode == "semantic" and {r.path[:3] for r in hits.collect()} == {"pet"}
    again = Workspace(spark, w.root)
    again.use(name)
    assert again.build_index() == 0 and {r.path[:3] for r in again.find("bond", limit=2, mode="semantic")[0].collect()} == {"ban"}
