"""Lines that tools print, and what a chart shows."""

from pyspark.sql import functions as F

from stratagraph.functions import render
from stratagraph.operators import scenes


def test_lines(spark):
    r = spark.createDataFrame([("r", "a.py", 3, 9, "f", "function"), ("r", "b.py", 4, 4, "g", "type"), ("r", None, None, None, "h", "type")], "repo string, path string, s int, e int, name string, kind string")
    c = [F.col(x) for x in ("path", "s", "e", "name", "kind")]
    assert [x[0] for x in r.select(render.citation(F.col("repo"), *c[:3])).collect()] == ["r/a.py:3-9", "r/b.py:4", None]
    assert [x[0] for x in r.select(render.declaration(*c)).collect()] == ["a.py:3-9  f [function]  observed/syntactic", "b.py:4  g [type]  observed/syntactic", "(no anchor)  h [type]  observed/syntactic"]
    assert r.select(render.reference(F.col("path"), F.col("s"), F.col("name"), F.lit(5), F.lit(2))).first()[0] == "a.py:3  f  derived/compiler  5 reference(s), 2 call(s)"
    text = r.select(render.context_prefix(F.lit("r"), F.col("path"), F.array(F.lit("os"), F.lit("abc")), F.array(F.lit("A"), F.lit("B")), F.array().cast("array<string>"))).first()[0]
    assert text == "repo: r | file: a.py\nimports: abc, os\nenclosing: A › B\n---\n"


def test_modules(spark):
    m = spark.createDataFrame([("swift", "Foundation"), ("swift", "MyKit"), ("swift", "Other"), ("python", "os.path"), ("rust", "std"), ("c", "stdio.h")], "lang string, name string")
    folders = spark.createDataFrame([("Sources/MyKit",)], "path string")
    assert [r.name for r in scenes.charted_modules(m, folders).collect()] == ["MyKit"]
    assert sorted(r.name for r in scenes.charted_modules(m, folders, external=True).collect()) == ["MyKit", "Other", "std"]
    keys = spark.createDataFrame([("Sources/App/FooStore.swift",)], "p string").select(*[scenes.cluster_key(g, F.col("p"), F.lit("file"), F.lit("Hub"), F.lit(None).cast("string")).alias(g) for g in ("area", "folder", "layer", "pattern", "role", "owner", "none")]).first()
    assert tuple(keys) == ("Sources/App", "Sources/App", "Sources", "Stores", "Hub", "Unowned", "")
