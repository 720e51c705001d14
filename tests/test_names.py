"""Prefix search of names against a plain version."""

import math
import re

from pyspark.sql import functions as F

from stratagraph.operators import names

TERM = re.compile(r"[\w$]+")


def _plain(versions, query, revision):
    alive = [(e, TERM.findall(n.lower())) for e, n, a, b in versions if a <= revision and (b is None or b > revision)]
    parts = sorted({p.lower() for p in query.replace('"', "").split()})
    average = sum(len(t) for _, t in alive) / len(alive)
    tf = {e: [sum(x.startswith(p) for x in t) for p in parts] for e, t in alive}
    df = [sum(c[i] > 0 for c in tf.values()) for i in range(len(parts))]
    out = {}
    for e, t in alive:
        if parts and all(tf[e]):
            out[e] = sum(max(math.log((len(alive) - d + 0.5) / (d + 0.5)), 1e-6) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / average)) for c, d in zip(tf[e], df, strict=True))
    return out


def test_prefixes_as_of_a_revision(spark):
    versions = [(1, "GraphStore open", 1, 3), (1, "GraphStore close", 3, None), (2, "graph_walk Graph2 graph", 1, None), (3, "Étude gr", 2, None), (4, "other", 1, 2), (5, "", 1, None), (6, "gra gr g", 1, None)]
    df = spark.createDataFrame(versions, "entity_id long, name string, valid_from long, valid_to long")
    posts, stats = names.name_postings(df).cache(), names.name_stats(df).cache()
    for query in ("gr", 'GRAPH "open"', "g", "graphstore cl", "ét", "nothing", "", "gr gra g"):
        for revision in (1, 3):
            got = {r.entity_id: r.score for r in names.search_names(posts, stats, query, revision).collect()}
            want = _plain(versions, query, revision)
            assert got.keys() == want.keys() and all(math.isclose(got[e], want[e]) for e in want), (query, revision)
    entities = spark.createDataFrame([(i, f"k{i}") for i in range(7)], "id long, key string")
    found = names.find_names(posts, stats, df, entities, "graph", 1).collect()
    assert [(r.rank, r.key, r.name) for r in found] == [(1, "k2", "graph_walk Graph2 graph")]
    assert names.query_heads("Gr \"opEn") == ["gr", "op"] and names.query_heads("g op") is None


def test_postings_are_counted_within_a_name(spark):
    df = spark.createDataFrame([(1, "a b a", 1, None), (1, "b", 2, 3)], "entity_id long, name string, valid_from long, valid_to long")
    posts = names.name_postings(df)
    assert {(r.entity_id, r.term, r.tf, r.length, r.valid_from) for r in posts.collect()} == {(1, "a", 2, 3, 1), (1, "b", 1, 3, 1), (1, "b", 1, 1, 2)}
    assert posts.schema["tf"].dataType.simpleString() == "int"
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()


def test_labels_as_a_reader_orders_them(spark):
    from stratagraph.operators import lookups

    wanted = ["_x", "a", "A", "file2", "file002b", "File10", "file" + "9" * 30, "résumé", "resumes", "Z", None]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(reversed(wanted))], "id int, label string").withColumn("g", F.lit(1))
    got = lookups.in_label_order(rows, ["g"], "label", "id").orderBy("position").collect()
    assert [r.label for r in got] == [None, *wanted[:-1]]
