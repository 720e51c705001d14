"""Metrics at many revisions against one revision at a time, in plain Python."""

import random

from stratagraph.operators import trend


def _reach(edges, a):
    seen, todo = set(), [a]
    while todo:
        for x, y in edges:
            if x == todo[0] and y not in seen:
                seen.add(y)
                todo.append(y)
        todo.pop(0)
    return seen


def test_metrics_at_every_revision(spark):
    rng = random.Random(9)
    at = lambda rows, r: [x[:-2] for x in rows if x[-2] <= r and (x[-1] is None or x[-1] > r)]
    nodes = [(i, rng.randint(1, 5), rng.choice([None, 8, 12])) for i in range(20)]
    edges = []
    for _ in range(60):
        start = rng.randint(1, 12)
        edges.append((rng.randint(0, 24), rng.randint(0, 24), start, rng.choice([None, start + rng.randint(1, 6)])))
    edges += [(1, 2, 1, None), (2, 1, 3, 6), (2, 1, 6, 9), (3, 3, 4, 5), (1, 2, 2, 4)]
    want = set()
    for r in (0, 2, 3, 6, 7, 11, 30):
        e = at(edges, r)
        alive = {n for (n,) in at(nodes, r)}
        cyclic = sum(s == d or s in _reach(e, d) for s, d in set(e))
        want.add((r, len(alive), len(e), cyclic, len(alive - {x for p in e for x in p})))
    n, e = spark.createDataFrame(nodes, "node long, valid_from long, valid_to long"), spark.createDataFrame(edges, "src long, dst long, valid_from long, valid_to long")
    got = trend.metrics_trend(n, e, spark.createDataFrame([(w[0],) for w in want], "revision long")).collect()
    assert {tuple(r) for r in got} == want
    assert trend.metrics_trend(n, e, spark.createDataFrame([], "revision long")).count() == 0


def test_distinct_keys_at_revisions(spark):
    import random

    from stratagraph.operators import scenes

    rng = random.Random(3)
    facts = [(rng.choice(["a", "b", "c", None]), a, rng.choice([None, a, a + 1, a + 3])) for a in (rng.randrange(12) for _ in range(40))] + [("d", 2, 4), ("d", 4, 6), ("d", 2, 4)]
    for some in (facts, facts[:5], []):
        df = spark.createDataFrame(some, "k string, valid_from int, valid_to int")
        got = {r.revision: r.n for r in scenes.distinct_trend(df, "k", spark.range(0, 16).withColumnRenamed("id", "revision")).collect()}
        assert got == {v: len({k for k, a, b in some if k and a <= v and (b is None or b > v)}) for v in range(16)}


def test_system_modules_are_a_fixed_list(spark):
    from pyspark.sql import functions as F

    from stratagraph.operators import scenes

    rows = spark.createDataFrame([("python", "os.path"), ("python", "__future__"), ("python", "numpy"), ("python", "Foundation"), ("swift", "Foundation"), ("c", "sys/types.h"), ("c", "os"), ("rust", "std")], "lang string, name string")
    got = [r.s for r in rows.select("lang", "name", scenes.is_system_module(F.col("lang"), F.col("name")).alias("s")).collect()]
    assert got == [True, True, False, False, True, True, False, False]


def test_knots_of_blocks_are_those_of_the_graph(spark):
    """A ring that runs through many blocks, with rings beside it and ways that lead nowhere, in blocks of a few edges, over numbers and texts."""
    from stratagraph.operators import graph

    edges = [(i, (i + 1) % 8) for i in range(8)] + [(100 + 3 * k + i, 100 + 3 * k + (i + 1) % 3) for k in range(5) for i in range(3)] + [(100 + 3 * k, 103 + 3 * k) for k in range(4)] + [(5, 5), (7, 100), (200, 201), (202, 202)]
    want = {frozenset(range(8)), *(frozenset(range(100 + 3 * k, 103 + 3 * k)) for k in range(5))}
    df = spark.createDataFrame(edges, "src long, dst long")
    for of, least in ((df, 1000), (df.selectExpr("'n' || src as src", "'n' || dst as dst"), 6)):
        parts = {}
        for r in graph.knots(of, least).collect():
            parts.setdefault(r.component, {r.component}).add(r.node)
        assert {frozenset(int(str(x).lstrip("n")) for x in p) for p in parts.values()} == want
    assert graph.knots(df.where("src > 199"), 6).collect() == []


def test_the_graph_is_searched_once_for_all_revisions(spark, monkeypatch):
    """Seventy revisions, more than a mask holds, of a graph whose core stays: no search has a row for each of them."""
    from stratagraph.operators import graph

    searched = []
    whole = graph.strong_components
    monkeypatch.setattr(graph, "strong_components", lambda e, group=None: (searched.append(e.count()), whole(e, group))[1])
    edges = [(i, (i + k) % 40, 1, None) for i in range(40) for k in (1, 7)] + [(50, 0, r, r + 1) for r in range(1, 80)] + [(r % 40, 50, r, r + 2) for r in range(3, 79)] + [(60, 61, 5, 9), (61, 60, 7, 12), (62, 62, 9, 9)]
    e = spark.createDataFrame(edges, "src long, dst long, valid_from long, valid_to long")
    n = spark.createDataFrame([(i, 1, None if i < 40 else 60) for i in range(64)], "node long, valid_from long, valid_to long")
    last = 70
    got = {r.revision: tuple(r) for r in trend.metrics_trend(n, e, spark.range(1, last + 1).withColumnRenamed("id", "revision")).collect()}
    want = {}
    for r in range(1, last + 1):
        now = [(s, d) for s, d, a, b in edges if a <= r and (b is None or b > r)]
        alive = set(range(40 if r >= 60 else 64))
        want[r] = (r, len(alive), len(now), sum(s == d or s in _reach(now, d) for s, d in set(now)), len(alive - {x for p in now for x in p}))
    assert got == want
    assert sum(searched) < len(edges)
