"""Pointer doubling over containment: chains of any depth, branches, cycles."""

import random

from pyspark.sql import functions as F

from stratagraph.operators import graph


def _up(parents, n):
    seen = []
    while n in parents and parents[n] not in seen:
        n = parents[n]
        seen.append(n)
    return seen, n in parents


def test_closure_and_nearest_ancestors(spark):
    rng = random.Random(6)
    parents = {i: i - 1 for i in range(1, 91)} | {200 + i: rng.choice([5, 40, 90, 200]) if i else 90 for i in range(20)}
    parents |= {300: 301, 301: 302, 302: 300, 303: 300, 400: 400, 500: 501}
    df = spark.createDataFrame(list(parents.items()), "child long, parent long").repartition(3)
    want = {(a, n, i + 1) for n in parents for above, cyclic in [_up(parents, n)] if not cyclic for i, a in enumerate(above)}
    got = graph.containment(df).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    marked = lambda n: n % 60 == 0 and n < 300 or n == 303
    near = {}
    for n in {*parents, *parents.values()}:
        hit = [a for a in [n, *_up(parents, n)[0]] if marked(a)]
        if hit:
            near[n] = hit[0]
    assert {r.node: r.ancestor for r in graph.ancestor_of(df, (F.col("node") % 60 == 0) & (F.col("node") < 300) | (F.col("node") == 303)).collect()} == near
    assert graph.containment(df.limit(0)).count() == 0 and graph.ancestor_of(df.limit(0), F.lit(True)).count() == 0
