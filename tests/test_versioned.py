"""Stored tables: deltas under a compare-and-set head, against the store in memory."""

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import store
from stratagraph.operators.versioned import Change, Conflict, Spec, VersionedTables

ENTITY, EDGE, ID = "entity_id long, state string", "source_id long, target_id long, kind string, layer string, properties string", "id long"
LINK = store.LINK


def _random_commit(spark, rng, alive, edges):
    """Changes that hold, of which the bookkeeping in alive (ids) and edges (keys by id) follows only afterwards from the store in memory."""
    asserted = [(rng.randint(1, 12), rng.choice("ABC")) for _ in range(rng.randint(0, 4))]
    gone = [(x,) for x in rng.sample(sorted(alive | {a for a, _ in asserted}), k=min(len(alive), rng.choice([0, 0, 1])))]
    after = (alive | {a for a, _ in asserted}) - {g for (g,) in gone}
    new = [(a, b, rng.choice(["imports", "declares"]), "observed", rng.choice(["{}", None])) for a, b in ((rng.choice(sorted(after)), rng.choice(sorted(after))) for _ in range(4 if after else 0))]
    open_edges = [i for i, ends in edges.items() if not {g for (g,) in gone} & set(ends)]
    closed = [(i,) for i in rng.sample(sorted(open_edges), k=min(len(open_edges), rng.choice([0, 1, 2])))]
    make = spark.createDataFrame
    links = [("edge", rng.randint(1, 5), rng.randint(1, 3)) for _ in range(2)]
    return store.Changes(make(asserted, ENTITY), make(gone, "entity_id long"), make(new, EDGE), make(closed, ID), make(links, LINK))


def _state(t):
    return {tuple(r) for r in t.versions.collect()}, {tuple(r) for r in t.edges.select(*store.EDGE.replace(" long", "").replace(" string", "").split(", ")).collect()}, {tuple(r) for r in t.provenance.select("fact_kind", "fact_id", "observation_id").collect()}


def test_stored_commits_equal_those_in_memory(spark, tmp_path):
    rng = random.Random(4)
    memory, stored = store.MemoryStore(spark), store.StoredGraph(spark, f"file://{tmp_path}/g")
    for i in range(5):
        t = memory.tables()
        alive = {r.entity_id for r in t.versions.where("valid_to is null").collect()}
        edges = {r.id: (r.source_id, r.target_id) for r in t.edges.where("valid_to is null").collect()}
        changes = _random_commit(spark, rng, alive, edges)
        memory.commit(changes)
        t = memory.tables()  # the plans of earlier revisions grow with each: keep rows only
        memory._states[-1] = store.Tables(*(spark.createDataFrame(d.collect(), d.schema) for d in (t.versions, t.edges, t.provenance, t.repositories, t.observations)))
        assert stored.commit(changes) == i + 1
        if i == 2:
            for name in ("versions", "edges"):
                stored.stored.compact(name)
        assert _state(stored.tables()) == _state(memory.tables())
    for r in (1, 3):
        assert _state(stored.tables(r)) == _state(memory.tables(r))
    with pytest.raises(store.UnknownEntity):
        stored.commit(store.Changes(edges=spark.createDataFrame([(1, 99, "imports", "observed", None)], EDGE)))
    with pytest.raises(store.UnknownEntity):
        stored.commit(store.Changes(gone=spark.createDataFrame([(99,)], "entity_id long")))
    with pytest.raises(store.UnknownRelationship):
        stored.commit(store.Changes(closed=spark.createDataFrame([(99,)], ID)))
    assert stored.revision() == 5 and _state(stored.tables()) == _state(memory.tables())
    gone = stored.stored.vacuum()
    assert gone >= 0 and _state(stored.tables()) == _state(memory.tables())
    names = spark.createDataFrame([("r", "One")], "repo string, display_name string")
    seen = spark.createDataFrame([("a", "k", "x"), ("a", "k", "x")], "path string, kind string, payload string")
    stored.commit(store.Changes(), names, seen)
    stored.commit(store.Changes(), names.withColumn("display_name", F.lit("Two")), seen)
    assert [tuple(r) for r in stored.tables().repositories.collect()] == [("r", "Two")] and stored.tables().observations.count() == 1
    assert [tuple(r) for r in stored.tables(6).repositories.collect()] == [("r", "One")]


def test_of_two_writers_one_wins_and_crashes_leave_the_head(spark, tmp_path):
    spec = {"t": Spec("k long, v string", ("k",), "k", 4)}
    a, b = VersionedTables(spark, f"file://{tmp_path}/v", spec), VersionedTables(spark, f"file://{tmp_path}/v", spec)
    rows = lambda v, r: Change(spark.range(5).select(F.col("id").alias("k"), F.lit(v).alias("v"), F.lit(r).cast("long").alias("valid_from")))
    head = a.head()
    assert head["revision"] == 0 and a.rows("t").count() == 0
    a.commit(head, {"t": rows("a", 1)})
    with pytest.raises(Conflict):
        b.commit(head, {"t": rows("b", 1)})
    assert {r.v for r in b.rows("t").collect()} == {"a"} and b.revision() == 1
    close = a.current("t").where("k < 2").select("k", "valid_from", F.lit(2).cast("long").alias("valid_to"))
    for step in ("_written", "_advance"):  # a crash before or after the data is written
        broken = VersionedTables(spark, a.root, spec)

        def crash(*_, inner=getattr(broken, step), step=step):
            if step == "_written":
                inner(*_)
            raise OSError("lost")

        setattr(broken, step, crash)
        with pytest.raises(OSError):
            broken.commit(broken.head(), {"t": Change(closed=close)})
        assert a.current("t").count() == 5 and a.revision() == 1
    a.commit(a.head(), {"t": Change(closed=close)})
    assert sorted(r.k for r in b.current("t").collect()) == [2, 3, 4] and b.as_it_was("t", 1).where("valid_to is null").count() == 5
    before = sorted(map(tuple, b.rows("t").collect()), key=str)
    old = b.head()
    b.compact("t")
    with pytest.raises(Conflict):  # a commit over the head before compaction
        a.commit(old, {"t": rows("c", 3)})
    assert sorted(map(tuple, a.rows("t").collect()), key=str) == before and a.revision() == 2
    assert [r.v for r in a.rows("t", [3]).collect()] == ["a"] and a.rows("t", []).count() == 0
    assert a.vacuum() == 6 and a.current("t").count() == 3


def test_a_commit_writes_and_a_lookup_reads_in_proportion(spark, tmp_path):
    spec = {"t": Spec("k long, v string", ("k",), "k", 16)}
    t = VersionedTables(spark, f"file://{tmp_path}/p", spec)
    many = spark.range(20_000).select(F.col("id").alias("k"), F.lit("v").alias("v"), F.lit(1).cast("long").alias("valid_from"))
    t.commit(t.head(), {"t": Change(many)})
    assert t.due("t") is False
    t.compact("t")
    at = t.commit(t.head(), {"t": Change(closed=t.current("t", [7, 8]).select("k", "valid_from", F.lit(2).cast("long").alias("valid_to")))})
    delta = at["tables"]["t"]["deltas"][-1]
    assert (delta["opened"], delta["closed"]) == (0, 2) and t.current("t").count() == 19_998
    plan = t.current("t", [9])._jdf.queryExecution().executedPlan().toString()
    assert "_bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and t.current("t", [9]).count() == 1
