"""The build tracker by event time: shuffled micro-batches give the transitions of the sorted log."""

import datetime as dt
import json
import random

from stratagraph.streaming import builds

FLOW = [("t", "push", 0, "entry"), ("g0", "beta", 0, "group"), ("s0", "swiftlint", 0, "step"), ("s1", "xcodebuild", 0, "step"), ("g1", "ship", 1, "group"), ("s2", "upload", 1, "step"), ("s3", "xcodebuild", 1, "step")]


def test_machine_follows_the_flow():
    run = builds.FlowRun(FLOW)
    assert run.start() == [("t", "done"), ("g0", "active"), ("s0", "active")]
    assert run.advance("make[1]: entering") == [] == run.advance("") == run.advance("a.c:1: error: no")
    assert run.advance("/usr/bin/swiftlint --strict") == [] and run.frontier == 1  # the first step is active already
    assert run.advance("echo anything") == [("s0", "done"), ("s1", "active")]
    assert run.advance("xcodebuild archive") == [("g0", "done"), ("s1", "done"), ("g1", "active"), ("s2", "done"), ("s3", "active")]
    assert run.advance("upload it") == []
    assert run.finish(1) == [("g1", "failed"), ("s3", "failed")]
    assert builds.FlowRun(FLOW).finish(0) == [(n[0], "done") for n in FLOW]
    assert builds.FlowRun([]).advance("a b") == []


def _plain(log):
    """Transitions of a sorted log, run by run."""
    out = []
    for run in sorted({r[0] for r in log}):
        machine, started = builds.FlowRun(FLOW), False
        for _, ts, _, line, code in sorted((r for r in log if r[0] == run), key=lambda r: (r[1], r[2], r[3] or "")):
            if not started:
                out += [(run, *c, ts) for c in machine.start()]
                started = True
            out += [(run, *c, ts) for c in (machine.advance(line) if code is None else machine.finish(code))]
            if code is not None:
                break
    return sorted(out)


def test_shuffled_batches_equal_the_sorted_log(spark, tmp_path):
    rng, t0 = random.Random(8), dt.datetime(2024, 1, 1)
    lines = ["swiftlint run", "xcodebuild build", "upload x", "make: nothing", "echo hi", "done", "error: x"]
    log = []
    for run in ("a", "b", "c", "d"):
        n = rng.randint(4, 9)
        log += [(run, t0 + dt.timedelta(seconds=i // 2), i, rng.choice(lines), None) for i in range(n)]
        if run != "d":
            log.append((run, t0 + dt.timedelta(seconds=n), n, None, rng.choice([0, 1])))
    rng.shuffle(log)
    far = [("zz", t0 + dt.timedelta(days=1), 0, "end", 0)]
    schema = f"run string, ts timestamp, number long, line string, exit int, flow {builds.FLOW}"
    for i, part in enumerate((log[::3], log[1::3], log[2::3], far)):
        spark.createDataFrame([(*r, FLOW) for r in part], schema).coalesce(1).write.parquet(f"{tmp_path}/log/{i}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
        out = builds.track_flow(stream, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        out.awaitTermination()
        rows_left = [p["stateOperators"][0]["numRowsTotal"] for p in out.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.run != "zz")
    assert got == _plain(log) and len(got) > 15
    assert rows_left[-1] < max(rows_left)  # finished runs leave nothing behind


class _State:
    """A value or list of state in memory, which keeps what was written."""

    def __init__(self):
        self.kept = []

    def get(self):
        return self.kept

    def appendValue(self, value):
        self.kept.append(value)


def test_lines_of_a_batch_wait_as_one_value():
    import pandas as pd

    class Handle:
        timers = []

        def getListState(self, name, schema):
            return _State()

        def getValueState(self, name, schema):
            return _State()

        def registerTimer(self, at):
            self.timers.append(at)

    tracker = builds._Tracker()
    tracker.init(Handle())
    said = [{"at": 1_000_000 + i, "number": i, "line": f'a "{i}" \u00e9\n'} for i in range(500)]
    pdf = pd.DataFrame({"run": "r", "due": [x["at"] // 1000 for x in said], "line": [json.dumps(x) for x in said], "flow": "[]"})
    assert list(tracker.handleInputRows(("r",), iter([pdf[:300], pdf[300:]]), None)) == []  # no frame that says nothing
    assert [json.loads(lines) for _, lines in tracker.waiting.kept] == [said[:300], said[300:]] and Handle.timers == [1000]


def test_a_flow_of_all_runs_and_times_of_another_zone(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema, store = "run string, ts timestamp, number long, line string, exit int", "spark.sql.streaming.stateStore.providerClass"
    before = {k: spark.conf.get(k) for k in (store, "spark.sql.session.timeZone")}
    log = [("a", t0, 1, "upload x", None), ("a", t0, 2, 'say "\u00e9"', None), ("a", t0 + dt.timedelta(microseconds=7), 0, None, 1), ("zz", t0 + dt.timedelta(days=1), 0, "end", 0)]
    spark.createDataFrame(log, schema).write.parquet(f"{tmp_path}/log")
    want = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/log").where("run = 'a'").selectExpr("number", "unix_micros(ts)").orderBy("number").collect()]
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        builds.track_flow(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), "1 hour", FLOW).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("run = 'a' and state in ('active', 'failed')").selectExpr("node", "state", "unix_micros(at)").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    (_, end), (_, began), _ = want
    assert {x for x in got if x[1] == "failed"} == {("g1", "failed", end), ("s3", "failed", end)} and {x[2] for x in got if x[1] == "active"} == {began}
