"""Continuous indexing: debounced change streams, incremental commits, the build tracker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

LOG_LINES = 400


def debounced(changes: DataFrame, gap: str = "500 milliseconds", late: str | None = None) -> DataFrame:
    """key, first, last, n: bursts of changes (key, ts) without a pause of `gap`. The same for batches and streams (`late`: the watermark)."""
    rows = changes if late is None else changes.withWatermark("ts", late)
    return rows.groupBy("key", F.session_window("ts", gap).alias("s")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).drop("s")


def watch(files: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run index(batch, batch id) for the new rows of a file stream; without `every`, until what is there has been taken.

    A batch that runs again after a failure has the same id, so index() can tell that it is done.
    """
    writer = files.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


STEP = "run string, step string, state string, at long"


def track_builds(log: DataFrame) -> DataFrame:
    """run, step, state, at: the state of each build step after the log lines of a run (columns run, at, line), in order of `at`.

    A line `> step` starts a step (the one before is done), `error:` fails the active step, `** end` finishes the active one.
    Works on streams with state per run. Every transition is given out; of the log a run's state keeps the last LOG_LINES lines. Lines of
    one micro-batch are taken in order of (at, line); a line that comes in a later batch is taken after them, whatever its `at`.
    """
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names, states, tail = state.get if state.exists else ([], [], [])
        steps: dict[str, str] = dict(zip(names, states, strict=True))
        active = next((s for s, v in steps.items() if v == "active"), None)
        rows = pd.concat(list(batches)).sort_values(["at", "line"], kind="stable")
        out = []
        for at, line in zip(rows["at"], rows["line"], strict=True):
            if line.startswith("> "):
                if active:
                    steps[active] = "done"
                    out.append((key[0], active, "done", at))
                active = line[2:].strip()
                steps[active] = "active"
                out.append((key[0], active, "active", at))
            elif active and (line.lower().startswith("error:") or line.startswith("** end")):
                steps[active] = "failed" if line.lower().startswith("error:") else "done"
                out.append((key[0], active, steps[active], at))
                active = None
        state.update((list(steps), list(steps.values()), [*tail, *rows["line"]][-LOG_LINES:]))
        yield pd.DataFrame(out, columns=["run", "step", "state", "at"])

    return log.groupBy("run").applyInPandasWithState(advance, STEP, "steps array<string>, states array<string>, log array<string>", "append", "NoTimeout")


class Progress(StreamingQueryListener):
    """Hands a phase and its count of rows to `tell` whenever a micro-batch ends: what a progress display shows."""

    def __init__(self, tell: Callable[[str, str, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell(event.name or str(event.id), "started", 0)

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.name or str(event.progress.id), f"batch {event.progress.batchId}", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.tell(str(event.id), "idle", 0)

    def onQueryTerminated(self, event) -> None:
        self.tell(str(event.id), "failed" if event.exception else "ended", 0)


PREVIEW_EVERY, PREVIEW_FILES = "800 milliseconds", 4000


def previews(files: DataFrame, show: Callable[[DataFrame], None], checkpoint: str, every: str = PREVIEW_EVERY, most: int = PREVIEW_FILES) -> StreamingQuery:
    """Show partial snapshots (path, newest row) of a file stream, one every `every` at most, and none once `most` files were shown.

    Each preview is the newest state only: previews that nobody took are not kept.
    """
    newest = files.groupBy("path").agg(F.max_by("blob_hash", "ts").alias("blob_hash"), F.max("ts").alias("ts"))
    shown = {"files": 0}

    def one(batch: DataFrame, _: int) -> None:
        if shown["files"] < most:
            shown["files"] += batch.count()
            show(batch)

    return newest.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stale_enrichments(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Of the wanted enrichments (repo, fingerprint, snapshot_id) those that the ledger of done ones does not hold: the others are skipped."""
    key = ["repo", "fingerprint", "snapshot_id"]
    w, d = wanted.alias("w"), done.select(*key).distinct().alias("d")
    return w.join(d, [F.col(f"w.{c}").eqNullSafe(F.col(f"d.{c}")) for c in key], "left_anti")
