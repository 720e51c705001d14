"""Build logs on the nodes of a flow, by event time: lines are put in order before they advance the machine, whatever order they come in.

A run's lines wait as list state until the watermark has passed their time; a timer then takes all that are due in order of time, number and line. So
the transitions are those of the sorted log, as long as no line comes later than the watermark allows (Spark drops those that do). A finished run
keeps no state: a line after the exit that the watermark still lets in starts the run anew.

The lines of a batch wait as one value of text, with the flow, and what changes leaves a run as one text, which Spark writes and reads: each value of state
costs a call and an encoding, and each column of a run's frame a conversion.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

TRANSITIONS = "run: string, node: string, state: string, at: long"  # at: microseconds
#: A flow's nodes, in order: label is the program that a step runs; role is step, group (a lane or target over the steps of its row) or entry (what triggers it).
FLOW = "array<struct<node:string,label:string,row:int,role:string>>"
_LINES = "flow string, lines string"  # JSON of FLOW; of a list of lines (at: microseconds, number, line, exit)
_WAITING, _PROGRESS = "waiting", "progress"
_NAMES = ("run", "node", "state", "at")


class FlowRun:
    """The machine of one run: a frontier over a flow's steps. advance() and finish() give the nodes whose state changes, in order of the flow."""

    def __init__(self, flow: Sequence[tuple[str, str, int, str]], states: dict[str, str] | None = None, frontier: int = 0):
        self.flow = [tuple(n) for n in flow]
        self.steps = [(node, label.lower(), row) for node, label, row, role in self.flow if role == "step"]
        self.states = dict(states) if states else {node: "pending" for node, *_ in self.flow}
        self.frontier = frontier

    def start(self) -> list[tuple[str, str]]:
        return self._changed(lambda: self._activate(0) if self.steps else None)

    def advance(self, line: str) -> list[tuple[str, str]]:
        """A line that runs a program makes the next step of that name active, else the next step; the steps before it are done."""
        program = self._program(line)
        if program is None or self.frontier >= len(self.steps):
            return []
        named = [i for i in range(self.frontier, len(self.steps)) if self.steps[i][1] == program]
        target = named[0] if named else self.frontier

        def move() -> None:
            for node, _, _ in self.steps[self.frontier : target]:
                self.states[node] = "done"
            self._activate(target)
            self.frontier = target + 1

        return self._changed(move)

    def finish(self, code: int) -> list[tuple[str, str]]:
        """Exit 0: all is done. Else the active step and its group have failed, and what was to come stays pending."""
        def end() -> None:
            for node, s in self.states.items():
                self.states[node] = "done" if code == 0 else "failed" if s == "active" and node in {n for n, _, _ in self.steps} else s
        return self._changed(end)

    def _activate(self, i: int) -> None:
        for node, _, _ in self.steps:
            if self.states[node] == "active":
                self.states[node] = "done"
        self.states[self.steps[i][0]] = "active"

    def _changed(self, act) -> list[tuple[str, str]]:
        before = dict(self.states)
        act()
        for node, _, row, role in self.flow:
            own = [self.states[n] for n, _, r in self.steps if r == row]
            if role == "step" or not own:
                continue
            began = any(s != "pending" for s in own)
            if role == "entry":
                self.states[node] = "done" if began else "pending"
            else:
                self.states[node] = "failed" if "failed" in own else "done" if all(s == "done" for s in own) else "active" if began else "pending"
        return [(node, self.states[node]) for node, *_ in self.flow if self.states[node] != before[node]]

    def _program(self, line: str) -> str | None:
        """The program that a line runs: of a step's name, or of a line that looks like a command. A build tool's own messages are none."""
        words = line.split()
        if not words or line.strip().startswith(("make[", "make:", "gmake")):
            return None
        program = words[0].rsplit("/", 1)[-1].lower()
        if any(program == label for _, label, _ in self.steps):
            return program
        return program if len(words) > 1 and words[0][0].isalpha() and ": error" not in line else None


class _Tracker(StatefulProcessor):
    def __init__(self, flow: str | None = None):
        self.flow = flow

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState(_WAITING, _LINES)
        self.progress = handle.getValueState(_PROGRESS, "flow string, states string, frontier int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            self.waiting.appendValue((self.flow or pdf["flow"].iloc[0], f"[{','.join(pdf['line'])}]"))
            first = int(pdf["due"].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get())
        lines = sorted(((x["at"], x["number"], x.get("line") or "", x.get("exit")) for _, some in waiting for x in json.loads(some)), key=lambda x: x[:3])
        due = [x for x in lines if x[0] // 1000 <= mark]
        out: list[tuple] = []
        if due:
            shape, states, frontier = self.progress.get() or (waiting[0][0], "[]", 0)
            flow, states = [(n.get("node"), n.get("label"), n.get("row"), n.get("role")) for n in json.loads(shape)], json.loads(states)
            run = FlowRun(flow, dict(zip([n[0] for n in flow], states, strict=True)) if states else None, frontier)
            if not states:
                out += [(key[0], *c, due[0][0]) for c in run.start()]
            ended = False
            for ts, _, line, code in due:
                if ended:
                    break  # nothing follows an exit
                out += [(key[0], *c, ts) for c in (run.advance(line) if code is None else run.finish(code))]
                ended = code is not None
            rest = lines[len(due) :]
            if ended and not rest:
                self.waiting.clear()
                self.progress.clear()
            else:
                kept = [dict(zip(("at", "number", "line", "exit"), x, strict=True)) for x in rest]
                self.waiting.put([(shape, json.dumps(kept))]) if rest else self.waiting.clear()
                self.progress.update((shape, json.dumps([run.states[n[0]] for n in flow]), len(run.steps) if ended else run.frontier))
                if rest:
                    self.handle.registerTimer(rest[0][0] // 1000)
        if out:
            yield pd.DataFrame({"changes": [json.dumps([dict(zip(_NAMES, x, strict=True)) for x in out])]})

    def close(self) -> None:
        pass


def track_flow(log: DataFrame, late: str = "10 minutes", flow: Sequence[tuple[str, str, int, str]] | None = None) -> DataFrame:
    """run, node, state, at: every transition of the flow's nodes, of a stream of log lines (run, ts, number, line, exit, flow).

    number orders lines of one time; a row with `exit` (the exit code) ends its run; flow (see FLOW) is that of the run's first row; one given here is
    that of all runs, and the log needs no such column. late: how long after newer lines a line may come. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    line = F.to_json(F.struct(F.unix_micros("ts").alias("at"), "number", "line", "exit"))
    own = [F.to_json("flow").alias("flow")] if flow is None else []
    rows = log.select("run", "ts", F.unix_millis("ts").alias("due"), line.alias("line"), *own).withWatermark("ts", late)
    tracker = _Tracker(None if flow is None else json.dumps([dict(zip(("node", "label", "row", "role"), n, strict=True)) for n in flow]))
    found = rows.groupBy("run").transformWithStateInPandas(statefulProcessor=tracker, outputStructType="changes string", outputMode="Append", timeMode="EventTime")
    changes = found.select(F.explode(F.from_json("changes", f"array<struct<{TRANSITIONS}>>")).alias("c"))
    return changes.select("c.run", "c.node", "c.state", F.timestamp_micros("c.at").alias("at"))
