"""Versioned tables in a folder: a base, deltas on top, and a head that moves by compare-and-set.

A table holds intervals [valid_from, valid_to). A commit writes only what it changes: rows it opens, and the keys of rows it closes. A manifest
names the folders that make up each table; it is written last, under the next free number, by a rename that fails if that number is taken. So of two
writers that started from one head one wins and the other one gets Conflict; what was written before a crash is not named by any manifest and is never read; a reader
keeps the manifest it began with. compact() folds deltas into a new base, whose rows are dealt into buckets by a column, so a look-up of few
keys reads few files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Closed keys are broadcast to the rows up to this count, which the manifest knows; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
#: Deltas of a table, and delta rows for each row of its base, beyond which it is due for compaction.
MOST_DELTAS, DUE_SHARE, DUE_ROWS = 16, 0.2, 50_000
WRITERS = 6
INTERVAL = ", valid_from long, valid_to long"


class Conflict(RuntimeError):
    """Another writer moved the head first. Nothing was changed; read again and commit again."""


@dataclass(frozen=True)
class Spec:
    """columns without the interval; key: with valid_from the columns that say which rows a closing means; bucket: the column that a base is dealt by."""

    columns: str
    key: tuple[str, ...]
    bucket: str
    buckets: int = 16  # Spark lists over 32 folders by a job

    @property
    def schema(self) -> str:
        return self.columns + INTERVAL


@dataclass(frozen=True)
class Change:
    """opened: the columns, valid_from and perhaps valid_to. closed: the key, valid_from of the row, valid_to."""

    opened: DataFrame | None = None
    closed: DataFrame | None = None


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str, specs: dict[str, Spec]):
        self.spark, self.root, self.specs = spark, root.rstrip("/"), specs

    # ---- the head

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("log").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def head(self) -> dict:
        """The newest manifest: seq, revision, tables: name -> base, rows, deltas (folder, opened, closed)."""
        fs, log = self._fs(), self._path("log")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        names = [n for n in names if n.isdigit()]
        if not names:
            return {"seq": 0, "revision": 0, "tables": {}}
        stream = fs.open(self._path(f"log/{max(names)}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def revision(self) -> int:
        return self.head()["revision"]

    def _advance(self, manifest: dict) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        own = self._path(f"log/_{uuid.uuid4().hex}")
        out = self._fs().create(own, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        only_new = self.spark.sparkContext._gateway.new_array(rename, 1)
        only_new[0] = rename.NONE
        try:
            files.rename(own, self._path(f"log/{manifest['seq']:012d}"), only_new)
        except Exception as failed:
            self._fs().delete(own, False)
            if "FileAlreadyExists" in str(failed):
                raise Conflict(f"commit {manifest['seq']} was made by another writer") from failed
            raise

    # ---- reading

    def rows(self, name: str, keys: Sequence | None = None, at: dict | None = None) -> DataFrame:
        """All rows of a table with their intervals. keys: only those values of the bucket column; of the base their buckets' files are read."""
        spec, at = self.specs[name], self.head() if at is None else at
        state = at["tables"].get(name)
        if state is None:
            return self.spark.createDataFrame([], spec.schema)
        only = None if keys is None else F.col(spec.bucket).isin(list(keys))
        parts = []
        if state["base"]:
            base = self.spark.read.schema(spec.schema + ", _bucket int").parquet(f"{self.root}/{state['base']}")
            if keys is not None:
                of = self.spark.range(1).select(F.array_distinct(F.array(*[self._bucket(F.lit(k).cast(base.schema[spec.bucket].dataType), spec) for k in keys])).alias("b")).first().b if keys else []
                base = base.where(F.col("_bucket").isin(of) & only)
            parts.append(base.drop("_bucket"))
        deltas = None
        if state["deltas"]:
            deltas = self.spark.read.schema(spec.schema + ", op string").parquet(*[f"{self.root}/{d['folder']}" for d in state["deltas"]])
            deltas = deltas if only is None else deltas.where(only | (F.col("op") == "c"))
            parts.append(deltas.where("op = 'o'").drop("op"))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        n_closed = sum(d["closed"] for d in state["deltas"])
        if not n_closed:
            return found
        on = [*spec.key, "valid_from"]
        closed = deltas.where("op = 'c'").select(*on, F.col("valid_to").alias("_to"))
        closed = F.broadcast(closed) if n_closed <= BROADCAST_ROWS else closed
        same = found["valid_from"] == closed["valid_from"]
        for k in spec.key:
            same = same & found[k].eqNullSafe(closed[k])
        return found.join(closed.select(*[closed[c] for c in on], "_to"), same, "left").select(*[found[c] for c in found.columns if c != "valid_to"], F.coalesce(found["valid_to"], "_to").alias("valid_to"))

    def current(self, name: str, keys: Sequence | None = None, at: dict | None = None) -> DataFrame:
        return self.rows(name, keys, at).where("valid_to is null")

    def as_it_was(self, name: str, revision: int) -> DataFrame:
        """All rows as they stood after a revision."""
        later = F.col("valid_to") > revision
        return self.rows(name).where(F.col("valid_from") <= revision).withColumn("valid_to", F.when(~later, F.col("valid_to")))

    @staticmethod
    def _bucket(value: Column, spec: Spec) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(spec.buckets)).cast("int")

    # ---- writing

    def commit(self, base: dict, changes: dict[str, Change], revision: int | None = None) -> dict:
        """Write the changes on top of the manifest they were computed from, as its next revision; the new manifest. Raises Conflict if the head has moved."""
        new = json.loads(json.dumps(base)) | {"seq": base["seq"] + 1, "revision": base["revision"] + 1 if revision is None else revision}
        with ThreadPoolExecutor(WRITERS) as pool:  # small jobs of different tables side by side
            deltas = list(pool.map(lambda x: self._written(*x), changes.items()))
        for name, delta in zip(changes, deltas, strict=True):
            if delta:
                state = new["tables"].setdefault(name, {"base": None, "rows": 0, "deltas": []})
                state["deltas"].append(delta)
        self._advance(new)
        return new

    def _written(self, name: str, change: Change) -> dict | None:
        spec = self.specs[name]
        empty = self.spark.createDataFrame([], spec.schema)
        names = empty.columns
        parts = []
        if change.opened is not None:
            opened = change.opened if "valid_to" in change.opened.columns else change.opened.withColumn("valid_to", F.lit(None).cast("long"))
            parts.append(opened.select(*names, F.lit("o").alias("op")))
        if change.closed is not None:
            parts.append(change.closed.select(*[F.col(c).cast(empty.schema[c].dataType).alias(c) if c in (*spec.key, "valid_from", "valid_to") else F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in names], F.lit("c").alias("op")))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        folder = f"{name}/{uuid.uuid4().hex}"
        seen = Observation()
        rows.observe(seen, F.count_if(F.col("op") == "o").alias("opened"), F.count_if(F.col("op") == "c").alias("closed")).write.parquet(f"{self.root}/{folder}")
        got = seen.get
        return {"folder": folder, **got} if got["opened"] + got["closed"] else None

    def due(self, name: str, at: dict | None = None) -> bool:
        state = (self.head() if at is None else at)["tables"].get(name)
        if state is None:
            return False
        rows = sum(d["opened"] + d["closed"] for d in state["deltas"])
        return len(state["deltas"]) > MOST_DELTAS or rows > max(DUE_ROWS, DUE_SHARE * state["rows"])

    def compact(self, name: str) -> dict:
        """Fold a table's deltas into a new base. Says the same as before; loses against a commit made meanwhile (Conflict)."""
        spec, at = self.specs[name], self.head()
        if not at["tables"].get(name, {}).get("deltas"):
            return at
        folder = f"{name}/{uuid.uuid4().hex}"
        seen = Observation()
        rows = self.rows(name, at=at).observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("_bucket", self._bucket(F.col(spec.bucket), spec))
        rows.repartitionByRange("_bucket", spec.bucket, *spec.key, "valid_from").sortWithinPartitions("_bucket", spec.bucket).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        new = json.loads(json.dumps(at)) | {"seq": at["seq"] + 1}
        new["tables"][name] = {"base": folder if seen.get["rows"] else None, "rows": seen.get["rows"], "deltas": []}
        self._advance(new)
        return new

    def delete(self, folder: str) -> None:
        """Delete a folder under the root that no manifest names; "": all of it."""
        self._fs().delete(self._path(folder) if folder else self._path("log").getParent(), True)

    def vacuum(self) -> int:
        """Delete data folders that the head does not name, and older manifests. Not while others read or write. How many folders went."""
        at, fs, gone = self.head(), self._fs(), 0
        named = {f for s in at["tables"].values() for f in (s["base"], *(d["folder"] for d in s["deltas"])) if f}
        for name in self.specs:
            for s in fs.listStatus(self._path(name)) if fs.exists(self._path(name)) else []:
                if f"{name}/{s.getPath().getName()}" not in named:
                    fs.delete(s.getPath(), True)
                    gone += 1
        for s in fs.listStatus(self._path("log")) if fs.exists(self._path("log")) else []:
            if s.getPath().getName() != f"{at['seq']:012d}":
                fs.delete(s.getPath(), False)
        return gone
