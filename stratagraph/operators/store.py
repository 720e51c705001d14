"""Commits as one step: assert entities, retract entities, assert relationships, retract relationships, link provenance; all or nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import temporal
from .versioned import Change, Spec, VersionedTables


class UnknownEntity(LookupError):
    """A commit names an entity that neither it nor the current graph has."""


class UnknownRelationship(LookupError):
    """A commit retracts an edge that is not current."""


@dataclass(frozen=True)
class Tables:
    """versions: entity_id, state, valid_from, valid_to. edges: id, the five key columns, valid_from, valid_to. provenance: fact_kind, fact_id,
    observation_id. repositories: repo, display_name. observations: id and what was seen."""

    versions: DataFrame
    edges: DataFrame
    provenance: DataFrame
    repositories: DataFrame
    observations: DataFrame


@dataclass(frozen=True)
class Changes:
    """entities: entity_id, state (and position); gone: entity_id; edges: the five key columns; closed: id; links: fact_kind, fact_id, observation_id."""

    entities: DataFrame | None = None
    gone: DataFrame | None = None
    edges: DataFrame | None = None
    closed: DataFrame | None = None
    links: DataFrame | None = None


VERSION = "entity_id long, state string, valid_from long, valid_to long"
EDGE = "id long, source_id long, target_id long, kind string, layer string, properties string, valid_from long, valid_to long"
LINK = "fact_kind string, fact_id long, observation_id long"


def empty(spark: SparkSession) -> Tables:
    none = lambda schema: spark.createDataFrame([], schema)
    return Tables(none(VERSION), none(EDGE), none(LINK), none("repo string, display_name string"), none("id long, path string, kind string, payload string"))


def upsert_repository(tables: Tables, rows: DataFrame) -> Tables:
    """Repositories (repo, display_name) by id; the new name replaces the old."""
    kept = tables.repositories.join(rows.select("repo").distinct(), "repo", "left_anti")
    return replace(tables, repositories=kept.unionByName(rows.groupBy("repo").agg(F.max("display_name").alias("display_name"))))


def record_snapshot(files: DataFrame, snapshots: DataFrame, snapshot_files: DataFrame, repo: str, snapshot_id: int) -> tuple[DataFrame, DataFrame]:
    """snapshots (repo, snapshot_id) and snapshot_files (snapshot_id, path, blob_hash, size) with a manifest (path, blob_hash, size) appended."""
    spark = files.sparkSession
    one = spark.createDataFrame([(repo, snapshot_id)], "repo string, snapshot_id long")
    rows = files.select(F.lit(snapshot_id).cast("long").alias("snapshot_id"), "path", "blob_hash", "size")
    return snapshots.unionByName(one), snapshot_files.unionByName(rows)


def record_observations(tables: Tables, rows: DataFrame) -> tuple[Tables, DataFrame]:
    """Observations (path, kind, payload) appended; their ids are hashes of what they say, so the same observation has one id wherever it is made."""
    new = rows.withColumn("id", F.xxhash64("path", "kind", "payload"))
    fresh = new.dropDuplicates(["id"]).join(tables.observations.select("id"), "id", "left_anti")
    return replace(tables, observations=tables.observations.unionByName(fresh.select(*tables.observations.columns))), new


def commit(tables: Tables, changes: Changes, revision: int) -> Tables:
    """The tables after a revision. Raises and changes nothing if an asserted or retracted entity or edge end is unknown, or a retracted edge is
    not current once the entities are retracted."""
    none = lambda schema: tables.versions.sparkSession.createDataFrame([], schema)
    entities = changes.entities if changes.entities is not None else none("entity_id long, state string")
    gone = changes.gone if changes.gone is not None else none("entity_id long")
    edges = changes.edges if changes.edges is not None else none("source_id long, target_id long, kind string, layer string, properties string")
    closed = changes.closed if changes.closed is not None else none("id long")
    ever = tables.versions.select("entity_id").unionByName(entities.select("entity_id")).distinct()
    if not gone.join(ever, "entity_id", "left_anti").isEmpty():
        raise UnknownEntity("a retracted entity is unknown")
    after = temporal.commit_entities(tables.versions, entities, gone, revision)
    now = after.where("valid_to is null").select(F.col("entity_id").alias("id")).distinct()
    if not temporal.unknown_endpoints(edges, now).isEmpty():
        raise UnknownEntity("an asserted relationship has an end that is not in this commit or the current graph")
    ends = gone.select(F.col("entity_id").alias("g")).distinct()
    current = tables.edges.where("valid_to is null").join(ends, F.col("source_id") == F.col("g"), "left_anti").join(ends, F.col("target_id") == F.col("g"), "left_anti")
    if not closed.join(current.select("id"), "id", "left_anti").isEmpty():
        raise UnknownRelationship("a retracted relationship is not current")
    linked = tables.provenance if changes.links is None else temporal.link_provenance(tables.provenance, changes.links)
    return replace(tables, versions=after, edges=temporal.commit_edges(tables.edges, edges, closed, gone, revision), provenance=linked)


class GraphStore(Protocol):
    """What callers of a graph need of it."""

    def revision(self) -> int: ...
    def tables(self, revision: int | None = None) -> Tables: ...
    def commit(self, changes: Changes) -> int: ...


@dataclass
class MemoryStore:
    """A store for tests: the tables of every revision are kept as they were."""

    spark: SparkSession
    _states: list[Tables] = field(default_factory=list)

    def revision(self) -> int:
        return len(self._states)

    def tables(self, revision: int | None = None) -> Tables:
        r = self.revision() if revision is None else revision
        return self._states[r - 1] if r else empty(self.spark)

    def commit(self, changes: Changes) -> int:
        r = self.revision() + 1
        self._states.append(commit(self.tables(), changes, r))
        return r


#: The graph as stored tables. An edge is closed by its id, a version by its entity; bases are dealt by what look-ups ask for.
STORED = {
    "versions": Spec("entity_id long, state string", ("entity_id",), "entity_id"),
    "edges": Spec("id long, source_id long, target_id long, kind string, layer string, properties string", ("id",), "source_id"),
    "links": Spec(LINK, ("fact_kind", "fact_id", "observation_id"), "fact_id"),
    "repositories": Spec("repo string, display_name string", ("repo",), "repo"),
    "observations": Spec("id long, path string, kind string, payload string", ("id",), "id"),
}
#: Changes of up to so many entities look their versions up by key; beyond, they meet the whole table in a join.
FEW = 256


class StoredGraph:
    """A graph store in a folder (see versioned.VersionedTables): a commit writes what it changes, all of it or nothing, on top of the head it was
    computed from. A second writer that commits meanwhile makes it fail with versioned.Conflict."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.stored = spark, VersionedTables(spark, root, STORED)

    def revision(self) -> int:
        return self.stored.revision()

    def tables(self, revision: int | None = None) -> Tables:
        """All rows up to a revision, with the intervals as they were then."""
        get = self.stored.rows if revision is None else lambda name: self.stored.as_it_was(name, revision)
        now = lambda name: get(name).where("valid_to is null").drop("valid_from", "valid_to")
        return Tables(get("versions"), get("edges"), now("links"), now("repositories"), now("observations"))

    def _known(self, at: dict, ids: DataFrame) -> DataFrame:
        """Versions of the entities named (id): by key if they are few."""
        few = [r.id for r in ids.distinct().limit(FEW + 1).collect()]
        return self.stored.rows("versions", few if len(few) <= FEW else None, at)

    def commit(self, changes: Changes, repositories: DataFrame | None = None, observations: DataFrame | None = None) -> int:
        """The new revision. Raises UnknownEntity or UnknownRelationship as commit() does, and Conflict if the head moved meanwhile; then nothing is changed."""
        at = self.stored.head()
        r = at["revision"] + 1
        none = lambda schema: self.spark.createDataFrame([], schema)
        entities = changes.entities if changes.entities is not None else none("entity_id long, state string")
        gone = changes.gone if changes.gone is not None else none("entity_id long")
        made: dict[str, Change] = {}
        ends = None
        if changes.edges is not None:
            ends = changes.edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        if changes.entities is not None or changes.gone is not None or ends is not None:
            named = entities.select(F.col("entity_id").alias("id")).unionByName(gone.select(F.col("entity_id").alias("id")))
            versions = self._known(at, named if ends is None else named.unionByName(ends))
            if changes.gone is not None and not gone.join(versions, "entity_id", "left_anti").join(entities, "entity_id", "left_anti").isEmpty():
                raise UnknownEntity("a retracted entity is unknown")
            current = versions.where("valid_to is null")
            if ends is not None:
                after = current.select("entity_id").unionByName(entities.select("entity_id")).join(gone, "entity_id", "left_anti")
                if not ends.join(after, F.col("id") == F.col("entity_id"), "left_anti").isEmpty():
                    raise UnknownEntity("an asserted relationship has an end that is not in this commit or the current graph")
            if changes.entities is not None or changes.gone is not None:
                made["versions"] = Change(*temporal.entity_changes(current, entities, gone, r))
        if changes.edges is not None or changes.closed is not None or changes.gone is not None:
            current = self.stored.current("edges", at=at)
            closed = changes.closed if changes.closed is not None else none("id long")
            if changes.closed is not None:
                g = gone.select(F.col("entity_id").alias("g")).distinct()
                open_edges = current.join(g, F.col("source_id") == F.col("g"), "left_anti").join(g, F.col("target_id") == F.col("g"), "left_anti") if changes.gone is not None else current
                if not closed.join(open_edges.select("id"), "id", "left_anti").isEmpty():
                    raise UnknownRelationship("a retracted relationship is not current")
            made["edges"] = Change(*temporal.edge_changes(current, changes.edges, changes.closed, changes.gone, r))
        new = F.lit(r).cast("long").alias("valid_from")
        if changes.links is not None:
            key = list(STORED["links"].key)
            made["links"] = Change(changes.links.select(*key).distinct().join(self.stored.rows("links", at=at).select(*key), key, "left_anti").select("*", new))
        if observations is not None:
            rows = observations.withColumn("id", F.xxhash64("path", "kind", "payload")).dropDuplicates(["id"])
            made["observations"] = Change(rows.join(self.stored.rows("observations", at=at).select("id"), "id", "left_anti").select("id", "path", "kind", "payload", new))
        if repositories is not None:
            rows = repositories.groupBy("repo").agg(F.max("display_name").alias("display_name"))
            old = self.stored.current("repositories", at=at).select("repo", F.col("display_name").alias("old"), "valid_from").join(rows, "repo").where("not old <=> display_name")
            made["repositories"] = Change(rows.join(self.stored.current("repositories", at=at), ["repo", "display_name"], "left_anti").select("*", new), old.select("repo", "valid_from", F.lit(r).cast("long").alias("valid_to")))
        return self.stored.commit(at, made)["revision"]

    def tidy(self) -> list[str]:
        """Fold deltas of the tables that are due into new bases; their names. History stays."""
        due = [name for name in STORED if self.stored.due(name)]
        for name in due:
            self.stored.compact(name)
        return due


#: Passes over the whole graph that propose changes, in the order in which they run: name -> (tables, revision) -> changes.
DERIVERS: dict[str, Callable[[Tables, int], Changes]] = {}


def deriver(name: str):
    """Register a pass; a name that is taken is replaced."""
    def add(f: Callable[[Tables, int], Changes]):
        DERIVERS[name] = f
        return f
    return add


def derive_all(store: GraphStore) -> int:
    """Run the registered passes, each over what the one before committed; the revision afterwards."""
    for f in list(DERIVERS.values()):
        store.commit(f(store.tables(), store.revision()))
    return store.revision()
