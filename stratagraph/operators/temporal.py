"""Revision intervals [valid_from, valid_to): reads at a revision, commits as SCD-2 merges, diffs, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(revision: int | Column | None = None) -> Column:
    """True for rows that are current, or (with a revision) valid at it."""
    if revision is None:
        return F.col("valid_to").isNull()
    r = revision if isinstance(revision, Column) else F.lit(revision)
    return (F.col("valid_from") <= r) & (F.col("valid_to").isNull() | (F.col("valid_to") > r))


def as_of(facts: DataFrame, revision: int | None = None) -> DataFrame:
    return facts.where(visible(revision))


def at_revisions(facts: DataFrame, revisions: DataFrame) -> DataFrame:
    """Facts valid at each of the revisions (column revision): a range join on the interval."""
    return facts.join(revisions, (F.col("valid_from") <= F.col("revision")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("revision"))))


def entities_at(entities: DataFrame, versions: DataFrame, revision: int | None = None) -> DataFrame:
    """Entities with the version that is valid at the revision."""
    return entities.withColumnRenamed("id", "entity_id").join(as_of(versions, revision).withColumnRenamed("id", "version_id"), "entity_id")


def revision_diff(facts: DataFrame, after: int, upto: int) -> DataFrame:
    """Rows asserted or retracted within (after, upto], with the change; a row may be both."""
    inside = lambda c: (F.col(c) > after) & (F.col(c) <= upto)
    changes = F.array_compact(F.array(F.when(inside("valid_from"), F.lit("asserted")), F.when(inside("valid_to"), F.lit("retracted"))))
    return facts.where(inside("valid_from") | inside("valid_to")).withColumn("change", F.explode(changes))


def node_delta(versions: DataFrame, after: int, upto: int, key: str = "entity_id") -> DataFrame:
    """Keys added, removed or changed within (after, upto]. A key that came and went within the interval is changed."""
    d = revision_diff(versions, after, upto).groupBy(key).agg(F.max(F.col("change") == "asserted").alias("a"), F.max(F.col("change") == "retracted").alias("r"))
    return d.select(key, F.when(F.col("a") & F.col("r"), "changed").when(F.col("a"), "added").otherwise("removed").alias("delta"))


def first_assertions(asserted: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """key and values of the first assertion of each key, by position and values."""
    order = F.struct(*[F.col(c) for c in (["position"] if "position" in asserted.columns else []) + values])
    return asserted.groupBy(*key).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*key, "_v.*")


def commit_entities(versions: DataFrame, asserted: DataFrame, retracted: DataFrame, revision: int) -> DataFrame:
    """The versions after a commit. asserted: entity_id, state and (where an entity is asserted more than once) position; retracted:
    entity_id. State is one comparable column.

    The first assertion of an entity by position counts (without that column the least state); a state equal to the current one changes
    nothing; retraction comes after assertion.
    """
    asserted = first_assertions(asserted, ["entity_id"], ["state"]).select("entity_id", F.col("state").alias("new_state"), F.lit(True).alias("is_new"))
    gone = retracted.select("entity_id").distinct().withColumn("is_gone", F.lit(True))
    current = versions.where("valid_to is null").select("entity_id", F.col("state").alias("old_state")).withColumn("is_old", F.lit(True))
    change = asserted.join(current, "entity_id", "full").join(gone, "entity_id", "full")
    change = change.withColumn("opens", F.coalesce(F.col("is_new") & (F.col("is_old").isNull() | ~F.col("new_state").eqNullSafe(F.col("old_state"))), F.lit(False)))
    closing = change.where("is_old and (opens or is_gone)").select("entity_id", F.lit(True).alias("closes"))
    kept = versions.join(closing, "entity_id", "left").withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("closes"), F.lit(revision).cast("long")).otherwise(F.col("valid_to"))).drop("closes")
    opened = change.where("opens").select("entity_id", F.col("new_state").alias("state"), F.lit(revision).cast("long").alias("valid_from"), F.when(F.col("is_gone"), F.lit(revision).cast("long")).alias("valid_to"))
    return kept.unionByName(opened.select(*kept.columns))


def entity_changes(current: DataFrame, asserted: DataFrame, retracted: DataFrame, revision: int) -> tuple[DataFrame, DataFrame]:
    """What commit_entities() changes, without the rows that stay: versions it opens (entity_id, state, valid_from, valid_to) and versions it closes
    (entity_id, valid_from, valid_to). current: entity_id, state, valid_from of current versions, at least of the entities named."""
    asserted = first_assertions(asserted, ["entity_id"], ["state"]).select("entity_id", F.col("state").alias("new_state"), F.lit(True).alias("is_new"))
    gone = retracted.select("entity_id").distinct().withColumn("is_gone", F.lit(True))
    change = asserted.join(gone, "entity_id", "full").join(current.select("entity_id", F.col("state").alias("old_state"), "valid_from", F.lit(True).alias("is_old")), "entity_id", "left")
    opens = F.coalesce(F.col("is_new") & (F.col("is_old").isNull() | ~F.col("new_state").eqNullSafe(F.col("old_state"))), F.lit(False))
    r = F.lit(revision).cast("long")
    opened = change.where(opens).select("entity_id", F.col("new_state").alias("state"), r.alias("valid_from"), F.when(F.col("is_gone"), r).alias("valid_to"))
    return opened, change.where(F.col("is_old") & (opens | F.col("is_gone"))).select("entity_id", "valid_from", r.alias("valid_to"))


EDGE_KEY = ("source_id", "target_id", "kind", "layer", "properties")


def commit_edges(edges: DataFrame, asserted: DataFrame, retracted: DataFrame, gone_entities: DataFrame, revision: int) -> DataFrame:
    """The edges after a commit: edges of retracted entities close, new ones open unless the five key columns are current, retracted ids close.

    retracted: id. gone_entities: entity_id. An asserted edge's id is a hash of its key and the revision.
    """
    gone = gone_entities.select(F.col("entity_id").alias("g")).distinct()
    now = edges.where("valid_to is null")
    of_gone = lambda end: now.join(gone, F.col(end) == F.col("g"), "left_semi").select("id")
    closed = of_gone("source_id").unionByName(of_gone("target_id")).unionByName(retracted.select("id")).distinct()
    still = edges.join(closed.withColumn("closes", F.lit(True)), "id", "left")
    still = still.withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("closes"), F.lit(revision).cast("long")).otherwise(F.col("valid_to"))).drop("closes")
    current = now.join(gone, F.col("source_id") == F.col("g"), "left_anti").join(gone, F.col("target_id") == F.col("g"), "left_anti")
    a, c = asserted.select(*EDGE_KEY).distinct().alias("a"), current.alias("c")
    new = a.join(c, [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in EDGE_KEY], "left_anti")
    opened = new.withColumns({"id": F.xxhash64(*EDGE_KEY, F.lit(revision)), "valid_from": F.lit(revision).cast("long"), "valid_to": F.lit(None).cast("long")})
    return still.unionByName(opened.select(*still.columns))


def edge_changes(current: DataFrame, asserted: DataFrame | None, retracted: DataFrame | None, gone_entities: DataFrame | None, revision: int) -> tuple[DataFrame | None, DataFrame | None]:
    """What commit_edges() changes, without the rows that stay: edges it opens, and edges it closes (id, valid_from, valid_to). current: the current edges.
    None for what a commit does not say or does."""
    r = F.lit(revision).cast("long")
    closing, stays = [], current
    if retracted is not None:
        closing.append(current.join(retracted.select("id").distinct(), "id", "left_semi").select("id", "valid_from"))
    if gone_entities is not None:
        gone = gone_entities.select(F.col("entity_id").alias("g")).distinct()
        for end in ("source_id", "target_id"):
            closing.append(current.join(gone, F.col(end) == F.col("g"), "left_semi").select("id", "valid_from"))
            stays = stays.join(gone, F.col(end) == F.col("g"), "left_anti")
    closed = None
    for c in closing:
        closed = c if closed is None else closed.unionByName(c)
    if closed is not None:
        closed = (closed if gone_entities is None else closed.distinct()).withColumn("valid_to", r)
    if asserted is None:
        return None, closed
    a, c = asserted.select(*EDGE_KEY).distinct().alias("a"), stays.alias("c")
    new = a.join(c, [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in EDGE_KEY], "left_anti")
    return new.withColumns({"id": F.xxhash64(*EDGE_KEY, F.lit(revision)), "valid_from": r}), closed


def unknown_endpoints(asserted: DataFrame, entities: DataFrame) -> DataFrame:
    """Asserted edges an endpoint of which is no entity; a commit with any is refused as a whole."""
    known = entities.select(F.col("id").alias("k"))
    return asserted.join(known, F.col("source_id") == F.col("k"), "left_anti").unionByName(asserted.join(known, F.col("target_id") == F.col("k"), "left_anti")).distinct()


def link_provenance(links: DataFrame, new: DataFrame) -> DataFrame:
    """The bridge (fact_kind, fact_id, observation_id) with new links; each once."""
    return links.unionByName(new).dropDuplicates(["fact_kind", "fact_id", "observation_id"])


def why(links: DataFrame, fact_kind: str) -> DataFrame:
    """fact_id, observation_id of the facts of a kind: rows, however many observations a fact has; lists show them in order."""
    return links.where(F.col("fact_kind") == fact_kind).select("fact_id", "observation_id").distinct()


def latest_snapshot(snapshots: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per repository the newest snapshot that a committed revision names: repository_id, snapshot_id."""
    return snapshots.join(revisions.select("snapshot_id").distinct(), "snapshot_id", "left_semi").groupBy("repository_id").agg(F.max("snapshot_id").alias("snapshot_id"))


def upsert_latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key by order: INSERT OR REPLACE."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).where("_n = 1").drop("_n")
