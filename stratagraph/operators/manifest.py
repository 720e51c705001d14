"""Set operations over content-addressed manifests: diff, renames, pruning, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, blob_hash (new or last), size, change: added, modified or removed. old and new: path, blob_hash, size."""
    o = old.select("path", F.col("blob_hash").alias("o_hash"), F.col("size").alias("o_size"))
    n = new.select("path", F.col("blob_hash").alias("n_hash"), F.col("size").alias("n_size"))
    both = o.join(n, "path", "full")
    change = F.when(F.col("o_hash").isNull(), "added").when(F.col("n_hash").isNull(), "removed").when(F.col("o_hash") != F.col("n_hash"), "modified")
    return both.withColumn("change", change).where("change is not null").select("path", F.coalesce("n_hash", "o_hash").alias("blob_hash"), F.coalesce("n_size", "o_size").alias("size"), "change")


def retracted_paths(diff: DataFrame) -> DataFrame:
    return diff.where("change in ('removed', 'modified')").select("path")


def _only(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands once."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def renames(diff: DataFrame) -> DataFrame:
    """old_path, new_path, exact: first by the same blob where it is unique on both sides and not empty, then among what is left
    by a file name that is unique on both sides."""
    removed = diff.where("change = 'removed'").select(F.col("path").alias("old_path"), "blob_hash", "size")
    added = diff.where("change = 'added'").select(F.col("path").alias("new_path"), F.col("blob_hash").alias("n_hash"))
    exact = _only(removed.where("size > 0"), "blob_hash").join(_only(added, "n_hash"), F.col("blob_hash") == F.col("n_hash")).select("old_path", "new_path")
    rest_old = removed.join(exact.select("old_path"), "old_path", "left_anti").withColumn("name", F.element_at(F.split("old_path", "/"), -1))
    rest_new = added.join(exact.select("new_path"), "new_path", "left_anti").withColumn("n_name", F.element_at(F.split("new_path", "/"), -1))
    fuzzy = _only(rest_old, "name").join(_only(rest_new, "n_name"), F.col("name") == F.col("n_name")).where("old_path <> new_path").select("old_path", "new_path")
    return exact.withColumn("exact", F.lit(True)).unionByName(fuzzy.withColumn("exact", F.lit(False)))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key is not had: the work list of incremental indexing."""
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def prune(rows: DataFrame, alive: DataFrame, key: str = "blob_hash") -> DataFrame:
    """Rows whose key some manifest still has."""
    return rows.join(alive.select(key).distinct(), key, "left_semi")


def verify(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """fact, problem: facts only a rebuild has are missing, facts only the store has are stale (column fact in both)."""
    return rebuilt.select("fact").exceptAll(stored.select("fact")).withColumn("problem", F.lit("missing")).unionByName(stored.select("fact").exceptAll(rebuilt.select("fact")).withColumn("problem", F.lit("stale")))


def paths_of_blobs(files: DataFrame) -> DataFrame:
    """blob_hash, path: where each blob stands, a row a path; lists show them by path."""
    return files.select("blob_hash", "path").distinct()
