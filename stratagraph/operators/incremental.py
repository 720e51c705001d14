"""Scoped re-derivation: from the paths that changed to the facts that they support, to paths whose edges resolve otherwise now, and to the rollups above.

A fact is supported by the paths that say it: a declaration by its file, a folder by every file below it, a module by every file that imports it, a rollup
by every importing file below its folder. Only the supports of dirty paths are derived again. Their difference, counted by fact, moves the number of a
fact's supports, and with it the fact: it is asserted when the number leaves zero, retracted when it comes back to zero, and a fact whose state is that
number (a rollup) gets a new version whenever it moves. So a commit reads and writes rows in proportion to what the dirty paths say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from . import resolve
from .derive import path_ancestors

#: Facts whose state is the number of their supports.
COUNTED = "dependsOn"


def _edge(source: Column, target: Column, kind: str) -> Column:
    return F.struct(F.concat_ws("|", F.lit(kind), source, target).alias("stable_key"), F.lit("edge").alias("state"))


def _entity(key: Column, kind: str, name: Column) -> Column:
    return F.struct(key.alias("stable_key"), F.concat_ws("|", F.lit(kind), name).alias("state"))


def tree_supports(files: DataFrame, repo: str) -> DataFrame:
    """path, stable_key, state: each file, the folders above it, and the edges down to it, supported by it."""
    r = F.lit(repo)
    key = lambda p: F.when(p == "", model.repo_key(r)).otherwise(model.dir_key(r, p))
    above = path_ancestors(F.col("path"))
    last = lambda p: F.element_at(F.split(p, "/"), -1)
    folders = F.transform(above, lambda p: F.when(p == "", _entity(model.repo_key(r), "repository", r)).otherwise(_entity(model.dir_key(r, p), "directory", last(p))))
    steps = F.transform(F.filter(above, lambda p: p != ""), lambda p: _edge(key(F.regexp_extract(p, r"^(.*)/[^/]*$", 1)), model.dir_key(r, p), "containsPhysical"))
    own = F.array(_entity(model.file_key(r, F.col("path")), "file", last(F.col("path"))), _edge(key(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), model.file_key(r, F.col("path")), "containsPhysical"))
    return files.select("path", F.explode(F.concat(folders, steps, own)).alias("f")).select("path", "f.*")


def import_supports(imports: DataFrame, repo: str) -> DataFrame:
    """path, stable_key, state of the rollup: every folder above a file that imports a module depends on it; supported by the file."""
    up = imports.select("path", "module").distinct().select("path", "module", F.explode(F.array_distinct(path_ancestors(F.col("path")))).alias("folder"))
    return up.select("path", F.concat_ws("|", F.lit(COUNTED), F.lit(repo), "folder", "module").alias("stable_key"), F.lit(None).cast("string").alias("state"))


def supports(repo: str, files: DataFrame, seen: DataFrame, build: DataFrame, all_build: DataFrame, paths: DataFrame) -> DataFrame:
    """path, stable_key, state, each once: what some files of a repository say.

    files: path, lang; seen and build: their observations; all_build: those of all build files (lanes are called across files); paths: path of every
    file (dependencies are looked for there).
    """
    seen = seen.join(files.select("path", "lang"), "path")
    entities, edges = [], []
    for e, d in (resolve.declarations(seen, repo, by=("path",)), resolve.import_edges(seen, repo, by=("path",)), resolve.build_edges(build, paths, repo, by=("path",))):
        entities.append(e.select("path", "stable_key", F.concat_ws("|", "kind", "name").alias("state")))
        edges.append(d)
    lanes = all_build.where("tool = 'fastlane'")
    edges.append(resolve.invoked_lanes(build.where("tool = 'github-actions'").unionByName(lanes), repo, by=("path",)))
    rows = tree_supports(files, repo)
    for e in entities:
        rows = rows.unionByName(e)
    for d in edges:
        rows = rows.unionByName(d.select("path", F.concat_ws("|", "kind", "source_key", "target_key").alias("stable_key"), F.lit("edge").alias("state")))
    imports = seen.where("kind = 'importStatement'").select("path", F.concat("lang", F.lit(":module:"), "name").alias("module"))
    rows = rows.unionByName(import_supports(imports, repo))
    return rows.groupBy("path", "stable_key").agg(F.min("state").alias("state"))


def facts(supported: DataFrame) -> DataFrame:
    """stable_key, state, n of all supports: what there would be without history."""
    each = supported.groupBy("stable_key", "state").agg(F.count(F.lit(1)).alias("n"))  # a least string is found by sorting: of few rows, not of all supports
    n = each.groupBy("stable_key").agg(F.min("state").alias("state"), F.sum("n").alias("n"))
    return n.withColumn("state", _state(F.col("state")))


def _state(said: Column, n: str = "n") -> Column:
    return F.when(F.col("stable_key").startswith(f"{COUNTED}|"), F.col(n).cast("string")).otherwise(said)


def dirty_paths(diff: DataFrame, build: DataFrame) -> DataFrame:
    """path, each once: the changed paths (path, change), and of build files (path, tool, target, dependency, pattern; as they were and as they are)
    those whose edges a change elsewhere moves: a dependency that came or went, or a lane that a workflow may call."""
    moved = diff.where("change in ('added', 'removed')").select(F.col("path").alias("moved"))
    needs = resolve.needed_paths(build)
    by_file = needs.select("path", F.explode(F.array("near", "root")).alias("moved")).join(moved, "moved", "left_semi")
    lanes = build.where("tool = 'fastlane'").select("path").distinct().join(diff.select("path"), "path", "left_semi").select(F.lit(1).alias("one")).distinct()
    callers = build.where("tool = 'github-actions'").select("path", F.lit(1).alias("one")).join(lanes, "one", "left_semi")
    return diff.select("path").unionByName(by_file.select("path")).unionByName(callers.select("path")).distinct()


def support_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """stable_key, moved, said: by how much the number of supports moves, and what the new ones say, of facts that dirty paths supported before or do after."""
    both = before.select("stable_key", "state", F.lit(-1).alias("d")).unionByName(after.select("stable_key", "state", F.lit(1).alias("d")))
    each = both.groupBy("stable_key", "state").agg(F.sum("d").alias("moved"), F.max("d").alias("d"))
    return each.groupBy("stable_key").agg(F.sum("moved").alias("moved"), F.min(F.when(F.col("d") > 0, F.col("state"))).alias("said"))


def fact_changes(changes: DataFrame, counts: DataFrame, current: DataFrame) -> DataFrame:
    """stable_key, n, old_n, state, old_state of the facts that changes touch. counts: stable_key, n; current: stable_key, state; both of at least these facts.
    A null state: no such fact."""
    j = changes.join(counts.select("stable_key", F.col("n").alias("old_n")), "stable_key", "left").join(current.select("stable_key", F.col("state").alias("old_state")), "stable_key", "left")
    j = j.withColumn("n", F.coalesce("old_n", F.lit(0)) + F.col("moved"))
    return j.select("stable_key", "n", "old_n", F.when(F.col("n") > 0, _state(F.coalesce("said", "old_state"))).alias("state"), "old_state")
