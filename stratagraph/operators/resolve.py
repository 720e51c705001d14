"""From observations to assertions: stable keys and edges of the physical tree, declarations, imports, builds and CI calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text as X
from .derive import path_ancestors


def _entity(key, kind: str, name) -> list:
    return [key.alias("stable_key"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), name.alias("name")]


def physical_tree(files: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Entities (stable_key, kind, name) and containsPhysical edges (source_key, target_key, kind) of a manifest (path)."""
    r = F.lit(repo)
    folders = files.select(F.explode(path_ancestors(F.col("path"))).alias("path")).distinct()
    dirs = folders.where("path <> ''")
    key = lambda p: F.when(p == "", model.repo_key(r)).otherwise(model.dir_key(r, p))
    name = F.element_at(F.split("path", "/"), -1)
    entities = folders.where("path = ''").select(*_entity(model.repo_key(r), "repository", r)).unionByName(dirs.select(*_entity(model.dir_key(r, F.col("path")), "directory", name))).unionByName(files.select(*_entity(model.file_key(r, F.col("path")), "file", name)))
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    edges = dirs.select(key(parent).alias("source_key"), model.dir_key(r, F.col("path")).alias("target_key")).unionByName(files.select(key(parent).alias("source_key"), model.file_key(r, F.col("path")).alias("target_key")))
    return entities, edges.withColumn("kind", F.lit("containsPhysical"))


def declarations(observations: DataFrame, repo: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Entities and declares edges of declaration observations (path, lang, name, decl_kind, decl_path, start); the first of a key counts.

    The parent is the deepest declared ancestor path of the same file, else the file. by: columns that both keep (the path that says so).
    """
    r = F.lit(repo)
    d = observations.where("kind = 'declaration'").withColumn("key", model.decl_key(F.col("lang"), r, F.col("path"), F.col("decl_path")))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("start", "decl_kind", "name"))).where("n = 1").drop("n")
    parts = F.split("decl_path", r"\.")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), ".").alias("up")))
    known = d.select(F.col("path").alias("k_path"), F.col("decl_path").alias("up"), F.col("key").alias("k_key"))
    ups = d.select("key", "path", F.explode(above).alias("a")).where("a.depth > 0").select("key", "path", "a.depth", "a.up")
    deepest = ups.join(known, ["up"]).where("path = k_path").groupBy("key").agg(F.max_by("k_key", "depth").alias("parent"))
    edges = d.join(deepest, "key", "left").select(F.coalesce("parent", model.file_key(r, F.col("path"))).alias("source_key"), F.col("key").alias("target_key"), F.lit("declares").alias("kind"), *by)
    return d.select(F.col("key").alias("stable_key"), F.col("decl_kind").alias("kind"), "name", *by), edges


def import_edges(observations: DataFrame, repo: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Modules and imports edges of import observations (path, lang, name)."""
    i = observations.where("kind = 'importStatement'").select("path", "lang", "name").distinct()
    key = model.module_key(F.col("lang"), F.col("name"))
    return i.select(*_entity(key, "module", F.col("name")), *by).distinct(), i.select(model.file_key(F.lit(repo), F.col("path")).alias("source_key"), key.alias("target_key"), F.lit("imports").alias("kind"), *by)


def needed_paths(build: DataFrame) -> DataFrame:
    """path, target, dependency, near, root: where the dependencies of build files would be, beside the file and from the root."""
    needs = build.where("tool in ('make', 'fastlane') and dependency is not null and not pattern").select("path", "target", "dependency").distinct()
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return needs.withColumns({"near": X.normalised_path(F.concat_ws("/", folder, "dependency")), "root": X.normalised_path(F.col("dependency"))})


def build_edges(build: DataFrame, files: DataFrame, repo: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Build targets, and builds edges to what each dependency is: a target of the same file, else a file under the build file's folder,
    else a file from the root, else nothing. build: path, tool, target, dependency, pattern."""
    r = F.lit(repo)
    rows = build.where("tool in ('make', 'fastlane')")
    key = lambda p, t: model.target_key(r, F.col(p), F.col(t))
    targets = rows.where("not pattern").select(*_entity(key("path", "target"), "buildTarget", F.col("target")), *by).distinct()
    needs = needed_paths(build)
    own = rows.select(F.col("path").alias("t_path"), F.col("target").alias("t_name")).distinct()
    paths = files.select("path").distinct()
    j = needs.join(own, (F.col("path") == F.col("t_path")) & (F.col("dependency") == F.col("t_name")), "left").join(paths.withColumnRenamed("path", "f_near"), F.col("near") == F.col("f_near"), "left").join(paths.withColumnRenamed("path", "f_root"), F.col("root") == F.col("f_root"), "left")
    to = F.coalesce(F.when(F.col("t_name").isNotNull(), key("path", "dependency")), F.when(F.col("f_near").isNotNull(), model.file_key(r, F.col("f_near"))), F.when(F.col("f_root").isNotNull(), model.file_key(r, F.col("f_root"))))
    return targets, j.select(key("path", "target").alias("source_key"), to.alias("target_key"), F.lit("builds").alias("kind"), *by).where("target_key is not null").distinct()


def invoked_lanes(build: DataFrame, repo: str, by: tuple[str, ...] = ()) -> DataFrame:
    """invokes edges from workflow files to the lane that the last lane-naming token of a command means, in each Fastfile."""
    r = F.lit(repo)
    lanes = build.where("tool = 'fastlane' and dependency is null").select(F.col("path").alias("l_path"), F.col("target").alias("lane")).distinct()
    words = build.where("tool = 'github-actions'").select("path", "target", F.posexplode(F.split("target", r"\s+")).alias("pos", "word"))
    hit = words.join(lanes, F.col("word") == F.col("lane")).groupBy("path", "target", "l_path").agg(F.max_by("lane", "pos").alias("lane"))
    return hit.select(model.file_key(r, F.col("path")).alias("source_key"), model.target_key(r, F.col("l_path"), F.col("lane")).alias("target_key"), F.lit("invokes").alias("kind"), *by).distinct()
