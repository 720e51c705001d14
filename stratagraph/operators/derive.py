"""Derived and inferred layers: rollups of imports and references, authorship, ownership, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_ancestors(path: Column) -> Column:
    """Every directory above a path, nearest last, and "" for the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def folder(path: str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def import_rollup(imports: DataFrame) -> DataFrame:
    """directory, module, import_count: imports (path, module, observation_id) counted once a file and module for every directory above.

    Files are counted in their own directory first; what travels up is one row a directory and module.
    """
    own = imports.groupBy(folder("path").alias("own"), "module").agg(F.count_distinct("path").alias("n"))
    inside = F.when(F.col("own") == "", F.lit("x")).otherwise(F.concat("own", F.lit("/x")))
    return own.select("module", "n", F.explode(path_ancestors(inside)).alias("directory")).groupBy("directory", "module").agg(F.sum("n").alias("import_count"))


def tree_rollup(imports: DataFrame, below: DataFrame) -> DataFrame:
    """ancestor, module, import_count: imports (node, module) counted once a node and module for everything that contains the node (below: ancestor, node, as
    graph.containment() gives it): the rollup over containment edges, whatever the keys look like."""
    once = imports.select("node", "module").distinct()
    return once.join(below, "node").groupBy("ancestor", "module").agg(F.count(F.lit(1)).alias("import_count"))


def rollup_provenance(imports: DataFrame) -> DataFrame:
    """directory, module, observation_id: what supports each row of the rollup, as rows of a bridge and not as lists."""
    return imports.select(F.explode(path_ancestors(F.col("path"))).alias("directory"), "module", "observation_id").distinct()


def stale(current: DataFrame, asserted: DataFrame, key: list[str]) -> DataFrame:
    """Current derived rows that were not asserted again with the same key."""
    return current.join(asserted.select(*key).distinct(), key, "left_anti")


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """rows dealt to so many tasks by keys; None leaves the number to the session."""
    return rows.repartition(tasks, *keys) if tasks else rows


def reference_pairs(occurrences: DataFrame, most: int = 200, tasks: int | None = None) -> DataFrame:
    """from_path, to_path, reference_count, observations (the `most` least). No pair's observations are gathered: equal ids are counted first, and
    of the ranked rows only the `most` least go on, with their pair's count. tasks: how many to deal the counted ids to."""
    pair = ["from_path", "to_path"]
    once = dealt(occurrences.groupBy(*pair, "observation_id").agg(F.count(F.lit(1)).alias("n")), tasks, *pair)
    whole = Window.partitionBy(*pair)
    before = F.sum("n").over(whole.orderBy("observation_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    first = once.withColumns({"before": before, "reference_count": F.sum("n").over(whole)}).where(F.col("before") < most)
    listed = first.groupBy(*pair).agg(F.first("reference_count").alias("reference_count"), F.array_sort(F.collect_list(F.struct("observation_id", "n"))).alias("o"))
    ids = F.slice(F.flatten(F.transform("o", lambda x: F.array_repeat(x["observation_id"], F.least(x["n"], F.lit(most)).cast("int")))), 1, most)
    return listed.select(*pair, "reference_count", ids.alias("observations"))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point (path, line, point_id) with the smallest span (path, start, end, rank, key) that holds its line; ties go to rank, then key.

    A span is the union of a few aligned blocks of 1, 2, 4... lines (two of a size at most), and a line lies in one block of each size. Of the spans that cover a
    block only the best is kept, so a block has one row however many spans cross it, and each distinct line asks its blocks once. Points and spans are never paired.
    """
    spans = spans.where("start <= end").withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    size = F.ceil(F.log2(F.col("end") - F.col("start") + 1)).cast("int")  # of the largest block that may fit, as a power of two
    low, high = lambda k: -_shifted(-F.col("start"), k), lambda k: _shifted(F.col("end") + 1, k)
    ends = lambda k: F.array(F.when(low(k) % 2 != 0, low(k)), F.when(high(k) % 2 != 0, high(k) - 1))
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), size), lambda k: F.transform(F.when(low(k) < high(k), F.array_compact(ends(k))).otherwise(F.array().cast("array<bigint>")), lambda b: F.struct(k.alias("k"), b.alias("b")))))
    best = lambda key, start, end, rank: F.min_by(F.struct(key, start, end), F.struct(F.col(end) - F.col(start), rank, key))
    covers = spans.select("path", F.explode(blocks).alias("at"), "key", "start", "end", "rank")
    covers = covers.groupBy("path", F.col("at.k").alias("k"), F.col("at.b").alias("b")).agg(F.min_by(F.struct("key", "start", "end", "rank"), F.struct(F.col("end") - F.col("start"), "rank", "key")).alias("s"))
    sizes = spans.agg(F.max(size).alias("most"))  # one row
    lines = points.select("path", "line").distinct().join(F.broadcast(sizes)).select("path", "line", F.explode(F.sequence(F.lit(0), "most")).alias("k"))
    asked = lines.withColumn("b", _shifted(F.col("line").cast("long"), F.col("k")))
    found = asked.join(covers, ["path", "k", "b"]).groupBy("path", "line").agg(best("s.key", "s.start", "s.end", "s.rank").alias("s"))
    return points.select("path", "line", "point_id").distinct().join(found, ["path", "line"]).select("path", "line", "point_id", "s.key", "s.start", "s.end")


def _shifted(value: Column, k: Column) -> Column:
    """value over 2 to the power k, rounded down."""
    return F.call_function("shiftright", value, k)


def symbol_pairs(occurrences: DataFrame) -> DataFrame:
    """from_key, to_key, reference_count, call_count; unresolved and self references are left out."""
    good = occurrences.where("from_key is not null and to_key is not null and from_key <> to_key")
    return good.groupBy("from_key", "to_key").agg(F.count(F.lit(1)).alias("reference_count"), F.count_if("is_call").alias("call_count"))


def authorship(touches: DataFrame) -> DataFrame:
    """path, person, commits, last_touched, name (the last seen) of touches (path, person, name, at)."""
    return touches.groupBy("path", "person").agg(F.count(F.lit(1)).alias("commits"), F.max("at").alias("last_touched"), F.max_by("name", F.struct("at", "name")).alias("name"))


def last_commits(touches: DataFrame) -> DataFrame:
    return touches.groupBy("person").agg(F.max("at").alias("last_commit"))


def dominant_owners(authors: DataFrame, least_share: float = 0.6) -> DataFrame:
    """path, person, share of the author with the greatest share of commits, where it reaches least_share (ties: least person)."""
    share = F.col("commits") / F.sum("commits").over(Window.partitionBy("path"))
    ranked = authors.withColumn("share", share).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("share"), "person")))
    return ranked.where((F.col("n") == 1) & (F.col("share") >= least_share)).select("path", "person", "share")


def owner_labels(files: DataFrame, authors: DataFrame, owners: DataFrame, last: DataFrame, departed_before: Column) -> DataFrame:
    """path, label: Unowned (no author), Stranded (all authors' last commit is earlier than departed_before), the owner, or Shared."""
    gone = authors.join(last, "person").groupBy("path").agg(F.min(F.col("last_commit") < departed_before).alias("stranded"))
    label = F.when(F.col("stranded").isNull(), "Unowned").when(F.col("stranded"), "Stranded").otherwise(F.coalesce("person", F.lit("Shared")))
    return files.select("path").join(gone, "path", "left").join(owners.select("path", "person"), "path", "left").select("path", label.alias("label"))


def stranded_files(labels: DataFrame) -> DataFrame:
    """Paths (path, label) that only departed people wrote."""
    return labels.where("label = 'Stranded'").select("path")


def responsibility_gaps(labels: DataFrame) -> DataFrame:
    """Paths that nobody answers for: unowned or stranded."""
    return labels.where("label in ('Unowned', 'Stranded')").select("path", "label")


def migration_progress(front: DataFrame) -> DataFrame:
    """One row: migrated, not_migrated, straddling, progress (migrated share; null without any file) of a migration front."""
    n = lambda state: F.count_if(F.col("state") == state)
    return front.agg(n("Migrated").alias("migrated"), n("Not migrated").alias("not_migrated"), n("Straddling").alias("straddling"), (n("Migrated") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("progress"))


def migratable_modules(imports: DataFrame) -> DataFrame:
    """module, importers of every module with an import; lists show them by name."""
    return imports.groupBy("module").agg(F.count_distinct("path").alias("importers"))


def test_outcome(passed: Column, failed: Column, exit_code: Column) -> Column:
    """passed, failed or partial, by the numbers of verdicts and the exit code."""
    clean = F.when(exit_code == 0, "passed").when(passed > 0, "partial").otherwise("failed")
    return F.when(failed == 0, clean).when(passed > 0, "partial").otherwise("failed")


def run_outcomes(runs: DataFrame) -> DataFrame:
    """run, outcome of test runs (run, transcript, exit_code)."""
    n = lambda word: F.size(F.split("transcript", f"{word} after")) - 1
    return runs.select("run", test_outcome(n("passed"), n("failed"), F.col("exit_code")).alias("outcome"))


def method_outcomes(runs: DataFrame) -> DataFrame:
    """run, method, outcome of each test that a transcript names; the last verdict counts."""
    line = runs.select("run", F.posexplode(F.split("transcript", "\n")).alias("at", "line"))
    parts = line.withColumn("m", F.regexp_extract("line", "^.*?Test (.*?) (passed|failed) after", 1)).withColumn("v", F.regexp_extract("line", "^.*?Test .*? (passed|failed) after", 1)).where("v <> ''")
    return parts.groupBy("run", F.col("m").alias("method")).agg(F.max_by("v", "at").alias("outcome"))


def coverage_locate(points: DataFrame, functions: DataFrame) -> DataFrame:
    """point_id, path, line, function, fraction of the innermost covered function (path, function, start, end, fraction) at each point."""
    spans = functions.select("path", "start", "end", F.lit(0).alias("rank"), F.struct("function", "fraction").alias("key"))
    return innermost(points, spans).select("point_id", "path", "line", "key.function", "key.fraction")


def issue_counts(issues: DataFrame) -> DataFrame:
    """repo, open, production, closed of issues (repo, state, labels): a production order is an open issue with that label."""
    is_open = F.lower("state") != "closed"
    return issues.groupBy("repo").agg(F.count_if(is_open).alias("open"), F.count_if(is_open & F.array_contains("labels", "production-order")).alias("production"), F.count_if(~is_open).alias("closed"))


def spend(ledger: DataFrame) -> DataFrame:
    """repo, spend, entries, last of ledger rows (repo, date, cost)."""
    return ledger.groupBy("repo").agg(F.sum("cost").alias("spend"), F.count(F.lit(1)).alias("entries"), F.max("date").alias("last"))


def recent(rows: DataFrame, group: list[str], order: list[Column], most: int = 30) -> DataFrame:
    """The first `most` rows of each group by order, with their position."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= most)


def portfolio(ledger: DataFrame, issues: DataFrame) -> DataFrame:
    """One row over all repositories: spend, open."""
    total = ledger.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spend"))
    return total.crossJoin(issues.agg(F.count_if(F.lower("state") != "closed").alias("open")))  # one row each


def migration_front(imports: DataFrame, old: Column, new: Column) -> DataFrame:
    """path, state of each importer of the old or new module: Migrated, Not migrated or Straddling."""
    per = imports.groupBy("path").agg(F.max(old).alias("o"), F.max(new).alias("n")).where("o or n")
    return per.select("path", F.when(F.col("o") & F.col("n"), "Straddling").when(F.col("n"), "Migrated").otherwise("Not migrated").alias("state"))


def coverage_functions(regions: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, function -> start, end, fraction (covered regions of all) of regions (path, function, start, end, hits). tasks: how many to deal the regions to."""
    return dealt(regions, tasks, "path", "function").groupBy("path", "function").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.count_if(F.col("hits") > 0) / F.count(F.lit(1))).alias("fraction"))


def coverage_merge(*reports: DataFrame, tasks: int | None = None) -> DataFrame:
    """The best fraction of each path and span over several reports. tasks: how many to deal the reports' rows to."""
    merged = reports[0]
    for r in reports[1:]:
        merged = merged.unionByName(r)
    return dealt(merged, tasks, "path", "start", "end").groupBy("path", "start", "end").agg(F.max("fraction").alias("fraction"))


def reference_coverage(declaring: DataFrame, touched: DataFrame) -> DataFrame:
    """coverage: the share of declaring files that some reference touches; null without declaring files."""
    d = declaring.select("path").distinct()
    t = touched.select("path").distinct().withColumn("t", F.lit(1))
    return d.join(t, "path", "left").agg((F.count("t") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("coverage"))
