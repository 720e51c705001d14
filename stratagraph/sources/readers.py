"""Sources as DataFrames: source trees, coverage reports, ledgers, issues and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

MOST_BYTES = 4 * 1024 * 1024
# Folders that are never read.
SKIPPED = [".git", ".build", ".swiftpm", "DerivedData", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", "Pods", "Carthage", "dist", "target", "build", "SourcePackages"]


def _tree(spark: SparkSession, root: str, at: str | list[str]) -> DataFrame:
    """The files that count, with `rel`, their path under root. No content is read unless a column asks for it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    rel = F.expr("substr(path, locate(base, path) + length(base))")
    parts = F.split("rel", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    bad = F.exists(folders, lambda d: d.isin(SKIPPED) | d.rlike(r"\.(xcodeproj|xcworkspace)$") | (d.startswith(".") & (d != ".github"))) | F.element_at(parts, -1).startswith(".")
    return raw.withColumn("base", F.lit(f"/{base}/")).withColumn("rel", rel).where(~bad)


def _language() -> Column:
    return F.when(F.col("length") <= MOST_BYTES, X.language(F.col("rel"))).alias("lang")


def source_tree(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """path, blob_hash, size, lang, text of the files under a folder, in any store that Spark reads. only: of these files (as source_listing() names them).

    Skipped folders, project bundles, hidden files and hidden folders but .github are left out. A file of over MOST_BYTES keeps its path and
    size, with the hash of nothing, no language and no text; text that isn't UTF-8 is null.
    """
    rows = _tree(spark, root, root if only is None else only)
    large = F.col("length") > MOST_BYTES
    return rows.select(F.col("rel").alias("path"), F.when(large, F.sha2(F.lit(""), 256)).otherwise(F.sha2("content", 256)).alias("blob_hash"), F.col("length").alias("size"), _language(), F.when(~large, F.expr("try_validate_utf8(cast(content as string))")).alias("text"))


def source_listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified, lang, file (its full name) of the files that source_tree() reads; their contents are not read."""
    return _tree(spark, root, root).select(F.col("rel").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), _language(), F.col("path").alias("file"))


def blobs(files: DataFrame) -> DataFrame:
    """Each content once: what a content-addressed store holds."""
    return files.dropDuplicates(["blob_hash"])


_REGION = T.ArrayType(T.ArrayType(T.LongType()))
COVERAGE = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("files", T.ArrayType(T.StructType([T.StructField("filename", T.StringType()), T.StructField("summary", T.StructType([T.StructField("lines", T.StructType([T.StructField("percent", T.DoubleType())]))]))]))),
    T.StructField("functions", T.ArrayType(T.StructType([T.StructField("filenames", T.ArrayType(T.StringType())), T.StructField("name", T.StringType()), T.StructField("regions", _REGION)]))),
])))])


def coverage(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of llvm-cov exports (json): (path, fraction) of files, and (path, function, start, end, hits) of function regions."""
    data = reports.select(F.explode(F.from_json("json", COVERAGE)["data"]).alias("d"))
    files = data.select(F.explode("d.files").alias("f")).select(F.col("f.filename").alias("path"), (F.col("f.summary.lines.percent") / 100).alias("fraction"))
    functions = data.select(F.explode("d.functions").alias("f")).select(F.get("f.filenames", F.lit(0)).alias("path"), F.col("f.name").alias("function"), F.explode("f.regions").alias("r"))
    return files, functions.select("path", "function", F.get("r", F.lit(0)).alias("start"), F.get("r", F.lit(2)).alias("end"), F.get("r", F.lit(4)).alias("hits"))


def ledger(cells: DataFrame) -> DataFrame:
    """Typed ledger rows of cells (array<string>): commit, date, model, tokens and cost; what is no number is null."""
    c = lambda i: F.get("cells", F.lit(i))
    number = lambda i, t: F.expr(f"try_cast(regexp_replace(get(cells, {i}), '[$,]', '') as {t})")
    names = ["input", "output", "cache_read", "cache_write"]
    return cells.select(c(0).alias("commit"), c(1).alias("date"), c(2).alias("model"), *[number(i + 3, "bigint").alias(n) for i, n in enumerate(names)], number(7, "double").alias("cost"), F.array_join(F.slice("cells", 9, 1 << 20), " | ").alias("summary"))


# What a project's factory is made of, each in every layout that counts, and text that only an unadapted template has.
EXPECTATIONS = [
    (["MISSION.md", "agents/MISSION.md"], "the charter and its invariants"),
    (["AGENTS.md", "CLAUDE.md", "agents/AGENTS.md"], "rules for coding agents"),
    (["FACTORY.md", "agents/FACTORY.md"], "how it is built and tested"),
    (["PROGRESS.md"], "work in flight"),
    (["DECISIONS.md"], "what was decided and what was refused"),
    (["METRICS.md"], "one row a shipped order"),
    (["ROADMAP.md", "docs/milestones.md"], "where it goes, in sized steps"),
    (["SECURITY.md"], "threats, and what it may reach outside"),
    (["docs/dark-factory.md", "agents/dark-factory.md"], "the pattern and its autonomy"),
    (["docs/converge.md", "agents/converge.md", ".claude/commands/converge.md"], "how one order ships"),
    (["wiki/README.md", "docs/wiki/home.md"], "where research is kept"),
    ([".github/workflows/pages.yml"], "publishes the wiki"),
    (["FIRST_RUN.md"], "adaptation is not finished: fill the stubs, then delete it"),
]
MARKERS = ["{{REPO_NAME}}", "> FIRST RUN:", "[invariant]", "[non-goal]", "[first milestone]", "[One paragraph:", "(example — delete on first run)"]
#: The last expectation is the other way round: a file that is there is a stub, one that is not is no gap.
FIRST_RUN = len(EXPECTATIONS) - 1
LOAD_BEARING = 3


def expectations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, paths, why) for i, (paths, why) in enumerate(EXPECTATIONS)], "position int, alternates array<string>, purpose string")


def project_audit(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, verdict) of a project's files (path, text): position, path, state, marker, purpose of each expectation, and one row (operational):
    the load-bearing documents are real and no first-run file is left."""
    wanted = expectations(files.sparkSession)
    found = factory_audit(files, wanted, MARKERS).join(wanted.select("position", "purpose"), "position")
    first = F.col("position") == FIRST_RUN
    found = found.where(~first | (F.col("state") != "missing")).withColumn("state", F.when(first, "stub").otherwise(F.col("state")))
    found = found.withColumn("marker", F.when((F.col("state") == "stub") & F.col("marker").isNull() & ~first, "unreadable").when(~first, F.col("marker")))
    verdict = found.agg(((F.count_if((F.col("position") < LOAD_BEARING) & (F.col("state") == "real")) == LOAD_BEARING) & (F.count_if(first) == 0)).alias("operational"))
    return found, verdict


MOST_NAMES = 50_000
OCCURRENCE = "usr string, name string, path string, line int, column int, role string"


def compiler_references(occurrences: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """from_path, to_path, usr, name, line, column, def_line, is_call: references across files of exported occurrences (usr, name, path, line, column,
    role: definition, reference or call).

    Symbols of the first `most` names in order count (the source's own bound); a symbol is defined where it is defined first by path and line; build
    products (.build/) are left out.
    """
    rows = occurrences.where(~F.col("path").startswith(".build/"))
    names = rows.select("name").distinct().orderBy("name").limit(most)
    defined = rows.where("role = 'definition'").join(F.broadcast(names), "name", "left_semi").groupBy("usr").agg(F.min_by(F.struct("name", "path", "line"), F.struct("path", "line")).alias("d"))  # `most` names
    used = rows.where("role in ('reference', 'call')").select("usr", F.col("path").alias("from_path"), "line", "column", (F.col("role") == "call").alias("is_call"))
    return used.join(defined, "usr").where("from_path <> d.path").select("from_path", F.col("d.path").alias("to_path"), "usr", F.col("d.name").alias("name"), "line", "column", F.col("d.line").alias("def_line"), "is_call")


def put_blobs(files: DataFrame, folder: str) -> None:
    """Append contents (blob_hash, text) that a content-addressed folder does not hold yet; writing the same twice does no harm."""
    spark = files.sparkSession
    new = blobs(files.where("text is not null")).select("blob_hash", "text")
    known = get_blobs(spark, folder)
    (new if known is None else new.join(known.select("blob_hash"), "blob_hash", "left_anti")).write.mode("append").parquet(folder)


def get_blobs(spark: SparkSession, folder: str) -> DataFrame | None:
    """Contents of the folder, each once; None before the first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema("blob_hash string, text string").parquet(folder).dropDuplicates(["blob_hash"]) if fs.exists(p) else None


def factory_audit(files: DataFrame, expectations: DataFrame, markers: list[str]) -> DataFrame:
    """position, path, state (real, stub, missing), marker: of each expectation (position, alternates) the first alternate that is there.

    files: path, text (null: unreadable). A text with a marker is a stub, and so is one that can't be read.
    """
    alternates = expectations.select("position", F.posexplode("alternates").alias("choice", "path"))
    found = alternates.join(files, "path").groupBy("position").agg(F.min_by(F.struct("path", "text"), "choice").alias("f"))
    marker = F.get(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.col("f.text"), m)), F.lit(0))
    state = F.when(F.col("f").isNull(), "missing").when(F.col("f.text").isNull() | marker.isNotNull(), "stub").otherwise("real")
    return expectations.join(found, "position", "left").select("position", F.coalesce("f.path", F.get("alternates", F.lit(0))).alias("path"), state.alias("state"), marker.alias("marker"))
