"""Documents of a project as rows: metrics, converge steps, commits, issues, runs, lanes, wiki pages and their kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_EMPTY = ("", "—", "-", "–")


def _optional(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*_EMPTY), F.trim(c))


def table_rows(docs: DataFrame) -> DataFrame:
    """doc_id, position, cells (array<string>) of the rows after the separators of pipe tables in docs (doc_id, text)."""
    ls = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line")).withColumn("line", F.trim("line"))
    rows = ls.where(F.col("line").startswith("|")).withColumn("rule", F.col("line").rlike(r"^[|\s:-]*-[|\s:-]*$"))
    first = rows.where("rule").groupBy("doc_id").agg(F.min("position").alias("body"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    return rows.where("not rule").join(first, "doc_id").where("position > body").select("doc_id", "position", cells.alias("cells"))


def metrics(rows: DataFrame) -> DataFrame:
    """issue, commit, date, iterations, tests, shipped, notes of metrics cells (cells); rows without a commit are left out, cells that do not fit
    their type are null."""
    c = lambda i: _optional(F.get("cells", F.lit(i)))
    number = lambda i: F.expr(f"try_cast(regexp_replace(get(cells, {i}), '[#,]', '') as bigint)")
    yes = F.when(F.lower(c(5)).isin("true", "yes", "y", "1", "✓", "✅"), True).when(F.lower(c(5)).isin("false", "no", "n", "0", "✗", "❌"), False)
    return rows.select(number(0).alias("issue"), c(1).alias("commit"), F.expr("try_cast(get(cells, 2) as date)").alias("date"), number(3).alias("iterations"), number(4).alias("tests"), yes.alias("shipped"), F.coalesce(F.get("cells", F.lit(6)), F.lit("")).alias("notes")).where("commit is not null")


def converge_steps(docs: DataFrame) -> DataFrame:
    """doc_id, step (its place), number, title, detail of the steps `N. **Title.** rest` of docs (doc_id, text), with the lines that follow each."""
    ls = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    head = r"^(\d+)\.\s*\*\*(.*?)\*\*(.*)$"
    marked = ls.withColumn("is_head", F.col("line").rlike(head))
    # a document's lines are folded within its own row, not over a window of the corpus
    lines = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "line", "is_head"))).alias("ls"))
    heads = F.filter("ls", lambda x: x["is_head"])
    placed = lines.select("doc_id", "ls", F.posexplode(heads).alias("step", "h"), F.transform(heads, lambda x: x["at"]).alias("ats"))
    until = F.coalesce(F.get("ats", F.col("step") + 1), F.lit(1 << 30))
    rest = F.transform(F.filter("ls", lambda x: (x["at"] > F.col("h.at")) & (x["at"] < until)), lambda x: x["line"])
    own = F.trim(F.regexp_extract("h.line", head, 3))
    detail = F.trim(F.array_join(F.concat(F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")), rest), " "))
    return placed.select("doc_id", "step", F.regexp_extract("h.line", head, 1).cast("long").alias("number"), F.regexp_replace(F.regexp_extract("h.line", head, 2), r"\.$", "").alias("title"), detail.alias("detail"))


def commit_lines(log: DataFrame) -> DataFrame:
    """sha, short, author, date, subject, closes (array<bigint>), ledger of log lines (line) of five fields between NULs; shorter ones are left out,
    a date that is none counts as 1970."""
    f = F.split("line", "\u0000")
    rows = log.where(F.size(f) >= 5).select(f[0].alias("sha"), f[1].alias("short"), f[2].alias("author"), F.coalesce(F.try_to_timestamp(f[3]), F.timestamp_seconds(F.lit(0))).alias("date"), f[4].alias("subject"))
    closes = F.transform(F.regexp_extract_all("subject", F.lit(r"(?i)\b(?:closes|fixes|resolves)\s+#(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    low = F.lower("subject")
    return rows.withColumns({"closes": closes, "ledger": low.startswith("chore(ledger") | low.startswith("chore(metrics")})


def commits(logs: DataFrame) -> DataFrame:
    """sha, author, email, at, path (one row a touched path; null where a commit names none) of logs (text) whose records start with U+001E and whose
    fields are split by U+001F: what `git log --no-merges --name-only` prints with such a format. Records of under four fields are left out."""
    record = logs.select(F.explode(F.split("text", "\x1e")).alias("r")).select(F.split(F.regexp_replace("r", "^\n+|\n+$", ""), "\x1f").alias("f")).where(F.size("f") >= 4)
    tail = F.coalesce(F.get("f", F.lit(4)), F.regexp_extract(F.col("f")[3], r"^[^\n]*\n([\s\S]*)$", 1))
    paths = F.filter(F.split(tail, "\n"), lambda p: p != "")
    at = F.coalesce(F.try_to_timestamp(F.substring_index(F.col("f")[3], "\n", 1)), F.lit("0001-01-02").cast("timestamp"))
    return record.select(F.col("f")[0].alias("sha"), F.col("f")[1].alias("author"), F.col("f")[2].alias("email"), at.alias("at"), F.explode_outer(paths).alias("path"))


def head_commit(spark: SparkSession, root: str) -> str | None:
    """The commit that a repository's HEAD names, read from its .git folder in any store that Spark reads; null where there is none."""
    def first(path: str) -> str | None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    head = first(f"{root}/.git/HEAD")
    if head is None or not head.startswith("ref: "):
        return head or None
    loose = first(f"{root}/.git/{head[5:]}")
    if loose is not None:
        return loose
    packed = first(f"{root}/.git/packed-refs") or ""
    return next((x.split(" ")[0] for x in packed.split("\n") if x.endswith(f" {head[5:]}")), None)


ISSUE = "struct<number:bigint,title:string,state:string,labels:array<struct<name:string,color:string>>,body:string,author:struct<login:string>,createdAt:timestamp,closedAt:timestamp,milestone:struct<title:string,number:bigint>,comments:array<struct<author:struct<login:string>,body:string,createdAt:timestamp>>>"
RUN = "struct<databaseId:bigint,name:string,status:string,conclusion:string,headSha:string,headBranch:string,event:string,createdAt:timestamp,url:string>"
CHECKS = "struct<check_runs:array<struct<name:string,status:string,conclusion:string>>>"


def issues(exports: DataFrame) -> DataFrame:
    """Issues of exported lists (repo, json: an array of issues): state is open unless it says closed, an author without login is unknown."""
    rows = exports.select("repo", F.explode(F.from_json("json", f"array<{ISSUE}>")).alias("i"))
    return rows.select("repo", "i.number", "i.title", F.when(F.lower("i.state") == "closed", "closed").otherwise("open").alias("state"), F.col("i.labels.name").alias("labels"), "i.body", F.coalesce("i.author.login", F.lit("unknown")).alias("author"), F.col("i.createdAt").alias("created"), F.col("i.closedAt").alias("closed"), F.col("i.milestone.title").alias("milestone"), F.size(F.coalesce("i.comments", F.array())).alias("comments"))


def workflow_runs(exports: DataFrame) -> DataFrame:
    """Runs of exported lists (repo, json: an array of runs)."""
    r = exports.select("repo", F.explode(F.from_json("json", f"array<{RUN}>")).alias("r"))
    return r.select("repo", F.col("r.databaseId").alias("run"), "r.name", "r.status", "r.conclusion", F.col("r.headSha").alias("sha"), F.col("r.headBranch").alias("branch"), "r.event", F.col("r.createdAt").alias("created"), "r.url")


def check_runs(exports: DataFrame) -> DataFrame:
    """Checks of a commit's envelope (sha, json): sha, name, status, conclusion."""
    return exports.select("sha", F.explode(F.from_json("json", CHECKS)["check_runs"]).alias("c")).select("sha", "c.name", "c.status", "c.conclusion")


def lanes(fastfiles: DataFrame, commands: DataFrame) -> DataFrame:
    """path, lane, platform, description, in_ci of Fastfiles (path, text). The platform is the last one named above, the description stands between
    the lane before and the lane; in_ci: a workflow command (command) has the lane among its words."""
    ls = fastfiles.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    part = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    marks = ls.select("path", "at", part(r"^platform\s+:(\w+)").alias("p"), part(r"""^desc\s+["'](.+)["']""").alias("d"), part(r"^(?:private_)?lane\s+:(\w+)").alias("l")).where("p is not null or d is not null or l is not null")
    above = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = marks.withColumn("p", F.last("p", True).over(above)).withColumn("before", F.count("l").over(above) - F.col("l").isNotNull().cast("int"))  # lanes above
    own = Window.partitionBy("path", "before").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    folded = marks.withColumn("d", F.last("d", True).over(own)).where("l is not null").select("path", F.col("l").alias("lane"), F.col("p").alias("platform"), F.col("d").alias("description"))
    said = commands.select(F.explode(F.split("command", " ")).alias("lane")).distinct().withColumn("in_ci", F.lit(True))
    return folded.join(said, "lane", "left").select("path", "lane", "platform", "description", F.coalesce("in_ci", F.lit(False)).alias("in_ci"))


def app_settings(appfiles: DataFrame) -> DataFrame:
    """path, key, value of Appfile lines (path, text): key "value", key("value") or with single quotes; comments are left out."""
    ls = appfiles.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where(~F.col("line").startswith("#"))
    pattern = r"""^(\w+)\s*\(?\s*["']([^"']+)["']"""
    return ls.where(F.col("line").rlike(pattern)).select("path", "at", F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))


# What a document is by its name, in the order in which lists show the kinds.
DOC_KINDS = {"MISSION.MD": "mission", "AGENTS.MD": "charter", "CLAUDE.MD": "charter", "FACTORY.MD": "factory", "PROGRESS.MD": "progress", "ROADMAP.MD": "roadmap", "MILESTONES.MD": "milestones", "LEDGER.MD": "ledger", "METRICS.MD": "metrics", "DECISIONS.MD": "decisions", "README.MD": "readme"}
KIND_ORDER = [*dict.fromkeys(DOC_KINDS.values()), "wiki", "views", "other"]


def doc_kind(path: Column) -> Column:
    name = F.upper(F.element_at(F.split(path, "/"), -1))
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for kv in DOC_KINDS.items() for x in kv]), name)
    return F.when(path.startswith("docs/wiki/"), "wiki").when(path.startswith("docs/views/"), "views").when(by_name.isNotNull(), by_name).when(path.startswith("docs/"), "wiki").otherwise("other")


def doc_policy(path: Column) -> Column:
    """editable, appendOnly (a correction is a new row) or readOnly."""
    name = F.upper(F.element_at(F.split(path, "/"), -1))
    return F.when(name == "LEDGER.MD", "readOnly").when(name.isin("METRICS.MD", "DECISIONS.MD"), "appendOnly").otherwise("editable")


def doc_tree(files: DataFrame) -> DataFrame:
    """kind_rank, kind, name, path, policy of documents (path): what a list groups by kind (in the order of kind_rank) and sorts by name."""
    kind = doc_kind(F.col("path"))
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), kind).cast("int") - 1
    return files.where(F.lower("path").endswith(".md")).select(rank.alias("kind_rank"), kind.alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", doc_policy(F.col("path")).alias("policy"))


def remote_slug(url: Column) -> Column:
    """owner/name of a remote on github.com, without .git; null for others."""
    return F.nullif(F.regexp_replace(F.regexp_extract(url, r"github\.com[:/]([^/\s]+/[^/\s]+?)/?$", 1), r"\.git$", ""), F.lit(""))


def slug(name: Column) -> Column:
    """The address of a page by its name: lower case, without extension, blanks and underscores as dashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[a-z]+$", ""), "[_ ]", "-"), "^-+|-+$", "")


def wiki_links(pages: DataFrame) -> DataFrame:
    """path, position, target, alias, to_path of `[[target|alias]]` in pages (path, text); to_path is the page whose name has the target's slug (the
    least path where several have it), null for none."""
    inner = F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    links = pages.select("path", F.posexplode(inner).alias("position", "x"))
    links = links.select("path", "position", F.trim(F.substring_index("x", "|", 1)).alias("target"), F.nullif(F.trim(F.when(F.contains("x", F.lit("|")), F.expr("substr(x, instr(x, '|') + 1)")).otherwise("")), F.lit("")).alias("alias"))
    known = pages.select(slug(F.element_at(F.split("path", "/"), -1)).alias("slug"), F.col("path").alias("to")).groupBy("slug").agg(F.min("to").alias("to_path"))
    return links.join(known, slug(F.col("target")) == F.col("slug"), "left").select("path", "position", "target", "alias", "to_path")


def frontmatter(pages: DataFrame) -> DataFrame:
    """path, key, value of the leading `---` block of pages (path, text); the last value of a key counts."""
    ls = pages.select("path", F.posexplode(F.split(F.regexp_extract("text", r"^\s*---[ \t]*\n([\s\S]*?)\n\s*---[ \t]*(?:\n[\s\S]*)?$", 1), "\n")).alias("at", "line")).where(F.contains("line", F.lit(":")))
    pairs = ls.select("path", "at", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("value")).where("key <> ''")
    return pairs.groupBy("path", "key").agg(F.max_by("value", "at").alias("value"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, position, block, level, line of the lines of docs (doc_id, text): heading (with level), item, quote, fence (code and its marks), table
    row, rule or text; blank lines are left out. Lines between two fences are code."""
    ls = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"), x.rlike(r"^\s*(```|~~~)").alias("mark"))).alias("ls"))
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<at:int,line:string,code:boolean>>").alias("out"))
    step = lambda acc, x: F.struct((acc["inside"] != x["mark"]).alias("inside"), F.array_append(acc["out"], F.struct(x["at"].alias("at"), x["line"].alias("line"), (acc["inside"] | x["mark"]).alias("code"))).alias("out"))
    rows = ls.select("doc_id", F.explode(F.aggregate("ls", start, step)["out"]).alias("x")).select("doc_id", F.col("x.at").alias("position"), "x.line", "x.code")
    line = F.trim("line")
    level = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
    kind = F.when(F.col("code"), "fence").when(level > 0, "heading").when(line.rlike(r"^([-*_]\s*){3,}$"), "rule").when(line.rlike(r"^([-*+]|\d+[.)])\s"), "item").when(line.startswith(">"), "quote").when(line.startswith("|"), "table").otherwise("text")
    return rows.where(F.col("code") | (line != "")).select("doc_id", "position", kind.alias("block"), F.when(~F.col("code") & (level > 0), level).otherwise(0).alias("level"), "line")


def decisions_about(decisions: DataFrame, topic: str | None = None) -> DataFrame:
    """Decisions (id, date, summary, evidence, detail) of all repositories that hold any word of over two letters of the topic; all without such a
    word. Lists show the newest first, ties by id."""
    words = [w for w in re.findall(r"[^\W_]+", (topic or "").lower()) if len(w) > 2]
    if not words:
        return decisions
    hay = F.lower(F.concat_ws(" ", "summary", "evidence", "detail"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(hay, F.lit(w))
    return decisions.where(hit)


def newest_artifact(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """path, modified of the newest file below a folder's `codecov` folders (no row if there is none); ties by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", F.col("modificationTime").alias("modified"))
    return files.where(F.contains("path", F.lit("/codecov/"))).orderBy(F.desc("modified"), "path").limit(1)
