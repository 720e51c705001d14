"""Registered queries over document sources: tables, commits, issues, pages, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import derive, lookups
from ..sources import documents, readers
from .fixtures import Tables
from .queries import query


@query("""SELECT n_nationkey AS doc_id, CAST(n + 3 AS INT) AS position, ['x', c_name, CAST(c_custkey AS VARCHAR)] AS cells FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) JOIN nation ON c_nationkey = n_nationkey""")
def table_rows(t: Tables) -> DataFrame:
    line = F.concat(F.lit("| x |"), "c_name", F.lit(" |  "), "c_custkey", F.lit("|"))
    body = t.customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    docs = body.select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("text\n\n| A | B | C |\n|---|:-:|---|\n"), "b", F.lit("\nafter")).alias("text"))
    return documents.table_rows(docs)


@query("SELECT s_suppkey, s_name FROM supplier WHERE starts_with(s_name, 'Supplier#00000000')")
def path_prefix(t: Tables) -> DataFrame:
    return lookups.under(t.supplier, "Supplier#00000000", "s_name").select("s_suppkey", "s_name")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_props(t: Tables) -> DataFrame:
    rows = lookups.properties(t.events, {"k": "bigint"}, "props")
    return rows.groupBy("event_type", (F.col("k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_CELLS = "(SELECT o_orderkey, [CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderstatus = 'P' THEN '—' ELSE 'c' || o_orderkey END, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, CAST(o_custkey AS VARCHAR), CASE WHEN o_custkey % 3 = 0 THEN 'yes' WHEN o_custkey % 3 = 1 THEN 'No' ELSE '?' END, 'n'] AS c FROM orders)"


@query(f"""SELECT CAST(c[1] AS BIGINT) AS issue, c[2] AS "commit", CAST(c[3] AS DATE) AS date, try_cast(c[4] AS BIGINT) AS iterations, CAST(c[5] AS BIGINT) AS tests, CASE c[6] WHEN 'yes' THEN true WHEN 'No' THEN false END AS shipped FROM {_CELLS} WHERE c[2] <> '—'""")
def metrics_rows(t: Tables) -> DataFrame:
    k = F.col("o_custkey") % 3
    cells = F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "—").otherwise(F.concat(F.lit("c"), "o_orderkey")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.when(k == 0, "yes").when(k == 1, "No").otherwise("?"), F.lit("n"))
    return documents.metrics(t.orders.select(cells.alias("cells"))).drop("notes")


@query("""SELECT conv_id AS doc_id, turn AS number, role AS title, CASE WHEN turn % 2 = 0 THEN 'first more' ELSE 'more' END AS detail FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn)""")
def converge_steps(t: Tables) -> DataFrame:
    line = F.concat(F.col("turn"), F.lit(". **"), "role", F.lit(".** "), F.when(F.col("turn") % 2 == 0, "first").otherwise(""), F.lit("\n\n   more"))
    one = t.conversations.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    docs = one.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return documents.converge_steps(docs.withColumn("text", F.concat(F.lit("# head\nignored\n"), "text"))).select("doc_id", F.col("number"), "title", "detail")


@query("""SELECT 's' || o_orderkey AS sha, o_orderdate AS date, CASE WHEN o_orderkey % 3 = 0 THEN [o_custkey, o_orderkey] ELSE [] END AS closes, o_orderkey % 3 = 1 AS ledger FROM orders WHERE o_orderkey % 7 <> 0""")
def commit_lines(t: Tables) -> DataFrame:
    subject = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Fix it (closes #"), "o_custkey", F.lit(", Resolves #"), "o_orderkey", F.lit(")"))).when(F.col("o_orderkey") % 3 == 1, "Chore(ledger): row #5").otherwise("see #4")
    fields = F.concat_ws("\u0000", F.concat(F.lit("s"), "o_orderkey"), F.lit("s"), F.lit("Ada"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 7 != 0, subject))
    return documents.commit_lines(t.orders.select(fields.alias("line"))).select("sha", F.col("date").cast("timestamp_ntz").alias("date"), "closes", "ledger")


@query("""SELECT 's' || o_orderkey AS sha, 'a' || o_custkey AS author, o_orderdate AS at, 'p' || l_partkey AS path FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0""")
def commit_paths(t: Tables) -> DataFrame:
    paths = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda p: F.concat(F.lit("p"), p)), "\n").alias("p"))
    head = F.concat_ws("\x1f", F.concat(F.lit("s"), "o_orderkey"), F.concat(F.lit("a"), "o_custkey"), F.lit("e@x.org"), F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")))
    logs = t.orders.join(paths, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.concat(F.lit("\x1e"), head, F.lit("\n\n"), F.coalesce("p", F.lit("")), F.lit("\n")).alias("text"), (F.col("o_orderkey") % 16).alias("g"))
    return documents.commits(logs.groupBy("g").agg(F.array_join(F.collect_list("text"), "").alias("text"))).select("sha", "author", F.col("at").cast("timestamp_ntz").alias("at"), "path")


@query("""SELECT 'n' || c_nationkey AS repo, c_custkey AS number, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'open' END AS state, [c_mktsegment] AS labels, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'unknown' END AS author FROM customer""")
def issue_rows(t: Tables) -> DataFrame:
    return documents.issues(_issue_exports(t)).select("repo", "number", "state", "labels", "author")


def _issue_exports(t: Tables, label=None) -> DataFrame:
    label = F.col("c_mktsegment") if label is None else label
    one = F.to_json(F.struct(F.col("c_custkey").alias("number"), F.lit("t").alias("title"), F.when(F.col("c_acctbal") < 0, "CLOSED").otherwise("OPEN").alias("state"), F.array(F.struct(label.alias("name"))).alias("labels"), F.when(F.col("c_custkey") % 2 == 0, F.struct(F.col("c_name").alias("login"))).alias("author")))
    return t.customer.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("repo")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("json"))


@query("""SELECT 'n' || c_nationkey AS repo, count(*) FILTER (c_acctbal >= 0) AS "open", count(*) FILTER (c_acctbal >= 0 AND c_mktsegment = 'BUILDING') AS production, count(*) FILTER (c_acctbal < 0) AS closed FROM customer GROUP BY c_nationkey""")
def issue_counts(t: Tables) -> DataFrame:
    label = F.when(F.col("c_mktsegment") == "BUILDING", "production-order").otherwise("other")
    return derive.issue_counts(documents.issues(_issue_exports(t, label)))


@query("""SELECT 'n' || s_nationkey AS repo, s_suppkey AS run, CASE WHEN s_acctbal > 0 THEN 'success' END AS conclusion, s_name AS branch FROM supplier""")
def workflow_runs(t: Tables) -> DataFrame:
    one = F.to_json(F.struct(F.col("s_suppkey").alias("databaseId"), F.lit("ci").alias("name"), F.when(F.col("s_acctbal") > 0, "success").alias("conclusion"), F.col("s_name").alias("headBranch")))
    exports = t.supplier.groupBy(F.concat(F.lit("n"), "s_nationkey").alias("repo")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("json"))
    return documents.workflow_runs(exports).select("repo", "run", "conclusion", "branch")


@query("""SELECT 'c' || s_nationkey AS sha, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'success' ELSE 'failure' END AS conclusion FROM supplier""")
def check_runs(t: Tables) -> DataFrame:
    one = F.to_json(F.struct(F.col("s_name").alias("name"), F.lit("completed").alias("status"), F.when(F.col("s_acctbal") > 0, "success").otherwise("failure").alias("conclusion")))
    exports = t.supplier.groupBy(F.concat(F.lit("c"), "s_nationkey").alias("sha")).agg(F.concat(F.lit('{"check_runs":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("json"))
    return documents.check_runs(exports).select("sha", "name", "conclusion")


@query("""SELECT 'n' || n_nationkey || '/Fastfile' AS path, 'l' || c_custkey AS lane, CASE WHEN n_nationkey % 2 = 0 THEN 'ios' END AS platform, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS description, c_custkey % 5 = 0 AS in_ci FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def fastlane_lanes(t: Tables) -> DataFrame:
    line = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('  desc "'), "c_name", F.lit('"\n'))).otherwise(""), F.when(F.col("c_custkey") % 2 == 0, "  private_lane :l").otherwise("  lane :l"), "c_custkey", F.lit(" do\n    build\n  end\n"))
    files = t.customer.groupBy("c_nationkey").agg(F.array_join(F.collect_list(line), "").alias("b")).select(F.concat(F.lit("n"), "c_nationkey", F.lit("/Fastfile")).alias("path"), F.concat(F.when(F.col("c_nationkey") % 2 == 0, "platform :ios do\n").otherwise(""), "b").alias("text"))
    commands = t.customer.where("c_custkey % 5 = 0").select(F.concat(F.lit("fastlane l"), "c_custkey").alias("command"))
    return documents.lanes(files, commands)


@query("""SELECT 'a' || s_nationkey AS path, 'k' || s_suppkey AS key, s_name AS value FROM supplier WHERE s_suppkey % 4 <> 0""")
def app_settings(t: Tables) -> DataFrame:
    form = F.when(F.col("s_suppkey") % 4 == 0, "# ").otherwise("")
    line = F.concat(form, F.lit("k"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, '("').otherwise(' "'), "s_name", F.when(F.col("s_suppkey") % 2 == 0, '")').otherwise('"'))
    files = t.supplier.groupBy(F.concat(F.lit("a"), "s_nationkey").alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return documents.app_settings(files).select("path", "key", "value")


@query("""SELECT path, CASE WHEN path LIKE 'docs/wiki/%' THEN 'wiki' WHEN path LIKE 'docs/views/%' THEN 'views' WHEN upper(split_part(path, '/', -1)) = 'README.MD' THEN 'readme' WHEN upper(split_part(path, '/', -1)) = 'LEDGER.MD' THEN 'ledger' WHEN upper(split_part(path, '/', -1)) = 'DECISIONS.MD' THEN 'decisions' WHEN path LIKE 'docs/%' THEN 'wiki' ELSE 'other' END AS kind,
CASE WHEN path LIKE '%ledger.md' THEN 'readOnly' WHEN path LIKE '%Decisions.md' THEN 'appendOnly' ELSE 'editable' END AS policy FROM (SELECT ['', 'docs/', 'docs/wiki/', 'docs/views/'][1 + doc_id % 4] || ['README.md', 'ledger.md', 'Decisions.md', doc_id || '.md'][1 + doc_id // 4 % 4] AS path FROM documents)""")
def doc_tree(t: Tables) -> DataFrame:
    at = lambda names, i: F.get(F.array(*[F.lit(n) if isinstance(n, str) else n for n in names]), i.cast("int"))
    name = at(["README.md", "ledger.md", "Decisions.md", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))], F.floor(F.col("doc_id") / 4) % 4)
    path = F.concat(at(["", "docs/", "docs/wiki/", "docs/views/"], F.col("doc_id") % 4), name)
    return documents.doc_tree(t.documents.select(path.alias("path"))).select("path", "kind", "policy")


@query("""SELECT 'w/page_' || page_id || '.md' AS path, 'Page ' || (page_id + 1) AS target, CASE WHEN page_id % 2 = 0 THEN 'next one' END AS alias, n.p AS to_path FROM pages LEFT JOIN (SELECT 'w/page_' || page_id || '.md' AS p, page_id - 1 AS k FROM pages) n ON n.k = page_id""")
def wiki_links(t: Tables) -> DataFrame:
    link = F.concat(F.lit("see [[Page "), F.col("page_id") + 1, F.when(F.col("page_id") % 2 == 0, "|next one").otherwise(""), F.lit("]] there"))
    return documents.wiki_links(t.pages.select(F.concat(F.lit("w/page_"), "page_id", F.lit(".md")).alias("path"), link.alias("text"))).select("path", "target", "alias", "to_path")


@query("""SELECT page_id AS path, 'url' AS key, url AS value FROM pages UNION ALL SELECT page_id, 'n', CAST(page_id AS VARCHAR) FROM pages""")
def frontmatter(t: Tables) -> DataFrame:
    text = F.concat(F.lit("---\nn: 0\nurl: "), "url", F.lit("\nno pair\nn: "), "page_id", F.lit("\n---\nother: x\n---\n"))
    return documents.frontmatter(t.pages.select(F.col("page_id").alias("path"), text.alias("text")))


@query("""SELECT doc_id, count(*) AS blocks, count(*) FILTER (line LIKE '|%') AS "tables" FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY doc_id""")
def markdown_blocks(t: Tables) -> DataFrame:
    b = documents.markdown_blocks(t.documents.select("doc_id", "text"))
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("block") == "table").alias("tables"))


@query("""SELECT item_id AS id FROM benchmark WHERE contains(lower(text), 'ershan') OR contains(lower(text), 'thble')""")
def prior_decisions(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    d = t.benchmark.select(F.col("item_id").alias("id"), none.alias("date"), F.col("text").alias("summary"), none.alias("evidence"), none.alias("detail"))
    return documents.decisions_about(d, "Ershan of thble").select("id")


@query("""WITH o AS (SELECT 'u' || l_partkey AS usr, 'n' || l_partkey AS name, 'f' || l_suppkey % 20 || '.swift' AS path, l_orderkey AS line, l_linenumber AS c, CASE l_linenumber WHEN 1 THEN 'definition' WHEN 2 THEN 'call' ELSE 'reference' END AS role FROM lineitem),
n AS (SELECT DISTINCT name FROM o ORDER BY name LIMIT 100), d AS (SELECT usr, arg_min(path, (path, line)) AS path, arg_min(line, (path, line)) AS line FROM o WHERE role = 'definition' AND name IN (SELECT name FROM n) GROUP BY usr)
SELECT o.path AS from_path, d.path AS to_path, o.usr, o.line, d.line AS def_line, role = 'call' AS is_call FROM o JOIN d ON o.usr = d.usr WHERE role <> 'definition' AND o.path <> d.path""")
def compiler_references(t: Tables) -> DataFrame:
    role = F.when(F.col("l_linenumber") == 1, "definition").when(F.col("l_linenumber") == 2, "call").otherwise("reference")
    o = t.lineitem.select(F.concat(F.lit("u"), "l_partkey").alias("usr"), F.concat(F.lit("n"), "l_partkey").alias("name"), F.concat(F.lit("f"), F.col("l_suppkey") % 20, F.lit(".swift")).alias("path"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("column"), role.alias("role"))
    built = o.withColumn("path", F.concat(F.lit(".build/"), "path"))
    return readers.compiler_references(o.unionByName(built), 100).select("from_path", "to_path", "usr", "line", "def_line", "is_call")


_LEDGER = "(SELECT c_nationkey AS repo, o_orderdate AS date, o_totalprice AS cost, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"


def _ledger(t: Tables) -> DataFrame:
    """Ledger rows as the reader of tables gives them: cells with signs and separators, typed by readers.ledger."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    cells = F.array(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("m"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"), F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)")), F.lit("s"))
    typed = readers.ledger(j.select(F.concat_ws("|", "c_nationkey", cells[0]).alias("r"), cells.alias("cells"))).select("commit", "date", "cost")
    return typed.join(j.select(F.col("o_orderkey").cast("string").alias("commit"), F.col("c_nationkey").alias("repo")), "commit")


@query(f"SELECT repo, round(sum(cost), 2) AS spend, count(*) AS entries, strftime(max(date), '%Y-%m-%d') AS last FROM {_LEDGER} GROUP BY repo")
def ledger_spend(t: Tables) -> DataFrame:
    return derive.spend(_ledger(t)).withColumn("spend", F.round("spend", 2))


@query(f"""SELECT repo, CAST(n AS INT) AS position, round(cost, 2) AS cost FROM (SELECT repo, cost, row_number() OVER (PARTITION BY repo ORDER BY strftime(date, '%Y-%m-%d') DESC, CAST(o_orderkey AS VARCHAR) DESC) AS n FROM {_LEDGER}) WHERE n <= 30""")
def ledger_series(t: Tables) -> DataFrame:
    return derive.recent(_ledger(t), ["repo"], [F.desc("date"), F.desc("commit")], 30).select("repo", "position", F.round("cost", 2).alias("cost"))


@query("""SELECT round((SELECT sum(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey), 1) AS spend, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS "open" """)
def portfolio(t: Tables) -> DataFrame:
    return derive.portfolio(_ledger(t), documents.issues(_issue_exports(t))).withColumn("spend", F.round("spend", 1))
