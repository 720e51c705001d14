"""The answers of tools as budgeted lines of text: a header, lines while they fit, and a footer that says what was left out.

Every tool returns rows (position, text). `asked` is the budget that a caller wants; the tool's most is never exceeded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import render
from ..functions import text as X
from ..operators import budget, lookups, search
from ..sources import documents, readers

# The greatest number of tokens that an answer may have, and what it has without being asked.
CEILINGS = {"status": 800, "factory_audit": 4000, "prior_decisions": 4000, "repo_map": 5000, "search": 8000, "find_definition": 4000, "find_references": 4000, "callers_of": 4000, "blast_radius": 4000, "list_symbols": 4000, "read_span": 8000}
DEFAULTS = {"factory_audit": 2000, "prior_decisions": 2000, "repo_map": 3000, "search": 4000}
FLOOR = 200


def allowed(tool: str, asked: int | None) -> int:
    return max(FLOOR, min(asked or DEFAULTS.get(tool, CEILINGS[tool]), CEILINGS[tool]))


def page(lines: DataFrame, order: list[Column], text: Column, tokens: int, header: str = "", most: int = 10_000) -> DataFrame:
    """position, text of header, the first lines in order that fit, and the footer. Lines beyond `most` cannot fit in any budget."""
    rows = lines.select(F.struct(*order).alias("o") if len(order) > 1 else order[0].alias("o"), text.alias("text"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    spent = max(1, -(-len(header.encode()) // 3)) if header else 0
    kept = budget.prefix_admit(rows.orderBy("o").limit(most).withColumn("g", F.lit(0)), ["g"], [F.col("o")], X.token_estimate(F.col("text")), tokens - spent)
    kept = kept.select((F.row_number().over(Window.partitionBy("g").orderBy("o"))).cast("int").alias("position"), "text")
    spark = lines.sparkSession
    head = spark.createDataFrame([(0, header)], "position int, text string") if header else kept.limit(0)
    foot = kept.agg(F.count(F.lit(1)).alias("shown")).crossJoin(total).where("shown < total").select((F.col("shown") + 1).cast("int").alias("position"), budget.footer(F.col("shown"), F.col("total")).alias("text"))  # one row each
    return head.unionByName(kept).unionByName(foot)


def status(summary: DataFrame, embedder: str | None = None) -> DataFrame:
    """A line a repository (repo, files, declarations, references), and one on the embedder."""
    line = F.format_string("%s: %d files, %d declarations, references: %s", "repo", "files", "declarations", F.when(F.col("compiled"), "compiler").otherwise("syntactic"))
    return page(summary, [F.col("repo")], line, CEILINGS["status"], f"embedder: {embedder or 'none, semantic search is not available'}")


def factory_audit(files: DataFrame, asked: int | None = None) -> DataFrame:
    """A line an expectation of a project's files (path, text); the header says whether its factory is operational."""
    found, verdict = readers.project_audit(files)
    header = "operational" if verdict.first()["operational"] else "not operational"
    return page(found, [F.col("position")], F.concat_ws("  ", "state", "path", F.concat(F.lit("marker: "), "marker"), "purpose"), allowed("factory_audit", asked), header)


def prior_decisions(decisions: DataFrame, topic: str | None = None, asked: int | None = None) -> DataFrame:
    """Decisions on a topic, the newest first; a refused one carries the first six lines of its reasons."""
    reasons = F.when(F.col("status") == "refused", F.array_join(F.transform(F.slice(X.lines(F.coalesce("detail", F.lit(""))), 1, 6), lambda x: F.concat(F.lit("    "), x)), "\n"))
    line = F.concat_ws("\n", F.format_string("%s  %s  [%s]  %s", "id", F.coalesce("date", F.lit("?")), "status", "summary"), F.nullif(reasons, F.lit("")))
    newest = F.coalesce(F.unix_date(F.expr("try_cast(date as date)")), F.lit(-(1 << 30)))
    return page(documents.decisions_about(decisions, topic), [(-newest).alias("d"), F.col("id")], line, allowed("prior_decisions", asked))


def find_definition(entities: DataFrame, symbol: str, limit: int = 10, asked: int | None = None) -> DataFrame:
    found = search.name_search(entities, symbol, min(limit, 50), list(lookups.model.DEFINITION_KINDS))
    return page(found, [F.col("rank")], render.declaration(F.col("path"), F.col("line"), F.col("line"), F.col("name"), F.col("kind")), allowed("find_definition", asked))


def _answers(entities: DataFrame, edges: DataFrame, symbol: str, calls_only: bool, tool: str, asked: int | None) -> DataFrame:
    key = symbol
    if ":" not in symbol:
        first = search.name_search(entities, symbol, 1, list(lookups.model.DEFINITION_KINDS)).first()
        key = first["key"] if first else symbol
    rows = lookups.references(entities, edges, key, calls_only)
    known = lookups.evidence(entities, edges, key).first()["evidence"]
    what = "callers" if calls_only else "references"
    none = f"{key}: {what} unavailable (no compiled references)" if known == "unavailable" else f"{key}: no {what}" if rows.isEmpty() else f"{key}: {what}"
    return page(rows, [F.col("position")], render.reference(F.col("path"), F.col("line"), F.col("name"), F.col("refs"), F.col("calls"), calls_only), allowed(tool, asked), none)


def find_references(entities: DataFrame, edges: DataFrame, symbol: str, asked: int | None = None) -> DataFrame:
    return _answers(entities, edges, symbol, False, "find_references", asked)


def callers_of(entities: DataFrame, edges: DataFrame, symbol: str, asked: int | None = None) -> DataFrame:
    return _answers(entities, edges, symbol, True, "callers_of", asked)


def blast_radius(entities: DataFrame, edges: DataFrame, key: str, depth: int = 2, asked: int | None = None) -> DataFrame:
    near = lookups.blast_radius(entities, edges, key, min(depth, 4)).join(entities.select("node", "name", "kind", "path", "line"), "node")
    order = [(-F.round("rank", 12)).alias("r"), F.col("key")]
    return page(near, order, render.declaration(F.col("path"), F.col("line"), F.col("line"), F.col("name"), F.col("kind")), allowed("blast_radius", asked), f"{key}: within {min(depth, 4)} hops")


def list_symbols(entities: DataFrame, path: str, asked: int | None = None) -> DataFrame:
    """Declarations of a path in source order; the path alone decides, whatever the repository."""
    return page(lookups.symbols_in_file(entities, path), [F.col("position")], render.declaration(F.col("path"), F.col("line"), F.col("line"), F.col("name"), F.col("kind")), allowed("list_symbols", asked))


def read_span(files: DataFrame, path: str, start: int, end: int, current_hash: str | None = None) -> DataFrame:
    """position, text of the lines of one file (repo, path, blob_hash, text), with a header that says where they are and whether the content has
    changed since current_hash was read. Raises LookupError for an unknown path and for one that several repositories have."""
    wanted = X.normalised_path(F.lit(path))
    found = files.where(F.col("path") == wanted).limit(2).collect()
    if not found:
        raise LookupError(f"unknown path: {path}")
    if len(found) > 1:
        raise LookupError(f"several repositories have {path}: name one")
    stale = current_hash is not None and found[0]["blob_hash"] != current_hash
    one = files.where(F.col("path") == wanted).select(X.read_span(F.col("text"), F.lit(start), F.lit(end)).alias("s"))
    body = one.select("s.start", F.posexplode(F.split("s.body", "\n")).alias("i", "line"))
    span = one.select("s.start", "s.end", "s.total").first()
    header = f"{path}:{span.start}-{span.end} of {span.total}" + ("  (stale: the file has changed)" if stale else "")
    return page(body, [F.col("i")], F.format_string("%5d  %s", F.col("start") + F.col("i"), F.col("line")), CEILINGS["read_span"], header)


def search_page(hits: DataFrame, note: str | None = None, asked: int | None = None) -> DataFrame:
    """position, text: each hit (rank, repo, path, line, score, snippet, resolution) as a citation, with its snippet where that still fits."""
    cite = F.format_string("%d. %s/%s:%d  [%s %.4f]", "rank", "repo", "path", "line", "resolution", "score")
    shown = budget.admit_with_citations(hits.withColumn("g", F.lit(0)), ["g"], F.col("rank"), cite, F.col("snippet"), allowed("search", asked))
    rows = shown.select(F.posexplode("shown").alias("i", "s")).select((F.col("i") + 1).cast("int").alias("position"), F.concat_ws("\n", "s.citation", "s.body").alias("text"))
    return rows if note is None else hits.sparkSession.createDataFrame([(0, note)], "position int, text string").unionByName(rows)


def repo_map(name: str, ranks: DataFrame, declarations: DataFrame, compiled: bool, focus: list[str] | None = None, asked: int | None = None, repos: int = 1) -> DataFrame:
    """position, text: files by centrality under their directories, each with its headline declarations as name:line; several repositories share
    the budget."""
    tokens = max(FLOOR, allowed("repo_map", asked) // max(1, repos))
    header = f"{name} — {ranks.count()} files, ranked by centrality" + (f", focused on {', '.join(focus)}" if focus else "")
    if not compiled:
        header += "\n(no compiler references — ranked by imports only; build the repo for more)"
    return budget.repo_map_page(ranks, declarations, tokens, header + "\n")
