"""Reads of the graph as callers ask them: by key, kind, id, path and reference. Entities are rows (node, key, kind, name, repo, path, line),
edges are rows (id, kind, src, dst, refs, calls); both as of one revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from . import graph


class UnknownRepository(LookupError):
    """Neither the id nor the display name of a repository."""


def by_key(entities: DataFrame, key: str) -> DataFrame:
    return entities.where(F.col("key") == key)


def by_kind(entities: DataFrame, *kinds: str) -> DataFrame:
    """Entities of the kinds; callers that list them order by key."""
    return entities.where(F.col("kind").isin(*kinds))


def by_ids(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities whose node is in ids (node): a semi join, so there may be any number of ids."""
    return entities.join(ids.select("node").distinct(), "node", "left_semi")


def relationships(edges: DataFrame, source: int | None = None, target: int | None = None, kind: str | None = None) -> DataFrame:
    """Edges from a source, to a target, of a kind; each where it is given."""
    for name, value in (("src", source), ("dst", target), ("kind", kind)):
        edges = edges if value is None else edges.where(F.col(name) == value)
    return edges


def repositories(entities: DataFrame) -> DataFrame:
    """repo, files, declarations of every repository, in order of repo."""
    return entities.groupBy("repo").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind").isin(*model.DEFINITION_KINDS)).alias("declarations"))


def resolve_repository(repos: DataFrame, name: str) -> str:
    """The id of the repository (repo, display_name) with this id or display name; the least id where several have the name."""
    row = repos.where((F.col("repo") == name) | (F.col("display_name") == name)).agg(F.min_by("repo", F.struct(F.col("repo") != name, "repo")).alias("r")).first()
    if row.r is None:
        raise UnknownRepository(name)
    return row.r


def revisions(commits: DataFrame) -> DataFrame:
    """revision, at of commits (revision, created): a text that is no time counts as the distant past."""
    return commits.select("revision", F.coalesce(F.try_to_timestamp("created"), F.lit("0001-01-02").cast("timestamp")).alias("at"))


def anchored_in(versions: DataFrame, path: str) -> DataFrame:
    """Current versions one of whose anchors (array of structs with path) is in a path."""
    return versions.where(F.col("valid_to").isNull() & F.exists("anchors", lambda a: a["path"] == path))


def symbols_in_file(entities: DataFrame, path: str) -> DataFrame:
    """Declarations of a file, with their position in source order."""
    found = by_kind(entities, *model.DEFINITION_KINDS).where(F.col("path") == path)
    return found.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("line", "key")))


def evidence(entities: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One row (evidence): compiler where the target's repository has any compiled reference, else unavailable; no such key: unavailable."""
    repo = by_key(entities, key).select("repo").limit(1)
    compiled = edges.where("kind = 'refersToSymbol'").join(entities.select(F.col("node").alias("src"), "repo").join(F.broadcast(repo), "repo", "left_semi"), "src", "left_semi")  # one repository
    return compiled.limit(1).agg(F.when(F.count(F.lit(1)) > 0, "compiler").otherwise("unavailable").alias("evidence"))


def references(entities: DataFrame, edges: DataFrame, key: str, calls_only: bool = False) -> DataFrame:
    """position, key, name, path, line, refs, calls, evidence of what refers to a symbol, most references first (with calls_only: callers,
    most calls first); ties by key. Empty with evidence `unavailable` means unknown, with `compiler` it means none."""
    target = by_key(entities, key).select(F.col("node").alias("dst"))
    into = edges.where("kind = 'refersToSymbol'" + (" and calls > 0" if calls_only else "")).join(F.broadcast(target), "dst", "left_semi")  # one key
    rows = into.join(entities.select(F.col("node").alias("src"), "key", "name", "path", "line"), "src")
    order = F.col("calls" if calls_only else "refs").desc()
    rows = rows.crossJoin(F.broadcast(evidence(entities, edges, key)))  # one row
    return rows.select(F.row_number().over(Window.partitionBy("dst").orderBy(order, "key")).alias("position"), "key", "name", "path", "line", "refs", "calls", "evidence")


def blast_radius(entities: DataFrame, edges: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """node, key, distance, rank of what a change of the symbol could reach; callers order by rank (descending) and key."""
    origin = by_key(entities, key).select("node")
    near = graph.blast_radius(edges.withColumn("weight", F.coalesce("refs", F.lit(0))), origin, depth)
    return near.join(entities.select("node", "key"), "node")


def under(rows: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    """Rows whose path begins with a prefix, taken letter by letter: no character of it is a pattern."""
    return rows.where(F.col(column).startswith(prefix))


def properties(rows: DataFrame, kinds: dict[str, str], column: str = "properties") -> DataFrame:
    """Rows with typed columns out of their JSON bag (name -> type): null where the bag is no JSON, lacks the name or has another type there."""
    bag = F.try_parse_json(column)
    return rows.select("*", *[F.try_variant_get(bag, f"$['{n}']", k).alias(n) for n, k in kinds.items()])


def layer_of(c: Column) -> Column:
    """A stored layer; what is none of the known ones counts as observed."""
    return F.when(c.isin(*model.LAYERS), c).otherwise("observed")


def role_disagreements(named: DataFrame, roles: DataFrame) -> DataFrame:
    """node, named, structural of nodes (node, named) whose role by name is not one that their place in the graph (node, role) allows."""
    expected = F.create_map(*[x for k, v in T.EXPECTED_ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    j = named.join(roles.select("node", F.col("role").alias("structural")), "node")
    return j.where(~F.array_contains(F.try_element_at(expected, F.col("named")), F.col("structural"))).select("node", "named", "structural")


def by_label(c: Column) -> Column:
    """How lists order labels: by letters as a reader does (accents and case only where the letters are equal), runs of digits by their number, of any
    length. Null stays null; ties are the caller's to break."""
    parts = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), F.lit(0))
    plain = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    number = lambda x: F.concat(F.lpad(F.length(plain(x)).cast("string"), 10, "0"), plain(x))  # noqa: E731  longer numbers are greater
    return F.collate(F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), number(x)).otherwise(x)), ""), "UNICODE")


def in_label_order(rows: DataFrame, group: list[str], label: str, tie: str) -> DataFrame:
    """rows with position (from 1) in the order of labels within each group, then by the label's own characters, then by `tie`."""
    w = Window.partitionBy(*group).orderBy(by_label(F.col(label)), label, tie)
    return rows.withColumn("position", F.row_number().over(w))


def label_search(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """The first `limit` nodes (node, label) by node whose label contains the trimmed query, whatever its case; the cut comes before callers
    sort by label. A blank query finds nothing."""
    q = query.strip().lower()
    return nodes.where(F.lit(bool(q)) & F.contains(F.lower("label"), F.lit(q))).orderBy("node").limit(limit)


# The properties that a chart sees.
TEXTS = ["core:lastCommit", "core:buildSystem", "core:buildTargetVerbatim"]
INTEGERS = ["core:buildOrder"]
FLAGS = ["core:buildPattern", "core:buildPhony"]
LISTS = ["core:buildSteps"]
LIST_SEPARATOR = "\x1f"


def projected_attributes(properties: Column) -> Column:
    """map<string, string> of the allowed properties of a variant bag that have the right type; a false flag and an empty list are absent."""
    def of(name: str, kind: str) -> Column:
        return F.try_variant_get(properties, f"$['{name}']", kind)
    def typed(name: str, *types: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(properties, f"$['{name}']", "variant")).isin(*types)
    entries = [F.when(typed(n, "STRING"), F.struct(F.lit(n).alias("k"), of(n, "string").alias("v"))) for n in TEXTS]
    entries += [F.when(typed(n, "BIGINT"), F.struct(F.lit(n).alias("k"), of(n, "bigint").cast("string").alias("v"))) for n in INTEGERS]
    entries += [F.when(typed(n, "BOOLEAN") & of(n, "boolean"), F.struct(F.lit(n).alias("k"), F.lit("true").alias("v"))) for n in FLAGS]
    for n in LISTS:
        texts = F.transform(F.filter(of(n, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
        entries.append(F.when(F.size(texts) > 0, F.struct(F.lit(n).alias("k"), F.array_join(texts, LIST_SEPARATOR).alias("v"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))
