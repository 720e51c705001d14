"""The command line: index repositories into a workspace and ask it. `python -m stratagraph.cli WORKSPACE COMMAND ...`"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lookups, scenes, temporal
from .plans import generator, tools
from .plans.workspace import Workspace
from .sources import documents, readers


def _lines(df: DataFrame) -> list[str]:
    return [r["text"] for r in df.orderBy("position").collect()]


def _table(df: DataFrame, *order: str) -> list[str]:
    return [json.dumps(r.asDict(), default=str) for r in df.orderBy(*order).collect()]


def _folder(w: Workspace, repo: str) -> str:
    known = {r["repo"]: r["folder"] for r in w.registered().collect()}
    if repo not in known:
        raise lookups.UnknownRepository(repo)
    return known[repo]


def _index(w: Workspace, a: argparse.Namespace) -> list[str]:
    repos = [a.repo] if a.repo else sorted(r["repo"] for r in w.registered().collect())
    for repo in repos:
        w.index(repo, _folder(w, repo))
    w.build_index()
    return [f"revision {w.revision()}"]


def _contains(w: Workspace, a: argparse.Namespace) -> list[str]:
    e = w.edges().where("kind in ('containsPhysical', 'declares')").join(lookups.by_key(w.entities(), a.key).select(F.col("node").alias("src")), "src")
    return _table(lookups.by_ids(w.entities(), e.select(F.col("dst").alias("node"))).select("key", "kind"), "key")


def _deps(w: Workspace, a: argparse.Namespace) -> list[str]:
    e = w.edges().where("kind in ('imports', 'dependsOn', 'references')").join(lookups.by_key(w.entities(), a.key).select(F.col("node").alias("src")), "src")
    return _table(lookups.by_ids(w.entities(), e.select(F.col("dst").alias("node"))).select("key", "kind"), "key")


def _span(w: Workspace, a: argparse.Namespace) -> list[str]:
    return _lines(tools.read_span(w.files(a.repo), a.path, a.start, a.end))


def _map(w: Workspace, a: argparse.Namespace) -> list[str]:
    ranks = w.ranks(a.repo, a.focus)
    decls = lookups.by_kind(w.entities().where(F.col("repo") == a.repo), *lookups.model.DEFINITION_KINDS).where("line is not null").select("path", "kind", "name", "line")
    compiled = bool(w.status().where(F.col("repo") == a.repo).select("compiled").first()["compiled"])
    return _lines(tools.repo_map(a.repo, ranks, decls, compiled, a.focus, a.tokens))


def _diff(w: Workspace, a: argparse.Namespace) -> list[str]:
    return _table(temporal.revision_diff(w.versions(), a.old, a.new).select("repo", "stable_key", "change"), "repo", "stable_key", "change")


def _owners(w: Workspace, a: argparse.Namespace) -> list[str]:
    log = documents.commits(w.spark.read.text(a.export, wholetext=True).withColumnRenamed("value", "text")).where("path is not null")
    person = lookups.model.identity(F.col("email"), F.col("author"))
    return [f"revision {w.enrich_ownership(a.repo, log.select('path', person.alias('person'), F.col('author').alias('name'), 'at'))}"]


def _compiled(w: Workspace, a: argparse.Namespace) -> list[str]:
    return [f"revision {w.enrich_references(a.repo, w.spark.read.schema(readers.OCCURRENCE).json(a.export))}"]


def _search(w: Workspace, a: argparse.Namespace) -> list[str]:
    hits, _, note = w.find(a.query, a.limit, a.repo, a.prefix, a.mode, a.focus)
    return _lines(tools.search_page(hits, note))


def _register(w: Workspace, a: argparse.Namespace) -> list[str]:
    w.register(a.repo, a.folder)
    return [f"registered {a.repo}"]


def _scene(w: Workspace, a: argparse.Namespace) -> list[str]:
    nodes = w.entities().select("node")
    return _table(scenes.metrics(nodes, w.edges().select("src", "dst")), "nodes")


#: name -> (help, arguments, what it prints)
COMMANDS: dict[str, tuple[str, list[tuple], Callable[[Workspace, argparse.Namespace], list[str]]]] = {
    "register": ("name a repository's folder", [("repo",), ("folder",)], _register),
    "repos": ("list the repositories", [], lambda w, a: _table(w.registered(), "repo")),
    "index": ("index one repository, or all", [("repo", "?")], _index),
    "contains": ("what an entity contains", [("key",)], _contains),
    "deps": ("what an entity depends on", [("key",)], _deps),
    "search": ("search the current files", [("query",)], _search),
    "owners": ("people and ownership from an exported log", [("repo",), ("export",)], _owners),
    "compiled": ("references from a compiler's exported occurrences (JSON lines)", [("repo",), ("export",)], _compiled),
    "why": ("the files that support a fact", [("key",)], lambda w, a: _table(w.why(a.key), "repo", "path")),
    "origins": ("the renames that indexing saw", [("repo",)], lambda w, a: _table(w.origins(a.repo), "revision", "new_path")),
    "def": ("find a definition", [("symbol",)], lambda w, a: _lines(tools.find_definition(w.entities(), a.symbol, a.limit))),
    "refs": ("what refers to a symbol", [("symbol",)], lambda w, a: _lines(tools.find_references(w.entities(), w.edges(), a.symbol))),
    "callers": ("what calls a symbol", [("symbol",)], lambda w, a: _lines(tools.callers_of(w.entities(), w.edges(), a.symbol))),
    "radius": ("what a change could reach", [("key",)], lambda w, a: _lines(tools.blast_radius(w.entities(), w.edges(), a.key, a.depth))),
    "symbols": ("declarations of a file", [("path",)], lambda w, a: _lines(tools.list_symbols(w.entities(), a.path))),
    "span": ("lines of a file", [("path",), ("start", int), ("end", int)], _span),
    "map": ("a repository's map", [("repo",)], _map),
    "metrics": ("counts of the graph", [], _scene),
    "status": ("what is indexed", [], lambda w, a: _lines(tools.status(w.status()))),
    "revisions": ("the newest revision", [], lambda w, a: [str(w.revision())]),
    "diff": ("facts that changed after one revision and up to another", [("old", int), ("new", int)], _diff),
    "verify": ("what a rebuild would say differently", [("repo",)], lambda w, a: _table(w.verify(a.repo, _folder(w, a.repo)), "fact")),
    "bench": ("time a generated graph", [], lambda w, a: [json.dumps(generator.bench(w.spark, f"{w.root}/bench"))]),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratagraph", description=__doc__)
    p.add_argument("workspace")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (text, arguments, _) in COMMANDS.items():
        c = sub.add_parser(name, help=text)
        taken = set()
        for arg in arguments:
            taken.add(arg[0])
            c.add_argument(arg[0], **({"nargs": "?"} if arg[1:] == ("?",) else {"type": arg[1]} if len(arg) > 1 else {}))
        for option, kind, default in (("repo", str, None), ("prefix", str, None), ("limit", int, 10), ("depth", int, 2), ("tokens", int, None), ("mode", str, "lexical")):
            if option not in taken:
                c.add_argument(f"--{option}", type=kind, default=default)
        c.add_argument("--focus", action="append")
    return p


def run(spark: SparkSession, arguments: list[str]) -> list[str]:
    a = parser().parse_args(arguments)
    return COMMANDS[a.command][2](Workspace(spark, a.workspace), a)


def main() -> None:
    spark = SparkSession.builder.appName("stratagraph").getOrCreate()
    import sys

    print("\n".join(run(spark, sys.argv[1:])))


if __name__ == "__main__":
    main()
