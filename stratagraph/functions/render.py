"""Text lines of tools as Column expressions: citations, declarations, references, and the prefix of a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def place(path: Column, start: Column, end: Column) -> Column:
    """path:start-end, path:start for one line, or the path where there is no line."""
    span = F.when(start == end, start.cast("string")).otherwise(F.concat(start, F.lit("-"), end))
    return F.when(start.isNull(), path).otherwise(F.concat(path, F.lit(":"), span))


def citation(repo: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(repo, F.lit("/"), place(path, start, end))


def declaration(path: Column, start: Column, end: Column, name: Column, kind: Column) -> Column:
    return F.concat(place(F.coalesce(path, F.lit("(no anchor)")), start, end), F.lit("  "), name, F.lit(" ["), kind, F.lit("]  observed/syntactic"))


def reference(path: Column, line: Column, name: Column, references: Column, calls: Column, calls_only: bool = False) -> Column:
    counts = F.concat(calls, F.lit(" call(s)"))
    if not calls_only:
        counts = F.concat(references, F.lit(" reference(s), "), counts)
    return F.concat(F.coalesce(path, F.lit("?")), F.lit(":"), F.coalesce(line, F.lit(0)), F.lit("  "), name, F.lit("  derived/compiler  "), counts)


def context_prefix(repo: Column, path: Column, imports: Column, enclosing: Column, siblings: Column) -> Column:
    """What stands before a chunk when it is embedded: facts of its own file only; at most eight siblings."""
    def listed(label: str, values: Column, sep: str) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, sep)))
    head = F.concat(F.lit("repo: "), repo, F.lit(" | file: "), path)
    return F.concat(F.concat_ws("\n", head, listed("imports", F.array_sort(imports), ", "), listed("enclosing", enclosing, " › "), listed("siblings", F.slice(siblings, 1, 8), ", ")), F.lit("\n---\n"))
