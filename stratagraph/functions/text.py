"""Text functions as Column expressions: lines, windows, identifiers, snippets, token estimates, paths, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_LINES = 60
#: Word boundaries inside an identifier: camelCase, the last capital of a run, and letters against digits.
BOUNDARY = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{N})(?=\P{N})|(?<=\P{N})(?=\p{N})"
TERM = r"[\p{L}\p{N}_$]+"
_BREAK = r"[^\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """body(value), computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their \\r; one empty line at the end is dropped; no lines in an empty text."""
    def trimmed(raw: Column) -> Column:
        n = F.size(raw) - F.when(F.element_at(raw, -1) == "", 1).otherwise(0)
        return F.transform(F.slice(raw, 1, n), lambda x: F.regexp_replace(x, r"\r$", ""))
    return let(F.split(text, "\n"), trimmed)


def windows(text: Column, size: int = WINDOW_LINES) -> Column:
    """array<struct<ordinal, start_line, body>> of consecutive windows."""
    def cut(ls: Column) -> Column:
        count = F.ceil(F.size(ls) / size).cast("int")
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("ordinal"), (i * size + 1).alias("start_line"), F.array_join(F.slice(ls, i * size + 1, F.lit(size)), "\n").alias("body")))
    return let(lines(text), cut)


def identifier_parts(token: Column) -> Column:
    """The words of an identifier: httpClient2Name -> http, Client, 2, Name."""
    runs = F.filter(F.split(token, _BREAK), lambda x: x != "")
    return F.flatten(F.transform(runs, lambda x: F.split(x, BOUNDARY)))


def split_text(text: Column) -> Column:
    """Per line, the parts of the tokens that have more than one."""
    def of_line(line: Column) -> Column:
        parts = F.transform(F.filter(F.split(line, _BREAK), lambda x: x != ""), lambda x: F.split(x, BOUNDARY))
        return F.array_join(F.flatten(F.filter(parts, lambda p: F.size(p) > 1)), " ")
    return F.array_join(F.transform(F.split(text, "\n"), of_line), "\n")


def query_terms(query: Column) -> Column:
    """Each token of a query, then its parts; the first spelling of each counts."""
    tokens = F.filter(F.split(query, _BREAK), lambda x: x != "")
    spelled = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.split(t, BOUNDARY))))
    return F.aggregate(spelled, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def matching_line(ls: Column, wanted: list[str]) -> Column:
    """Number (from 1) of the first line that contains a term, or the first whose split does; null if none."""
    def first(test) -> Column:
        return F.nullif(F.array_position(F.transform(ls, test), True), F.lit(0)).cast("int")
    def holds(line: Column) -> Column:
        low = F.lower(line)
        out = F.lit(False)
        for t in wanted:
            out = out | F.contains(low, F.lit(t.lower()))
        return out
    return F.coalesce(first(holds), first(lambda x: holds(split_text(x))))


def snippet(ls: Column, line: Column, around: int = 2) -> Column:
    """The lines around a line, within the text."""
    start = F.greatest(F.lit(1), line - around)
    return F.array_join(F.slice(ls, start, line + around - start + 1), "\n")


def read_span(text: Column, start: Column, end: Column, most: int = 400) -> Column:
    """struct<start, end, total, body>: lines start..end clamped to the text and to `most` lines."""
    def cut(ls: Column) -> Column:
        a = F.least(F.greatest(start, F.lit(1)), F.greatest(F.size(ls), F.lit(1)))
        b = F.least(F.greatest(end, a), F.size(ls), a + most - 1)
        return F.struct(a.alias("start"), b.alias("end"), F.size(ls).alias("total"), F.array_join(F.slice(ls, a, F.greatest(b - a + 1, F.lit(0))), "\n").alias("body"))
    return let(lines(text), cut)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 3)).cast("long")


def is_prose(line: Column) -> Column:
    return F.trim(line).rlike(r"^(//|/\*|\*|@|#)")


def normalised_path(path: Column) -> Column:
    """`.` and `..` folded."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))), "/")


def program_of(command: Column) -> Column:
    """The program that a shell command runs: past assignments, without its folder; $(X) is X."""
    words = F.filter(F.split(F.trim(command), r"\s+"), lambda w: ~w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=") & (w != ""))
    return F.regexp_replace(F.element_at(F.split(F.get(words, F.lit(0)), "/"), -1), r"^\$[({](\w+)[)}]$", "$1")


LANGUAGES = {"swift": "swift", "py": "python", "c": "c", "h": "c", "rs": "rust", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml"}


def language(path: Column) -> Column:
    """Language hint by extension; null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_test(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_extract(name, r"^[^.]*", 0)
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    named = F.exists(folders, lambda x: x.isin("Tests", "tests", "test", "Test", "__tests__", "spec", "specs", "Spec", "UITests"))
    return F.coalesce(named | stem.rlike("(Tests?|_test)$") | stem.startswith("test_") | name.contains(".test.") | name.contains(".spec."), F.lit(False))


# Name endings and folders that tell a file's part, the first that fits.
PATTERN_ROLES = [
    ("ViewModels", "ViewModels?", ["ViewModels"]),
    ("Views", "View|Screen|Page|Window|Cell", ["Views", "Screens", "UI"]),
    ("Controllers", "Controller|Coordinator|Router|Presenter", ["Controllers", "Coordinators"]),
    ("Stores", "Store|Repository|Persistence|Database|DAO", ["Stores", "Repositories"]),
    ("Services", "Service|Client|Provider|Manager|Engine|API", ["Services", "Providers", "Networking"]),
    ("Models", "Model|Entity|DTO|Record", ["Models", "Entities"]),
]
EXPECTED_ROLES = {"Services": ["Core", "Hub"], "Stores": ["Core", "Hub"], "Models": ["Core", "Hub", "Leaf"], "Views": ["Entry", "Hub", "Leaf"], "ViewModels": ["Entry", "Hub"], "Controllers": ["Entry", "Hub"]}


def pattern_role(path: Column, kind: Column) -> Column:
    stem = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^[^.]*", 0)
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    out = F.when(kind == "module", "Modules").when(is_test(path), "Tests").when(path.isNull(), "Other")
    for name, ends, under in PATTERN_ROLES:
        out = out.when(stem.rlike(f"({ends})$") | F.arrays_overlap(folders, F.array(*map(F.lit, under))), name)
    return out.otherwise("Other")


def area(path: Column) -> Column:
    """First two folders under a source or test root, else the first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, "").when(F.get(parts, F.lit(0)).isin("Sources", "Tests", "src", "lib", "test", "tests") & (F.size(parts) > 2), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    return let(F.sqrt(dot(v, v)), lambda n: F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n)))
