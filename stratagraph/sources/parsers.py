"""Parsers of build files, source code and documents. Plain Python on one text each; extract() runs them over blobs on the executors."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

RECIPE_LINES, LANE_STEPS = 12, 14
# Words that lead a line of a lane without being an action.
NOT_ACTIONS = frozenset("if unless case when else elsif begin rescue ensure end do while until for return next break yield then in lane private_lane platform desc puts require import self true false nil".split())

_ASSIGN = re.compile(r"^([^\s:=?+#]+)\s*(::?=|\?=|\+=|=)\s*(.*)$")


def _joined(text: str) -> list[str]:
    return re.sub(r"\\\n", " ", text).split("\n")


def _expanded(s: str, variables: dict[str, str]) -> str:
    """$(NAME) and ${NAME} replaced, five times at most; unknown names stay."""
    for _ in range(5):
        new = re.sub(r"\$(?:\((\w[\w.-]*)\)|\{(\w[\w.-]*)\})", lambda m: variables.get(m[1] or m[2], m[0]), s)
        if new == s:
            break
        s = new
    return s.strip()


def make_rules(text: str) -> list[dict]:
    """Targets of a Makefile in order: target, verbatim (its spelling where variables were in it), prerequisites, recipe, phony, pattern.

    `+=` appends. A target stated more than once has all prerequisites, and the last recipe that isn't empty.
    """
    rows, variables, phony = _joined(text), {}, set()
    for line in rows:
        m = None if line.startswith("\t") else _ASSIGN.match(line.strip())
        if m:
            name, op, value = m[1], m[2], m[3].strip()
            variables[name] = f"{variables[name]} {value}".strip() if op == "+=" and name in variables else value
    found: dict[str, dict] = {}
    current: list[dict] = []
    for line in rows:
        if line.startswith("\t"):
            command = line.strip().lstrip("@-+").strip()
            if command and not command.startswith("#"):
                for part in current:
                    if len(part["recipe"]) < RECIPE_LINES:
                        part["recipe"].append(_expanded(command, variables))
            continue
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith(".PHONY"):
            phony |= set(line[6:].lstrip(": ").split())
            continue
        current = []
        head, colon, rest = line.partition(":")
        if not colon or _ASSIGN.match(line) or "=" in head or rest.startswith("="):
            continue
        needs = _expanded(rest.lstrip(":"), variables).replace("|", " ").split()
        for spelled in head.split():
            for name in _expanded(spelled, variables).split():
                current.append({"target": name, "verbatim": spelled if spelled != name else None, "needs": needs, "recipe": []})
        for part in current:
            rule = found.setdefault(part["target"], {"target": part["target"], "verbatim": part["verbatim"], "prerequisites": [], "parts": []})
            rule["verbatim"] = rule["verbatim"] or part["verbatim"]
            rule["prerequisites"] += [x for x in dict.fromkeys(needs) if x not in rule["prerequisites"]]
            rule["parts"].append(part["recipe"])
    for rule in found.values():
        rule["recipe"] = next((p for p in reversed(rule.pop("parts")) if p), [])
        rule["phony"], rule["pattern"] = rule["target"] in phony, "%" in rule["target"]
    return list(found.values())


def fastlane_lanes(text: str) -> list[dict]:
    """Lanes of a Fastfile: name, private, calls (other lanes of the file), steps."""
    rows, blocks, i = text.split("\n"), [], 0
    while i < len(rows):
        m = re.match(r"(\s*)(private_)?lane\s+:(\w+)", rows[i])
        i += 1
        if m:
            end = re.compile(re.escape(m[1]) + r"end\s*$")
            body = []
            while i < len(rows) and not end.match(rows[i]):
                body.append(rows[i].strip())
                i += 1
            i += 1
            blocks.append((m[3], bool(m[2]), body))
    known = {name for name, _, _ in blocks}
    lanes = []
    for name, private, body in blocks:
        named = [re.findall(r"^([a-z_][a-z0-9_]*)", b)[:1] + re.findall(r":([a-z_][a-z0-9_]*)", b) for b in body if not b.startswith("#")]
        calls = list(dict.fromkeys(x for n in named for x in n if x in known and x != name))
        steps = [n[0] for n in named if n and n[0] != name and n[0] not in NOT_ACTIONS][:LANE_STEPS]
        lanes.append({"name": name, "private": private, "calls": calls, "steps": steps})
    return lanes


def ci_commands(text: str) -> list[str]:
    """fastlane invocations of a workflow file, comments left out."""
    return [m[0].strip() for line in text.split("\n") if not line.strip().startswith("#") and (m := re.search(r"(?:bundle exec )?fastlane\s+\S.*", line))]


def build_kind(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    if name in ("Makefile", "makefile", "GNUmakefile") or name.endswith(".mk"):
        return "make"
    if name == "Fastfile":
        return "fastlane"
    return "github-actions" if re.search(r"(^|/)\.github/workflows/[^/]+\.ya?ml$", path) else None


def _row(kind: str, name: str, start: int, end: int, decl_kind: str | None = None, decl_path: str | None = None) -> dict:
    return {"kind": kind, "name": name, "decl_kind": decl_kind, "decl_path": decl_path, "start": start, "end": end}


def _python_blocks(text: str) -> Iterator[tuple[int, ast.AST]]:
    """Top-level blocks of Python that parse, with the line before each. A block that does not parse is tried without its first lines."""
    try:
        yield 0, ast.parse(text)
        return
    except (SyntaxError, ValueError, RecursionError):
        lines = text.split("\n")
    starts = [i for i, x in enumerate(lines) if x[:1] not in ("", " ", "\t", "#", ")", "]", "}")] + [len(lines)]
    pending: list[int] = []  # decorators belong to what follows
    for a, b in zip(starts, starts[1:], strict=False):
        pending.append(a)
        if lines[a].startswith("@"):
            continue
        at, pending = pending[0], []
        try:
            yield at, ast.parse("\n".join(lines[at:b]))
        except (SyntaxError, ValueError, RecursionError):
            head = next((i for i in range(at, b) if re.match(r"(class|(async )?def)\b", lines[i])), None)
            if head is not None:  # a declaration whose head is right stands, whatever is wrong inside
                try:
                    yield head, ast.parse(f"{lines[head].rstrip()} pass")
                except (SyntaxError, ValueError):
                    pass  # its head is what is wrong
                inner = "\n".join(lines[head + 1 : b])
                width = min((len(x) - len(x.lstrip()) for x in inner.split("\n") if x.strip()), default=0)
                if width:
                    for off, tree in _python_blocks("\n".join(x[width:] for x in inner.split("\n"))):
                        yield head + 1 + off, tree


def python_observations(text: str) -> list[dict]:
    """Imports and declarations of Python. Where the text does not parse as a whole, its top-level blocks are parsed one by one and only
    those that are wrong are left out (a head that is right still counts, and members stand by themselves)."""
    out: list[dict] = []

    def walk(node: ast.AST, path: list[str], at: int) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.Import):
                out.extend(_row("importStatement", a.name, x.lineno + at, x.end_lineno + at) for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                names = [x.module] if x.module and not x.level else ["." * x.level + (x.module or a.name) for a in x.names[: 1 if x.module else None]]
                out.extend(_row("importStatement", n, x.lineno + at, x.end_lineno + at) for n in names)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                here = [*path, x.name]
                out.append(_row("declaration", x.name, x.lineno + at, x.end_lineno + at, "type" if isinstance(x, ast.ClassDef) else "function", ".".join(here)))
                walk(x, here, at)
            else:
                walk(x, path, at)

    for at, tree in _python_blocks(text):
        walk(tree, [], at)
    return out


def _blanked(text: str, line_comment: str = "//") -> str:
    """Comments and string contents as spaces, so braces in them don't count."""
    pattern = re.compile(r'/\*.*?\*/|' + re.escape(line_comment) + r'[^\n]*|"(?:\\.|[^"\\\n])*"', re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_GOES_ON = re.compile(r"\s*(\{|where\b|->)")


def _braced(text: str, heads: re.Pattern, name_of, kind_of, nest: frozenset[str]) -> Iterator[dict]:
    """Declarations whose head matches; the extent runs to the matching brace, or to the line's end. Paths nest over kinds in `nest`."""
    clean = _blanked(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda i: bisect.bisect_left(breaks, i) + 1
    closing, unclosed = {}, []
    for m in re.finditer(r"[{}]", clean):
        if m[0] == "{":
            unclosed.append(m.start())
        elif unclosed:
            closing[unclosed.pop()] = m.end()
    spans = []
    for m in heads.finditer(clean):
        brace = re.compile(r"[{;\n]").search(clean, m.end())
        while brace and brace[0] == "\n" and _GOES_ON.match(clean, brace.end()):
            brace = re.compile(r"[{;\n]").search(clean, brace.end())
        end = m.end()
        if brace and brace[0] == "{":
            end = closing.get(brace.start(), len(clean))
        spans.append((m.start() + len(m[0]) - len(m[0].lstrip()), end, name_of(m, text), kind_of(m)))
    above: list[tuple] = []
    for a, b, name, kind in spans:  # heads come in order of their starts
        while above and above[-1][1] < b:
            above.pop()
        yield _row("declaration", name, line_of(a), line_of(max(a, b - 1)), kind, ".".join([s[2] for s in above if s[3] in nest] + [name]))
        above.append((a, b, name, kind))


def c_observations(text: str) -> list[dict]:
    out = [_row("importStatement", m[1], text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.start()) + 1) for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]', text, re.M)]
    heads = re.compile(r"^[ \t]*(?:typedef\s+)?(struct|enum)\s+(\w+)(?=\s*\{)|^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{}()]*\)(?=\s*\{)", re.M)
    return out + [r for r in _braced(text, heads, lambda m, _: m[2] or m[3], lambda m: {"struct": "type", "enum": "enumeration"}.get(m[1], "function"), frozenset()) if r["name"] not in ("if", "for", "while", "switch")]


_RUST = {"fn": "function", "struct": "type", "union": "type", "enum": "enumeration", "trait": "interface", "mod": "type", "type": "type", "const": "variable", "static": "variable", "macro_rules!": "function"}


def rust_observations(text: str) -> list[dict]:
    out = [_row("importStatement", re.sub(r"\s+", "", m[1]), text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end()) + 1) for m in re.finditer(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", text, re.M)]
    heads = re.compile(r"(?:^|(?<=[{;]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+|async\s+|const\s+(?=fn)|extern\s+\"[^\"]*\"\s+)*(fn|struct|union|enum|trait|mod|type|const|static|macro_rules!)\s+(?:mut\s+)?(\w+)", re.M)
    return out + list(_braced(text, heads, lambda m, _: m[2], lambda m: _RUST[m[1]], frozenset({"type", "interface"})))


_SWIFT = {"class": "type", "actor": "type", "struct": "type", "enum": "enumeration", "protocol": "interface", "func": "function", "var": "variable", "let": "variable", "extension": "extension"}


def swift_observations(text: str) -> list[dict]:
    """Imports and declarations of Swift; functions are named with their labels, members of extensions nest under the base name,
    variables inside functions are left out."""
    out = [_row("importStatement", m[1], text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"^[ \t]*(?:@\w+\s+)*import\s+(?:(?:struct|class|func|enum|protocol|var|let)\s+)?([\w.]+)", text, re.M)]
    heads = re.compile(r"(?:^|(?<=[{;]))[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|internal|fileprivate|open|final|static|class(?=\s+(?:func|var))|override|mutating|lazy|weak|indirect|nonisolated|async)(?:\(set\))?\s+)*(class|actor|struct|enum|protocol|func|var|let|extension)\s+([\w.]+)", re.M)

    def name(m: re.Match, source: str) -> str:
        if m[1] != "func":
            return m[2]
        args = re.match(r"(?:<[^>]*>)?\s*\(([^)]*)\)", source[m.end() :])
        labels = "".join(f"{a.split()[0].rstrip(':')}:" for a in (args[1] if args else "").split(",") if a.strip())
        return f"{m[2]}({labels})"

    rows = list(_braced(text, heads, name, lambda m: _SWIFT[m[1]], frozenset({"type", "interface", "enumeration", "extension"})))
    inside = [(r["start"], r["end"]) for r in rows if r["decl_kind"] == "function"]
    local = lambda r: r["decl_kind"] == "variable" and any(a <= r["start"] <= b for a, b in inside)
    return out + [r for r in rows if r["decl_kind"] != "extension" and not local(r)]


EXTRACTORS = {"python": python_observations, "c": c_observations, "rust": rust_observations, "swift": swift_observations}
OBSERVATIONS = "blob_hash string, path string, kind string, name string, decl_kind string, decl_path string, start int, end int"


def extract(blobs: DataFrame) -> DataFrame:
    """Observations of blobs (blob_hash, path, lang, text): the first extractor that claims the language takes each; none, no rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"blob_hash": b, "path": p, **o} for b, p, lang, text in zip(pdf["blob_hash"], pdf["path"], pdf["lang"], pdf["text"], strict=True) if lang in EXTRACTORS for o in EXTRACTORS[lang](text or "")]
            yield pd.DataFrame(rows, columns=["blob_hash", "path", "kind", "name", "decl_kind", "decl_path", "start", "end"])
    return blobs.select("blob_hash", "path", "lang", "text").mapInPandas(run, OBSERVATIONS)


BUILD = "path string, tool string, target string, dependency string, position int, verbatim string, pattern boolean, phony boolean, steps array<string>"


def build_observations(blobs: DataFrame) -> DataFrame:
    """Of build files (path, text): a row for each target (dependency null) and one for each of its dependencies, in order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                tool = build_kind(path)
                if tool == "make":
                    made = [(r["target"], r["prerequisites"], r["verbatim"], r["pattern"], r["phony"], r["recipe"]) for r in make_rules(text)]
                elif tool == "fastlane":
                    made = [(r["name"], r["calls"], None, False, r["private"], r["steps"]) for r in fastlane_lanes(text)]
                else:
                    made = [(c, [], None, False, False, []) for c in ci_commands(text)] if tool else []
                for target, needs, verbatim, pattern, phony, steps in made:
                    rows += [(path, tool, target, d, i, verbatim, pattern, phony, steps) for i, d in enumerate([None, *needs])]
            yield pd.DataFrame(rows, columns=["path", "tool", "target", "dependency", "position", "verbatim", "pattern", "phony", "steps"])
    return blobs.select("path", "text").mapInPandas(run, BUILD)


def chunk_plan(n_lines: int, decls: list[dict], prose: set[int], most: int = 120, least: int = 3, overlap: int = 15, header: int = 20, window: int = 60) -> list[dict]:
    """Chunks of a file: start, end, decl_key. decls: key, start, end; prose: comment and attribute lines.

    A declaration takes the prose above it; one that holds others gives a header up to the first of them; a leaf of at least `least`
    lines is a chunk, cut with overlap beyond `most`; lines that nothing claims go to windows.
    """
    spans = []
    for d in sorted(decls, key=lambda d: (d["start"], -d["end"])):
        start = d["start"]
        while start - 1 in prose:
            start -= 1
        spans.append((start, d["end"], d["key"]))
    out: list[tuple[int, int, str | None]] = []
    for a, b, key in spans:
        inner = [x for x, y, k in spans if k != key and a <= x and y <= b and (x, y) != (a, b)]
        if inner:
            out.append((a, min(min(inner) - 1, a + header - 1), key))
        elif b - a + 1 >= least:
            while b - a + 1 > most:
                out.append((a, a + most - 1, key))
                a += most - overlap
            out.append((a, b, key))
    out = [x for x in out if x[0] <= x[1]]
    claimed = {i for a, b, _ in out for i in range(a, b + 1)}
    free = [i for i in range(1, n_lines + 1) if i not in claimed]
    run: list[int] = []
    for i in [*free, None]:
        if run and (i is None or i != run[-1] + 1 or len(run) == window):
            out.append((run[0], run[-1], None))
            run = []
        if i is not None:
            run.append(i)
    return [{"ordinal": n, "start": a, "end": b, "decl_key": k} for n, (a, b, k) in enumerate(sorted(out, key=lambda x: x[0]))]


def table_rows(markdown: str) -> list[list[str]]:
    """Cells of the rows after the separators of pipe tables."""
    rows, body = [], False
    for line in (x.strip() for x in markdown.split("\n")):
        if line.startswith("|"):
            if re.fullmatch(r"[|\s:-]*-[|\s:-]*", line):
                body = True
            elif body:
                rows.append([c.strip() for c in line.strip("|").split("|")])
    return rows


def decisions(markdown: str) -> list[dict]:
    """Rows of a decision table with the body of the section that is headed by their id."""
    details = {m[1]: m[2].strip() for m in re.finditer(r"^## ([^\s—-]+)[^\n]*\n(.*?)(?=^## |\Z)", markdown, re.M | re.S)}
    out = []
    for line in markdown.split("\n"):
        c = [x.strip() for x in line.strip().strip("|").split("|")]
        if len(c) >= 5 and c[0] and c[0].lower() != "id" and not re.fullmatch(r"[:-]+", c[0]) and "example" not in c[2]:
            out.append({"id": c[0], "date": c[1], "summary": c[2], "status": c[3].lower() if c[3].lower() in ("active", "accepted", "refused", "superseded", "proposed") else "unknown", "evidence": c[4], "supersedes": c[5] if len(c) > 5 and c[5] not in ("—", "") else None, "detail": details.get(c[0])})
    return out


def frontmatter(text: str) -> dict[str, str]:
    m = re.match(r"\s*---\s*\n(.*?)^\s*---\s*$", text, re.S | re.M)
    return {k.strip(): v.strip() for k, c, v in (x.partition(":") for x in (m[1] if m else "").split("\n")) if c and k.strip()}


def wiki_links(text: str) -> list[tuple[str, str | None]]:
    return [(t.strip(), a.strip() or None) for t, _, a in (m[1].partition("|") for m in re.finditer(r"\[\[([^\]]+)\]\]", text))]


def slug(name: str) -> str:
    return re.sub(r"[_ ]", "-", re.sub(r"\.[a-z]+$", "", name.lower())).strip("-")


def git_log(text: str) -> list[dict]:
    """Records of a log split on U+001E with fields split on U+001F: sha, author, email, date, paths; short records are left out."""
    out = []
    for record in text.split("\x1e"):
        f = record.strip("\n").split("\x1f")
        if len(f) >= 4:
            tail = f[4] if len(f) > 4 else ""
            out.append({"sha": f[0], "author": f[1], "email": f[2], "date": f[3].split("\n")[0], "paths": [p for p in (tail or "\n".join(f[3].split("\n")[1:])).split("\n") if p]})
    return out


def remote_repository(url: str) -> str | None:
    m = re.search(r"github\.com[:/]([^/\s]+)/([^/\s]+?)(?:\.git)?/?$", url)
    return f"{m[1]}/{m[2]}" if m else None
