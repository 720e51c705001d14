"""Chat formatting: conversations through a template that is a black box, with the place of each turn and the loss mask.

A template is a function from messages (role, text) to a string; nothing else about it is asked. A conversation's successive turn prefixes
are rendered, and consecutive outputs compared: what the longer one has beyond the shorter one is the new turn's span. Where the shorter one is not
the beginning of the longer one, the template has rewritten history: the span then begins where the two part. The place of a turn's text within its
span is found by rendering the prefix with two other texts of one character in that turn's stead: they first differ where the text begins.

The result is one row a turn, so a conversation of any length is streamed. Every prefix is rendered whole, as a template may look back to the first turn: work is in
proportion to the square of a conversation's turns. A caller that knows how many turns a template looks back may say so (held); a prefix then is rendered whole up to
2 * held turns, and beyond from a turn that moves on by `held`. A conversation's rows are read by one task, in order (a digest over it can't be taken otherwise), which
holds the conversation and its rendering.

Turns are ordered by `turn` (null last), then role, then text; rows that are equal in all are turns of their own. A null role or text is an empty
one. A row without conv_id belongs to no conversation and is formatted as one of its own. Empty table: empty result. Only conv_id, turn, role and
text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
_ROWS = 2_000
TURNS = "conv_id long, position long, role string, start long, piece string, text_start long, text_end long, rewrites boolean"


@dataclass(frozen=True)
class Template:
    """render: messages -> text, the black box. read: formatted text -> messages, its inverse. unescape: a text as it stands in the output -> the text."""

    render: Callable[[Sequence[Message]], str]
    read: Callable[[str], list[Message]]
    unescape: Callable[[str], str]


#: Fixed marks of the bracket template: what opens and closes a turn of a role. Other roles stand between <role:NAME> and </role>.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: A mark, or one that was escaped: its first character, backslashes, and the rest of it.
MARK = r"([<\[])(\\*)(/?INST\]|/?s>|</?SYS>>|role:|/role>)"
_MARK, _ESCAPED = re.compile(MARK), re.compile(MARK.replace(r"(\\*)", r"\\(\\*)"))
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<role:(?P<name>[^>]*)>(?P<other>.*?)</role>", re.S)


def escape(text: str) -> str:
    """text with a backslash put after the first character of each mark, and one more where that had been done already: no mark is left, and none is lost."""
    return _MARK.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _bracket(messages: Sequence[Message]) -> str:
    out = []
    for role, text in messages:
        opens, closes = MARKS.get(role) or (f"<role:{role.replace('%', '%25').replace('>', '%3E')}>", "</role>")
        out += (opens, escape(text), closes)
    return "".join(out)


def _read_bracket(formatted: str) -> list[Message]:
    found = []
    for m in _TURN.finditer(formatted):
        role = m.lastgroup if m.lastgroup in MARKS else m["name"].replace("%3E", ">").replace("%25", "%")
        found.append((role, unescape(m[m.lastgroup])))
    return found


#: Marks every turn, escapes marks inside texts, and never looks back.
BRACKET = Template(_bracket, _read_bracket, unescape)


def _parting(a: str, b: str) -> int:
    """The first place at which the two differ: their common beginning's length, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Renderer:
    """A conversation's turns one by one: add() gives start, piece, text_start, text_end, rewrites of the next turn.

    The formatted conversation is what was there before, cut at start, and then piece. text_start and text_end are places in the formatted
    conversation; null if the template leaves the turn's text out.
    """

    def __init__(self, template: Template, held: int | None):
        self.template, self.held = template, held
        self.turns: list[Message] = []
        self.before = ""
        self.base = 0  # where in the formatted conversation the rendering of the held turns begins
        self.first = True

    def add(self, role: str, text: str) -> tuple[int, str, int | None, int | None, bool]:
        render = self.template.render
        if self.held is not None and len(self.turns) == 2 * self.held:  # a prefix of later turns only: its rendering ends where the longer one ended
            self.turns = self.turns[self.held :]
            shorter = render(self.turns)
            self.base += len(self.before) - len(shorter)
            self.before = shorter
        after = render([*self.turns, (role, text)])
        x, y = render([*self.turns, (role, "x")]), render([*self.turns, (role, "y")])
        at = _parting(x, y) if x != y else None
        rewrites = not after.startswith(self.before)
        start = _parting(self.before, after) if rewrites else len(self.before)
        begins = 0 if self.first else start  # what a template puts before any turn belongs to the first
        ends = None if at is None else len(after) - (len(x) - at - 1)
        out = (self.base + begins, after[begins:], None if at is None else self.base + at, None if ends is None else self.base + ends, rewrites)
        self.turns.append((role, text))
        self.before, self.first = after, False
        return out


def _rendered(template: Template, held: int | None, alone: bool):
    """Batches of conv_id, role, text in order -> rows of TURNS. alone: each row is a conversation."""
    names = [c.split()[0] for c in TURNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, renderer, position, out = None, None, 0, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if renderer is None or alone or conv != current:
                    current, renderer, position = conv, Renderer(template, held), 0
                out.append((conv, position, role, *renderer.add(role, text)))
                position += 1
                if len(out) >= _ROWS:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return render


def format_turns(conversations: DataFrame, template: Template = BRACKET, held: int | None = None) -> DataFrame:
    """conv_id, position (from 0), role, start, piece, text_start, text_end, rewrites: the formatted conversations, a row a turn.

    A conversation's formatted text is what stood there before a turn, cut at `start`, and then `piece`; without rewriting, simply all pieces in
    order. held: how far the template is known to look back, in turns; None: every prefix is rendered whole. [text_start, text_end) are the places of the turn's (escaped) text in it as it was when the turn was added, in code points.
    """
    empty = F.lit("")
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), F.coalesce(conversations["role"].cast("string"), empty).alias("role"), F.coalesce(conversations["text"], empty).alias("text"))
    ordered = rows.where("conv_id is not null").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    given = ["conv_id", "role", "text"]
    alone = rows.where("conv_id is null").select(*given).mapInArrow(_rendered(template, held, True), TURNS)
    return ordered.select(*given).mapInArrow(_rendered(template, held, False), TURNS).unionByName(alone)


def loss_spans(turns: DataFrame, roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """conv_id, position, loss_start, loss_end of the turns of format_turns() that a model is trained on: the places of their texts."""
    return turns.where(F.col("role").isin(*roles) & F.col("text_start").isNotNull()).select("conv_id", "position", F.col("text_start").alias("loss_start"), F.col("text_end").alias("loss_end"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


class _Reader:
    """Digests of one conversation, read from its formatted pieces."""

    def __init__(self, template: Template, trained: frozenset[str]):
        self.template, self.trained = template, trained
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.formatted = 0
        self.rewrites = False

    def add(self, role: str, start: int, piece: str, text_start: int | None, text_end: int | None, rewrites: bool) -> None:
        self.rewrites |= rewrites
        for r, t in self.template.read(piece):
            self.turns.update(f"{r}\n{t}\n".encode())
            self.n += 1
        if role in self.trained and text_start is not None:
            text = self.template.unescape(piece[text_start - start : text_end - start])
            self.loss.update(text.encode())
            self.chars += len(text)
        self.formatted = start + len(piece)

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted, self.rewrites


def read_back(turns: DataFrame, template: Template = BRACKET, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """What the output of format_turns() says, a row a conversation: n_turns, a digest of roles and texts, length and digest of all text under the loss
    mask, length of the formatted text, and whether the template rewrote history (the digests then are of what each turn added)."""
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    of, roles = ["role", "start", "piece", "text_start", "text_end", "rewrites"], frozenset(trained)

    def reader(alone: bool):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, state, out = None, None, []
            for batch in batches:
                for conv, *turn in zip(batch.column("conv_id").to_pylist(), *(batch.column(c).to_pylist() for c in of), strict=True):
                    if state is None or alone or conv != current:
                        if state is not None:
                            out.append(state.row(current))
                        current, state = conv, _Reader(template, roles)
                    state.add(*turn)
                    if len(out) >= _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
            if state is not None:
                out.append(state.row(current))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        return read

    ordered = turns.where("conv_id is not null").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(reader(False), READ).unionByName(turns.where("conv_id is null").mapInArrow(reader(True), READ))
