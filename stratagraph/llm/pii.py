"""PII: format-preserving Feistel pseudonyms.

Found and validated: payment cards (Luhn), IBANs (modulo 97), US social security numbers (issued ranges), IPv4 addresses, phone
numbers, calendar dates, e-mail addresses. Each value is a number in the domain of its format and goes through a keyed Feistel
permutation of that domain (cycle walking until the result is valid again): a card keeps its first digit and gets a right check digit, a date
stays a date, separators, country codes, the domain of an e-mail address and letter case stay. The permutation depends on key, kind and format
only, so equal values stay linked across documents, different values stay different, and restore() takes a text back. A date's permutation
depends on the day alone, so a day is linked across the styles in which dates are written. A phone number is a shape (7 to 15 digits after + and
a country code, after 00 and a country code with a separator, or ten digits grouped as in North America); numbering plans are not known, but area and exchange that begin with 2 to 9 still do.

A value may start wherever no letter or digit precedes it (+ and an opening parenthesis may follow a letter), but not within digits that . or - tie to a letter (as v1.2.3.4.5), and
ends where no letter or digit follows; a time may follow a date (2024-01-05T10:22). If the longest reading is not valid, shorter ones
are tried. A phone number does not reach into a value of another kind that ends beyond it. An IBAN has its country's length if it
is valid so, else the longest valid one; one that begins in small letters must have that length. Domains of addresses may have letters of any script.

Whole texts are read; documents are judged one by one in Arrow batches, nothing is shuffled or gathered.

Nulls: a null text stays null and has no findings. Other columns are untouched; input columns that clash with the added ones are
replaced. Repeated rows get equal results.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
KINDS = ("card", "iban", "ssn", "ipv4", "phone", "date", "email")
ADDED = "n_found long, kinds array<string>, pseudonymised string"

#: Where a value may start: no value is shorter than seven characters.
_START = re.compile(r"(?<![^\W_])(?=[+(]?\d[\d ().:/-]{5})|(?<!\d)(?=[+(]\d[\d ().:/-]{5})")
_TIED = re.compile(r"[^\W\d]\d+(?:[.-]\d+)+")
_END = re.compile(r"(?![^\W_])")
_DATE_END = re.compile(r"(?![^\W_])|[Tt](?=\d)")
_IBAN_START = re.compile(r"(?<![^\W_])(?=[A-Za-z]{2}\d{2} ?[A-Za-z0-9]{4})")
_IBAN = re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?")
#: Lengths of IBANs by country.
_IBAN_LENGTHS = {c: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}.items() for c in names.split()}
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[^\W_](?:(?:[^\W_]|-){0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?!\w)")
_PARTS: list[tuple[str, re.Pattern]] = [
    ("date", re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4})")),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}")),
    ("ipv4", re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")),
    ("card", re.compile(r"\d{4}(?:([ -])\d{4}\1\d{4}\1\d{1,7}|\d{9,15})|\d{4}([ -])\d{6}\2\d{5}")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?!\d{3}-\d\d-\d{4})00[1-9]\d{0,2}[ .-](?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}([.-])\d{3}\1\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4}")),
]


class Feistel:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network over enough bits, walked until it falls inside."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.keys = [hashlib.blake2b(f"{kind}|{size}|{i}".encode(), key=key[:64], digest_size=32).digest() for i in range(ROUNDS)]
        self.mask = (1 << self.half) - 1

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes((self.half + 7) // 8, "big"), key=self.keys[i], digest_size=(self.half + 7) // 8).digest(), "big") & self.mask

    def _once(self, x: int, back: bool) -> int:
        a, b = x >> self.half, x & self.mask
        if back:
            for i in reversed(range(ROUNDS)):
                a, b = b ^ self._f(i, a), a
        else:
            for i in range(ROUNDS):
                a, b = b, a ^ self._f(i, b)
        return a << self.half | b

    def permute(self, x: int, back: bool = False, valid: Callable[[int], bool] = lambda _: True) -> int:
        while True:
            x = self._once(x, back)
            if x < self.size and valid(x):
                return x


def luhn(digits: str) -> int:
    """The check digit that completes digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _day_class(ordinal: int) -> tuple[bool, int]:
    """Days of one class are written with as many digits, and read the same way round, in every style."""
    d = dt.date.fromordinal(ordinal)
    return d.month >= 10, 0 if d.day < 10 else 1 if d.day <= 12 else 2


@functools.cache
def _days() -> tuple[dict[tuple[bool, int], list[int]], dict[int, int]]:
    """The days of each class in order, and each day's place in its class."""
    classes: dict[tuple[bool, int], list[int]] = {}
    place = {}
    for o in range(FIRST_DAY, LAST_DAY + 1):
        days = classes.setdefault(_day_class(o), [])
        place[o] = len(days)
        days.append(o)
    return classes, place


def _date(m: re.Match) -> tuple[dt.date, bool, bool] | None:
    """The date, whether the year leads, and whether the day leads the month (as in 31/12; only where it must)."""
    if m[1]:
        y, a, b, year_first, day_first = int(m[1]), int(m[3]), int(m[4]), True, False
    else:
        y, a, b, year_first = int(m[8]), int(m[5]), int(m[7]), False
        day_first = m[6] == "." or a > 12
        if day_first:
            a, b = b, a
    try:
        day = dt.date(y, a, b)
    except ValueError:
        return None
    return (day, year_first, day_first) if FIRST_DAY <= day.toordinal() <= LAST_DAY else None


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


class Pseudonyms:
    """pseudonym() and restore() of texts under one key."""

    def __init__(self, key: str):
        self.key, self.nets = key.encode() or b"\0", {}

    def _net(self, kind: str, size: int) -> Feistel:
        if (kind, size) not in self.nets:
            self.nets[kind, size] = Feistel(self.key, kind, size)
        return self.nets[kind, size]

    def _number(self, kind: str, m: re.Match, back: bool) -> str | None:
        s = m[0]
        digits = re.sub(r"\D", "", s)
        if kind == "card":
            if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
                return None
            size = 10 ** (len(digits) - 2)
            body = digits[0] + str(self._net(kind, size).permute(int(digits[1:-1]), back, lambda x: x > 0 or digits[0] != "0")).zfill(len(digits) - 2)
            return _fill(s, body + str(luhn(body)))
        if kind == "ssn":
            return _fill(s, str(self._net(kind, 10**9).permute(int(digits), back, _ssn_ok)).zfill(9)) if _ssn_ok(int(digits)) else None
        if kind == "ipv4":
            octets = s.split(".")
            if any(int(o) > 255 or o != str(int(o)) for o in octets):
                return None
            x = self._net(kind, 1 << 32).permute(int.from_bytes(bytes(map(int, octets)), "big"), back)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "phone":
            if not 7 <= len(digits.removeprefix("00")) <= 15:
                return None
            code = re.match(r"(?:\+|00)\d{1,3}(?=\D)", s)
            lead = code.end() if code else 0
            local = re.sub(r"\D", "", s[lead:])
            planned = len(local) == 10 and (not lead or s[:lead] in ("+1", "001"))
            plan = lambda x: not planned or ((d := str(x).zfill(10))[0] > "1", d[3] > "1") == (local[0] > "1", local[3] > "1")
            return s[:lead] + _fill(s[lead:], str(self._net(kind, 10 ** len(local)).permute(int(local), back, plan)).zfill(len(local)))
        found = _date(m)
        if not found:
            return None
        day, year_first, day_first = found
        classes, place = _days()
        days = classes[_day_class(day.toordinal())]
        new = dt.date.fromordinal(days[self._net(f"date{_day_class(day.toordinal())}", len(days)).permute(place[day.toordinal()], back)])
        a, b = (new.day, new.month) if day_first else (new.month, new.day)
        a, b = (f"{v:0{len(w)}d}" for v, w in ((a, m[3] or m[5]), (b, m[4] or m[7])))
        return (m[2] or m[6]).join((f"{new.year:04d}", a, b) if year_first else (a, b, f"{new.year:04d}"))

    def _iban(self, s: str, back: bool) -> str | None:
        flat = s.replace(" ", "")
        def check(body: str, country: str) -> int:
            return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        if not 15 <= len(flat) <= 34 or check(flat[4:], flat[:2]) != int(flat[2:4]):
            return None
        body = self._mixed("iban", flat[4:], back)
        flat = f"{flat[:2]}{check(body, flat[:2]):02d}{body}"
        it = iter(flat)
        return "".join(c if c == " " else next(it) for c in s)

    def _mixed(self, kind: str, s: str, back: bool) -> str:
        """Letters become letters of the same case, digits digits; the rest stays."""
        sizes = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in s]
        x, size = 0, 1
        for c, n in zip(s, sizes, strict=True):
            x = x * n + (ord(c.lower()) - 97 if n == 26 else int(c) if n == 10 else 0)
            size *= n
        if size == 1:
            return s
        shape = "".join({26: "a", 10: "9"}.get(n, c) for c, n in zip(s, sizes, strict=True))
        x, out = self._net(f"{kind}|{shape}", size).permute(x, back), []
        for c, n in zip(reversed(s), reversed(sizes), strict=True):
            x, r = divmod(x, n)
            out.append(chr(97 + r).upper() if n == 26 and c.isupper() else chr(97 + r) if n == 26 else str(r) if n == 10 else c)
        return "".join(reversed(out))

    def apply(self, text: str, back: bool = False) -> tuple[str, list[str]]:
        """The text with pseudonyms (or, back, without) and the kinds found, in order."""
        found: list[tuple[int, int, str, str]] = []
        if "@" in text:
            for m in _EMAIL.finditer(text):
                name, at, domain = m[0].partition("@")
                found.append((m.start(), m.end(), "email", self._mixed("email", name, back) + at + domain))
        at = 0
        for m in _IBAN_START.finditer(text):
            if m.start() >= at and (best := self._iban_at(text, m.start(), back)) is not None:
                found.append(best)
                at = best[1]
        found += self._numbers(text, sorted(x[:2] for x in found), back)
        out, kinds, at = [], [], 0
        for a, b, kind, new in sorted(found):
            if a >= at:
                out += [text[at:a], new]
                kinds.append(kind)
                at = b
        return "".join([*out, text[at:]]), kinds

    def _iban_at(self, text: str, a: int, back: bool) -> tuple[int, int, str, str] | None:
        """The IBAN that starts at a: of its country's length if that is valid, else the longest."""
        best, end, length = None, len(text), _IBAN_LENGTHS.get(text[a : a + 2].upper())
        while m := _IBAN.match(text, a, end):
            end = m.end() - 1
            if _END.match(text, m.end()) and (new := self._iban(m[0], back)) is not None:
                right = len(m[0].replace(" ", "")) == length
                if right or best is None and text[a].isupper():  # small letters stand in words: then the length must be the country's
                    best = (a, m.end(), "iban", new)
                if right:
                    break
        return best

    def _numbers(self, text: str, taken: list[tuple[int, int]], back: bool) -> Iterator[tuple[int, int, str, str]]:
        """Values of digits and separators outside the taken spans, the leftmost first, longer kinds before shorter ones."""
        at, later, tied = 0, iter([*sorted(taken), (len(text), len(text))]), None
        a, b = next(later)
        for s in _START.finditer(text):
            i = s.start()
            while b <= i:
                a, b = next(later)
            if i < at or i >= a:
                continue
            if i and text[i - 1] in ".-":
                if tied is None:
                    tied = iter([*(m.span() for m in _TIED.finditer(text)), (len(text), len(text))])
                    c, d = next(tied)
                while d <= i:
                    c, d = next(tied)
                if c <= i:
                    continue
            best = None
            for kind, pattern in _PARTS:
                got = self._longest(kind, pattern, text, i, a, back)
                if got and (best is None or got[1] > best[1]):
                    best = got
            if best:
                yield best
                at = best[1]

    def _longest(self, kind: str, pattern: re.Pattern, text: str, a: int, end: int, back: bool) -> tuple[int, int, str, str] | None:
        """The longest valid value of a kind that starts at a and ends by `end`."""
        limit, after = end, _DATE_END if kind == "date" else _END
        while m := pattern.match(text, a, end):
            end = m.end() - 1
            if after.match(text, m.end()) and (new := self._number(kind, m, back)) is not None and not (kind == "phone" and self._crossed(text, a, m.end(), limit)):
                return a, m.end(), kind, new
        return None

    def _crossed(self, text: str, a: int, b: int, limit: int) -> bool:
        """Whether a value of another kind starts between a and b and ends beyond b."""
        for s in _START.finditer(text, a + 1, limit):
            if s.start() >= b:
                break
            for kind, pattern in _PARTS:
                if kind != "phone" and (got := self._longest(kind, pattern, text, s.start(), limit, False)) and got[1] > b:
                    return True
        return False

    def pseudonym(self, text: str) -> str:
        return self.apply(text)[0]

    def restore(self, text: str) -> str:
        return self.apply(text, back=True)[0]


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs' columns, then n_found, kinds (in order of place) and pseudonymised (the text)."""
    taken = {x.split()[0] for x in ADDED.split(", ")}
    kept = [f for f in docs.schema if f.name.lower() not in taken]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            done = [(None, []) if t is None else names.apply(t) for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array([len(k) for _, k in done], pa.int64()), pa.array([k for _, k in done], pa.list_(pa.string())), pa.array([t for t, _ in done], pa.string())], [*(f.name for f in kept), "n_found", "kinds", "pseudonymised"])

    return docs.mapInArrow(run, schema)
