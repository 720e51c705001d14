"""Jaccard join, decontamination and substring dedup against brute force, and the FM-index by itself."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.llm import decontaminate, fm_index, jaccard_join, substring, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@given(st.lists(st.integers(1, 5), max_size=80), st.lists(st.integers(1, 6), min_size=1, max_size=4))
@settings(deadline=None, max_examples=150)
def test_fm_index_finds_all(symbols, pattern):
    s = np.array(symbols, np.int64)
    index = fm_index.FMIndex(s, sample=4)
    lo, hi = index.search(np.array([pattern]), np.array([len(pattern)]))
    got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert got == [i for i in range(len(symbols) - len(pattern) + 1) if symbols[i : i + len(pattern)] == pattern]


@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=4, max_size=14), st.integers(0, 5)), min_size=1, max_size=9), st.integers(2, 4))
@settings(deadline=None, max_examples=300)
def test_matching_statistics_against_earlier_owners(texts, most):
    symbols = np.concatenate([np.array([*t, 0]) + 1 for t, _ in texts])
    owner = np.concatenate([np.full(len(t) + 1, o) for t, o in texts])
    matcher = fm_index.Matcher(fm_index.FMIndex(symbols), symbols, owner, most)
    begin = np.concatenate([[0], np.cumsum([len(t) for t, _ in texts])])
    got = matcher.lengths(np.concatenate([np.array(t) + 1 for t, _ in texts]), begin, np.array([o for _, o in texts])).tolist()
    holds = lambda t, part: any(t[i : i + len(part)] == part for i in range(len(t) - len(part) + 1))
    want = [max(n for n in range(min(most, len(t) - i) + 1) if n == 0 or any(p < o and holds(x, t[i : i + n]) for x, p in texts)) for t, o in texts for i in range(len(t))]
    assert got == want


@given(st.lists(st.integers(0, 99), min_size=1, max_size=300), st.data())
@settings(deadline=None, max_examples=100)
def test_least_of_ranges(values, data):
    lo = np.array([data.draw(st.integers(0, len(values) - 1)) for _ in range(5)])
    hi = np.array([data.draw(st.integers(a + 1, len(values))) for a in lo])
    assert fm_index._RangeLeast(np.array(values)).of(lo, hi).tolist() == [min(values[a:b]) for a, b in zip(lo, hi)]


@given(st.lists(st.text(alphabet="aB ß\té1,", max_size=30), min_size=1, max_size=6))
@settings(deadline=None, max_examples=150)
def test_words_as_by_pattern(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    for table, pattern in ((tokens.space_words(), WORD), (tokens.letter_words(), LETTERS)):
        w = tokens.Words(np.frombuffer(b"".join(data), np.uint8), offsets, table, lower=True)
        for i, t in enumerate(texts):
            mine = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
            assert mine == pattern.findall(t.translate(LOWER))
        names = {}
        for a, b, h in zip(w.start, w.end, w.hash):
            assert names.setdefault(bytes(w.data[a:b]), int(h)) == int(h)


def _set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _components(rows, k, t):
    t = Fraction(t)
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, _set(x, k)) for d, x in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            n = len(x & y)
            if n and n * t.denominator >= t.numerator * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {(d, len(s), root(d)) for d, s in sets}


@pytest.mark.parametrize("k,t", [(3, "0.9"), (5, "0.8")])
def test_jaccard_components(spark, awkward, empty, k, t):
    rows = [(r.doc_id, r.text) for r in awkward.collect() if r.doc_id is not None]
    got = jaccard_join.jaccard_components(awkward, k, t).collect()
    assert len(got) == awkward.count()
    assert {tuple(r) for r in got if r.doc_id is not None} == _components(rows, k, t)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard_join.jaccard_components(empty, k, t).count() == 0


def _cloud(n, seed):
    """Near copies of one text with a few changes each, and short texts around the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(90)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 30)}"
        rows.append((i, " ".join(w[: rng.choice([90, 90, 89, 85, 14, 12, 8, 2])])))
    return rows


def test_jaccard_in_blocks_loses_no_link(spark, monkeypatch):
    rows = _cloud(160, 3)
    want = _components(rows, 3, "0.9")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block, flush in ((1024, 1 << 20), (20, 300)):
        monkeypatch.setattr(jaccard_join, "FLUSH", flush)
        assert {tuple(r) for r in jaccard_join.jaccard_components(df, 3, "0.9", block=block).collect()} == want


def test_jaccard_cuts_a_chain_of_families(spark, monkeypatch):
    """Families that share a passage, but do not link, meet in no block: else their tokens travel to the square of their number."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for f in range(40):
        base = [*passage, *(f"f{f}_{i}" for i in range(50))]
        for c in range(3):
            w = list(base)
            for i in rng.sample(range(100), 3):
                w[i] = f"c{f}_{c}_{i}"
            rows.append((len(rows), " ".join(w)))
    large, links = [], jaccard_join._links

    def seen(tokens, *rest):
        large.append(tokens.where("blocks > 1").count())
        return links(tokens, *rest)

    monkeypatch.setattr(jaccard_join, "_links", seen)
    want = _components(rows, 1, "0.8")
    assert len({c for _, _, c in want}) == 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (10_000, 5):
        monkeypatch.setattr(jaccard_join, "HOT_TOKEN", hot, raising=False)
        assert {tuple(r) for r in jaccard_join.jaccard_components(df, 1, "0.8", block=20).collect()} == want
    assert large == [0, 0]


def _stars(families, slices, seed):
    """Per family: in slice 0 a hub, last, and many texts that hold some of its signatures each; in every other slice a near copy of the hub."""
    rng = random.Random(seed)
    parts = [[] for _ in range(slices)]
    for f in range(families):
        base = [f"b{f}_{i}" for i in range(60)]

        def changed(n, mark):
            w = list(base)
            for i in rng.sample(range(60), n):
                w[i] = f"{mark}_{f}_{i}"
            return " ".join(w)

        parts[0] += [changed(18, f"p{i}") for i in range(300)] + [" ".join(base)]
        for s in range(1, slices):
            parts[s] += [changed(6, f"c{s}"), parts[0][-1 - s]]  # and a copy of a text of slice 0
    return [(s, t) for s, p in enumerate(parts) for t in p]


@pytest.mark.parametrize("slices", [2, 8])
def test_jaccard_of_stars_over_slices_loses_no_link(spark, slices):
    rows = [(i, t, s) for i, (s, t) in enumerate(_stars(3, slices, slices))]
    df = spark.createDataFrame(rows, "doc_id long, text string, s int").repartitionByRange(slices, "s")
    want = _components([(i, t) for i, t, _ in rows], 1, "0.8")
    assert len(rows) - len({c for _, _, c in want}) >= 3 * (slices - 1)
    assert {tuple(r) for r in jaccard_join.jaccard_components(df, 1, "0.8").collect()} == want


def test_jaccard_of_borderline_partners_of_families(spark):
    """Many copies of p with one change each and y in one partition, x in another: x reaches y only."""
    rng = random.Random(8)
    rows, where = [], []
    for f in range(40):
        p = [f"f{f}w{i}" for i in range(100)]
        y = list(p)
        for i in rng.sample(range(100), 3):
            y[i] = f"y{f}_{i}"
        x = list(y)
        for i in rng.sample(range(100), 2 + f % 3):
            x[i] = f"x{f}_{i}"
        copies = [[*p[:i], f"c{f}_{i}", *p[i + 1 :]] for i in rng.sample(range(100), 14)]
        for part, w in [(0, p), (0, y), *((0, c) for c in copies), (1, x)]:
            rows.append((len(rows), " ".join(w)))
            where.append(part)
    df = spark.createDataFrame([(*r, w) for r, w in zip(rows, where)], "doc_id long, text string, s int").repartitionByRange(2, "s")
    assert {tuple(r) for r in jaccard_join.jaccard_components(df, 3, "0.9").collect()} == _components(rows, 3, "0.9")


def test_jaccard_of_shared_ids_and_of_many_classes(spark, monkeypatch):
    text = [" ".join(f"{a}{i}" for i in range(20)) for a in "abcd"]
    rows = [(1, text[0]), (2, text[1]), (2, text[0]), (3, text[1]), (4, text[2]), (5, text[2] + " more"), (6, text[3]), (7, None), (8, ""), (9, text[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, 18, 1), (2, 18, 1), (2, 18, 1), (3, 18, 1), (4, 18, 4), (5, 19, 4), (6, 18, 6), (7, 0, 7), (8, 0, 8), (9, 18, 4)])
    for most, hot in ((100_000, 100_000), (0, 100_000), (1, 1)):
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", most)
        monkeypatch.setattr(jaccard_join, "HOT_CLASS", hot)
        assert sorted(tuple(r) for r in jaccard_join.jaccard_components(df, 3, "0.9").collect()) == want


@given(st.integers(0, 10**6), st.sampled_from(["0.9", "0.8", "0.95"]), st.integers(1, 60))
@settings(deadline=None, max_examples=200)
def test_signatures_lose_no_pair(seed, t, n):
    rng = np.random.default_rng(seed)
    f = Fraction(t)
    base = rng.integers(1, 2**62, n).astype(np.uint64)
    x, y = base[rng.integers(0, 3) :], np.concatenate([base[: n - rng.integers(0, 3)], rng.integers(1, 2**62, rng.integers(0, 3)).astype(np.uint64)])
    both = len(np.intersect1d(x, y))
    if both and both * f.denominator >= f.numerator * len(np.union1d(x, y)):
        both = np.concatenate([np.sort(x), np.sort(y)]), np.array([0, len(x), len(x) + len(y)])
        s, owner, level, least = jaccard_join.signatures(*both, f.numerator, f.denominator)
        assert set(s[owner == 0].tolist()) & set(s[owner == 1].tolist())
        for me in (0, 1):  # neither is ruled out by its count of shared signatures
            other = set(s[owner != me].tolist())
            counts = {v: sum(x in other for x in s[(owner == me) & (level == v)].tolist()) for v in level[owner == me].tolist()}
            assert any(n >= least[(owner == me) & (level == v)][0] for v, n in counts.items())


@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 9)), max_size=40))
@settings(deadline=None, max_examples=200)
def test_ties_keep_owners_connected(pairs):
    key, owner = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    rows = list(zip(*(x.tolist() for x in jaccard_join.tied(key, owner, np.ones(len(key), np.int64))), strict=True))
    travelling = {r[0]: r[1] for r in rows if r[3] == 0}
    assert set(travelling) == set(key.tolist())
    for k in set(key.tolist()):
        owners = {o for q, o in pairs if q == k}
        assert travelling[k] == min(owners) and (len(owners) == 1 or owners <= {r[1] for r in rows if r[3] == min(owners)})
    assert sum(r[2] for r in rows) == len(set(pairs))  # every owner of a signature counts once


def _hits(text, items, width):
    w = LETTERS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, phrases in items:
        for p in phrases:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
    return len(w), sorted(hit), sorted(found)


def test_decontaminate(spark, awkward, empty, monkeypatch):
    source = next(r.text for r in awkward.collect() if r.doc_id == 15)
    bench = [(1, source[20:160]), (10, "ONE"), (2, None), (3, ""), (4, "..."), (5, source[20:100]), (1, source[20:160]), (6, "never seen words at all")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    items = []
    for i, t in bench:
        w = LETTERS.findall((t or "").translate(LOWER))
        items.append((str(i), {tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9))} if w else set()))
    for most in (500_000, 10):
        monkeypatch.setattr(decontaminate, "PIECE_PHRASES", most)
        for r in decontaminate.decontaminate(awkward, benchmark, shard_words=3000, cleaned=True).collect():
            n, hit, found = _hits(r.text, items, 10)
            assert (r.n_words, r.n_hit, r.items) == (n, len(hit), found)
            assert [x for s in r.spans for x in range(s.start, s.end)] == hit
            kept = [x for i, x in enumerate(LETTERS.findall((r.text or "").translate(LOWER))) if i not in set(hit)]
            assert LETTERS.findall((r.clean_text or "").translate(LOWER)) == kept
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert decontaminate.decontaminate(awkward, benchmark.limit(0)).where("n_hit > 0").count() == 0


def _cut(rows, width):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        out[d, t] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("hot,grams", [(200_000, 2_000_000), (1, 2_000_000), (200_000, 0), (2, 0), (None, 2_000_000)])
def test_substrings(spark, awkward, monkeypatch, hot, grams):
    monkeypatch.setattr(substring, "BROADCAST_GRAMS", grams)
    want = _cut([(r.doc_id, r.text) for r in awkward.collect() if r.doc_id is not None], 20)
    got = substring.dedup_substrings(awkward, width=20, gram=6, shard_words=500, hot=hot).collect()
    assert len(got) == awkward.count() and sum(r.n_removed for r in got) > 100
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.kept_text == " ".join(WORD.findall(r.text or ""))
        else:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id, r.text]


def test_substrings_of_nothing(spark, empty):
    assert substring.dedup_substrings(empty).count() == 0
