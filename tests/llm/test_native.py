"""Fingerprints, sharding, mixing and line dedup against brute force, on awkward tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from stratagraph.llm import fingerprint, lines, mixing, shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _signed(u):
    return u - (1 << 64) if u >= 1 << 63 else u


def _hash(s, seed=42):
    return _signed(xxhash.xxh64(s.encode(), seed=seed).intdigest())


def _chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
    return _signed(h)


def _shingles(t):
    w = [_hash(x) for x in WORD.findall(t or "")]
    return {_chain(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)}


def test_sketch_is_bottom_k(spark, awkward):
    got = fingerprint.fingerprints(awkward.select("doc_id", "text")).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert r.fingerprint == sorted(_shingles(r.text))[: fingerprint.K]


def test_sketch_estimates_and_merges(spark):
    a, b = " ".join(f"w{i}" for i in range(2000)), " ".join(f"w{i}" for i in range(1000, 3000))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n"), fingerprint.merged(F.col("a"), F.col("b")).alias("m"), "a").first()
    assert abs(r.j - 1 / 3) < 0.15 and abs(r.c - 0.5) < 0.2 and abs(r.n - 1996) < 500
    assert r.m == sorted(_shingles(a) | _shingles(b))[: fingerprint.K]


def test_edited_follows_order(spark, awkward, empty, monkeypatch):
    rows = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in awkward.select("doc_id", "text").collect()), key=lambda x: (x[0], x[1] or 0, x[2]))
    want = Counter()
    for i, (_, d, t) in enumerate(rows):
        h = len(t) // 2
        edited = t[: len(t) - h] + rows[(i + 1) % len(rows)][2][:h]
        want[d, len(t), edited, _near(t, edited), _near(t, rows[(i + 1) % len(rows)][2])] += 1
    for size, most in ((1 << 12, 4096), (1 << 30, 4096), (1 << 9, 2)):
        monkeypatch.setattr(fingerprint, "BIN_BYTES", size)
        monkeypatch.setattr(fingerprint, "MOST_BINS", most)
        got = Counter((r.doc_id, r.n_chars, r.edited, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprint.edited_fingerprints(awkward).collect())
        assert got == want
    assert fingerprint.edited_fingerprints(empty).count() == 0


def test_hot_rows_leave_no_bin_crowded(spark, monkeypatch):
    rows = [(None, "same start " * 3 + f"{i % 97:03d} é{i}") for i in range(1500)] + [(None, "a copy of one row")] * 900 + [(5, "x" * 40)] * 500 + [(i, "t") for i in range(100)] + [(7, "seven77" + "z" * 60)] * 3 + [(7, "seven77")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = Counter((d, t[: len(t) - len(t) // 2] + ordered[(i + 1) % len(rows)][1][: len(t) // 2]) for i, (d, t) in enumerate(ordered))
    for most in (3,):
        monkeypatch.setattr(fingerprint, "MOST_BINS", most)
        monkeypatch.setattr(fingerprint, "BIN_BYTES", 4000)
        sizes = fingerprint.with_next(df).where("guard = 0").groupBy("bin").agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()
        assert max(r.n for r in sizes) <= 2 * 4000 and sum(r.n for r in sizes) == sum(len(t.encode()) + 16 for _, t in rows)
        assert Counter((r.doc_id, r.edited) for r in fingerprint.edited_fingerprints(df).collect()) == want


def _near(a, b):
    x, y = (set(sorted(_shingles(t))[: fingerprint.K]) for t in (a, b))
    union = set(sorted(x | y)[: fingerprint.K])
    return round(len(x & y & union) / len(union), 9) if union else 1.0


def test_frequent_and_missing_ids_are_cut_by_text(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{i * 37 % 101} text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    binned = fingerprint.with_next(df, 300)
    assert max(r["count"] for r in binned.groupBy("bin").count().collect()) < 60
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = {(d, t): t[: len(t) - len(t) // 2] + ordered[(i + 1) % 600][1][: len(t) // 2] for i, (d, t) in enumerate(ordered)}
    old = fingerprint.BIN_BYTES
    try:
        fingerprint.BIN_BYTES = 300
        got = fingerprint.edited_fingerprints(df).select("doc_id", "n_chars", "edited").collect()
    finally:
        fingerprint.BIN_BYTES = old
    assert sorted(r.edited for r in got) == sorted(want.values())


def test_bins_cut_small(spark, awkward):
    few, many = fingerprint.with_next(awkward, 1 << 30), fingerprint.with_next(awkward, 1 << 11)
    assert few.select("bin").distinct().count() <= 2 < many.select("bin").distinct().count()


def test_shards_hold_every_row_once(spark, awkward, empty):
    got = shards.shuffle_into_shards(awkward, shards=8, bucket_bytes=2000)
    assert [c for c in got.columns if c not in ("shard", "slot")] == [c for c in awkward.columns if c != "shard"]
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in awkward.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(len(by[s]) for s in range(8)) <= 1
    again = shards.shuffle_into_shards(awkward.repartition(5), shards=8, bucket_bytes=2000).collect()
    assert {(r.doc_id, r.text, r.shard, r.slot) for r in rows if r.doc_id} == {(r.doc_id, r.text, r.shard, r.slot) for r in again if r.doc_id}
    assert shards.shuffle_into_shards(empty).count() == 0


def test_copies_of_a_row_are_scattered_apart(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES", 7)
    n = F.when(F.col("id") < 400, -1).otherwise(F.col("id"))
    for extra in (F.lit("x"), F.create_map(F.lit("k"), n)):
        df = spark.range(0, 1200, 1, 5).select(F.when(n >= 0, n).alias("doc_id"), F.when(n >= 0, F.lit("some text")).alias("text"), extra.alias("extra"))
        placed = shards.shuffle_into_shards(df, shards=4, bucket_bytes=200)
        kept = Counter()
        for r in placed.collect():
            kept[r.doc_id, r.text, str(r.extra)] += 1
            kept["place", r.shard, r.slot] += 1
        assert {k: v for k, v in kept.items() if k[0] != "place"} == Counter((r.doc_id, r.text, str(r.extra)) for r in df.collect())
        assert all(kept["place", i % 4, i // 4] == 1 for i in range(1200))
        # the copies stand all over the order, not in one bucket's stretch
        stretch = Counter((r.slot * 4 + r.shard) // 100 for r in placed.where("doc_id is null").collect())
        assert len(stretch) == 12 and max(stretch.values()) < 70
        again = shards.shuffle_into_shards(df.repartition(3), shards=4, bucket_bytes=200)
        assert sorted(map(str, placed.collect())) == sorted(map(str, again.collect()))


def test_shards_take_map_columns(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    assert shards.shuffle_into_shards(df, shards=4, bucket_bytes=40).count() == 50


def _level(weights, caps, budget):
    """Water-filling by rounds, as it is told: clamp, share again, until none is above."""
    clamped = set()
    while True:
        free = [i for i in range(len(caps)) if i not in clamped]
        rest = budget - sum(caps[i] for i in clamped)
        share = rest / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if share * weights[i] >= caps[i]}
        if not over:
            return [caps[i] if i in clamped else share * weights[i] for i in range(len(caps))]
        clamped |= over


def test_mix_reaches_targets(spark, awkward, empty):
    rows = mixing.plan_mix(awkward).collect()
    assert len(rows) == awkward.count()
    size, taken, target, most = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and r.repetitions <= 2
        size[r.source] += r.size
        taken[r.source] += r.size * r.repetitions
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    want = _level([(5, 2, 1)[i % 3] for i in range(len(names))], [2 * size[s] for s in names], 1.5 * sum(size.values()))
    for s, w in zip(names, want, strict=True):
        assert math.isclose(target[s], w) and abs(taken[s] - w) <= most[s]
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns and mixed.count() == sum(r.repetitions for r in rows)


def test_mix_of_copies_meets_its_target(spark):
    rows = [(None, "a b c d", "s", i % 3) for i in range(300)] + [(1, "x y", "t", 0), (2, "x y z", "t", 0)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, number int").repartition(7)
    got = mixing.plan_mix(df, weights=(1, 3), share=0.9).collect()
    assert len(got) == len(rows)
    for s, most in (("s", 4), ("t", 3)):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.repetitions for r in mine) - mine[0].target) <= most / 2
        assert mine[0].target not in (0, mine[0].source_size)
    assert mixing.mix(df, weights=(1, 3), share=0.9).count() == sum(r.repetitions for r in got)


def test_mix_by_ranges_as_by_rows(spark, awkward, monkeypatch):
    want = Counter((r.doc_id, r.repetitions) for r in mixing.plan_mix(awkward).collect())
    for rows, group in ((3, 4096), (1, 2)):
        monkeypatch.setattr(mixing, "ROWS_PER_RANGE", rows)
        monkeypatch.setattr(mixing, "GROUP", group)
        assert want == Counter((r.doc_id, r.repetitions) for r in mixing.plan_mix(awkward).collect())


def _chunks(t):
    ls = t.split("\n")
    h, a = [_hash(x) for x in ls], 0
    for i in range(len(ls)):
        if _chain([h[i - j] for j in range(lines.WINDOW) if i >= j]) % lines.DIVISOR == 0 or i == len(ls) - 1:
            while a <= i:
                n = min(lines.MOST_LINES, i - a + 1)
                yield a, n, "\n".join(ls[a : a + n])
                a += n


def test_line_dedup_keeps_firsts(spark, awkward, empty):
    rows = {(r.doc_id is None, r.doc_id, _hash(r.text) if r.text is not None else 0, r.text) for r in awkward.collect()}
    seen, want = set(), {}
    for late, d, _, t in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2])):
        keep, gone = [], 0
        for a, n, body in _chunks(t) if t is not None else ():
            if n > 1 and body in seen:
                gone += n
            else:
                seen |= {body} if n > 1 else set()
                keep += t.split("\n")[a : a + n]
        want[d, t] = (0 if t is None else len(t.split("\n")), gone, None if t is None else "\n".join(keep))
    got = lines.dedup_lines(awkward).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert (r.n_lines, r.n_removed, r.kept_text) == want[r.doc_id, r.text]
    assert sum(r.n_removed for r in got) > 0
    assert lines.dedup_lines(empty).count() == 0


def test_queries_hash_what_operators_give(spark, awkward, tmp_path):
    from stratagraph.llm.queries import QUERIES

    awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in awkward.collect() if r.doc_id is not None}
    ids = sorted(rows)
    text = lambda d: rows[ids[ids.index(d) % len(ids)]]
    print_of = lambda t: "".join(f"{x & (1 << 64) - 1:016x}" for x in sorted(_shingles(t))[: fingerprint.K])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = QUERIES["op7_fingerprints"](spark, str(tmp_path)).collect()
    assert len(got) == len(ids)
    for r in got:
        t, following = text(r.doc_id), rows[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(edited), print_of(t), print_of(edited))
        assert (round(r.near_edited, 9), round(r.near_next, 9)) == (_near(t, edited), _near(t, following))
    for r in QUERIES["op8_shards"](spark, str(tmp_path)).collect():
        t = text(r.doc_id).encode()
        assert (r.law, r.grown_shard, r.size, r.text_crc32) == ("rows", None, len(t) + 1, zlib.crc32(t))
    kept = {r.doc_id: r.kept_text or "" for r in lines.dedup_lines(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect():
        assert r.kept_sha256 == sha(kept[r.doc_id])
