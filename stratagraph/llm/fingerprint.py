"""Document fingerprints: bottom-k sketches of shingle hashes. DataFrame operations only.

A fingerprint is the ascending array of the K least distinct 64-bit hashes of a text's shingles, SHINGLE
words each (a text of fewer words is one shingle, a text without words has none). Fingerprints of parts
merge into the fingerprint of the whole; two of them estimate resemblance, containment and the
number of distinct shingles.

Nulls: a null text counts as empty and has the empty fingerprint. Two empty fingerprints resemble each
other fully, an empty and another one not at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, small, text_or_empty, words, written

K = 128
SHINGLE = 5
BIN_BYTES = 4 << 20
#: Bins of the first cut; a bin that is still too large is cut again.
MOST_BINS = 4096
#: Cuts are broadcast for at most so many bins (about a kilobyte each); beyond, the join shuffles.
MOST_CUTS = 10_000
#: So many copies of one row are left together, however long it is.
FEW_COPIES = 16
_FAN = 64


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<long>: the fingerprint of text."""
    def of_words(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashed, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (shingle - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, shingle)])))
    hashes = let(words(text), lambda w: F.when(F.size(w) > 0, of_words(w)).otherwise(F.array().cast("array<bigint>")))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both parts together (shingles across the seam are not in it)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1."""
    return let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def encoded(a: Column) -> Column:
    """A fingerprint as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _bin(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at most doc_id, by two short steps; null ids come last."""
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(1)).otherwise(F.lit(0))
    chunks = [bounds[i : i + _FAN] for i in range(0, len(bounds), _FAN)]
    def arr(v: list[int]) -> Column:
        return F.array(*[F.lit(x).cast("bigint") for x in v])
    firsts, table = arr([c[0] for c in chunks]), F.array(*map(arr, chunks))
    def at_most(a: Column) -> Column:
        return F.size(F.filter(a, lambda b: b <= doc_id))
    found = let(at_most(firsts), lambda i: F.when(i == 0, F.lit(0)).otherwise((i - 1) * _FAN + at_most(F.get(table, i - 1))))
    return F.when(doc_id.isNull(), F.lit(len(bounds) + 1)).otherwise(found)


_LENGTHS = [1 << i for i in range(29, -1, -1)]


def _common(a: Column, b: Column) -> Column:
    """How many code points two texts begin with alike, by halving."""
    return F.aggregate(F.array(*map(F.lit, _LENGTHS)), F.lit(0), lambda n, p: F.when(F.left(a, n + p) == F.left(b, n + p), n + p).otherwise(n))


def _crowded(binned: DataFrame, depth: int, size: Column, bin_bytes: int) -> DataFrame:
    """Of the bins of a depth those of over twice bin_bytes (a row a bin): bin, one_id, and where a bin has one id or none, same (code points that its texts begin
    with alike) and salts (over 1: its rows are copies of one)."""
    mine = binned.where(F.size("bin") == depth)
    sizes = mine.groupBy("bin").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"), (F.min("doc_id").eqNullSafe(F.max("doc_id"))).alias("one_id"))
    sizes = written(sizes.where((F.col("bytes") > 2 * bin_bytes) & (F.col("rows") > 1)), "print-crowded")
    texts = mine.join(small(sizes.where("one_id").select("bin"), MOST_CUTS), "bin", "left_semi").groupBy("bin").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    texts = texts.select("bin", _common(F.col("low"), F.col("high")).alias("same"), (F.col("low") == F.col("high")).alias("copies"))
    salts = F.when(F.col("copies"), F.ceil(F.col("bytes") / bin_bytes)).otherwise(1)
    found = sizes.join(texts, "bin", "left").where(~F.coalesce("copies", F.lit(False)) | (F.col("rows") > FEW_COPIES))
    return written(found.select("bin", "one_id", F.coalesce("same", F.lit(0)).alias("same"), salts.alias("salts")), "print-same")


def _value() -> Column:
    """What a crowded bin is cut by: doc_id, or the seven bytes of text after what all its texts begin with, as a number: ordered as the texts are."""
    after = F.substring(F.substring(F.col("text"), F.col("same") + 1, F.lit(7)).cast("binary"), 1, 7)
    return F.when(F.col("one_id"), F.conv(F.rpad(F.hex(after), 14, "0"), 16, 10).cast("bigint")).otherwise(F.col("doc_id"))


def _cut(binned: DataFrame, crowded: DataFrame) -> DataFrame:
    """binned, with crowded bins cut into parts of about the same size. A value at which a bin is cut stands alone, so every cut gets on."""
    inner = binned.join(small(crowded, MOST_CUTS), "bin").where("salts = 1")
    cuts = inner.groupBy("bin").agg(F.percentile_approx(_value(), [i / _FAN for i in range(1, _FAN)], 10 * _FAN).alias("q"))
    bounds = F.array_distinct(F.flatten(F.transform("q", lambda v: F.array(v, v + 1))))
    parts = written(crowded.join(cuts, "bin", "left").select("bin", "one_id", "same", "salts", bounds.alias("bounds")), "print-parts")
    part = F.when(F.col("salts") > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.size("bin")), F.col("salts"))).otherwise(F.size(F.filter("bounds", lambda b: b <= _value())).cast("long"))
    joined = binned.join(small(parts, MOST_CUTS), "bin", "left")
    return joined.select("doc_id", "text", F.when(F.col("salts").isNull(), F.col("bin")).otherwise(F.array_append("bin", part)).alias("bin"))


def _before(heads: DataFrame) -> DataFrame:
    """bin, before: the bin before each, the last one before the first. By the first place of the bins, then across those: no task orders all bins."""
    own = Window.partitionBy("first").orderBy("bin")
    placed = heads.select("bin", F.col("bin")[0].alias("first")).withColumn("near", F.lag("bin").over(own))
    ends = placed.groupBy("first").agg(F.max("bin").alias("end"))  # MOST_BINS + 1 rows at most
    order = Window.orderBy("first")
    ends = ends.select("first", F.coalesce(F.lag("end").over(order), F.max("end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("far"))
    return placed.join(ends, "first").select("bin", F.coalesce("near", "far").alias("before"))


def with_next(docs: DataFrame, bin_bytes: int | None = None) -> DataFrame:
    """doc_id, text, and bin and guard (their order), each row once, and one `guard` row at the end of each bin: a copy of the row after it.

    Rows are ordered by doc_id (null last), then text; the last row is followed by the first. Bins are ranges of doc_id of about
    bin_bytes of text, cut at approximate quantiles, MOST_BINS at first. A bin of over twice that is cut again, as often as needed: by doc_id; if it has one
    doc_id or none, by what its texts have after their common beginning; copies of one row are dealt out, as their order makes no difference. So no task sorts
    the whole table, and no bin but one of a single row or of few copies of one stays crowded, whatever stands in how many rows.
    """
    bin_bytes = bin_bytes or BIN_BYTES
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    size = F.octet_length("text").cast("long") + 16
    total = base.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = min(MOST_BINS, max(1, math.ceil(total / bin_bytes)))
    cuts = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] if n > 1 else []
    cuts = sorted(cuts or [])
    bounds = sorted({*cuts, *(a + 1 for a, b in zip(cuts, cuts[1:], strict=False) if a == b and a < 2**63 - 1)})  # a frequent doc_id stands alone
    binned, depth = base.withColumn("bin", F.array(_bin(F.col("doc_id"), bounds).cast("long"))), 1
    while not (crowded := _crowded(binned, depth, size, bin_bytes)).isEmpty():
        binned, depth = _cut(binned, crowded), depth + 1
    least = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text"))
    heads = written(binned.groupBy("bin").agg(F.min(least).alias("head")), "print-heads")  # a row a bin
    guards = heads.join(_before(heads), "bin").select("head.doc_id", "head.text", F.col("before").alias("bin"), F.lit(1).alias("guard"))
    return binned.select("doc_id", "text", "bin", F.lit(0).alias("guard")).unionByName(guards).repartition(n if depth == 1 else n * 2, "bin")


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each document with its fingerprint: docs' columns and fingerprint array<long>."""
    return docs.withColumn("fingerprint", sketch(text_or_empty("text"), k, shingle))


def edited_fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited (text), sketch, edited_sketch, near_edited, near_next; see the op7 query."""
    order = Window.partitionBy("bin").orderBy("guard", F.col("doc_id").asc_nulls_last(), "text")
    rows = with_next(docs).withColumn("next", F.lead("text").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(coalesce(next, ''), cast(floor(length(text) / 2) as int))"))
    rows = rows.select("bin", "guard", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(half >= 0, edited).alias("edited"))
    rows = rows.select("*", sketch(F.col("text"), k, shingle).alias("sketch"), F.when(F.col("guard") == 0, sketch(F.col("edited"), k, shingle)).alias("edited_sketch"))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).where("guard = 0")
    return rows.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
