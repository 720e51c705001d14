"""Sharding by a two-pass external shuffle. DataFrame operations only.

Pass one scatters records uniformly into buckets of about BUCKET_BYTES by a seeded hash, as many
buckets as the input needs. Pass two holds one bucket at a time and permutes it with shuffle(), which
is Spark's seeded Fisher-Yates. The buckets' order, one after another, is the shuffled corpus;
record p of it goes to shard p mod `shards`, slot p div `shards`. So shards differ by one record at
most, slots have no gaps, and copies of a text spread as any other records do.

A bucket is sorted by hash before it is permuted, buckets of one task are visited in order, and the
number of tasks is fixed, so a task that runs again after a lost executor gives the same places.

A row is scattered by a hash of all its columns, so equal rows meet in one bucket. Where a bucket is CROWDED times
larger than it should be, its rows that occur more than REPEATED times are counted, and their copies are
numbered and scattered by number. Rows are equal here if two 64-bit hashes agree.

Nulls: a null text has no bytes and CRC 0 and counts as one byte; a null doc_id is a value like any
other. Repeated rows each get a slot of their own. An empty table gives an empty result. Input columns
that clash with `shard` or `slot` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bare, small, text_or_empty, unpacked, written

BUCKET_BYTES = 8 << 20
MOST_TASKS = 100_000
GROUP = 4096
CROWDED = 4
REPEATED = 64
COPIES = 10_000


def _maps(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_maps(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and _maps(kind.elementType)


def _offsets(counts: DataFrame) -> DataFrame:
    """bucket, n -> bucket, start: sums over groups of GROUP buckets first, so that no task sorts all buckets at great numbers."""
    counts = counts.withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = counts.groupBy("group").agg(F.sum("n").alias("all"))
    groups = groups.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("group").orderBy("bucket")) - F.col("n")
    return counts.withColumn("inner", inner).join(groups, "group").select("bucket", (F.col("base") + F.col("inner")).alias("start"))


def _sizes(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def _copies_apart(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """keyed, with the copies of repeated rows numbered in their keys. Copies are counted before they meet, and dealt out by COPIES."""
    name = ["key", "key2"]
    one = keyed.join(repeated, name, "left_semi").groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.first("rec").alias("rec"), F.first("bytes").alias("bytes"))
    dealt = one.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("key", "deal")
    last = F.least(F.col("n"), (F.col("deal") + 1) * COPIES) - 1
    copies = dealt.withColumn("copy", F.explode(F.sequence(F.col("deal") * COPIES, last)))
    copies = copies.select("rec", "bytes", F.xxhash64("key", "copy").alias("key"), F.xxhash64("key2", "copy").alias("key2"))
    return keyed.join(repeated, name, "left_anti").select(*copies.columns).unionByName(copies)


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 8, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs' columns, then shard (int) and slot (long)."""
    base = bare(docs, ["text"])
    n_bytes = F.octet_length(text_or_empty("_text")).cast("long") + 1
    total, rows = base.agg(F.coalesce(F.sum(n_bytes), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil(total / bucket_bytes))
    whole = F.to_json("rec") if _maps(docs.schema) else F.col("rec")
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key")), F.lit(buckets))
    keyed = base.select("rec", n_bytes.alias("bytes"), F.xxhash64(F.lit(seed), whole).alias("key"), F.xxhash64(F.lit(seed + 2), whole).alias("key2")).withColumn("bucket", bucket)
    sizes = written(_sizes(keyed), "shard-sizes")
    crowded = sizes.where((F.col("bytes") > CROWDED * bucket_bytes) | (F.col("n") > CROWDED * rows / buckets)).where(F.col("n") > REPEATED)
    if not crowded.isEmpty():
        found = keyed.join(small(crowded.select("bucket")), "bucket", "left_semi").groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n"))
        repeated = written(found.where(F.col("n") > REPEATED).select("key", "key2"), "shard-repeated")
        if not repeated.isEmpty():
            keyed = _copies_apart(keyed, small(repeated)).withColumn("bucket", bucket)
            sizes = written(_sizes(keyed), "shard-sizes")
    starts = written(_offsets(sizes.select("bucket", "n")), "shard-starts")
    item = F.struct("key", "rec")
    filled = keyed.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").agg(F.collect_list(item).alias("items"))
    if _maps(docs.schema):
        ordered = F.array_sort("items", lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    else:
        ordered = F.sort_array("items")
    permuted = filled.sortWithinPartitions("bucket").select("bucket", F.posexplode(F.shuffle(ordered, F.lit(seed))).alias("pos", "item"))
    place = F.col("start") + F.col("pos")
    placed = permuted.join(small(starts), "bucket").select(F.col("item.rec").alias("rec"), (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))
    return unpacked(placed, docs.columns, ["shard", "slot"])


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write shards as folders shard=N, rows in slot order within a file."""
    (sharded.repartitionByRange(max(1, files_per_shard) * 8, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
