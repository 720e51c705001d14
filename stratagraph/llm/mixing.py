"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Sources are ranked by code point (null last) and weigh `weights` in rotation. Together they get
`share` times all sizes; no source gets more than `cap` times its own size, and what that cuts off
is shared again by weight until nobody is above. A source's target then turns into repetitions: each
document is taken floor(target / source size) times, and the rest of the target is filled with one
more repetition of the first documents in a seeded hash order. The order is cut where the sum of
sizes comes nearest to the rest, so a source misses its target by half a document at most. Where the cut falls among copies (rows equal in doc_id and
text), they are numbered, and as many of them are taken as come nearest.

Only (source, hash, size) rows are shuffled, and never a whole source into one task: a source is split
into hash ranges of about ROWS_PER_RANGE rows. The cut is sought among groups of GROUP ranges, then among the ranges of
its group, and only its range is looked at row by row.
Documents themselves meet the finished table of one row per source.

Nulls: a null text has size 0; null sources form one source; a null doc_id takes part like any other.
Rows with the same doc_id and text are taken alike but for those at a source's cut. An empty table gives an empty result. Documents of
size 0 are repeated floor(target / source size) times and count nothing; in a source whose size is 0, none.
Input columns that clash with the added ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bare, small, text_or_empty, unpacked, written

ROWS_PER_RANGE = 2_000
GROUP = 4096
HASH_SPAN = 1 << 60
ADDED = ["size", "source_size", "target", "repetitions"]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def order_hash(seed: int) -> Column:
    """60 bits of a seeded hash of doc_id and text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_doc_id").cast("string"), F.lit("~")), text_or_empty("_text"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, rows, source_size -> also target. Windows here run over one row per source."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    limit = (F.col("source_size") * cap).cast("double")
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = sizes.withColumn("w", w).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("w"))
    level = level.withColumns({
        "budget": F.sum("source_size").over(every) * share,
        "clamped": F.coalesce(F.sum("limit").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open_w": F.sum("w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    level = level.withColumn("level", (F.col("budget") - F.col("clamped")) / F.col("open_w"))
    level = level.withColumn("free_level", F.first(F.when(F.col("limit") > F.col("level") * F.col("w"), F.col("level")), ignorenulls=True).over(every))
    return level.select("source", "rows", "source_size", F.least("limit", F.coalesce(F.col("free_level") * F.col("w"), F.col("limit"))).alias("target"))


def decisions(sized: DataFrame, weights, share, cap) -> DataFrame:
    """One row per source: source, source_size, target, whole, cut (documents whose hash is at most cut get one more)."""
    stats = written(targets(sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stats.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("width", F.floor(F.lit(HASH_SPAN) / F.ceil(F.col("rows") / ROWS_PER_RANGE)) + 1)
    ranged = sized.join(plan.where("rest > 0").select(F.col("source").alias("s"), "rest", "width"), F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.floor(F.col("h") / F.col("width")))
    by_range = ranged.groupBy("source", "range").agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"), F.first("width").alias("width"))
    by_range = written(by_range.withColumn("group", F.floor(F.col("range") / GROUP)), "mix-ranges")
    groups = by_range.groupBy("source", "group").agg(F.sum("sum").alias("sum"), F.first("rest").alias("rest"))
    ahead_of = F.sum("sum").over(Window.partitionBy("source").orderBy("group")) - F.col("sum")
    reached = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest"))
    group = groups.withColumn("before", ahead_of).where(reached).select(F.col("source").alias("gs"), F.col("group").alias("gg"), F.col("before").alias("base"))
    inside = by_range.join(group, F.col("source").eqNullSafe(F.col("gs")) & (F.col("group") == F.col("gg")))
    before = F.col("base") + F.sum("sum").over(Window.partitionBy("source").orderBy("range")) - F.col("sum")
    crossing = inside.withColumn("before", before).where(reached)
    crossing = written(crossing, "mix-crossing").select(F.col("source").alias("cs"), F.col("range").alias("cr"), "before")
    near = ranged.join(crossing, F.col("source").eqNullSafe(F.col("cs")) & (F.col("range") == F.col("cr")))
    unit = near.groupBy("source", "h").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("one"), F.first("before").alias("before"), F.first("rest").alias("rest"), F.first("width").alias("width"), F.first("range").alias("range"))
    ahead = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("h")) - F.col("size")
    unit = unit.withColumn("ahead", ahead)
    whole_unit = F.col("ahead") + F.col("size") <= F.col("rest")
    nearest = F.floor((F.col("rest") - F.col("ahead")) / F.col("one") + 0.5)
    some = F.when(F.col("n") == 1, (F.col("ahead") + F.col("size") / 2 <= F.col("rest")).cast("long")).otherwise(F.least(F.col("n"), nearest))
    some = F.when(whole_unit, F.col("n")).when(F.col("ahead") <= F.col("rest"), some).otherwise(0)
    unit = unit.withColumn("some", some)
    cut = F.coalesce(F.max(F.when(F.col("some") == F.col("n"), F.col("h"))), F.first(F.col("range") * F.col("width")) - 1)
    edge = F.max(F.when((F.col("some") > 0) & (F.col("some") < F.col("n")), F.struct("h", "some")))
    cut = unit.groupBy(F.col("source").alias("us")).agg(cut.alias("cut"), edge.alias("edge"))
    return plan.join(cut, F.col("source").eqNullSafe(F.col("us")), "left").select("source", "source_size", "target", F.col("whole").cast("int").alias("whole"), F.coalesce("cut", F.lit(-1)).alias("cut"), F.col("edge.h").alias("edge"), F.col("edge.some").alias("edge_rows"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with `number`, from 1 in each source: copies of one row, so any order will do. Rows are numbered within the partitions of a stored table, and
    the partitions' counts are summed; no source is in one task."""
    stored = written(rows.withColumns({"part": F.spark_partition_id(), "seat": F.monotonically_increasing_id()}), "mix-copies")
    counts = stored.groupBy(F.col("_source").alias("s"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("s").orderBy("p")) - F.col("n")).drop("n")
    local = stored.withColumn("local", F.row_number().over(Window.partitionBy("_source", "part").orderBy("seat")))
    return local.join(ahead, F.col("_source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("number", F.col("ahead") + F.col("local"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 20) -> DataFrame:
    """Each document once, with size (words), source_size, target and repetitions."""
    base = bare(docs, ["doc_id", "text", "source"])
    size = word_count(text_or_empty("_text"))
    sized = written(base.select(F.col("_source").alias("source"), size.alias("size"), order_hash(seed).alias("h")), "mix-sizes")
    plan = written(decisions(sized, weights, share, cap), "mix-decisions").withColumnRenamed("source", "d_source")
    decided = small(plan)
    joined = base.select("rec", "_source", size.alias("size"), order_hash(seed).alias("h")).join(decided, F.col("_source").eqNullSafe(F.col("d_source")), "left")
    all_or_none = joined.withColumn("repetitions", (F.col("whole") + (F.col("h") <= F.col("cut")).cast("int")).cast("int"))
    if plan.where("edge is not null").isEmpty():
        return unpacked(all_or_none, docs.columns, ADDED)
    on_edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    copies = _numbered(joined.where(on_edge)).withColumn("repetitions", (F.col("whole") + (F.col("number") <= F.col("edge_rows")).cast("int")).cast("int"))
    return unpacked(all_or_none.where(~on_edge).select("rec", *ADDED).unionByName(copies.select("rec", *ADDED)), docs.columns, ADDED)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: documents' columns, every document as often as its repetitions say."""
    planned = plan_mix(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"], docs["text"], docs["source"]), **options)
    copies = planned.where("repetitions > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("repetitions"))))
    return copies.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
