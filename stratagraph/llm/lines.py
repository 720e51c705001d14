"""Line dedup by content-defined chunks. DataFrame operations only.

A text is cut at newlines; each line has a 64-bit hash, and a rolling hash over WINDOW consecutive line hashes
ends a chunk where it is 0 modulo DIVISOR, or at MOST_LINES. Boundaries depend on nearby lines only, so an inserted line
moves none but those around it. A chunk of at least two lines whose bytes occur more than once in the corpus is kept
where it stands first (least doc_id, then text hash, then place) and removed elsewhere. Chunks that agree in hash are
compared byte by byte: only chunks with the same bytes are one.

Only (hash, place) rows are shuffled to find repeated chunks; for the comparison the bodies of repeated chunks are counted by their
bytes, pre-aggregated before the shuffle; documents are shuffled once, to cut the removed chunks out. Hot chunks meet
their first one in a join that AQE can split.

Nulls: a null text has no lines and stays null; rows with a null doc_id come last in the order of places. Rows equal in
doc_id and text share one result. Empty lines count as lines; a chunk of empty lines only is treated like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, let, small, unpacked, written

WINDOW = 2
DIVISOR = 4
MOST_LINES = 16
ADDED = ["n_lines", "n_removed", "kept_text"]


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR, most: int = MOST_LINES) -> Column:
    """array<struct<at:int, lines:int, body:string>>: the chunks of text in order; `at` is the first line (from 0)."""
    def cut(lines: Column) -> Column:
        n = F.size(lines)
        hashed = F.transform(lines, lambda x: F.xxhash64(x))
        def ends_of(h: Column) -> Column:
            def is_end(i: Column) -> Column:
                rolled = F.xxhash64(*[F.get(h, i - j) for j in range(window)])
                return (F.pmod(rolled, F.lit(divisor)) == 0) | (i == n - 1)
            return F.filter(F.sequence(F.lit(0), n - 1), is_end)
        def split_long(ends: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))
            spans = F.arrays_zip(starts.alias("a"), ends.alias("e"))
            return F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["a"], s["e"], F.lit(most)), lambda a: F.struct(a.alias("at"), F.least(F.lit(most), s["e"] - a + 1).alias("lines")))))
        spans = let(let(hashed, ends_of), split_long)
        return F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["lines"].alias("lines"), F.array_join(F.slice(lines, s["at"] + 1, s["lines"]), "\n").alias("body")))
    return let(F.split(text, "\n"), cut)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs' columns, then n_lines, n_removed (lines) and kept_text (the lines left, joined by newlines)."""
    base = bare(docs, ["doc_id", "text"]).withColumn("th", F.xxhash64("_text"))
    cut = base.where("_text is not null").select("_doc_id", "th", F.explode(chunks(F.col("_text"), **options)).alias("c")).where("c.lines > 1")
    cut = cut.select("_doc_id", "th", F.col("c.at").alias("at"), F.col("c.lines").alias("lines"), F.xxhash64("c.body").alias("h"), F.col("c.body").alias("body"))
    place = F.struct(F.col("_doc_id").isNull().alias("late"), F.col("_doc_id").alias("doc_id"), F.col("th").alias("th"), F.col("at").alias("at"))
    narrow = written(cut.drop("body"), "line-chunks")
    firsts = narrow.groupBy(F.col("h").alias("f_h")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("f_h", "first")
    firsts = written(firsts, "line-firsts")
    # the comparison of bytes: a repeated hash with one body stands for that body; the others are taken body by body
    bodies = cut.join(small(firsts.select("f_h")), F.col("h") == F.col("f_h"), "left_semi").groupBy("h", "body").agg(F.count(F.lit(1)).alias("n"))
    clashing = written(bodies.groupBy(F.col("h").alias("x_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x_h"), "line-clashes")
    gone = narrow.join(firsts, F.col("h") == F.col("f_h")).where(place != F.col("first")).select("_doc_id", "th", "at", "lines", "h")
    if not clashing.isEmpty():
        gone = gone.join(clashing, F.col("h") == F.col("x_h"), "left_anti")
        held = cut.join(clashing, F.col("h") == F.col("x_h"), "left_semi")
        kept = held.groupBy(F.col("h").alias("k_h"), F.col("body").alias("k_body")).agg(F.min(place).alias("first"))
        gone = gone.unionByName(held.join(kept, (F.col("h") == F.col("k_h")) & (F.col("body") == F.col("k_body"))).where(place != F.col("first")).select("_doc_id", "th", "at", "lines", "h"))
    gone = written(gone.groupBy(F.col("_doc_id").alias("g_id"), F.col("th").alias("g_th")).agg(F.collect_set(F.struct("at", "lines")).alias("gone")), "line-gone")
    final = base.join(gone.hint("merge"), F.col("_doc_id").eqNullSafe(F.col("g_id")) & F.col("th").eqNullSafe(F.col("g_th")), "left")
    def left_over(lines: Column) -> Column:
        dropped = F.flatten(F.transform(F.col("gone"), lambda g: F.sequence(g["at"], g["at"] + g["lines"] - 1)))
        marks = F.sequence(F.lit(0), F.size(lines) - 1)
        return let(F.array_except(marks, dropped), lambda keep: F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"))) + 1).cast("long")
    n_removed = F.coalesce(F.aggregate("gone", F.lit(0).cast("bigint"), lambda acc, g: acc + g["lines"]), F.lit(0).cast("bigint"))
    kept_text = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(let(F.split("_text", "\n"), left_over))
    return unpacked(final.select("rec", n_lines.alias("n_lines"), n_removed.alias("n_removed"), kept_text.alias("kept_text")), docs.columns, ADDED)
