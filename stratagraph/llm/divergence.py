"""Source divergence audit: how far the sources of a language differ in their smoothed term frequencies, and by which terms each stands out.

Tasks that read the texts count terms by (lang, source) and hand on counts; a term's counts meet by (lang, term) and become a sparse vector:
the sources that have it, with their counts. Terms of a language with the same vector are one vector with a multiplicity, and every pair of sources is
evaluated once a distinct vector. Only what a vector holds is evaluated: with p(c) a source's share of a count c, the distance of sources a and b is

    V * |pa(0) - pb(0)|                                              as if no term occurred in either,
    + sum over vectors with a, of multiplicity * (|pa - pb(0)| - |pa(0) - pb(0)|), and the same for b,
    + sum over vectors with both, of multiplicity * (|pa - pb| - |pa - pb(0)| - |pb - pa(0)| + |pa(0) - pb(0)|).

The second line depends on a's count only, so it is evaluated once a distinct count of a source. Arithmetic is on integers; shares are divided as decimals of 38 digits.
Rankings by term go over the original terms; the rows beyond the last rank are dropped before the shuffle.

Null text, lang and source are read as ''. A language none of whose terms is frequent has distances of 0. Repeated rows count as often as they stand, each
as a document. Ties of a ranking go to the smaller item in UTF-8 order. Empty table: empty result. Only text, lang and source are read, so extra columns of
any name do no harm. A single text is handled in one piece.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import released

#: Entries of a task's counters before they are emptied into the shuffle.
HELD_TERMS = 150_000
SCALE = 1_000_000_000
_PIECE = 256
_SALTS = 16
COUNTED = "lang string, source string, term string, n long, docs long"


def _term_table() -> bytes:
    """a-z and all bytes of other than ASCII stay, A-Z become lower case, anything else a space."""
    t = bytearray(b" " * 256)
    for b in (*range(0x61, 0x7B), *range(0x80, 0x100)):
        t[b] = b
    for b in range(0x41, 0x5B):
        t[b] = b + 32
    return bytes(t)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of lang, source, text (binary) -> rows of COUNTED: a task's counts, in pieces."""
    table = _term_table()

    def flushed(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            size = len(n)
            columns = [pa.array([lang], pa.string()).take(pa.array([0] * size)), pa.array([source], pa.string()).take(pa.array([0] * size)), pa.array(list(n), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])

    counts: dict = defaultdict(lambda: (Counter(), Counter()))
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, _PIECE):
            part = batch.slice(at, _PIECE)
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms = text.translate(table).split()
                if terms:
                    n, docs = counts[lang, source]
                    before = len(n)
                    n.update(terms)
                    docs.update(set(terms))
                    held += len(n) - before
            if held >= HELD_TERMS:
                yield from flushed(counts)
                counts.clear()
                held = 0
    yield from flushed(counts)
    counts.clear()
    released()


def source_vectors(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """lang, term, vector (array of source, n; by source): the terms that stand in at least least_docs of their language's documents."""
    rows = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")], docs["text"].cast("binary").alias("text")).where("text is not null")
    counted = rows.mapInArrow(_counts, COUNTED).repartition("lang", "term")  # counts of a term meet once; each task sends one a source
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return vectors.where(F.col("docs") >= least_docs).select("lang", "term", "vector")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)); null where there are no terms."""
    exact = lambda c: c.cast("decimal(28,0)")
    above, below = exact(count + 5) * F.lit(SCALE).cast("decimal(10,0)"), exact(total + 5 * terms)
    return F.when(terms > 0, 1 + F.call_function("div", above, below)).cast("long")


def _groups(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, source, total, terms, p0 of every source of a language, also those without terms; p0 is the share of a count of 0."""
    found = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = vectors.select("lang", F.explode("vector").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    terms = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    whole = found.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms"])
    return whole.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))


def _source_pairs(groups: DataFrame) -> DataFrame:
    """lang, a, b, a0, b0, terms: every two sources of a language, both ways round: the rows of the result. Salted, so that a language is not one task."""
    left = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "terms", F.pmod(F.xxhash64("source"), F.lit(_SALTS)).alias("salt"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<long>")).alias("salt"))
    return left.join(right, ["lang", "salt"]).where("a <> b").drop("salt")


def divergence(docs: DataFrame, least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank; see the op13 query for what each part holds."""
    vectors = written(source_vectors(docs, least_docs), "audit-vectors")
    groups = written(_groups(docs, vectors), "audit-groups")
    pairs = _source_pairs(groups)
    distance = _distances(vectors, groups, pairs)
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = distance.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    top = _standing_out(vectors, groups).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)
    return ranked.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _distances(vectors: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value."""
    distinct = vectors.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("m"))
    distinct = written(distinct.withColumn("v", F.monotonically_increasing_id()), "audit-distinct")
    shares = groups.select("lang", "source", "total", "terms", "p0")
    entries = distinct.select("lang", "v", "m", F.explode("vector").alias("x")).select("lang", "v", "m", "x.source", "x.n").join(shares, ["lang", "source"])
    entries = entries.select("lang", "v", "m", "source", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    # one source of a pair, by its distinct shares
    ones = entries.groupBy("lang", F.col("source").alias("a"), "p").agg(F.sum("m").alias("m"))
    one = pairs.join(ones, ["lang", "a"]).select("lang", "a", "b", (F.col("m") * (gap("p", "b0") - gap("a0", "b0"))).alias("value"))
    one = one.unionByName(one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # both sources of a pair, by distinct vectors
    held = entries.groupBy("lang", "v", "m").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("e"))
    firsts = held.where(F.size("e") > 1).select("lang", "m", "e", F.posexplode("e").alias("i", "x"))
    both = firsts.select("lang", "m", "x", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("y"))
    both = both.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), (F.col("m") * (gap("x.p", "y.p") - gap("x.p", "y.p0") - gap("y.p", "x.p0") + gap("x.p0", "y.p0"))).alias("value"))
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    none = pairs.select("lang", "a", "b", F.coalesce(F.col("terms") * gap("a0", "b0"), F.lit(0)).alias("value"))
    total = none.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def _standing_out(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term of the source whose share is above the language's), value."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    entries = vectors.select("lang", "term", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("lang_n"), F.explode("vector").alias("x"))
    entries = entries.select("lang", "term", "lang_n", "x.source", "x.n").join(groups.join(whole, "lang").select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return entries.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
