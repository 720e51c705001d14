"""Spelling variant grouping: words of a corpus, the words one edit away from each, and the frequent form each goes back to.

Words are counted in the tasks that read the texts; (word, n) rows are shuffled. The join of words one edit apart is an even-partition
pigeonhole join. A word is cut into two segments whose lengths depend on its own length only. If one code point of it is replaced, or one is
inserted, then one segment stands unchanged in the other word: the first at its beginning, the second at its end, shifted by
one if that word is one longer. So every word is indexed by two segments and probes with its beginnings and ends for words of its own length and of one less.
Candidates that share a segment are verified to be one edit apart, and pairs that were found by both segments are
deduplicated.

A segment that many words share (over `crowd` candidate pairs) does not form a group: what is left of its words is cut in two again by the same
rule, as often as needed. Once one code point is left of a word, a group can't have more words than the alphabet has letters. No group of a
segment is gathered in a task; candidates are streamed through the join.

Null texts have no words; a null doc_id counts as an empty one in the hash. Repeated rows count as often as they stand. An empty
table, or one without frequent words, gives an empty result. Ties of forms go to the smallest in code-point order. Only doc_id and text are read, so extra
columns of any name do no harm. A single text is handled in one piece.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .tokens import released

#: One run in so many, by the crc32 of document and run, loses a letter: spelling variants to be found.
DIVISOR = 199
#: Entries of a task's counter before it is emptied into the shuffle.
HELD_WORDS = 300_000
#: Candidate pairs of a segment beyond which it is cut again.
CROWD = 1 << 16
_PIECE = 256


def _run_table() -> bytes:
    """Of Latin-1: a-z and 0xC0 to 0xFF stay, A-Z become lower case, anything else a space."""
    t = bytearray(b" " * 256)
    for b in (*range(0x61, 0x7B), *range(0xC0, 0x100)):
        t[b] = b
    for b in range(0x41, 0x5B):
        t[b] = b + 32
    return bytes(t)


def _counted(least_length: int, divisor: int):
    """Batches of doc_id (string), text (binary) -> (word, n): a task's counts, in pieces. Runs become Latin-1 bytes, a code point each."""
    table = _run_table()

    def flushed(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE):
                part = batch.slice(at, _PIECE)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    runs = Counter(text.decode("utf-8", "replace").encode("latin-1", "replace").translate(table).split())
                    salt = zlib.crc32(f"{doc or ''}:".encode())
                    for run, n in runs.items():
                        if len(run) < least_length:
                            continue  # a run that loses a letter is no longer than it was
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), salt)
                        if h % divisor == 0:
                            cut = h % len(run)
                            run = run[:cut] + run[cut + 1 :]
                            if len(run) < least_length:
                                continue
                        counts[run] += n
                if len(counts) >= HELD_WORDS:
                    yield flushed(counts)
                    counts = Counter()
        if counts:
            yield flushed(counts)
        counts.clear()
        released()

    return count


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, divisor: int = DIVISOR) -> DataFrame:
    """word, n: the words of at least least_length code points that occur at least least_count times."""
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"), docs["text"].cast("binary").alias("text")).where("text is not null")
    counts = rows.mapInArrow(_counted(least_length, divisor), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# In the tables of the join: side i (indexed) or p (probes), word, n, key (the indexed word's length and what agrees so far), rest (what is left of the
# word), m (code points that are left of the indexed word; a probe has as many or one more; the key decides it).


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: by the first segment of what is left, and by the second one, which a longer probe has one place later."""
    half = F.floor(F.col("m") / 2).cast("int")
    tail = F.col("m") - half
    over = F.length("rest") - tail
    first = F.struct(F.concat_ws("<", "key", F.expr("left(rest, cast(floor(m / 2) as int))")).alias("key"), F.substring("rest", half + 1, F.length("rest")).alias("rest"), tail.alias("m"))
    second = F.struct(F.concat_ws(">", "key", F.substring("rest", over + 1, tail)).alias("key"), F.substring("rest", F.lit(1), over).alias("rest"), half.alias("m"))
    return rows.select("side", "word", "n", F.explode(F.array(first, second)).alias("x")).select("side", "word", "n", "x.key", "x.rest", "x.m")


def _joined(rows: DataFrame) -> DataFrame:
    """a, an, b, bn: pairs one edit apart of rows that agree in key."""
    i = rows.where("side = 'i'").select("key", F.col("word").alias("a"), F.col("n").alias("an"), F.col("rest").alias("ar"))
    p = rows.where("side = 'p'").select("key", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("rest").alias("br"))
    same_length = F.length("ar") == F.length("br")
    near = (~same_length | (F.col("a") < F.col("b"))) & (F.levenshtein("ar", "br", 1) == 1)
    return i.join(p, "key").where(near).select("a", "an", "b", "bn")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, an, b, bn: each pair of different words (word, n; each once) that differ by exactly one inserted, deleted or replaced code point, once."""
    length = F.length("word")
    indexed = words.select(F.lit("i").alias("side"), "word", "n", F.concat(length, F.lit("")).alias("key"), F.col("word").alias("rest"), length.alias("m"))
    probes = words.select(F.lit("p").alias("side"), "word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    probes = probes.select("side", "word", "n", F.concat("m", F.lit("")).alias("key"), F.col("word").alias("rest"), "m")
    rows = written(_halves(indexed.unionByName(probes)), "variant-segments")
    found = None
    while True:
        sizes = rows.groupBy("key").agg(F.max("m").alias("m"), F.count_if(F.col("side") == "i").alias("i"), F.count_if(F.col("side") == "p").alias("p"))
        crowded = written(sizes.where((F.col("i") * F.col("p") > crowd) & (F.col("m") > 1)).select("key"), "variant-crowded")
        last = crowded.isEmpty()
        calm = rows if last else rows.join(crowded, "key", "left_anti")
        pairs = written(_joined(calm), "variant-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        rows, before = written(_halves(rows.join(crowded, "key", "left_semi")), "variant-segments"), rows
        dropped(before, crowded)
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: pointers are doubled until none leads on. A form occurs more often than its word, so there are no cycles."""
    state = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        after = written(state.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "variant-roots")
        dropped(state)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        state = after


def group_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, divisor: int = DIVISOR, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus.

    form is the word one edit away that occurs most often, if that is at least `ratio` times as often as the word itself; root is where forms of forms
    end, the word itself if it has none.
    """
    words = written(word_counts(docs, least_length, least_count, divisor), "variant-words")
    pairs = near_pairs(words, crowd)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form")).alias("near")), F.struct(F.col("b").alias("word"), F.struct((-F.col("an")).alias("less"), F.col("a").alias("form")).alias("near"))))
    near = pairs.select(ends.alias("x")).groupBy("x.word").agg(F.count(F.lit(1)).alias("n_near"), F.min("x.near").alias("near"))
    is_form = -F.col("near.less") >= F.col("n") * ratio
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near.form")).alias("form"), F.when(is_form, -F.col("near.less")).alias("form_n"))
    formed = written(formed, "variant-forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
