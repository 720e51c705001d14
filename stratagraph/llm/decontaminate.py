"""Benchmark decontamination by an FM-index per training shard.

The phrases are all windows of `width` consecutive words of each benchmark item; an item with fewer words, but
some, is one phrase. A shard is a run of documents of one partition with about SHARD_WORDS words: words that
occur in no phrase share one symbol, documents are kept apart by another, and an FM-index is built over the
symbols. Every distinct phrase is searched backward through the wavelet ranks; the rows found are located by
sampled suffix positions; occurrences of a document are merged into removal spans.

Phrases are cut and made distinct on the executors. At most about PIECE_PHRASES of them are broadcast at once; a benchmark of more is
searched in several passes over the documents, which carry the spans and items found so far, so memory has a bound whatever the
benchmark's size. Within a pass a shard has one index. Documents are not shuffled.

Nulls: a null text, of a document or an item, has no words. A null item_id is an item named "" . Repeated items
count once by their id. Without benchmark rows nothing is hit. Repeated documents are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import Words, letter_words, text_slices

WIDTH = 10
SHARD_WORDS = 1 << 19
PIECE_PHRASES = 500_000
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def _windows(width: int):
    """item, words (64-bit names, one after another) of every window of benchmark rows."""
    is_word = letter_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                w = Words(data, offsets, is_word, lower=True)
                n = np.diff(w.first)
                count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
                start = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                size = np.repeat(np.minimum(n, width), count)
                place = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                ends = np.concatenate([[0], np.cumsum(size)]) * 8
                names = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(w.hash[place]))])
                items = batch.column("item").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), count)))
                yield pa.RecordBatch.from_arrays([items, names.cast(pa.binary())], ["item", "words"])

    return run


def _phrases(rows: pa.Table, width: int) -> dict:
    """Vocabulary, distinct phrases as vocabulary numbers (from 1), and the items of each phrase."""
    words = rows.column("words").combine_chunks()
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]) // 8 if len(words) else np.empty(0, np.int64)
    flat = np.frombuffer(b"".join(words.to_pylist()), np.uint64)
    vocabulary, number = np.unique(flat, return_inverse=True)
    phrases = np.zeros((len(lengths), width), np.int32)
    phrases[np.arange(width)[None, :] < lengths[:, None]] = number.reshape(-1) + 1
    return {"vocabulary": vocabulary, "phrases": phrases, "lengths": lengths.astype(np.int64), "owners": rows.column("items").to_pylist()}


def _passes(benchmark: DataFrame, width: int, most: int) -> Iterator[dict]:
    """Phrases of at most about `most` windows at a time; once without any, where there is none."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("text"))
    distinct = written(rows.mapInArrow(_windows(width), "item string, words binary").groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")), "leak-phrases")
    n = max(1, -(-distinct.count() // most))
    for i in range(n):
        yield _phrases(distinct.where(F.pmod(F.xxhash64("words"), F.lit(n)) == i).toArrow(), width)


def _hits(symbols: np.ndarray, piece: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and phrases of all occurrences in a shard's symbols (vocabulary numbers + 1; 1 anything else, 2.. words)."""
    from .fm_index import FMIndex

    if not len(piece["phrases"]) or not len(symbols):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    index = FMIndex(symbols)
    index.suffixes = None
    shifted = np.where(piece["phrases"] > 0, piece["phrases"] + 2, 0)
    lo, hi = index.search(shifted, piece["lengths"])
    some = np.flatnonzero(hi > lo)
    counts = (hi - lo)[some]
    rows = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return index.locate(rows), np.repeat(some, counts)


def _judge(words: Words, n_docs: int, piece: dict, width: int) -> tuple[np.ndarray, list[set]]:
    """How many more hits begin than end at each word (and the end); items of each document."""
    hit = np.zeros(len(words) + 1, np.int64)
    items: list[set] = [set() for _ in range(n_docs)]
    vocabulary = piece["vocabulary"]
    if not len(vocabulary):
        return hit, items
    at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    symbol = np.where(vocabulary[at] == words.hash, at + 3, 2)  # 1 keeps documents apart, 2 is a word of no phrase
    place, phrase = _hits(np.insert(symbol, words.first[1:], 1), piece, width)
    if len(place):
        d = np.searchsorted(words.first[1:] + np.arange(n_docs), place, "right")
        start = place - d
        np.add.at(hit, start, 1)
        np.add.at(hit, start + piece["lengths"][phrase], -1)
        for x, p in np.unique(np.stack([words.doc_of()[start], phrase], 1), axis=0):
            items[x].update(piece["owners"][p])
    return hit, items


def _runs(flag: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags that stay within a text: text, first word, last word + 1."""
    edge = flag.copy()
    edge[1:] &= ~flag[:-1]
    cut = first[1:-1][first[1:-1] < len(flag)]
    edge[cut] = flag[cut]
    start = np.flatnonzero(edge)
    if not len(start):
        return start, start, start
    falls = flag & ~np.append(flag[1:], False)
    inner = cut[cut > 0] - 1
    falls[inner] = flag[inner]
    end = np.flatnonzero(falls) + 1
    return np.searchsorted(first, start, "right") - 1, start, end


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS, cleaned: bool = False) -> DataFrame:
    """docs' columns, then n_words, n_hit, items (ids as strings, sorted), spans (merged, in words of the document; end is exclusive) and,
    if `cleaned`, clean_text: the text without the bytes from the first to the last word of each span. Added columns replace those of the same name."""
    names = ["n_words", "n_hit", "items", "spans", *(["clean_text"] if cleaned else [])]
    kept = [c for c in docs.columns if c.lower() not in names]
    found = docs.select(*[docs[c] for c in kept], F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    for i, piece in enumerate(_passes(benchmark, width, PIECE_PHRASES)):
        found = _searched(found if not i else written(found, "leak-pass"), kept, piece, width, shard_words, cleaned)
    return found.select(*kept, *names)


def _searched(docs: DataFrame, kept: list[str], phrases: dict, width: int, shard_words: int, cleaned: bool) -> DataFrame:
    """One pass: docs have what earlier passes found in items and spans."""
    added = FOUND + (", clean_text string" if cleaned else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept) + ", " + added
    piece = docs.sparkSession.sparkContext.broadcast(phrases)
    is_word = letter_words()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text", shard_words * 6):
                words = Words(data, offsets, is_word, lower=True)
                n = b - a
                hit, items = _judge(words, n, piece.value, width)
                rows = batch.slice(a, n)
                spans = rows.column("spans")
                before = np.repeat(words.first[:-1], pc.list_value_length(spans).to_numpy())
                if len(before):
                    np.add.at(hit, before + spans.flatten().field("start").to_numpy(), 1)
                    np.add.at(hit, before + spans.flatten().field("end").to_numpy(), -1)
                    for x, old in zip(items, rows.column("items").to_pylist(), strict=True):
                        x.update(old)
                flag = np.cumsum(hit[:-1]) > 0
                sums = np.concatenate([[0], np.cumsum(flag)])
                d, s, e = _runs(flag, words.first)
                n_spans = np.bincount(d, minlength=n)
                spans = pa.StructArray.from_arrays([pa.array(s - words.first[d], pa.int32()), pa.array(e - words.first[d], pa.int32())], ["start", "end"])
                offs = np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)
                columns = [rows.column(c) for c in kept] + [
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(sums[words.first[1:]] - sums[words.first[:-1]], pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.ListArray.from_arrays(pa.array(offs), spans),
                ]
                names = [*kept, "n_words", "n_hit", "items", "spans"]
                if cleaned:
                    text = rows.column("text").to_pylist()
                    for i in np.unique(d):
                        raw, out, at = (text[i] or "").encode(), [], 0
                        for k in np.flatnonzero(d == i):
                            out.append(raw[at : words.start[s[k]] - offsets[i]])
                            at = words.end[e[k] - 1] - offsets[i]
                        text[i] = b"".join([*out, raw[at:]]).decode()
                    columns.append(pa.array(text, pa.string()))
                    names.append("clean_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(shards, schema)
