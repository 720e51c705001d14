"""Substring dedup: compressed FM-indexes per shard, matching statistics by backward steps through wavelet ranks.

A window is `width` consecutive words of a document; a word covered by a window whose words also start in a document with a
smaller doc_id is removed. Windows are judged on the input.

1. Each window picks its least-hashed GRAM-word gram (a minimizer), so equal windows pick equal grams. Grams are counted with
   their least and greatest document; only passages (the words of consecutive windows that pick one gram occurrence) whose
   gram stands in several documents can hold repeats.
2. Passages are dealt to shards by gram, equal ones merged with their least document. A shard's passages become one FM-index:
   wavelet matrix of the Burrows-Wheeler transform, and how many symbols neighbouring suffixes share. A passage that another one of
   its gram may be earlier than is streamed backward through the index; its matching statistics say for every word how many words from
   there stand in a passage of an earlier document, and windows for which that is `width` are reported as intervals.
3. A gram with more occurrences than a shard has room for (HOT) would overfill it: its windows are compared by two 64-bit hashes instead,
   with the least document of each aggregated before the shuffle. The result is the same.

Words travel as 32-bit names within a shard; two windows count as equal if all `width` names are.

Nulls: a null text has no words. A row without doc_id keeps its words and is no source for others. Rows that share
doc_id and text share one result; rows that share only doc_id are judged each for itself and don't count for one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .fm_index import FMIndex, Matcher
from .tokens import U, Words, mixed, space_words, text_slices, window_hash

WIDTH = 50
GRAM = 12
SHARD_WORDS = 1 << 20
#: A passage has so many words at most by what a gram may stand for; a gram with more occurrences than fit a shard is hot.
PASSAGE_WORDS = 70
#: A very common window meets its least document in so many tasks.
SALTS = 16
BROADCAST_GRAMS = 2_000_000
PASSAGE = "gram long, words binary, owners binary, window long, window2 long, doc_id long, th int, at int"
_OWNER = np.dtype([("doc_id", "<i8"), ("th", "<i4"), ("at", "<i4")])


def _picks(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text that pick the same gram occurrence: gram hash, first window, last window (word places)."""
    g = window_hash(w.hash, gram)
    n = len(w) - width + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    span = width - gram + 1
    best, reach = np.arange(len(g)), 1
    while reach * 2 <= span:
        a, b = best[: len(best) - reach], best[reach:]
        best = np.where(g[a] <= g[b], a, b)
        reach *= 2
    a, b = best[: len(g) - span + 1], best[span - reach : span - reach + len(g) - span + 1]
    pick = np.where(g[a] <= g[b], a, b)
    doc = w.doc_of()
    inside = np.flatnonzero(doc[:n] == doc[width - 1 : width - 1 + n])
    if not len(inside):
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    p = pick[inside]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (inside[1:] != inside[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    return g[p[first]], inside[first], inside[last]


def _grams(width: int, gram: int):
    is_word = space_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                w = Words(data, offsets, is_word, lower=False)
                g, s, _ = _picks(w, width, gram)
                ids = batch.column("doc_id").slice(a, b - a).to_numpy()[w.doc_of()[s]] if len(s) else np.empty(0, np.int64)
                order = np.lexsort((ids, g))
                g, ids = g[order], ids[order]
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
                last = np.append(first[1:], len(g)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), pa.array(ids[first], pa.int64()), pa.array(ids[last], pa.int64()), pa.array(last - first + 1, pa.int64())], ["gram", "least", "most", "n"])

    return run


def _passages(width: int, gram: int, known):
    """known: broadcast (grams, hot flags); or None where each row brings its own in `grams` and `hots`."""
    is_word = space_words()
    names_of = [x.split()[0] for x in PASSAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                w = Words(data, offsets, is_word, lower=False)
                g, s, e = _picks(w, width, gram)
                if known is not None:
                    grams, hots = known.value
                else:
                    grams = batch.column("grams").slice(a, b - a).combine_chunks() if hasattr(batch.column("grams"), "combine_chunks") else batch.column("grams").slice(a, b - a)
                    flat = grams.flatten().to_numpy().view(U)
                    hots = batch.column("hots").slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                    grams, at = np.unique(flat, return_index=True)
                    hots = hots[at]
                if not len(grams) or not len(g):
                    continue
                at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                mine = np.flatnonzero(grams[at] == g)
                g, s, e, hot = g[mine], s[mine], e[mine], hots[at[mine]]
                doc = w.doc_of()[s]
                rows = batch.slice(a, b - a)
                owner = np.zeros(len(g), _OWNER)
                owner["doc_id"], owner["th"], owner["at"] = rows.column("doc_id").to_numpy()[doc], rows.column("th").to_numpy()[doc], s - w.first[doc]
                names = w.hash.astype(np.uint32)
                found: dict[tuple[int, bytes], list[int]] = {}
                for i in np.flatnonzero(~hot).tolist():
                    found.setdefault((int(g[i]), names[s[i] : e[i] + width].tobytes()), []).append(i)
                n = len(found)
                nothing = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([k for k, _ in found], U).view(np.int64)), pa.array([x for _, x in found], pa.binary()), pa.array([owner[i].tobytes() for i in found.values()], pa.binary()), nothing(n, pa.int64()), nothing(n, pa.int64()), nothing(n, pa.int64()), nothing(n, pa.int32()), nothing(n, pa.int32())], names_of)
                if hot.any():
                    which = np.flatnonzero(hot)
                    counts = e[which] - s[which] + 1
                    place = np.repeat(s[which] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                    o = owner[np.repeat(which, counts)]
                    at = place - w.first[np.repeat(doc[which], counts)]
                    window, window2 = (window_hash(x, width)[place].view(np.int64) for x in (w.hash, mixed(w.hash + U(width))))
                    yield pa.RecordBatch.from_arrays([nothing(len(at), pa.int64()), nothing(len(at), pa.binary()), nothing(len(at), pa.binary()), pa.array(window), pa.array(window2), pa.array(o["doc_id"]), pa.array(o["th"]), pa.array(at.astype(np.int32))], names_of)

    return run


def shard_matches(passages: list[np.ndarray], least: np.ndarray, gram: np.ndarray, width: int) -> list[np.ndarray | None]:
    """For each passage whether each of its windows stands in a passage of an earlier document (None: none does). least: document of each."""
    out: list[np.ndarray | None] = [None] * len(passages)
    _, group = np.unique(gram, return_inverse=True)
    first = np.full(group.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, least)
    asks = least > first[group]  # others of the gram are the earliest there is
    indexed = np.flatnonzero(np.bincount(group, asks)[group] > 0)
    if not len(indexed):
        return out
    asks = np.flatnonzero(asks[indexed])
    sizes = np.array([len(passages[i]) for i in indexed], np.int64)
    _, symbol = np.unique(np.concatenate([passages[i] for i in indexed]), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = np.insert(symbol.reshape(-1) + 2, begin[1:], 1)  # 1 ends a passage
    _, rank = np.unique(least[indexed], return_inverse=True)
    index = FMIndex(text)
    matcher = Matcher(index, text, np.repeat(rank, sizes + 1), width)
    index.suffixes = None
    flat = np.concatenate([text[begin[i] + i : begin[i + 1] + i] for i in asks])
    starts = np.concatenate([[0], np.cumsum(sizes[asks])])
    found = matcher.lengths(flat, starts, rank[asks]) >= width
    for k, i in enumerate(asks.tolist()):
        out[indexed[i]] = found[starts[k] : starts[k + 1] - width + 1]
    return out


def _search(width: int):
    def run(table: pa.Table) -> pa.Table:
        seen: dict[tuple[int, bytes], int] = {}
        passages, grams, owners = [], [], []
        for gram, words, owner in zip(table.column("gram").to_pylist(), table.column("words"), table.column("owners"), strict=True):
            k = seen.setdefault((gram, words.as_py()), len(seen))
            if k == len(passages):
                passages.append(np.frombuffer(words.as_py(), np.uint32))
                grams.append(gram)
                owners.append([])
            owners[k].append(np.frombuffer(owner.as_py(), _OWNER))
        owners = [np.concatenate(o) for o in owners]
        least = np.array([o["doc_id"].min() for o in owners], np.int64)
        ids, ths, starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]

        def report(o: np.ndarray, s, e) -> None:
            ids.append(o["doc_id"])
            ths.append(o["th"])
            starts.append((o["at"] + s).astype(np.int32))
            ends.append((o["at"] + e).astype(np.int32))

        for words, o, m, found in zip(passages, owners, least, shard_matches(passages, least, np.array(grams, np.int64), width), strict=True):
            report(o[o["doc_id"] > m], 0, len(words))  # all windows stand in the least document's passage
            if found is not None and found.any():
                edge = np.diff(np.pad(found, 1).astype(np.int8))
                for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    report(o[o["doc_id"] == m], s, e - 1 + width)
        return pa.table({"doc_id": np.concatenate(ids), "th": np.concatenate(ths), "start": np.concatenate(starts), "end": np.concatenate(ends)})

    return run


def _cut(kept: list[str]):
    is_word = space_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                w = Words(data, offsets, is_word, lower=False, hashed=False)
                rows = batch.slice(a, b - a)
                spans = rows.column("spans")
                counts = np.diff(spans.offsets.to_numpy()[: b - a + 1]) if spans.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in spans])
                flat = spans.flatten()
                first = np.repeat(w.first[:-1], counts)
                mark = np.zeros(len(w) + 1, np.int64)
                if len(flat):
                    np.add.at(mark, first + flat.field("start").to_numpy(), 1)
                    np.add.at(mark, first + flat.field("end").to_numpy(), -1)
                gone = np.cumsum(mark)[:-1] > 0
                n_gone = np.concatenate([[0], np.cumsum(gone)])
                raw = data.tobytes()
                keep_s, keep_e = w.start, w.end
                texts = []
                for i in range(b - a):
                    at = np.arange(w.first[i], w.first[i + 1])
                    at = at[~gone[at]]
                    texts.append(b" ".join([raw[x:y] for x, y in zip(keep_s[at].tolist(), keep_e[at].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(np.diff(w.first), pa.int64()), pa.array(n_gone[w.first[1:]] - n_gone[w.first[:-1]], pa.int64()), pa.array(texts, pa.string())], [*kept, "n_words", "n_removed", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int | None = None) -> DataFrame:
    """docs' columns, then n_words, n_removed and kept_text (kept words joined by one space); input columns of these names are replaced. hot: a gram
    with more occurrences is compared by hash (without it, one that a shard has no room for)."""
    hot = shard_words // PASSAGE_WORDS if hot is None else hot
    taken = {"n_words", "n_removed", "kept_text"}
    kept = [f for f in docs.schema if f.name.lower() not in taken]
    spark = docs.sparkSession
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.hash(docs["text"]).alias("th"), docs["text"].alias("text")).where("doc_id is not null and text is not null")
    counted = keyed.mapInArrow(_grams(width, gram), "gram long, least long, most long, n long").groupBy("gram").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    repeated = written(counted.where("least < most").select("gram", "n"), "substring-grams")
    n_grams, n_places = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_grams <= BROADCAST_GRAMS:
        local = repeated.orderBy("gram").toArrow()
        grams = local.column("gram").to_numpy().view(U)
        order = np.argsort(grams)
        known = spark.sparkContext.broadcast((grams[order], local.column("n").to_numpy()[order] > hot))
        source = keyed
    else:
        known = None
        own = keyed.mapInArrow(_own_grams(width, gram), "doc_id long, th int, gram long").join(repeated, "gram").groupBy(F.col("doc_id").alias("o_id"), F.col("th").alias("o_th")).agg(F.collect_list("gram").alias("grams"), F.collect_list(F.col("n") > hot).alias("hots"))
        source = keyed.join(own, (F.col("doc_id") == F.col("o_id")) & (F.col("th") == F.col("o_th"))).select("doc_id", "th", "text", "grams", "hots")
    found = written(source.mapInArrow(_passages(width, gram, known), PASSAGE), "substring-passages")
    shards = max(1, math.ceil(n_places * PASSAGE_WORDS / shard_words))
    spans = found.where("gram is not null").select(F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"), "gram", "words", "owners").groupBy("shard").applyInArrow(lambda t: _search(width)(t), "doc_id long, th int, start int, end int")
    windows = found.where("window is not null").select("window", "window2", "doc_id", "th", "at")
    least = windows.groupBy("window", "window2").agg(F.min("doc_id").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
    spans = spans.unionByName(salted.join(least, ["window", "window2", "salt"]).where("doc_id > least").select("doc_id", "th", F.col("at").alias("start"), (F.col("at") + width).alias("end")))
    gone = spans.groupBy(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    gone = written(gone, "substring-spans")
    rec = docs.select(F.struct(*[docs[f.name] for f in kept]).alias("rec"), docs["doc_id"].cast("bigint").alias("j_id"), F.hash(docs["text"]).alias("j_th"), docs["text"].alias("text"))
    joined = rec.join(gone.hint("merge"), (F.col("j_id") == F.col("g_id")) & (F.col("j_th") == F.col("g_th")), "left")
    cut = joined.select("rec", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    rec_type = cut.schema["rec"].dataType.simpleString()
    done = cut.mapInArrow(_cut(["rec"]), f"rec {rec_type}, n_words long, n_removed long, kept_text string")
    return done.select(*[F.col("rec").getField(f.name).alias(f.name) for f in kept], "n_words", "n_removed", "kept_text")


def _own_grams(width: int, gram: int):
    is_word = space_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                w = Words(data, offsets, is_word, lower=False)
                g, s, _ = _picks(w, width, gram)
                doc = w.doc_of()[s] if len(s) else np.empty(0, np.int64)
                pairs = np.unique(np.stack([doc, g.view(np.int64)], 1), axis=0) if len(g) else np.empty((0, 2), np.int64)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(pairs[:, 0])), rows.column("th").take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], ["doc_id", "th", "gram"])

    return run
