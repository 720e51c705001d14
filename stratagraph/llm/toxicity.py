"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon (words, and stems of STEMS bytes, weighed by how labelled texts use them, besides a
short seed list), the share of lexicon words near a second-person word, capitals, punctuation, obfuscation (symbols inside
words, and lexicon words that show only after symbols are read as letters), length. Nothing but the text goes in.

Fitting takes at most SAMPLE_ROWS labelled documents, the first by a hash of doc_id, and of rows that share a doc_id the least
text. That bound is the only one on rows. Term counts
are summed on the executors; the driver gets the lexicon (MOST_TERMS at most) and the features of the sample. A training
text never meets its own contribution to the lexicon. Calibration is fitted on predictions of trees that didn't see the row.

Nulls: a null text is scored as an empty one; a row without doc_id counts as not held out. Labels without a document, without doc_id
or without a mark are not used; of several marks for a document the greatest counts. Without labelled rows of
both kinds every text gets the share of toxic labels (0 without any). Input columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import U, Words, letter_words, lower_table, mixed, text_slices

SAMPLE_ROWS = 20_000
MOST_TERMS = 20_000
LEAST_DOCS = 3
STEMS = (4, 5, 6)
NEAR = 3
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32

# English insults that seed the lexicon, and words for "you" in English, German, French and Spanish.
SEED_TERMS = "idiot stupid moron loser scum trash clown pathetic disgusting worthless dumb fool jerk creep filthy imbecile garbage vermin bastard bitch crap damn hate kill ugly retard freak coward liar pig".split()
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch sie ihnen tu toi te ton ta tes vous votre vos ti tus usted ustedes vosotros su".split()
# Symbols and the letters that they stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "u", "+": "t", "|": "l"}

FEATURES = 14


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _word_names(texts: list[str]) -> np.ndarray:
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(data), np.uint8), offsets, letter_words(), lower=True).hash


def _leet_table() -> np.ndarray:
    t = lower_table()
    for a, b in LEET.items():
        t[ord(a)] = ord(b)
    return t


def _terms(w: Words) -> list[np.ndarray]:
    """Names of each word and of its stems (0 where the word is no longer than the stem)."""
    out = [w.hash]
    size = w.end - w.start
    for n in STEMS:
        some = np.flatnonzero(size > n)
        name = np.zeros(len(w), U)
        part = np.full(len(some), n, U)
        for j in range(n):
            part = part * U(1099511628211) + w.data[w.start[some] + j].astype(U)
        name[some] = mixed(part + U(n))
        out.append(name)
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    is_word = letter_words()
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for a, b, data, offsets in text_slices(batch, "text"):
            w = Words(data, offsets, is_word, lower=True)
            doc, marks = w.doc_of(), toxic[a:b]
            terms = np.concatenate(_terms(w))
            docs = np.tile(doc, len(STEMS) + 1)
            keep = terms != 0
            pairs = np.unique(np.stack([terms[keep].view(np.int64), docs[keep]], 1), axis=0) if keep.any() else np.empty((0, 2), np.int64)
            name, at = np.unique(pairs[:, 0], return_inverse=True)
            bad = np.bincount(at, weights=marks[pairs[:, 1]], minlength=len(name)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(bad), pa.array(np.bincount(at, minlength=len(name)) - bad)], ["term", "bad", "good"])


class Lexicon:
    """Terms in order of name, with the numbers of toxic and other texts that have them."""

    def __init__(self, name: np.ndarray, bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int):
        seeds = np.setdiff1d(_word_names(SEED_TERMS), name)
        name = np.concatenate([name, seeds])
        order = np.argsort(name)
        self.name = name[order]
        self.bad = np.concatenate([bad, np.full(len(seeds), 2)])[order].astype(float)
        self.good = np.concatenate([good, np.zeros(len(seeds))])[order].astype(float)
        self.n_bad, self.n_good = max(1, n_bad), max(1, n_good)
        self.you = np.sort(_word_names(YOU))

    def weight(self, terms: np.ndarray, bad_less: np.ndarray | float = 0.0, good_less: np.ndarray | float = 0.0) -> np.ndarray:
        """Log odds of each term, shrunk, 0 for terms not in it; less the texts' own part."""
        if not len(self.name):
            return np.zeros(len(terms))
        at = np.minimum(np.searchsorted(self.name, terms), len(self.name) - 1)
        bad, good = np.maximum(self.bad[at] - bad_less, 0), np.maximum(self.good[at] - good_less, 0)
        w = np.log((bad + 0.25) / (self.n_bad + 0.5)) - np.log((good + 0.25) / (self.n_good + 0.5))
        return np.where((self.name[at] == terms) & (bad >= 1), np.maximum(w, 0), 0.0)


def _features(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray, marks: np.ndarray | None) -> np.ndarray:
    n = len(offsets) - 1
    w = Words(data, offsets, letter_words(), lower=True)
    doc = w.doc_of()
    words = np.maximum(np.bincount(doc, minlength=n), 1).astype(float)
    less = (0.0, 0.0) if marks is None else (marks[doc].astype(float), 1.0 - marks[doc])

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n) / words

    weights = [lexicon.weight(t, *less) for t in _terms(w)]
    stem = np.maximum.reduce(weights[1:])
    strong = np.maximum(weights[0], stem)
    hit = strong > 3.0
    first = w.first
    near = np.zeros(len(w) + 1)
    if len(w):
        you = np.isin(w.hash, lexicon.you)
        at = np.flatnonzero(you)
        lo, hi = np.maximum(at - NEAR, first[doc[at]]), np.minimum(at + NEAR + 1, first[doc[at] + 1])
        np.add.at(near, lo, 1)
        np.add.at(near, hi, -1)
    near = np.cumsum(near)[: len(w)] > 0
    chars = np.maximum(np.diff(offsets), 1).astype(float)

    def per_byte(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / chars

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    punct = ~(upper | lower | digit | space) & (data < 128)
    letter = upper | lower | (data >= 128)
    inside = np.zeros(len(data), bool)
    if len(data) > 2:
        inside[1:-1] = (digit | punct)[1:-1] & letter[:-2] & letter[2:]
    read = Words(_leet_table()[data], offsets, letter_words(), lower=False)
    changed = np.concatenate([[0], np.cumsum(digit | punct)])
    mixed_word = (changed[read.end] - changed[read.start] > 0) if len(read) else np.zeros(0, bool)
    hidden = np.bincount(read.doc_of()[mixed_word], weights=lexicon.weight(read.hash[mixed_word]) > 3.0, minlength=n) if mixed_word.any() else np.zeros(n)
    best = np.zeros(n)
    np.maximum.at(best, doc, strong)
    return np.stack([
        per_word(weights[0] > 3.0), per_word(stem > 3.0), per_word(strong), best, per_word(hit), np.bincount(doc, weights=hit, minlength=n),
        per_word(hit & near), per_word(near), per_byte(upper), per_byte(punct), per_byte((data == 33) | (data == 63)), per_byte(inside), hidden / words, np.log1p(np.bincount(doc, minlength=n)),
    ], 1)


class Trees:
    """Boosted regression trees on binned features, log loss, second-order leaf values."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, p - y, np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            f += self._value(tree, b)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        """(feature, bin, value) of a full tree's nodes, in heap order; feature -1 is a leaf."""
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[k] = -RATE * gs / (hs + 1)
            if k >= 2**DEPTH - 1 or len(rows) < 8:
                continue
            best = 1e-3
            for j in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[rows, j], weights=g[rows], minlength=BINS + 1))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], weights=h[rows], minlength=BINS + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                i = int(gain.argmax())
                if gain[i] > best:
                    best, feature[k], cut[k] = gain[i], j, i
            if feature[k] >= 0:
                right = b[rows, feature[k]] > cut[k]
                node[rows] = 2 * k + 1 + right
        return feature, cut, value

    def _value(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            j = feature[node]
            node = np.where(j >= 0, 2 * node + 1 + (b[np.arange(len(b)), np.maximum(j, 0)] > cut[node]), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + sum((self._value(t, b) for t in self.trees), np.zeros(len(b)))


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw score, calibrated score) for linear interpolation. Equal raw scores are pooled first; the calibrated scores rise."""
    raw, place, n = np.unique(f, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []
    for s, t, k in zip(raw, np.bincount(place, weights=y, minlength=len(raw)), n, strict=True):
        blocks.append([t, float(k), s * k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray):
        self.lexicon, self.rate, self.trees = lexicon, float(y.mean()) if len(y) else 0.0, None
        if 0 < y.sum() < len(y):
            fold = np.arange(len(y)) % 3
            out = np.zeros(len(y))
            for k in range(3):
                if 0 < y[fold != k].sum() < (fold != k).sum():
                    out[fold == k] = Trees(x[fold != k], y[fold != k]).raw(x[fold == k])
            self.trees = Trees(x, y)
            self.knots = isotonic(out, y)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.rate)
        return np.clip(np.interp(self.trees.raw(_features(self.lexicon, data, offsets, None)), *self.knots), 0, 1)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled documents that are not held out."""
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    share = 1.2 * sample_rows / max(1, marks.count())  # a hash keeps somewhat more rows than needed, a sort of those cuts them
    near = marks.withColumn("h", F.xxhash64("l_id", F.lit(1))).where(F.pmod("h", F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40)))
    chosen = near.orderBy(F.pmod("h", F.lit(1 << 40)), "l_id").limit(sample_rows).select("l_id", "toxic")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # sample_rows rows at most
    sample = written(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample")
    n_bad, n_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    counts = sample.mapInArrow(_count_terms, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.25) / (n_bad + 0.5)) - F.log((F.col("good") + 0.25) / (n_all - n_bad + 0.5))
    terms = counts.where(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).where("odds > 1").orderBy(F.desc(F.col("odds") * F.log1p(F.col("bad"))), "term").limit(MOST_TERMS).toPandas()
    lexicon = Lexicon(terms["term"].to_numpy(np.int64).view(U), terms["bad"].to_numpy(), terms["good"].to_numpy(), n_bad, n_all - n_bad)
    shared = spark.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for a, b, data, offsets in text_slices(batch, "text"):
                x = _features(shared.value, data, offsets, toxic[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(toxic[a:b], pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(features, "doc_id long, toxic long, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    x = rows.column("x").combine_chunks()
    x = (x.flatten().to_numpy() if len(rows) else np.empty(0)).reshape(-1, FEATURES)
    return Model(lexicon, x, np.minimum(1, rows.column("toxic").to_numpy()).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns, then score (0 to 1) and predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name.lower() not in ("score", "predicted")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "predicted int"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([np.empty(0), *(shared.value.score(data, offsets) for _, _, data, offsets in text_slices(batch, "text"))])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*(f.name for f in kept), "score", "predicted"])

    return docs.mapInArrow(scored, schema)
