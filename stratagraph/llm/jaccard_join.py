"""Exact n-gram Jaccard self-join with a token-group matrix.

1. Every text becomes its set of distinct shingle hashes; the set has a name (a hash). Texts with one and the same set form
   one node, the least doc_id, and nothing below sees more than one of them in a task.
2. Part signatures find the candidates. Two sets that reach the threshold differ in at most D tokens, and D follows from their
   sizes; with the token universe cut into parts by hash, so that a set fills more than D of them, at least one filled part
   holds the same tokens in both. A set's signatures are the hashes of its filled parts, for every number of parts that a
   partner of a permitted size may agree on, so no link is lost. A set that fills too few also signs a second cut of the
   universe (and so on), and after the last cut its empty parts.
3. Candidates are bounded exactly: with f filled parts at most D of them can differ, so a set of which fewer than f - D
   signatures are held by any other set has no partner at that number of parts. This bounds its overlap with the union of all others, and
   takes out sets that merely share a passage. Sets that are left and share a signature are tied by a star to one of the
   owners, never in pairs; those that the ties connect are a cluster.
   A cluster of several blocks is mostly a chain of small families that share passages, and it grows faster than the corpus. It is cut
   by prefixes: with the tokens of all such clusters ordered from rare to common, two sets that link share one of their first
   n - ceil(threshold * n) + 1. Sets tied by such a token form the new clusters, and passages that many sets hold come last.
4. A cluster is partitioned into groups of similar nodes; the token-group matrix holds each group's token union. The
   overlap of a node with a union bounds its overlap with every member, and only groups whose bound reaches what the
   sizes require are opened; members there are compared exactly.

Owners of a signature are tied where they are read first, about FLUSH signatures at a time, and only one of them travels on: a
signature of a third of all documents costs its task one row per FLUSH. A verifying task holds two blocks, each of about BLOCK nodes and
BLOCK_TOKENS tokens. A cluster of more blocks is compared in two rounds: every block with itself and with the first one; then the nodes
outside of the largest component so far with all blocks. So near copies in great numbers cost tasks in proportion to their number, and
only nodes that link with none of them meet every block. A task returns a spanning forest of its links, not all pairs.

Nulls: null and wordless texts have no shingles and link with nothing. A row without doc_id has no component (null).
Rows that share a doc_id share a component. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, dropped, small, written
from .components import components
from .tokens import SLICE_BYTES, U, Words, list_array, mixed, released, space_words, text_slices, window_hash

BLOCK, BLOCK_TOKENS = 1024, 1 << 19
GROUP = 32
CUTS = 5
LADDER = 1.5
#: So many signatures of consecutive documents are tied with one another before they travel.
FLUSH = 1 << 18
#: Classes of more documents than this reach them by broadcast, so that no task gathers one: a table of N rows has N / HOT_CLASS at most.
HOT_CLASS = 100_000
#: Tokens of more sets than this reach them by broadcast: of N tokens in all sets N / HOT_TOKEN at most.
HOT_TOKEN = 10_000
#: A name's low bits hold the number of parts and the cut of a signature.
LEVEL_BITS = 9
_SALT = [0x1B873593 + 0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(CUTS)]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and where each text's begin (and the end)."""
    n_docs = len(words.first) - 1
    n_words = np.diff(words.first)
    all_windows = window_hash(words.hash, k)
    doc = words.doc_of()
    n = len(words)
    inside = np.arange(max(0, n - k + 1))
    inside = inside[doc[inside] == doc[inside + k - 1]] if len(inside) else inside
    hashes, owner = all_windows[inside], doc[inside]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        whole = np.array([int(mixed(np.array([_fold(words.hash[words.first[d] : words.first[d + 1]])], U))[0]) for d in short], U)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(n_docs + 1))


def _fold(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = (out * 0x9E3779B97F4A7C15 + x) & (1 << 64) - 1
    return out


def most_different(total: int | np.ndarray, num: int, den: int):
    """Most tokens in which two sets of `total` tokens together may differ at Jaccard >= num/den: total * (den - num) / (den + num)."""
    return total * (den - num) // (den + num)


def ladder(top: int) -> np.ndarray:
    steps = [1]
    while steps[-1] < top:
        steps.append(max(steps[-1] + 1, int(steps[-1] * LADDER)))
    return np.array(steps, np.int64)


def parts_for(n: int, num: int, den: int, steps: np.ndarray) -> np.ndarray:
    """Numbers of parts that a set of n tokens and its possible partners may agree on."""
    least, most = -(-n * num // den), n * den // num
    lo = most_different(n + least, num, den) + 1
    hi = most_different(n + most, num, den) + 1
    a, b = np.searchsorted(steps, [lo, hi])
    return steps[a : b + 1]


def signatures(hashes: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part signatures of all sets: (signature, set number, level, least number of this set's signatures of the level that a partner shares)."""
    sizes = np.diff(first)
    steps = ladder(max(2, most_different(int(sizes.max()) * 3 + 3, num, den) + 2)) if len(sizes) else ladder(2)
    plans = {int(n): parts_for(int(n), num, den, steps) for n in np.unique(sizes) if n}
    which = np.array([i for i, n in enumerate(sizes.tolist()) if n for _ in plans[n]], np.int64)
    need = np.concatenate([np.empty(0, np.int64)] + [plans[n] for n in sizes.tolist() if n])
    step = np.searchsorted(steps, need)
    parts = need + need // 6 + 1  # a few more than the differences: some may stay empty, the others bound
    out = [(np.empty(0, U), *[np.empty(0, np.int64)] * 3)]
    for cut in range(CUTS):
        if not len(which):
            break
        n = sizes[which]
        rows = np.repeat(first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        tokens = mixed(hashes[rows] ^ U(_SALT[cut]))
        base = np.concatenate([[0], np.cumsum(parts)])
        part = ((tokens >> U(32)) * np.repeat(parts, n).astype(U) >> U(32)).astype(np.int64)
        slot = np.repeat(base[:-1], n) + part
        # a sum of finished hashes names a set of tokens, whatever their order
        order = np.argsort(slot, kind="stable")
        slot, tokens = slot[order], mixed(tokens[order])
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        total = np.add.reduceat(tokens, begin)
        filled = slot[begin]
        of = np.searchsorted(base, filled, "right") - 1
        name = mixed(total ^ mixed((filled - base[of]).astype(U) * U(0x100000001B3) + parts[of].astype(U) * U(0xC2B2AE3D27D4EB4F) + U(cut)))
        some = np.bincount(of, minlength=len(which))
        least = np.maximum(1, some - need + 1)
        out.append((name, which[of], step[of] * (CUTS + 1) + cut, least[of]))
        lacking = np.flatnonzero(some < need)
        if cut == CUTS - 1 and len(lacking):
            for j in lacking.tolist():
                empty = np.setdiff1d(np.arange(parts[j]), filled[of == j] - base[j])
                name = mixed(empty.astype(U) * U(0x100000001B3) + parts[j : j + 1].astype(U) * U(0xC2B2AE3D27D4EB4F) + U(CUTS))
                out.append((name, np.full(len(empty), which[j]), np.full(len(empty), step[j] * (CUTS + 1) + CUTS), np.ones(len(empty), np.int64)))
        which, parts, need, step = which[lacking], parts[lacking], need[lacking], step[lacking]
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def set_names(hashes: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """A hash of every set, whatever its order."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(hashes + U(salt)), dtype=U)])
    return mixed(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U))


def tied(key: np.ndarray, owner: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of some documents -> rows (key, owner, least, tie; tie 0 is none) that travel on.

    One owner travels for each signature. If there are others it stands for all (least 0: such a row counts for nothing), and every
    owner has a row of its own, under a key of its own, with the tie.
    """
    order = np.lexsort((owner, key))
    key, owner, least = key[order], owner[order], least[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner, least = key[new], owner[new], least[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(key)))
    several = np.repeat(n > 1, n)
    tie = np.repeat(owner[start], n)[several]
    own = (mixed(key[several] ^ mixed(owner[several])), owner[several], least[several], tie)
    travels = (key[start], owner[start], np.where(n > 1, 0, least[start]), np.zeros(len(start), owner.dtype))
    return tuple(np.concatenate(x) for x in zip(travels, own, strict=True))


def _names(k: int):
    """doc_id, n (size), s1 and s2 (names) of every text's set."""
    is_word = space_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                hashes, first = shingle_sets(Words(data, offsets, is_word, lower=True), k)
                s1, s2 = (pa.array(set_names(hashes, first, salt).view(np.int64)) for salt in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first), pa.int64()), s1, s2], ["doc_id", "n", "s1", "s2"])

    return run


def _signed(k: int, num: int, den: int, flush: int):
    is_word = space_words()

    def rows(held: list[tuple]) -> pa.RecordBatch:
        key, owner, least, tie = tied(*(np.concatenate([h[i] for h in held]) for i in range(3)))
        arrays = [pa.array(key.view(np.int64)), pa.array(owner.view(np.int64)), pa.array(least, pa.int32()), pa.array(tie.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, ["key", "owner", "least", "tie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text", SLICE_BYTES // 4):  # a set signs more than it holds
                hashes, first = shingle_sets(Words(data, offsets, is_word, lower=True), k)
                key, of, level, least = signatures(hashes, first, num, den)
                name = set_names(hashes, first, 1) >> U(LEVEL_BITS) << U(LEVEL_BITS)
                held.append((key, name[of] | level.astype(U), least.astype(np.int32)))
                if sum(len(h[0]) for h in held) >= flush:
                    yield rows(held)
                    held = []
        if held:
            yield rows(held)

    return run


def _token_sets(k: int):
    is_word = space_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                hashes, first = shingle_sets(Words(data, offsets, is_word, lower=True), k)
                rows = batch.slice(a, b - a)
                tokens = list_array(hashes.view(np.int64), np.diff(first), pa.int64())
                mine = pa.array(set_names(hashes, first, 2).view(np.int64) == rows.column("s2").to_numpy())  # not another row of this doc_id
                yield pa.RecordBatch.from_arrays([rows.column(c).filter(mine) for c in ("node", "cluster", "block", "blocks")] + [tokens.filter(mine)], ["node", "cluster", "block", "blocks", "tokens"])

    return run


def local_links(sets: list[np.ndarray], side: np.ndarray, num: int, den: int, group: int = GROUP) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: within side 0 if there is no other, else between sides 0 and 1.

    Token-group matrix: sets in order of their least tokens form groups of `group`; a group's row is its token union.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, df = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = df[column] > 1  # a token of one set overlaps with nothing
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    members = np.flatnonzero(side == 0)
    members = members[np.argsort(np.array([sets[i][0] for i in members], U), kind="stable")]
    queries = np.flatnonzero(side == 1) if side.any() else members
    starts = np.arange(0, len(members), group)
    slab = max(256, (2 << 20) // len(sets))

    def rows(of: np.ndarray) -> Iterator[np.ndarray]:
        """The incidence rows of some sets, a slab of columns at a time."""
        at = np.full(len(sets), -1)
        at[of] = np.arange(len(of))
        for lo in range(0, width, slab):
            x, y = np.searchsorted(column, [lo, lo + slab])
            mine = at[owner[x:y]] >= 0
            out = np.zeros((len(of), min(slab, width - lo)), np.float32)
            out[at[owner[x:y][mine]], column[x:y][mine] - lo] = 1
            yield out

    opened = np.ones((len(queries), len(starts)), bool)
    if len(starts) > 1:
        bound = np.zeros(opened.shape, np.float32)
        for q, m in zip(rows(queries), rows(members), strict=True):
            bound += q @ np.maximum.reduceat(m, starts, axis=0).T
        least = np.minimum.reduceat(sizes[members], starts)
        opened = bound >= -(-(sizes[queries][:, None] + least[None, :]) * num // (num + den))
    overlap = np.zeros((len(queries), len(members)), np.float32)
    for q, m in zip(rows(queries), rows(members), strict=True):
        for g, at in enumerate(starts):
            who = np.flatnonzero(opened[:, g])
            overlap[who, at : at + group] += q[who] @ m[at : at + group].T
    linked = overlap * den >= num * (sizes[queries][:, None] + sizes[members][None, :] - overlap)
    label = np.arange(len(sets))
    while linked.any():
        before = label.copy()
        label[members] = np.minimum(label[members], np.where(linked, label[queries][:, None], len(sets)).min(0))
        label[queries] = np.minimum(label[queries], np.where(linked, label[members][None, :], len(sets)).min(1))
        label = label[label]
        if (label == before).all():
            break
    return [(i, int(x)) for i, x in enumerate(label) if x != i]


def _verify(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cluster, node, side = (table.column(c).to_numpy() for c in ("cluster", "node", "side"))
        tokens = table.column("tokens").combine_chunks()
        values, offsets = tokens.values.to_numpy().view(np.uint64), tokens.offsets.to_numpy()
        order = np.lexsort((node, cluster))
        bounds = np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1], [True]])) if len(order) else [0]
        us, vs = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                rows = order[a:b]
                for i, j in local_links([values[offsets[r] : offsets[r + 1]] for r in rows], side[rows], num, den):
                    us.append(node[rows[i]])
                    vs.append(node[rows[j]])
        released()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _candidates(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Names (without level) of the sets that may have a partner, and ties between names that share a signature: both written."""
    signed = docs.mapInArrow(_signed(k, num, den, FLUSH), "key long, owner long, least int, tie long")
    same = Window.partitionBy("key").orderBy("owner", "least")  # of an owner's rows the one that stands for others comes first and stays
    all_of = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = signed.select("owner", "least", "tie", F.first("owner").over(all_of).alias("p"), F.last("owner").over(all_of).alias("q"), F.lag("owner").over(same).alias("before"))
    met = met.where("(p <> q or tie <> 0) and (before is null or before <> owner)").select("owner", "least", F.when(F.col("tie") != 0, F.col("tie")).otherwise(F.col("p")).alias("tie"))
    met = written(met, "join-met")
    able = met.where("least > 0").groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).where("n >= least").select("owner")
    able = written(able, "join-able")
    name = lambda c: F.shiftright(c, LEVEL_BITS)
    # a set that stands for others stays a tie between them even where it has no partner itself
    ties = met.where("owner <> tie").join(able, "owner", "left_semi").unionByName(met.where("owner <> tie and least = 0"))
    ties = written(ties.select(name("owner").alias("u"), name("tie").alias("v")).where("u <> v").distinct(), "join-ties")
    alive = written(able.select(name("owner").alias("name")).distinct(), "join-alive")
    dropped(met, able)
    return alive, ties


def _cut(tokens: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """tokens, written, with clusters of several blocks cut by prefixes of rare tokens: no link is lost, and sets without a partner there go."""
    large = tokens.where("blocks > 1")
    if not large.limit(1).count():
        return tokens
    each = large.select("node", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    held = written(each.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "join-held")
    marked = each.join(F.broadcast(held.where(F.col("held") > HOT_TOKEN)), "token", "left")
    rest = marked.where("held is null").drop("held").join(held.where(F.col("held") <= HOT_TOKEN), "token", "left")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("held", F.lit(1)), "token"))
    ranked = marked.where("held is not null").unionByName(rest).withColumn("rank", rank)
    prefix = written(ranked.where(f"held is not null and rank <= n - (n * {num} + {den - 1}) div {den} + 1").select("token", "node"), "join-prefix")
    ties = prefix.join(prefix.groupBy("token").agg(F.min("node").alias("v")), "token").select(F.col("node").alias("u"), "v")
    part = written(components(ties, "join-cut").withColumnRenamed("component", "to"), "join-cut")
    sized = large.select("node", F.size("tokens").alias("n")).join(part, "node").groupBy("to").agg(*_blocks(block))
    part = written(part.join(sized, "to").select("node", "to", "blocks"), "join-cut")
    moved = large.drop("cluster", "block", "blocks").join(small(part), "node").select("node", F.col("to").alias("cluster"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks", "tokens")
    out = written(tokens.where("blocks = 1").unionByName(moved), "join-tokens")
    dropped(tokens, held, prefix, part)
    return out


def _blocks(block: int) -> list[Column]:
    """blocks and nodes of a cluster's sets of n tokens each."""
    return [F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("nodes")]


def _links(tokens: DataFrame, num: int, den: int, block: int) -> list[DataFrame]:
    """Spanning forests of the links of all clusters, as written tables (u, v)."""
    verify, kind = _verify(num, den), "u long, v long"
    size = tokens.where("blocks = 1").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0))).first()
    bins = max(1, math.ceil(size[0] / block), math.ceil(size[1] / BLOCK_TOKENS))
    alone = tokens.where("blocks = 1").select(F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("long").alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "cluster", "node", F.lit(0).alias("side"), "tokens")
    large = tokens.where("blocks > 1")
    to = lambda i, j, side: F.struct(F.lit(i).cast("int").alias("i"), F.lit(j).cast("int").alias("j"), F.lit(side).alias("side"))
    others = F.transform(F.sequence(F.lit(1), F.col("blocks") - 1), lambda j: to(0, j, 0))
    where = F.when(F.col("block") == 0, F.concat(F.array(to(0, 0, 0)), others)).otherwise(F.array(to(F.col("block"), F.col("block"), 0), to(0, F.col("block"), 1)))
    first = large.select(F.col("cluster").alias("task"), F.explode(where).alias("t"), "cluster", "node", "tokens").select("task", "t.i", "t.j", "cluster", "node", "t.side", "tokens")
    found = [written(alone.unionByName(first).groupBy("task", "i", "j").applyInArrow(verify, kind), "join-links")]
    if large.limit(1).count():
        part = components(found[0], "join-parts")
        part = written(large.join(part, "node", "left").select("cluster", "node", "blocks", F.coalesce("component", "node").alias("component")), "join-parts")
        sizes = part.groupBy("cluster", "component").count()
        most = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("most"))
        loose = part.join(most, "cluster").where("component <> most").select("cluster", "node", "blocks")
        n = loose.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("loose"))
        loose = loose.join(n, "cluster").select("node", F.pmod(F.xxhash64("node", F.lit(1)), F.col("loose")).cast("int").alias("i"))
        span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        all_blocks = large.join(n, "cluster").select(F.col("cluster").alias("task"), span(F.col("loose")).alias("i"), F.col("block").alias("j"), "cluster", "node", F.lit(0).alias("side"), "tokens")
        asking = large.join(loose, "node").select(F.col("cluster").alias("task"), "i", span(F.col("blocks")).alias("j"), "cluster", "node", F.lit(1).alias("side"), "tokens")
        found.append(written(all_blocks.unionByName(asking).groupBy("task", "i", "j").applyInArrow(verify, kind), "join-links"))
        dropped(part)
    return found


def _with_component(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """sets with the component of their class: classes (s1, s2, n_docs, component) that hold several documents or have links.

    A class with many documents never gathers in a task: it reaches its documents by broadcast.
    """
    out = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")]
    sets = sets.withColumn("asks", F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = classes.withColumnsRenamed({"s1": "c1", "s2": "c2"})
    on = F.col("asks") & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))
    if classes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return sets.join(F.broadcast(classes), on, "left").select(*out)
    hot = written(classes.where(F.col("n_docs") > HOT_CLASS).drop("n_docs"), "join-hot")
    of_hot = sets.join(small(hot), on, "left")
    rest = of_hot.where("c1 is null").drop("c1", "c2", "component")
    return of_hot.where("c1 is not null").select(*out).unionByName(rest.join(classes.where(F.col("n_docs") <= HOT_CLASS), on, "left").select(*out))


def jaccard_components(docs: DataFrame, k: int = 3, threshold: str = "0.9", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (columns doc_id and text); threshold is a decimal or a fraction, taken exactly."""
    t = Fraction(threshold)
    num, den = t.numerator, t.denominator
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    sets = written(docs.mapInArrow(_names(k), "doc_id long, n long, s1 long, s2 long"), "join-sets")
    known = sets.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_docs"), F.first("n").alias("n")), "join-classes")
    alive, ties = _candidates(docs.where("doc_id is not null"), k, num, den)
    clusters = written(components(ties, "join-clusters"), "join-clusters")
    placed = clusters.withColumnRenamed("node", "name").join(alive, "name").join(classes.withColumn("name", F.shiftright("s1", LEVEL_BITS)), "name").select("node", "s2", "n", F.col("component").alias("cluster"))
    sized = placed.groupBy("cluster").agg(*_blocks(block)).where("nodes > 1")
    placed = written(placed.join(sized, "cluster").select("node", "s2", "cluster", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks"), "join-placed")
    dropped(alive, ties, clusters)
    texts = docs.join(small(placed), docs["doc_id"] == placed["node"]).select("node", "s2", "cluster", "block", "blocks", "text")
    tokens = written(texts.mapInArrow(_token_sets(k), "node long, cluster long, block int, blocks int, tokens array<long>").dropDuplicates(["node"]), "join-tokens")
    tokens = _cut(tokens, num, den, block)
    links = _links(tokens, num, den, block)
    edges = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    several = known.groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b").select("doc_id")
    if several.limit(1).count():  # rows of one doc_id with different texts
        nodes = known.join(several, "doc_id").join(classes.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node").distinct()
        edges = edges.unionByName(nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").select(F.col("node").alias("u"), "v"))
    linked = components(edges, "join-found")
    found = classes.join(linked, "node", "left").where("n_docs > 1 or component is not null").select("s1", "s2", "n_docs", F.coalesce("component", "node").alias("component"))
    found = written(found, "join-found")
    dropped(tokens, placed, classes, *links)
    return _with_component(sets, found)
