"""Geometry and flow: hulls and layouts per graph, the CI flow of build targets, chunks and embeddings per file."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.parsers import chunk_plan


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the least point."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(pts)[:-1] + half(pts[::-1])[:-1])


def cluster_hulls(points: DataFrame) -> DataFrame:
    """cluster, corner, x, y of points (cluster, x, y). Points go through a coarse cut first, so one large cluster is not one large task:
    the hull of the hulls of parts is the hull of the whole."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "corner": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    kind = points.schema["cluster"].dataType.simpleString()
    schema = f"cluster {kind}, corner int, x double, y double"
    parts = points.select("cluster", "x", "y").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    first = parts.groupBy("cluster", "part").applyInPandas(run, schema)
    return first.groupBy("cluster").applyInPandas(run, schema)


def _near(pos: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of points in the same or in neighbouring cells of a grid of width `reach`: all that are within it, and some beyond."""
    cell = np.floor(pos / reach).astype(np.int64)
    cell -= cell.min(0) - 1
    width = cell.max(0) + 2
    code = np.ravel_multi_index(cell.T, width)
    order = np.argsort(code, kind="stable")
    keys = code[order]
    left, right = [], []
    for step in np.ndindex(*(3,) * pos.shape[1]):
        other = np.ravel_multi_index((cell + np.array(step) - 1).T, width)
        a, b = np.searchsorted(keys, other), np.searchsorted(keys, other, "right")
        n = b - a
        i = np.repeat(np.arange(len(pos)), n)
        j = order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        left.append(i[i < j])
        right.append(j[i < j])
    return np.concatenate(left), np.concatenate(right)


def force_layout(nodes: list[str], edges: list[tuple[str, str]], k: float = 60.0, steps: int = 300, seed: int = 0xC516, dims: int = 2, clusters: dict[str, str] | None = None) -> dict[str, tuple[float, ...]]:
    """Spring layout of one scene: seeded places, repulsion within 2.5 k (over a grid, not over all pairs), attraction along edges, cooling by 0.95
    down to 1. Nodes of clusters start around anchors on a ring and are drawn to them."""
    rng, at = np.random.default_rng(seed), {n: i for i, n in enumerate(nodes)}
    n = len(nodes)
    spread = k * math.sqrt(max(1, n))
    pos = rng.uniform(-1, 1, (n, dims)) * spread
    anchors = None
    if clusters:
        names = sorted(set(clusters.values()))
        turn = {c: 2 * math.pi * i / len(names) for i, c in enumerate(names)}
        anchors = np.zeros((n, dims))
        for name, i in at.items():
            if name in clusters:
                anchors[i, :2] = spread * np.array([math.cos(turn[clusters[name]]), math.sin(turn[clusters[name]])])
        pos = anchors + pos / max(1, len(names))
    pairs = np.array([(at[a], at[b]) for a, b in edges if a in at and b in at and a != b]).reshape(-1, 2)
    heat = k
    for _ in range(steps if n > 1 else 0):
        move = np.zeros_like(pos)
        i, j = _near(pos, 2.5 * k)
        d = pos[i] - pos[j]
        r = np.maximum(np.sqrt((d**2).sum(1)), 0.01)
        push = d * np.where(r < 2.5 * k, k * k / r**2, 0)[:, None]
        np.add.at(move, i, push)
        np.add.at(move, j, -push)
        if len(pairs):
            d = pos[pairs[:, 0]] - pos[pairs[:, 1]]
            pull = d * (np.sqrt((d**2).sum(1)) / k)[:, None]
            np.add.at(move, pairs[:, 0], -pull)
            np.add.at(move, pairs[:, 1], pull)
        if anchors is not None:
            move += 0.1 * (anchors - pos)
        size = np.maximum(np.sqrt((move**2).sum(1)), 1e-9)
        pos += move / size[:, None] * np.minimum(size, heat)[:, None]
        heat = max(1.0, heat * 0.95)
    return {name: tuple(map(float, pos[i])) for name, i in at.items()}


def space_layout(nodes: list[str], edges: list[tuple[str, str]], clusters: dict[str, str], steps: int = 260, cell: float = 6.0, seed: int = 0xC516) -> dict[str, tuple[float, float, float]]:
    """Springs in space: edges within a cluster rest at 3, those between clusters at 9; nodes nearer than a cell push one another apart. Clusters start
    evenly on a sphere."""
    rng, at = np.random.default_rng(seed), {n: i for i, n in enumerate(nodes)}
    names = sorted({clusters.get(n, "") for n in nodes})
    i = np.arange(len(names)) + 0.5
    y = 1 - 2 * i / max(1, len(names))
    ring, turn = np.sqrt(1 - y * y), i * math.pi * (3 - math.sqrt(5))
    centre = np.stack([np.cos(turn) * ring, y, np.sin(turn) * ring], 1) * 14 * np.cbrt(max(1, len(names)))
    pos = np.array([centre[names.index(clusters.get(n, ""))] for n in nodes]).reshape(-1, 3) + rng.uniform(-2, 2, (len(nodes), 3))
    pairs = np.array([(at[a], at[b]) for a, b in edges if a in at and b in at and a != b]).reshape(-1, 2)
    rest = np.array([3.0 if clusters.get(nodes[a]) == clusters.get(nodes[b]) else 9.0 for a, b in pairs])
    for step in range(steps if len(nodes) > 1 else 0):
        move = np.zeros_like(pos)
        i, j = _near(pos, cell)
        d = pos[i] - pos[j]
        r = np.maximum(np.sqrt((d**2).sum(1)), 0.01)
        push = d / r[:, None] * np.maximum(cell - r, 0)[:, None] * 0.3
        np.add.at(move, i, push)
        np.add.at(move, j, -push)
        if len(pairs):
            d = pos[pairs[:, 0]] - pos[pairs[:, 1]]
            r = np.maximum(np.sqrt((d**2).sum(1)), 0.01)
            pull = d / r[:, None] * ((r - rest) * 0.1)[:, None]
            np.add.at(move, pairs[:, 0], -pull)
            np.add.at(move, pairs[:, 1], pull)
        pos += move * (1 - step / (2 * steps))
    return {name: tuple(map(float, pos[i])) for name, i in at.items()}


def layouts(edges: DataFrame, dims: int = 2) -> DataFrame:
    """scene, node, position (array<double>) of scenes' edges (scene, src, dst); a scene is one picture, laid out in one task."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(set(zip(pdf["src"].astype(str), pdf["dst"].astype(str), strict=True)))
        placed = force_layout(sorted({x for p in pairs for x in p}), pairs, dims=dims)
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "node": list(placed), "position": [list(v) for v in placed.values()]})

    return edges.select("scene", "src", "dst").groupBy("scene").applyInPandas(run, f"scene {edges.schema['scene'].dataType.simpleString()}, node string, position array<double>")


def node_radius(degree):
    return 0.5 * (1 + 0.55 * F.pow(degree, F.lit(1 / 3)))


def ci_flow(build: DataFrame) -> DataFrame:
    """path, node, column, row, kind, needs of a flow chart: targets in column 1, what a target needs without being one in column 0 (goals that nothing
    needs have a trigger there), steps from column 2 on. needs: the targets of column 1 that the node waits for, in their order. build: rows of build_observations; Fastfiles come before Makefiles."""
    targets = build.where("dependency is null and not pattern and tool in ('make', 'fastlane')")
    rank = F.when(F.col("tool") == "fastlane", 0).otherwise(1)
    rows = targets.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("target").alias("t"), F.col("steps").alias("s")))).alias("a")).select("path", F.posexplode("a").alias("row", "a"))
    lanes = rows.select("path", F.col("a.t").alias("node"), F.lit(1).alias("column"), "row", F.lit("target").alias("kind"))
    steps = rows.select("path", "row", F.posexplode("a.s").alias("i", "node")).select("path", "node", (F.col("i") + 2).alias("column"), "row", F.lit("step").alias("kind"))
    needed = build.where("dependency is not null").select("path", F.col("dependency").alias("node")).distinct()
    goals = lanes.join(needed, ["path", "node"], "left_anti").select("path", F.concat(F.lit("trigger:"), "node").alias("node"), F.lit(0).alias("column"), "row", F.lit("trigger").alias("kind"))
    targets_only = lanes.select("path", F.col("node").alias("dependency")).distinct()
    order = F.struct("position", "dependency")
    waits = build.where("dependency is not null").join(targets_only, ["path", "dependency"], "left_semi").groupBy("path", F.col("target").alias("node")).agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x["dependency"]).alias("needs"))
    none = F.array().cast("array<string>")
    return lanes.join(waits, ["path", "node"], "left").withColumn("needs", F.coalesce("needs", none)).unionByName(steps.withColumn("needs", none)).unionByName(goals.withColumn("needs", none))


def plan_chunks(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """blob_hash, ordinal, start, end, decl_key: chunks of files (blob_hash, text) with their declarations (blob_hash, key, start, end)."""
    listed = declarations.groupBy("blob_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "key"))).alias("decls"))
    prose = re.compile(r"\s*(//|/\*|\*|@|#)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for blob, text, decls in zip(pdf["blob_hash"], pdf["text"], pdf["decls"], strict=True):
                lines = (text or "").split("\n")
                lines = lines[:-1] if lines and lines[-1] == "" else lines
                found = [] if decls is None else [{"key": d["key"], "start": d["start"], "end": d["end"]} for d in decls]
                out += [(blob, c["ordinal"], c["start"], c["end"], c["decl_key"]) for c in chunk_plan(len(lines), found, {i for i, x in enumerate(lines, 1) if prose.match(x)})]
            yield pd.DataFrame(out, columns=["blob_hash", "ordinal", "start", "end", "decl_key"])

    return files.select("blob_hash", "text").join(listed, "blob_hash", "left").mapInPandas(run, "blob_hash string, ordinal int, start int, end int, decl_key string")


def wordpiece(text: str, vocabulary: dict[str, int], most: int = 512) -> list[int]:
    """Ids of [CLS] pieces [SEP], padded to `most`: accents folded, lower case, runs of letters and digits or single signs, greedy longest pieces."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    ids = []
    for word in re.findall(r"[^\W_]+|[^\s\w]|_", plain):
        at, pieces = 0, []
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                pieces = [vocabulary["[UNK]"]]
                break
            pieces.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        ids += pieces
    ids = [vocabulary["[CLS]"], *ids[: most - 2], vocabulary["[SEP]"]]
    return ids + [vocabulary["[PAD]"]] * (most - len(ids))


def _embed(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> np.ndarray:
        v = np.zeros(256, np.float32)
        for w in re.findall(r"[^\W_]+", (text or "").lower()):
            h = 0xCBF29CE484222325
            for b in w.encode():
                h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
            v[h % 256] += 1
        return v / (np.linalg.norm(v) or 1)

    return texts.map(one)


def hashed_embedding(text):
    """A 256-d bag of words by FNV-1a of lower-cased words, at length 1: the embedder of tests."""
    return F.pandas_udf(_embed, T.ArrayType(T.FloatType()), F.PandasUDFType.SCALAR)(text)
