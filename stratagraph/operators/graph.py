"""Graph algorithms as loops of joins. Long loops write their state to the shared folder every few steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; on a local master without it, a temporary folder that goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="stratagraph-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighborhood(edges: DataFrame, origin: DataFrame, depth: int | None, directed: bool = False) -> DataFrame:
    """node, distance within depth hops of the origins (column node); depth None goes on until nothing is new."""
    hops = edges.select("src", "dst").distinct() if directed else undirected(edges)
    if depth is None:
        return _reached(settled(hops), origin, directed)
    seen = front = origin.select("node").distinct().withColumn("distance", F.lit(0))
    for step in range(1, depth + 1):
        new = front.join(hops, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(step))
        seen = seen.unionByName(new)
        front = new
    return seen


#: A front of at most so many rows is sent to the edges; beyond, both are shuffled. Levels that are read as one table before they are written as one.
FRONT_ROWS, LEVELS = 50_000, 16


def _reached(hops: DataFrame, origin: DataFrame, directed: bool) -> DataFrame:
    """node, distance of all that the origins reach over hops (src, dst; settled, as each step reads them). A level is written once. What a step finds is held against the
    levels before: where edges go both ways, against the last two, as nothing farther back is next to the front."""
    front = settled(origin.select("node").distinct().withColumn("distance", F.lit(0)))
    known, last, rows, step = [front], [front], front.count(), 0
    while rows:
        step += 1
        near = F.broadcast(front.select("node")) if rows <= FRONT_ROWS else front.select("node")
        new = hops.join(near, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = settled(new.join(_together(known if directed else last).select("node"), "node", "left_anti").withColumn("distance", F.lit(step)))
        rows, front, last = new.count(), new, [front, new]
        if rows:
            known.append(new)
        if len(known) > LEVELS:
            known = [settled(_together(known))]
    return _together(known)


def _together(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole


def touched_edges(edges: DataFrame, near: DataFrame, depth: int) -> DataFrame:
    """Edges incident to a node that a neighborhood of that depth expanded."""
    inner = near.where(F.col("distance") < depth).select("node")
    return edges.join(inner, F.col("src") == F.col("node"), "left_semi").unionByName(edges.join(inner, F.col("dst") == F.col("node"), "left_semi")).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, seeds: DataFrame | None = None) -> DataFrame:
    """node, rank after a fixed number of iterations. edges: src, dst, weight (at least 1e-4 counts); unknown endpoints are ignored,
    parallel edges add up, self loops stay. Dangling mass and restarts go to the seeds (all nodes without any)."""
    nodes = nodes.select("node").distinct()
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    known = known.groupBy("src", "dst").agg(F.sum(F.greatest("weight", F.lit(1e-4))).alias("w"))
    out = known.groupBy("src").agg(F.sum("w").alias("total"))
    share = settled(known.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    chosen = nodes if seeds is None else nodes.join(seeds.select("node").distinct(), "node", "left_semi")
    n = chosen.count()
    if n == 0:
        chosen, n = nodes, nodes.count()
    base = nodes.join(chosen.withColumn("restart", F.lit(1.0 / max(1, n))), "node", "left").na.fill(0.0, ["restart"])
    base = settled(base.join(out.select(F.col("src").alias("node"), F.lit(True).alias("flows")), "node", "left"))
    state = base.select("*", F.col("restart").alias("rank"))
    for _ in range(iterations):
        arrived = state.join(share, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        dangling = state.agg(F.coalesce(F.sum(F.when(F.col("flows").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        rank = (1 - damping + damping * F.col("lost")) * F.col("restart") + damping * F.coalesce("got", F.lit(0.0))
        state = state.drop("rank").join(arrived, "node", "left").join(F.broadcast(dangling)).select("node", "restart", "flows", rank.alias("rank"))  # dangling is one row
        state = settled(state)  # three readers a step: without the cut the plan would grow threefold
    return state.select("node", "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: ends of edges at the node (a self edge counts twice)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def roles(edges: DataFrame, threshold: int = 2) -> DataFrame:
    """node, fan_in, fan_out, role by distinct neighbours without self edges: Core, Hub, Entry or Leaf."""
    e = edges.where("src <> dst")
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("fan_in"))
    out = e.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("fan_out"))
    both = into.join(out, "node", "full").na.fill(0, ["fan_in", "fan_out"])
    i, o = F.col("fan_in") >= threshold, F.col("fan_out") >= threshold
    return both.select("node", "fan_in", "fan_out", F.when(i & o, "Hub").when(i, "Core").when(o, "Entry").otherwise("Leaf").alias("role"))


def strong_components(edges: DataFrame, group: str | None = None) -> DataFrame:
    """node, component (its least node) of the strongly connected components; nodes of edges only, self edges ignored. group: a column of edges, where
    no node is in two groups; the result is the same without it.

    First the component of the busiest node (of each group): what it reaches and what reaches it. The rest by forward colouring: each node takes the least
    label that reaches it; a colour's root and what reaches the root within the colour is a component. Components found leave the graph, and so do nodes
    without edges on one side.
    """
    of = F.lit(0) if group is None else F.col(group)
    rest = settled(edges.where("src <> dst").select("src", "dst", of.alias("g")).distinct())
    done = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("component", F.col("node"))
    found = None
    ends = rest.groupBy("g", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o")).join(rest.groupBy("g", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i")), ["g", "node"])
    busiest = settled(ends.groupBy("g").agg(F.max_by("node", F.struct(F.col("o") * F.col("i"), "node")).alias("node")))  # a row a group
    if not busiest.isEmpty():
        ahead = _reached(rest, busiest, True).select("node")
        back = _reached(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")), busiest, True).select("node")
        both = settled(ahead.join(back, "node", "left_semi"))
        if group is None:
            part = both.join(F.broadcast(both.agg(F.min("node").alias("component"))))  # one row
        else:
            placed = both.join(rest.select(F.col("src").alias("node"), "g").distinct(), "node").unionByName(busiest.select("node", "g").join(both, "node", "left_semi")).distinct()
            part = placed.join(placed.groupBy("g").agg(F.min("node").alias("component")), "g").select("node", "component")
        found = settled(part)
        gone = found.select("node")
        rest = settled(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    else:
        rest = rest.select("src", "dst")
    while not rest.isEmpty():
        while True:  # nodes without a way in or a way out are components of their own
            trimmed = settled(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            same = trimmed.count() == rest.count()
            rest = trimmed
            if same:
                break
        if rest.isEmpty():
            break
        colour = rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node"))
        while True:
            passed = colour.join(rest, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            nxt = settled(colour.join(passed, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
            colour, moved = nxt.select("node", "colour"), nxt.where("moved").isEmpty()
            if moved:
                break
        inner = rest.join(colour.withColumnsRenamed({"node": "src", "colour": "sc"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "dc"}), "dst").where("sc = dc").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = colour").select("node")
        reached = neighborhood(inner, roots, None, directed=True).select("node")
        part = settled(colour.join(reached, "node", "left_semi").withColumnRenamed("colour", "component"))
        found = part if found is None else found.unionByName(part)
        rest = settled(rest.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if found is None:
        return done
    return done.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _knots(edges: pa.Table) -> pa.Table:
    """node, component (any of its nodes) of the strong components of two nodes at least of one block's edges (src, dst): Tarjan's, with a stack of its own."""
    both = pa.concat_arrays([c for name in ("src", "dst") for c in edges[name].chunks]).dictionary_encode()
    codes, n = both.indices.to_numpy(), len(both.dictionary)
    src, dst = codes[: len(codes) // 2], codes[len(codes) // 2 :]
    order = np.argsort(src, kind="stable")
    heads, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, number, low, part, open_, count = first[:], [0] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        way = [] if number[root] else [root]
        while way:
            v = way[-1]
            if not number[v]:
                count += 1
                number[v] = low[v] = count
                open_.append(v)
            if at[v] < first[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if not number[w]:
                    way.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            way.pop()
            if low[v] == number[v]:
                while part[v] < 0:
                    part[open_.pop()] = v
            elif way:
                low[way[-1]] = min(low[way[-1]], low[v])
    part = np.array(part, dtype=np.int64)
    several = np.flatnonzero(np.bincount(part, minlength=n)[part] > 1)
    return pa.table({"node": both.dictionary.take(pa.array(several)), "component": both.dictionary.take(pa.array(part[several]))})


def relabelled(edges: DataFrame, components: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges with the columns a and b: the components of their ends, or the ends themselves that have none."""
    for end, name in ((src, "a"), (dst, "b")):
        edges = edges.join(components.select(F.col("node").alias(end), F.col("component").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
    return edges


#: Edges of a block that one task searches.
BLOCK_ROWS = 250_000


def knots(edges: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """node, component (one of its nodes, which may be without a row) of the strong components of two nodes at least.

    A search level by level takes as many steps as the graph is wide. So nodes are first cut, in their order, into blocks of about `rows` edges; what is strongly
    connected within a block is so in the graph, and becomes one node. That is repeated as long as it halves the edges, and the graph that is left is searched whole.
    """
    rest, found = settled(edges.where("src <> dst").select("src", "dst").distinct()), None
    size = rest.count()
    while size:
        blocks = -(-size // rows)
        cuts = rest.select("src").repartitionByRange(blocks, "src").groupBy(F.spark_partition_id().alias("p")).agg(F.min("src").alias("least")).collect()  # a row a block
        bounds = F.array(*(F.lit(r.least) for r in cuts))
        block = lambda end: F.size(F.filter(bounds, lambda b: b <= F.col(end)))  # noqa: B023, E731
        kind = rest.schema["src"].dataType.simpleString()
        tied = settled(rest.withColumn("block", block("src")).where(F.col("block") == block("dst")).groupBy("block").applyInArrow(_knots, f"node {kind}, component {kind}"))
        found = tied if found is None else _renamed(found, tied)
        rest = settled(relabelled(rest, tied).where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        before, size = size, rest.count()
        if blocks == 1 or size > before / 2:
            break
    if found is None:
        return rest.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return _renamed(found, strong_components(rest).where("node <> component")) if size and blocks > 1 else found


def _renamed(found: DataFrame, onto: DataFrame) -> DataFrame:
    """found (node, component) after its components, and other nodes, became part of those of `onto` (node, component)."""
    onto = settled(onto)
    moved = found.join(onto.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return settled(moved.unionByName(onto.join(found, "node", "left_anti").select("node", "component")))


def reached_masks(hops: DataFrame, start: DataFrame) -> DataFrame:
    """node, mask: in which of some graphs the start (node, mask) reaches a node, itself included. hops: src, dst, mask (settled): a bit for each graph that has the edge."""
    front = settled(start.select("node", "mask"))
    known, rows = [front], front.count()
    upto = lambda: _together(known).groupBy("node").agg(F.bit_or("mask").alias("mask"))
    while rows:
        near = front.withColumnsRenamed({"node": "src", "mask": "m"})
        got = hops.join(F.broadcast(near) if rows <= FRONT_ROWS else near, "src").select(F.col("dst").alias("node"), F.col("mask").bitwiseAND(F.col("m")).alias("mask")).where("mask <> 0").groupBy("node").agg(F.bit_or("mask").alias("mask"))
        front = settled(got.join(upto().withColumnRenamed("mask", "old"), "node", "left").select("node", F.expr("mask & ~coalesce(old, 0)").alias("mask")).where("mask <> 0"))
        rows = front.count()
        if rows:
            known.append(front)
        if len(known) > LEVELS:
            known = [settled(upto())]
    return settled(upto())


def cyclic_masks(edges: DataFrame, n: int) -> DataFrame:
    """src, dst, mask: in which of n graphs (62 at most) an edge lies within a strong component, or leads from a node to itself; not those for which it is none. edges: src,
    dst, mask (settled, one row an edge): a bit for each graph that has it.

    All graphs are searched at once. What is strongly connected by edges that all have is so in each, and becomes one node; then the busiest node's component is found in all
    graphs by masks, and edges without a way in or a way out lose those bits. Only the edges that then are left are searched with a row for each graph.
    """
    joined = settled(relabelled(edges, knots(edges.where(F.col("mask") == (1 << n) - 1))))
    inside, across = joined.where("a = b").select("src", "dst", "mask"), joined.where("a <> b")
    g = settled(across.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.bit_or("mask").alias("mask")))
    bits = F.sum(F.bit_count("mask"))
    busy = g.groupBy(F.col("src").alias("node")).agg(bits.alias("o")).join(g.groupBy(F.col("dst").alias("node")).agg(bits.alias("i")), "node")
    pivot = settled(busy.agg(F.max_by("node", F.struct(F.col("o") * F.col("i"), "node")).alias("node")).where("node is not null").withColumn("mask", F.lit((1 << n) - 1).cast("long")))  # one row
    if pivot.isEmpty():
        return inside
    ahead, back = reached_masks(g, pivot), reached_masks(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "mask"), pivot)
    held = ahead.join(back.withColumnRenamed("mask", "m"), "node").select("node", F.col("mask").bitwiseAND(F.col("m")).alias("mask")).where("mask <> 0")
    ends = g.join(held.select(F.col("node").alias("src"), F.col("mask").alias("s")), "src", "left").join(held.select(F.col("node").alias("dst"), F.col("mask").alias("d")), "dst", "left").na.fill(0, ["s", "d"])
    ends = settled(ends.select("src", "dst", F.expr("mask & s & d").alias("cyclic"), F.expr("mask & ~(s | d)").alias("mask")))
    found, rest = ends.where("cyclic <> 0").select("src", "dst", F.col("cyclic").alias("mask")), ends.where("mask <> 0").select("src", "dst", "mask")
    size = rest.agg(bits).first()[0] or 0
    while size:
        into, out = rest.groupBy(F.col("dst").alias("src")).agg(F.bit_or("mask").alias("i")), rest.groupBy(F.col("src").alias("dst")).agg(F.bit_or("mask").alias("o"))
        rest = settled(rest.join(into, "src").join(out, "dst").select("src", "dst", F.expr("mask & i & o").alias("mask")).where("mask <> 0"))
        before, size = size, rest.agg(bits).first()[0] or 0
        if size > 0.9 * before:
            break
    if size:
        each = rest.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bit"), "mask").where("mask & shiftleft(1L, bit) <> 0")
        key = lambda end: F.concat_ws("|", "bit", end).alias(f"k{end}")
        keyed = settled(each.select("src", "dst", "bit", key("src"), key("dst")))
        parts = relabelled(keyed, strong_components(keyed.select(F.col("ksrc").alias("src"), F.col("kdst").alias("dst"), "bit"), "bit"), "ksrc", "kdst")
        found = found.unionByName(parts.where("a = b").groupBy("src", "dst").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))
    same = found.groupBy("src", "dst").agg(F.bit_or("mask").alias("m")).withColumnsRenamed({"src": "a", "dst": "b"})
    return inside.unionByName(across.join(same, ["a", "b"]).select("src", "dst", F.col("mask").bitwiseAND(F.col("m")).alias("mask")).where("mask <> 0"))


def cyclic_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct edges within a component of several nodes, and self edges."""
    e = edges.select("src", "dst").distinct()
    joined = e.join(components.withColumnsRenamed({"node": "src", "component": "a"}), "src").join(components.withColumnsRenamed({"node": "dst", "component": "b"}), "dst")
    return joined.where("a = b").select("src", "dst")


def shortest_path_edges(edges: DataFrame, start, goal, most: int = 500) -> DataFrame:
    """Edges (src, dst, position) on any shortest directed path from start to goal, the `most` first by position, src and dst; empty if there is none or start is
    the goal.

    Two fronts walk towards one another, the smaller one a step at a time, and stop where they meet, so what is read is near the two ends. From the nodes where
    they meet the levels are walked back: each keeps the edges that lead one level nearer to its end.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    hops = edges.select("src", "dst").distinct()
    sides = {}
    for name, end in (("ahead", start), ("back", goal)):
        first = settled(spark.range(1).select(F.lit(end).cast(kind).alias("node"), F.lit(0).alias("distance")))
        sides[name] = {"seen": first, "front": first, "size": 1, "depth": 0, "levels": [first], "hops": hops if name == "ahead" else hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    ahead, back = sides["ahead"], sides["back"]
    none = hops.select("src", "dst", F.lit(0).alias("position")).limit(0)
    if not ahead["front"].join(back["front"], "node", "left_semi").isEmpty():
        return none
    while True:
        s, other = (ahead, back) if ahead["size"] <= back["size"] else (back, ahead)
        s["depth"] += 1
        new = s["front"].join(s["hops"], F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(s["seen"], "node", "left_anti")
        s["front"] = settled(new.withColumn("distance", F.lit(s["depth"])))
        s["size"] = s["front"].count()
        if not s["size"]:
            return none  # one side has been walked through without meeting the other
        s["levels"].append(s["front"])
        s["seen"] = s["seen"].unionByName(s["front"])
        meet = s["front"].select("node").join(other["front"].select("node"), "node", "left_semi")
        if not meet.isEmpty():
            break
    met = settled(meet)
    found = None
    for side, turn in ((ahead, False), (back, True)):
        on = met
        for depth in range(side["depth"], 0, -1):
            level = side["hops"].join(on.select(F.col("node").alias("dst")), "dst", "left_semi").join(side["levels"][depth - 1].select(F.col("node").alias("src")), "src", "left_semi")
            level = settled(level.select("src", "dst"))
            on = level.select(F.col("src").alias("node")).distinct()
            placed = level.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(ahead["depth"] + back["depth"] - depth).alias("position")) if turn else level.select("src", "dst", F.lit(depth - 1).alias("position"))
            found = placed if found is None else found.unionByName(placed)
    return found.orderBy("position", "src", "dst").limit(most)


def ancestor_of(parents: DataFrame, wanted: Column) -> DataFrame:
    """node, ancestor: the nearest node upward (itself first), however far, for which `wanted` (over column node) holds. parents: child, parent, one a child.

    Pointers are doubled, so the rounds are the logarithm of the depth. A node without such an ancestor, or whose way up runs into a cycle without one,
    has no row.
    """
    marked = parents.select(F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("ok", wanted)
    up = marked.where("not ok").join(parents, F.col("node") == F.col("child")).select("node", F.col("parent").alias("at"))
    up = up.join(marked.select(F.col("node").alias("at"), "ok"), "at").select("node", "at", "ok")
    state = settled(marked.where("ok").select("node", F.col("node").alias("at"), "ok").unionByName(up))
    return _doubled(state).where("ok").select("node", F.col("at").alias("ancestor"))


def _doubled(state: DataFrame) -> DataFrame:
    """state (node, at, ok), one row a node, after every pointer that is not ok was followed until it is, leads nowhere (its row goes) or runs in a cycle."""
    rounds, most = 0, None
    while not state.where("not ok").isEmpty():
        rounds += 1
        if rounds > 6:  # only chains of over 64 and cycles come here: 2 ** rounds steps reach the end of any chain of the nodes there are
            most = state.count().bit_length() if most is None else most
            if rounds > most + 1:
                break
        onward = state.select(F.col("node").alias("n"), F.col("at").alias("next"), F.col("ok").alias("there"))
        moved = state.where("not ok").join(onward, F.col("at") == F.col("n")).select("node", F.col("next").alias("at"), F.col("there").alias("ok"))
        state = settled(state.where("ok").unionByName(moved))
    return state


def containment(parents: DataFrame) -> DataFrame:
    """ancestor, node, hops of every node below another one. parents: child, parent; of several parents the least counts. Nodes whose way up runs into a cycle are
    left out. By doubling: the pairs of up to 2k hops are those of up to k, and those of k hops followed by those."""
    one = settled(parents.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("at")))
    tops = one.select("at").distinct().join(one.select(F.col("node").alias("at")), "at", "left_anti")
    reach = one.join(tops.withColumn("top", F.lit(True)), "at", "left").select("node", "at", F.col("top").isNotNull().alias("ok"))
    jump = settled(_doubled(settled(reach)).where("ok").select("node").join(one, "node"))
    closed, k = jump.select("node", F.col("at").alias("ancestor"), F.lit(1).alias("hops")), 1
    while True:
        onward = settled(jump.join(jump.select(F.col("node").alias("at"), F.col("at").alias("next")), "at").select("node", F.col("next").alias("at")))
        if k > 1 or not onward.isEmpty():
            below = closed.select(F.col("node").alias("at"), "ancestor", (F.col("hops") + k).alias("hops"))
            closed = settled(closed.unionByName(jump.join(below, "at").select("node", "ancestor", "hops")))
        if onward.isEmpty():
            return closed.select("ancestor", "node", "hops")
        jump, k = onward, 2 * k


def tree_rows(parents: DataFrame, labels: DataFrame) -> DataFrame:
    """node, parent, depth, path (labels from the root) of a containment forest, level by level: rows, not nested values, however deep.

    parents: child, parent; labels: node, label. A node that several parents hold has one row, under the nearest of them (the least where
    several are near), so a graph with many ways down has as many rows as nodes. Nodes that no root reaches (cycles) are left out.
    """
    kind = labels.schema["node"].dataType
    level = labels.join(parents.select(F.col("child").alias("node")), "node", "left_anti").select("node", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"), F.array("label").alias("path"))
    below = settled(parents.select("parent", F.col("child").alias("node")).join(labels, "node"))  # read at each level
    level = settled(level)
    known, found, rows, depth = [level.select("node")], [level], level.count(), 0
    while rows:
        depth += 1
        above = level.select(F.col("node").alias("parent"), "path")
        down = below.join(F.broadcast(above) if rows <= FRONT_ROWS // 10 else above, "parent").groupBy("node").agg(F.min_by(F.struct("parent", "path", "label"), "parent").alias("p"))
        down = down.join(_together(known), "node", "left_anti")
        level = settled(down.select("node", "p.parent", F.lit(depth).alias("depth"), F.array_append("p.path", F.col("p.label")).alias("path")))
        rows = level.count()
        if rows:
            found.append(level)
            known.append(level.select("node"))
        if len(known) > LEVELS:
            known = [settled(_together(known))]
        if len(found) > 4 * LEVELS:
            found = [settled(_together(found))]
    return _together(found)


def outline(parents: DataFrame, labels: DataFrame) -> DataFrame:
    """node, child, label: the outline as a DAG. Each node's children once, sorted by label where they are shown; edges that close a cycle
    are cut (an edge from a node to one that is not deeper than itself). Nothing is expanded, so shared parts cost their rows once."""
    named = labels.select("node")
    e = settled(parents.select(F.col("parent").alias("src"), F.col("child").alias("dst")).distinct().join(named.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    roots = named.join(parents.select(F.col("child").alias("node")), "node", "left_anti")
    depth = settled(_reached(e, roots, True).select("node", F.col("distance").alias("depth")))
    e = e.select(F.col("src").alias("node"), F.col("dst").alias("child")).join(depth, "node").join(depth.withColumnsRenamed({"node": "child", "depth": "below"}), "child").where("below > depth")
    return e.join(labels.withColumnRenamed("node", "child"), "child").select("node", "child", "label")


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) both ends of which are in nodes (node)."""
    keep = nodes.select("node").distinct()
    return edges.join(keep, F.col("src") == F.col("node"), "left_semi").join(keep, F.col("dst") == F.col("node"), "left_semi")


BLAST_KINDS = ("refersToSymbol", "references", "imports", "declares")


def blast_radius(edges: DataFrame, origin: DataFrame, depth: int = 2) -> DataFrame:
    """node, distance, rank of what is within `depth` hops of the origins (node) over BLAST_KINDS, most central first for the origins:
    PageRank personalised on them, over the touched edges, a reference counting as often as it is made (weight) plus one.

    edges: src, dst, kind, weight.
    """
    over = edges.where(F.col("kind").isin(*BLAST_KINDS))
    near = settled(neighborhood(over, origin, depth))
    touched = settled(edges_among(touched_edges(over, near, depth), near))
    ranks = pagerank(near, touched.select("src", "dst", (F.abs("weight") + 1).cast("double").alias("weight")), seeds=origin)
    return near.join(ranks, "node")
