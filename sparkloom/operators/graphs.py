"""Graph operators as joins over edge tables (src, dst); no graph is built on the driver.

Edges are counted first. Up to LOCAL_EDGES of them are walked by one task, as rounds of joins would
cost a job for each hop; more of them go by rounds, with the same result. Rounds are written
to the shared checkpoint folder, so plans stay short and rounds survive lost executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.rounds import cut

#: Edges that one task may hold: 16 bytes each and their adjacency.
LOCAL_EDGES = 1_000_000


def small(edges: DataFrame) -> bool:
    """Whether staged edges of whole-number nodes may go to one task."""
    whole = all(k in ("tinyint", "smallint", "int", "bigint") for k in (dict(edges.dtypes)["src"], dict(edges.dtypes)["dst"]))
    return whole and edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES


def walked(edges: DataFrame, walk: Callable[[np.ndarray, np.ndarray], tuple[list, list]], name: str, kind: str) -> DataFrame:
    """(node, name) that walk gives for the arrays of all edges' ends, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b.to_numpy(np.int64) for b in batches]
        both = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        nodes, values = walk(both[:, 0], both[:, 1])
        yield pd.DataFrame({"node": np.array(nodes, np.int64), name: np.array(values, np.int64)})

    return edges.select("src", "dst").repartition(1).mapInPandas(run, f"node {dict(edges.dtypes)['src']}, {name} {kind}")


def neighbours(src: np.ndarray, dst: np.ndarray) -> Callable[[int], list[int]]:
    """By a node, what its edges lead to."""
    order = np.argsort(src, kind="stable")
    keys, first = np.unique(src[order], return_index=True)
    lists = dict(zip(keys.tolist(), np.split(dst[order], first[1:]))) if len(keys) else {}
    return lambda n: lists[n].tolist() if n in lists else []


def walk_layers(src: np.ndarray, dst: np.ndarray) -> tuple[list, list]:
    """Nodes by the longest path to them, in the order in which they come free."""
    to = neighbours(src, dst)
    waits: dict[int, int] = dict.fromkeys(np.union1d(src, dst).tolist(), 0)
    for n, k in zip(*np.unique(dst, return_counts=True)):
        waits[int(n)] = int(k)
    layer = {n: 0 for n, k in waits.items() if k == 0}
    todo = list(layer)
    for n in todo:
        for m in to(n):
            waits[m] -= 1
            if waits[m] == 0:
                layer[m] = layer[n] + 1  # the last to come free is the farthest, as nodes are taken by layers
                todo.append(m)
    return list(layer), list(layer.values())


def walk_components(src: np.ndarray, dst: np.ndarray) -> tuple[list, list]:
    """Nodes of strongly connected components of two or more, with the least node: depth first, without recursion."""
    to = neighbours(src, dst)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    nodes, roots = [], []
    for start in np.unique(src).tolist():
        if start in index:
            continue
        work = [(start, iter(to(start)))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            n, rest = work[-1]
            for m in rest:
                if m not in index:
                    index[m] = low[m] = len(index)
                    stack.append(m)
                    on.add(m)
                    work.append((m, iter(to(m))))
                    break
                if m in on:
                    low[n] = min(low[n], index[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == index[n]:
                    found = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        found.append(m)
                        if m == n:
                            break
                    if len(found) > 1:
                        nodes += found
                        roots += [min(found)] * len(found)
    return nodes, roots


def walk_reach(starts: list[int], depth: int) -> Callable[[np.ndarray, np.ndarray], tuple[list, list]]:
    def walk(src: np.ndarray, dst: np.ndarray) -> tuple[list, list]:
        to = neighbours(src, dst)
        seen = dict.fromkeys(starts, 0)
        todo = list(seen)
        for n in todo:
            if depth and seen[n] >= depth:
                break
            for m in to(n):
                if m not in seen:
                    seen[m] = seen[n] + 1
                    todo.append(m)
        return list(seen), list(seen.values())

    return walk


def reach(edges: DataFrame, starts: DataFrame, depth: int = 0) -> DataFrame:
    """(node, distance) of all nodes reached from the starts (node), which have distance 0; depth 0 is unbounded."""
    e = cut(edges.select("src", "dst").distinct())
    few = starts.select("node").distinct().limit(LOCAL_EDGES + 1)
    if small(e) and few.count() <= LOCAL_EDGES and dict(starts.dtypes)["node"] in ("int", "bigint"):
        found = walked(e, walk_reach(sorted(r["node"] for r in few.where("node IS NOT NULL").collect()), depth), "distance", "int")
        return found.withColumn("node", F.col("node").cast(dict(starts.dtypes)["node"]))
    seen = cut(starts.select("node").distinct().withColumn("distance", F.lit(0)))
    front, hop = seen, 0
    while depth == 0 or hop < depth:
        hop += 1
        front = cut(front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(hop)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def blast_radius(edges: DataFrame, origin: DataFrame, depth: int = 0) -> DataFrame:
    """(node, distance) of what depends on the origin: reached against the edges, without the origin."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, origin, depth).where("distance > 0")


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path to each node of an acyclic graph; nodes on or behind a cycle have no row."""
    e = cut(edges.select("src", "dst").distinct())
    if small(e):
        return walked(e, walk_layers, "layer", "int")
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    left_edges, left = cut(edges.where("src != dst").distinct()), cut(nodes.join(edges.where("src = dst").select(F.col("src").alias("node")), "node", "left_anti"))
    done, layer = None, 0
    while True:
        free = cut(left.join(left_edges.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("layer", F.lit(layer)))
        if free.isEmpty():
            break
        done = free if done is None else cut(done.unionByName(free))
        left = cut(left.join(free.select("node"), "node", "left_anti"))
        left_edges = cut(left_edges.join(free.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
        layer += 1
    return done if done is not None else nodes.where("false").withColumn("layer", F.lit(0))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each strongly connected component of two nodes or more.

    Nodes without in- or out-edges are trimmed; then each node takes the least node that reaches
    it (its colour), and what reaches the colour's root backwards within the colour is a component;
    found components leave and the rest goes on.
    """
    e = cut(edges.where("src != dst").select("src", "dst").distinct())
    if small(e):
        return walked(e, walk_components, "component", dict(e.dtypes)["src"])
    out = None
    while True:
        while True:
            kept = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if kept.count() == e.count():
                break
            e = kept
        if e.isEmpty():
            break
        colour = cut(e.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            pushed = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min("colour").alias("new")).withColumnRenamed("dst", "node")
            new = cut(colour.join(pushed, "node", "left").select("node", "colour", F.least("colour", F.coalesce("new", "colour")).alias("best")))
            changed = new.where("best < colour").limit(1).count()
            colour = new.select("node", F.col("best").alias("colour"))
            if not changed:
                break
        same = cut(e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst"))
        found = reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour").select("node"))
        part = cut(colour.join(found.select("node"), "node", "left_semi").select("node", F.col("colour").alias("component")))
        out = part if out is None else cut(out.unionByName(part))
        gone = part.select("node")
        e = cut(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    empty = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    if out is None:
        return empty
    size = F.count(F.lit(1)).over(Window.partitionBy("component"))
    return out.withColumn("_n", size).where("_n > 1").drop("_n")


def simple_paths(edges: DataFrame, start, end, most_nodes: int = 8, most_paths: int = 10) -> DataFrame:
    """(path, nodes): simple paths from start to end of at most most_nodes nodes, the shortest first, then by path."""
    e = cut(edges.where("src != dst").select("src", "dst").distinct())
    kind = dict(e.dtypes)["src"]
    now = e.where(F.col("src") == F.lit(start)).select(F.array("src", "dst").alias("path"))
    found = now.where(F.element_at("path", -1) == F.lit(end))
    for _ in range(most_nodes - 2):
        open_ = now.where(F.element_at("path", -1) != F.lit(end)).withColumn("src", F.element_at("path", -1))
        now = cut(open_.join(e, "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array(F.col("dst").cast(kind))).alias("path")))
        found = found.unionByName(now.where(F.element_at("path", -1) == F.lit(end)))
        if now.isEmpty():
            break
    return found.withColumn("nodes", F.size("path")).orderBy("nodes", "path").limit(most_paths)


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(q): Newman's modularity of weighted undirected edges (a, b, w) under members (node, community); 1 without edges."""
    m = edges.agg(F.sum("w").alias("m"))
    j = edges.join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inner = j.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    ends = j.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    one = m.crossJoin(inner).crossJoin(ends)  # three single rows
    return one.select(F.when(F.coalesce("m", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("inner") / F.col("m") - F.col("k2") / (4 * F.col("m") * F.col("m"))).alias("q"))


def communities(edges: DataFrame, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """(node, community) by rounds of moves to the neighbouring community of most modularity gain.

    In a round only nodes of one hash parity move, so that neighbours do not swap places for ever;
    gain = weight to the community / m - resolution * degree of the community * own degree / (2 m^2).
    """
    both = cut(edges.where("a != b").select("a", "b", "w").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    degree = cut(both.groupBy("a").agg(F.sum("w").alias("k")))
    m = (degree.agg(F.sum("k")).first()[0] or 0.0) / 2
    state = cut(degree.select(F.col("a").alias("node"), F.col("a").alias("community"), "k"))
    for i in range(rounds if m else 0):
        total = state.groupBy("community").agg(F.sum("k").alias("tot"))
        links = both.join(state.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
        own = state.select("node", F.col("community").alias("old"), "k")
        choice = links.join(own, "node").join(total, "community")
        rest = F.col("tot") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0.0)
        gain = F.col("w") / m - resolution * rest * F.col("k") / (2 * m * m)
        best = choice.withColumn("gain", gain).groupBy("node").agg(F.max(F.struct("gain", (F.col("community") == F.col("old")).alias("stay"), (-F.col("community")).alias("c"))).alias("best"))
        moves = (F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2) & ~F.col("best.stay") & (F.col("best.gain") > 1e-12)
        new = cut(state.join(best, "node", "left").select("node", "community", F.when(moves, -F.col("best.c")).otherwise(F.col("community")).alias("now"), "k"))
        moved = new.where("now != community").count()
        state = new.select("node", F.col("now").alias("community"), "k")
        if not moved and i % 2:
            break
    return state.select("node", "community")


def blast_view(edges: DataFrame, origin: DataFrame, depth: int) -> DataFrame:
    """(kind, a, b, distance): a node row for the origin and each node that depends on it, and a link row for each edge among them."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = cut(reach(back, origin, depth))
    ends = nodes.select("node")
    links = edges.select("src", "dst").distinct().join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    none = F.lit(None)
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), none.cast("long").alias("b"), "distance").unionByName(links.select(F.lit("link").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), none.cast("int").alias("distance")))


def hyperedges(members: DataFrame, edge: str, node: str) -> DataFrame:
    """(src, dst): each hyperedge as a node of its own ("edge:" and its name) that leads to its members."""
    return members.select(F.concat(F.lit("edge:"), F.col(edge).cast("string")).alias("src"), F.col(node).alias("dst")).distinct()


def members_of(edges: DataFrame) -> DataFrame:
    """(edge, node) of hyperedges()."""
    return edges.where(F.col("src").startswith("edge:")).select(F.substring("src", 6, 1 << 30).cast("long").alias("edge"), F.col("dst").alias("node"))


def longest_path(edges: DataFrame) -> DataFrame:
    """(path): the longest path of an acyclic graph, of equal ones the first by its nodes; nodes on cycles or before them are left out."""
    e = cut(edges.where("src != dst").select("src", "dst").distinct())
    height = cut(layers(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    down = e.join(height.select(F.col("node").alias("src"), F.col("layer").alias("a")), "src").join(height.select(F.col("node").alias("dst"), F.col("layer").alias("b")), "dst").where("a = b + 1")
    step = cut(down.groupBy("src").agg(F.min("dst").alias("dst")))
    start = height.orderBy(F.desc("layer"), "node").limit(1).select("node")
    chain = reach(step, start)
    return chain.agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "node"))), lambda s: s["node"]).alias("path")).where(F.size("path") > 0)
