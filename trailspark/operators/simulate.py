"""Random walkers on tissue graphs.

Every choice is a hash of (seed, walker, step), so results don't depend on
partitions or retries. Walkers are independent: they are rows dealt over tasks,
each with the graph as a broadcast after a check of its size. A larger graph goes
past the tasks of the walkers as a stream of lists of neighbours, which lie in a
file of the task while it walks; both ways give the same rows.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import _cut, numbered, undirected

#: Most arcs that are broadcast as adjacency lists.
BROADCAST_ARCS = 1_000_000
#: Lists of neighbours that a task keeps in memory beside its file, and walkers that share a file.
AHEAD, WALKERS = 512, 16
#: Fixed values of the coverage simulation: minutes, minutes of a step.
TOTAL_MINUTES, STEP_MINUTES = 2880.0, 0.1715
STEPS = int(TOTAL_MINUTES / STEP_MINUTES)
# Multiplier, increment and modulus of the portable step generator.
LCG = (1103515245, 12345, 1 << 31)


def lcg_steps(spark: SparkSession, arcs: DataFrame, walkers: int, steps: int, reverse: bool = False) -> DataFrame:
    """``walker, step, node``: walks by one join a step, from the node whose index is the walker's, with a portable generator.

    The next neighbour is entry ``state % n`` of the sorted neighbours; without
    ``reverse`` the node just left is no choice, but at a dead end. This form
    takes graphs of any size: nothing is broadcast, no task has all nodes, and
    lineage is cut at each step.
    """
    lists = _cut(arcs.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_list("b")).alias("next")))
    n = lists.count()
    mul, inc, mod = LCG
    cur = spark.range(walkers).select(F.col("id").alias("walker"), (F.col("id") % n).alias("idx")).join(numbered(lists), "idx").select("walker", "node", F.lit(None).cast("long").alias("prev"), ((F.col("walker") * 7919 + 1) % mod).alias("state"))
    out = cur.select("walker", F.lit(0).alias("step"), "node")
    for s in range(1, steps + 1):
        j = cur.join(lists, "node").withColumn("state", (F.col("state") * mul + inc) % mod)
        choices = F.col("next") if reverse else F.when(F.col("prev").isNull() | (F.size("next") == 1), F.col("next")).otherwise(F.array_except("next", F.array("prev")))
        j = j.withColumn("choices", choices)
        cur = j.select("walker", F.element_at("choices", (F.col("state") % F.size("choices") + 1).cast("int")).alias("nn"), F.col("node").alias("prev"), "state").select("walker", F.col("nn").alias("node"), "prev", "state")
        cur = _cut(cur)
        out = out.unionByName(cur.select("walker", F.lit(s).alias("step"), "node"))
    return out


@dataclass(frozen=True)
class Position:
    """A place on an edge: a share ``loc`` of the way from tail to head."""

    tail: int
    head: int
    loc: float


class Graph:
    """Weighted adjacency of an undirected graph."""

    def __init__(self, edges):
        self.adj: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in edges:
            self.adj.setdefault(a, []).append((b, w))
            self.adj.setdefault(b, []).append((a, w))
        for v in self.adj.values():
            v.sort()
        self.weight = {(a, b): w for a, v in self.adj.items() for b, w in v}
        self._around: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def moves(self, at: Position, d: float, depth: int = 64) -> list[tuple[Position, list[int]]]:
        """Every place ``d`` ahead without turning back, with the nodes passed.

        Less than what is left of the edge stays on it; exactly that much moves
        on. A dead end has no way on. Edges without length are passed at most
        ``depth`` deep.
        """
        out, stack = [], [(at, d, [])]
        while stack:
            p, rest, path = stack.pop()
            w = self.length(p)
            left = (1 - p.loc) * w
            if rest < left:
                out.append((Position(p.tail, p.head, p.loc + rest / w), path))
            elif len(path) < depth:
                stack += [(Position(p.head, n, 0.0), rest - left, [*path, p.head]) for n in reversed(self.around(p.head)[0].tolist()) if n != p.tail]
        return out

    def reverse(self, p: Position) -> Position:
        return Position(p.head, p.tail, 1 - p.loc)

    def around(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted neighbours and the weights of the edges to them."""
        if node not in self._around:
            v = self.adj[node]
            self._around[node] = np.array([b for b, _ in v], np.int64), np.array([self.weight[node, b] for b, _ in v], float)
        return self._around[node]

    def sizes(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many neighbours nodes have, and the least weight to one."""
        found = [self.around(n)[1] for n in nodes.tolist()]
        return np.array([len(w) for w in found], np.int64), np.array([w.min() for w in found], float)

    def length(self, p: Position) -> float:
        """Weight of the edge that a place is on."""
        b, w = self.around(p.tail)
        return float(w[b.searchsorted(p.head)])

    def beyond(self, node: int, tail: int, rest: float, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The neighbours but the tail, weights, and how many places lie ``rest`` behind the node by way of each.

        Neighbours whose edges are all longer than what is left are counted without their lists.
        """
        b, w = self.around(node)
        on = b != tail
        many = (on & (rest < w)).astype(np.int64)
        far = np.flatnonzero(on & (rest >= w)) if depth > 0 else np.empty(0, np.int64)
        if len(far):
            degree, least = self.sizes(b[far])
            short = rest - w[far] < least
            twins = b.searchsorted(b[far], "right") - b.searchsorted(b[far])
            many[far[short]] = (degree - twins)[short]
            for k in far[~short].tolist():
                many[k] = self.beyond(int(b[k]), node, float(rest - w[k]), depth - 1)[2].sum()
        return b[on], w[on], many[on]

    def ways(self, at: Position, d: float, depth: int = 64) -> int:
        """How many places ``moves`` gives."""
        left = (1 - at.loc) * self.length(at)
        return 1 if d < left else int(self.beyond(at.head, at.tail, d - left, depth - 1)[2].sum())

    def way(self, at: Position, d: float, k: int, depth: int = 64) -> Position:
        """The place that ``moves`` gives at index ``k``; places are counted, not listed."""
        w = self.length(at)
        left = (1 - at.loc) * w
        if d < left:
            return Position(at.tail, at.head, at.loc + d / w)
        node, tail, rest = at.head, at.tail, d - left
        while True:
            depth -= 1
            b, w, many = self.beyond(node, tail, rest, depth)
            before = np.cumsum(many)
            i = int(before.searchsorted(k, "right"))
            k -= int(before[i] - many[i])
            if rest < w[i]:
                return Position(node, int(b[i]), float(rest / w[i]))
            node, tail, rest = int(b[i]), node, float(rest - w[i])


class Filed(Graph):
    """A graph whose lists of neighbours lie in a file of this task; in memory are where they begin, their sizes and the last few read."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        """``node, next``, with or without weights ``far``: sorted neighbours of each node once."""
        self.file, at, found = tempfile.TemporaryFile(), 0, []
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                of, b = pc.list_value_length(part.column("next")).to_numpy().astype(np.int64), part.column("next").flatten().to_numpy()
                small = len(b) and b.min() >= 0 and b.max() < 1 << 32
                b = b.astype(np.uint32) if small else b.astype(np.int64)
                self.file.write(b)
                first = np.cumsum(of) - of
                size, least, weights = np.full(len(of), b.itemsize), np.zeros(len(of)), np.zeros(len(of), np.int64)
                if "far" in part.schema.names:
                    w = part.column("far").flatten().to_numpy().astype(float)
                    same = np.r_[False, b[1:] == b[:-1]]
                    same[first] = False
                    if same.any():  # of several edges between two nodes the longest counts
                        run = np.cumsum(~same) - 1
                        w = np.maximum.reduceat(w, np.flatnonzero(~same))[run]
                    self.file.write(w)
                    least, weights = np.minimum.reduceat(w, first), at + b.nbytes + first * 8
                found.append((part.column("node").to_numpy().astype(np.int64), of, at + first * size, size, weights, least))
                at += b.nbytes + (len(b) * 8 if "far" in part.schema.names else 0)
        self.file.flush()
        self.nodes, self.degree, self.at, self.size, self.weights, self.least = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64) for _ in range(6))
        order = self.nodes.argsort()
        self.nodes, self.degree, self.at, self.size, self.weights, self.least = (c[order] for c in (self.nodes, self.degree, self.at, self.size, self.weights, self.least))
        self._around = {}

    def read(self, at: int, n: int, kind: type) -> np.ndarray:
        """Numbers of the file; a read may give fewer bytes than asked for."""
        parts, size = [], n * np.dtype(kind).itemsize
        while size:
            parts.append(os.pread(self.file.fileno(), size, at))
            at, size = at + len(parts[-1]), size - len(parts[-1])
        return np.frombuffer(b"".join(parts), kind)

    def _list(self, node: int, weighted: bool) -> tuple:
        if (node, weighted) not in self._around:
            k = self.nodes.searchsorted(node)
            n = int(self.degree[k])
            b = self.read(int(self.at[k]), n, np.uint32 if self.size[k] == 4 else np.int64).astype(np.int64)
            if len(self._around) >= AHEAD:
                self._around.pop(next(iter(self._around)))
            self._around[node, weighted] = b, self.read(int(self.weights[k]), n, float) if weighted else None
        return self._around[node, weighted]

    def around(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        return self._list(node, True)

    def neighbours(self, node: int) -> np.ndarray:
        return self._list(node, False)[0]

    def sizes(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.nodes.searchsorted(nodes)
        return self.degree[k], self.least[k]


Uniform = Callable[[], float]


def uniforms(seed: int, walker: int, step: int) -> Uniform:
    """Numbers in [0, 1) of one walker's step, by counter."""
    state = [(seed * 0x9E3779B97F4A7C15 + walker * 0xBF58476D1CE4E5B9 + step * 0x94D049BB133111EB) & ((1 << 64) - 1)]

    def draw() -> float:
        state[0] = (state[0] + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
        x = state[0]
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
        x = (x ^ x >> 27) * 0x94D049BB133111EB & ((1 << 64) - 1)
        return ((x ^ x >> 31) >> 11) / (1 << 53)

    return draw


def normal(u: Uniform, mean: float, std: float) -> float:
    return mean + std * math.sqrt(-2 * math.log(1 - u())) * math.cos(2 * math.pi * u())


def pick(g: Graph, at: Position, u: Uniform, d: float, turned: bool = False) -> Position:
    """One of the places ``d`` ahead, or behind too, each path as likely as any other; a walker without a way on turns round where it is."""
    ahead, back = g.ways(at, d), g.ways(g.reverse(at), d) if turned else 0
    if not ahead + back:
        return g.reverse(at)
    k = int(u() * (ahead + back))
    return g.way(at, d, k) if k < ahead else g.way(g.reverse(at), d, k - ahead)


def brownian(g: Graph, at: Position, u: Uniform, d: float) -> Position:
    return pick(g, at, u, d, True)


def simple_forward(g: Graph, at: Position, u: Uniform, d: float, p: float) -> Position:
    at = g.reverse(at) if u() < p else at
    return pick(g, at, u, d)


def normal_mixture(g: Graph, at: Position, u: Uniform, turn: float, mix: float, m1: float, s1: float, m2: float, s2: float) -> Position:
    """Standard deviations, not variances."""
    m, s = (m1, s1) if u() < mix else (m2, s2)
    return simple_forward(g, at, u, abs(normal(u, m, s)), turn)


def single_normal(g: Graph, at: Position, u: Uniform, turn: float, m: float, s: float) -> Position:
    return normal_mixture(g, at, u, turn, 1.0, m, s, m, s)


MOVERS: dict[str, Callable] = {"brownian": brownian, "simple_forward": simple_forward, "normal_mixture": normal_mixture, "normal": single_normal}


def collected(edges: DataFrame, most: int = BROADCAST_ARCS) -> list[tuple[int, int, float]]:
    """The graph for a broadcast, after a check of its size."""
    n = edges.count()
    if 2 * n > most:
        raise ValueError(f"{n} edges are too many to send to every task; walk by joins (lcg_steps)")
    return [(r.a, r.b, float(r.weight)) for r in edges.select("a", "b", "weight").orderBy("a", "b").collect()]


def fits(edges: DataFrame, most: int | None) -> bool:
    """Whether the graph is broadcast: up to ``BROADCAST_ARCS``, or whatever is asked for."""
    return most is not None or 2 * edges.count() <= BROADCAST_ARCS


def filed(edges: DataFrame, cells: int, walk: Callable[[Filed, int], list], spec: str) -> DataFrame:
    """Rows ``walk(graph, cell)`` of walkers on a graph of any size, with or without a ``weight``.

    A walk can't be cut: each step depends on the one before, and on a connected graph
    leads anywhere. So lists of neighbours stream past each task of walkers, once for
    ``WALKERS`` of them, into a file beside it; the task holds no list but the last few.
    """
    weight = ["weight"] if "weight" in edges.columns else []
    arcs = edges.select("a", "b", *weight).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *weight))
    entry = F.struct("b", F.col("weight").cast("double").alias("w")) if weight else F.struct("b")
    lists = arcs.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_list(entry)).alias("next"))
    copies = max(1, min(-(-cells // WALKERS), edges.sparkSession.sparkContext.defaultParallelism))
    sent = lists.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "node", F.col("next.b").alias("next"), *([F.col("next.w").alias("far")] if weight else []))
    kinds = [pa.float64() if f.endswith("double") else pa.int64() for f in spec.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    copy.append(batch.column("copy")[0].as_py()) if not copy else None
                    yield batch

        g = Filed(seen())
        for cell in range(copy[0], cells, copies) if copy else ():
            yield pa.record_batch([pa.array(c, k) for c, k in zip(walk(g, cell), kinds, strict=True)], names=[f.split(" ")[0] for f in spec.split(", ")])

    return sent.repartitionById(copies, "copy").mapInArrow(run, spec)


def edges_at(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cell_id, a, b``: of edges in order of their ends, those at the places ``cell_id, idx``; only ends are sorted, not edges."""
    per = _cut(edges.groupBy("a").count().orderBy("a")).withColumn("_p", F.spark_partition_id())
    sizes = {r["_p"]: r["n"] for r in per.groupBy("_p").agg(F.sum("count").alias("n")).collect()}  # a row for each partition
    offsets = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0)))]).tolist()
    start = F.element_at(F.array(*(F.lit(o).cast("long") for o in offsets)), F.col("_p") + 1)
    per = per.select("a", "count", (start + F.sum("count").over(Window.partitionBy("_p").orderBy("a")) - F.col("count")).alias("_from"))
    hit = _cut(per.join(F.broadcast(wanted), (F.col("idx") >= F.col("_from")) & (F.col("idx") < F.col("_from") + F.col("count"))).select("cell_id", "a", (F.col("idx") - F.col("_from") + 1).cast("int").alias("_j")))
    ends = edges.join(F.broadcast(hit.select("a").distinct()), "a").groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("_b"))
    return hit.join(ends, "a").select("cell_id", "a", F.element_at("_b", F.col("_j")).alias("b"))


def places(spark: SparkSession, cells: int, n: int, first: Callable[[int], float]) -> DataFrame:
    """``cell_id, idx``: a place below ``n`` for each walker from its first draw."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"cell_id": pdf["id"], "idx": [int(first(c) * n) for c in pdf["id"].tolist()]})

    return spark.range(cells).mapInPandas(run, "cell_id long, idx long")


def simulate(edges: DataFrame, cells: int, iterations: int, mover: str | Callable = "brownian", params: tuple = (1.0,), seed: int = 0, most: int | None = None) -> DataFrame:
    """``iteration, cell_id, tail_id, head_id, edge_loc``: positions of independent walkers; iteration 0 is the start.

    ``most``: the graph is broadcast and has at most so many arcs; by default its size decides.
    """
    spark = edges.sparkSession
    move = MOVERS[mover] if isinstance(mover, str) else mover
    spec = "iteration long, cell_id long, tail_id long, head_id long, edge_loc double"

    def positions(g: Graph, cell: int, edge: Callable[[float], tuple[int, int]]) -> list[tuple]:
        u = uniforms(seed, cell, 0)
        a, b = edge(u())
        at = Position(a, b, u()) if u() < 0.5 else Position(b, a, u())
        rows = [(0, cell, at.tail, at.head, at.loc)]
        for k in range(1, iterations + 1):
            at = move(g, at, uniforms(seed, cell, k), *params)
            rows.append((k, cell, at.tail, at.head, at.loc))
        return rows

    edges = _cut(edges)
    if not fits(edges, most):
        first = edges_at(edges, places(spark, cells, edges.count(), lambda cell: uniforms(seed, cell, 0)()))
        start = {r.cell_id: (r.a, r.b) for r in first.collect()}  # two numbers a walker
        return filed(edges, cells, lambda g, cell: list(zip(*positions(g, cell, lambda _: start[cell]), strict=True)), spec)
    shared = spark.sparkContext.broadcast(collected(edges, BROADCAST_ARCS if most is None else most))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        listed = shared.value
        g = Graph(listed)
        for pdf in batches:
            for cell in pdf["id"].tolist():
                yield pd.DataFrame(positions(g, cell, lambda u: listed[int(u * len(listed))][:2]), columns=[f.split(" ")[0] for f in spec.split(", ")])

    return spark.range(cells).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, spec)


def walk_visits(edges: DataFrame, cells: int, steps: int = STEPS, seed: int = 0, most: int | None = None) -> DataFrame:
    """``cell_id, node, first_step``: distinct nodes of walkers that never turn back but at dead ends, the start at step 0."""
    spark = edges.sparkSession
    spec = "cell_id long, node long, first_step long"
    draw = lambda cell, n: np.random.Generator(np.random.Philox(key=np.array([seed, cell], np.uint64))).random(n)

    def visits(neighbours: Callable[[int], np.ndarray], cell: int, start: Callable[[float], int]) -> dict[int, int]:
        draws = draw(cell, steps + 1)
        node, prev = start(draws[0]), None
        seen = {node: 0}
        for k, x in enumerate(draws[1:].tolist(), 1):
            around = neighbours(node)
            if prev is None or len(around) == 1:
                nxt = around[int(x * len(around))]
            else:
                i = int(x * (len(around) - 1))
                nxt = around[i + (i >= around.searchsorted(prev))]
            node, prev = int(nxt), node
            seen.setdefault(node, k)
        return seen

    edges = _cut(edges.select("a", "b"))
    if not fits(edges, most):

        def walk(g: Filed, cell: int) -> list:
            seen = visits(g.neighbours, cell, lambda u: int(g.nodes[int(u * len(g.nodes))]))
            return [[cell] * len(seen), list(seen), list(seen.values())]

        return filed(edges, cells, walk, spec)
    shared = spark.sparkContext.broadcast(collected(edges.withColumn("weight", F.lit(1.0)), BROADCAST_ARCS if most is None else most))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        adj = {k: np.array([n for n, _ in v], np.int64) for k, v in Graph(shared.value).adj.items()}
        nodes = sorted(adj)
        for pdf in batches:
            for cell in pdf["id"].tolist():
                seen = visits(adj.get, cell, lambda u: nodes[int(u * len(nodes))])
                yield pd.DataFrame({"cell_id": cell, "node": list(seen), "first_step": list(seen.values())})

    return spark.range(cells).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, spec)


def coverage_sweep(edges: DataFrame, start: int, stop: int, step: int, steps: int = STEPS, seed: int = 0) -> DataFrame:
    """``graph_size, cells, coverage`` for swarms of each size: one set of walks, as walker k is the same in every swarm."""
    sizes = list(range(start, stop + 1, step))
    # the first swarm that a node's earliest walker belongs to
    visits = walk_visits(edges, max(sizes, default=0), steps, seed).groupBy("node").agg(F.min("cell_id").alias("cell"))
    n = undirected(edges).select("a").distinct().count()
    grid = edges.sparkSession.createDataFrame([(s,) for s in sizes], "cells long")
    return grid.join(F.broadcast(visits.groupBy("cell").agg(F.count("*").alias("new"))), F.col("cell") < F.col("cells"), "left").groupBy("cells").agg(F.sum(F.coalesce("new", F.lit(0))).alias("coverage")).select(F.lit(n).cast("long").alias("graph_size"), "cells", "coverage")


def xyz(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Positions in space: ``tail + edge_loc (head - tail)`` from node coordinates ``id, x, y, z``."""
    a = nodes.select(F.col("id").alias("tail_id"), *(F.col(c).alias(f"_a{c}") for c in "xyz"))
    b = nodes.select(F.col("id").alias("head_id"), *(F.col(c).alias(f"_b{c}") for c in "xyz"))
    d = positions.join(a, "tail_id").join(b, "head_id")
    return d.select(*positions.columns, *((F.col(f"_a{c}") + F.col("edge_loc") * (F.col(f"_b{c}") - F.col(f"_a{c}"))).alias(c) for c in "xyz"))
