"""Graphs as edge tables, walks over them, and tree kernels for the points of one track.

Relational parts are DataFrame operations. Trees of one track (a few hundred
points) are numpy in one Arrow group; the point cloud of a whole group never
goes to the driver.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; repeated edges stay and weigh in walks."""
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def adjacency(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_list("b")).alias("neighbours"))


def adjacency_text(arcs: DataFrame) -> DataFrame:
    """One line for each node: its id, then its neighbours."""
    return adjacency(arcs).select("node", F.concat_ws(" ", F.col("node").cast("string"), F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ")).alias("line"))


def branch_points(arcs: DataFrame) -> DataFrame:
    return degrees(arcs).where("degree > 2")


def expand(frontier: DataFrame, arcs: DataFrame) -> DataFrame:
    """Next steps of ``frontier (node, prev)`` without going back."""
    return frontier.join(arcs, frontier["node"] == arcs["a"]).where("prev is null or b <> prev").select(F.col("b").alias("node"), F.col("a").alias("prev"))


#: Layers of a search that are kept as tables of their own before they become one.
LAYERS = 16
#: Arcs of a partition of a search; larger graphs have more partitions, not larger ones.
ARCS = 1 << 19


def hop_distances(edges: DataFrame, start: int, most: int = ARCS) -> DataFrame:
    """``node, hops`` from a start node: breadth-first layers by joins until one is empty.

    Neighbours of a layer are in it, in the one before or in the next, so only two
    layers are held against the new nodes, however many there are. Arcs lie in as many
    partitions as there are times ``most`` of them, and pass a table of the layer's
    nodes unsorted, so what a task holds does not grow with the graph.
    """
    edges = _cut(edges.select("a", "b"))
    parts = sized(edges, 2 * edges.count(), most)
    arcs = _cut(undirected(edges).repartition(parts, "a", "b").distinct())
    layer = _cut(edges.sparkSession.createDataFrame([(start, 0)], "node long, hops long"))
    before, layers, h = layer, [layer], 0
    while True:
        h += 1
        near = layer.select("node").unionByName(before.select("node")).repartition(parts, "node")
        step = arcs.repartition(parts, "a").join(layer.repartition(parts, "node").hint("shuffle_hash"), F.col("a") == F.col("node"))
        new = step.select(F.col("b").alias("node")).distinct().repartition(parts, "node").join(near.hint("shuffle_hash"), "node", "left_anti")
        reached = _cut(new.withColumn("hops", F.lit(h).cast("long")))
        if reached.isEmpty():
            return reduce(DataFrame.unionByName, layers)
        layers.append(reached)
        if len(layers) > LAYERS:
            layers = [_cut(reduce(DataFrame.unionByName, layers).coalesce(arcs.rdd.getNumPartitions()))]
        before, layer = layer, reached


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or "/tmp/trailspark-checkpoints")
    return df.checkpoint()


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt by key over more than all shuffle partitions: groups that take long for their size should not be joined into few tasks.

    Of rows that lie by the key in as many partitions already, Spark leaves this step
    out and joins small ones, so the number is another.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *key)


def by_group(df: DataFrame, key: Sequence[str], run: Callable[[pa.Table], pa.Table], spec: str) -> DataFrame:
    """``run`` over the rows of each key, spread; Arrow tables, as groups are small and many."""
    return spread(df, *key).groupBy(*key).applyInArrow(run, spec)


def columns(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns of numbers side by side; unknown ones are NaN."""
    return np.stack([t[c].to_numpy().astype(float) for c in names], 1)


def keyed(t: pa.Table, key: Sequence[str], found: dict) -> pa.Table:
    """Columns of equal length beside the key of the group ``t``."""
    n = len(next(iter(found.values())))
    return pa.table({**{k: pa.array([t[k][0].as_py()] * n, t.schema.field(k).type) for k in key}, **found})


def sized(df: DataFrame, rows: int, most: int = ARCS) -> int:
    """Partitions that ``rows`` rows take, ``most`` in each; the session's number at least."""
    return max(-(-rows // most), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(nodes: DataFrame) -> DataFrame:
    """``node, idx``: places from 0 in ascending order, without bringing the nodes into one task: rows of a sorted partition count on from those before."""
    rows = _cut(nodes.select("node").orderBy("node")).select("node", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_r"))
    sizes = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}  # a row for each partition
    before, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    start = F.element_at(F.array(*(F.lit(o).cast("long") for o in offsets or [0])), F.col("_p") + 1)
    return rows.select("node", (start + F.col("_r")).alias("idx"))


class Tree:
    """An undirected graph over hashable nodes; edges keep their order of insertion."""

    def __init__(self):
        self.adj: dict = defaultdict(dict)

    @classmethod
    def of(cls, edges) -> Tree:
        t = cls()
        for a, b in edges:
            t.link(a, b)
        return t

    def link(self, a, b) -> None:
        self.adj[a][b] = self.adj[b][a] = True

    def drop(self, node) -> None:
        for other in self.adj.pop(node, {}):
            self.adj[other].pop(node, None)

    def walk(self, start) -> tuple[dict, object]:
        """Predecessors of all reachable nodes by hops, and the last of the farthest (the first one found)."""
        before, hops, far, queue = {start: None}, {start: 0}, start, deque([start])
        while queue:
            node = queue.popleft()
            for other in self.adj[node]:
                if other not in before:
                    before[other], hops[other] = node, hops[node] + 1
                    far = other if hops[other] > hops[far] else far
                    queue.append(other)
        return before, far

    def path(self, a, b) -> list:
        """Nodes from a to b by fewest hops; empty where there is no way."""
        before, _ = self.walk(a)
        out = [b] if b in before else []
        while out and out[-1] != a:
            out.append(before[out[-1]])
        return out[::-1]

    def is_tree(self) -> bool:
        if not self.adj:
            return False
        edges = sum(map(len, self.adj.values())) // 2
        return edges == len(self.adj) - 1 and len(self.walk(next(iter(self.adj)))[0]) == len(self.adj)

    def longest_path(self) -> list:
        """A diameter by hops, from its far end back."""
        if not self.adj:
            return []
        _, a = self.walk(next(iter(self.adj)))
        before, b = self.walk(a)
        out = [b]
        while before[out[-1]] is not None:
            out.append(before[out[-1]])
        return out

    def segments(self) -> list[list]:
        """Longest paths, peeled off one after the other: a path's nodes of two edges or fewer go, branch points stay for the paths that meet there.

        Nodes of one or two edges are in one path each, every node is in at least one.
        """
        rest = Tree()
        for a, others in self.adj.items():
            for b in others:
                rest.link(a, b)
        out = []
        while rest.adj:
            path = rest.longest_path()
            out.append(path)
            for node in [n for n in path if len(rest.adj[n]) <= 2]:
                rest.drop(node)
        return out


def split_segment(segment: Sequence, is_branch: Callable) -> list[list]:
    """Parts between points where ``is_branch`` holds, sharing them; runs of such points are dropped."""
    out, part = [], []
    for p in segment:
        part.append(p)
        if is_branch(p):
            if len(part) > 1 and not all(is_branch(q) for q in part):
                out.append(part)
            part = [p]
    if len(part) > 1:
        out.append(part)
    return out


#: Points up to which all distances of a group are held at once.
DENSE = 512


def _distances(points: np.ndarray) -> np.ndarray:
    return reduce(np.add, ((c[:, None] - c) ** 2 for c in np.ascontiguousarray(points.T)))


def _dense_tree(points: np.ndarray) -> list[tuple[int, int]]:
    """Prim over the places of all edges in their order, so no two are equal."""
    n = len(points)
    i, j = np.triu_indices(n, 1)  # by smaller, then larger index
    order = np.argsort(_distances(points)[i, j], kind="stable")
    i, j, far = i[order], j[order], len(order)
    place = np.full((n, n), far)
    place[i, j] = place[j, i] = np.arange(far)
    best, cur, edges = np.full(n, far), n - 1, []
    for _ in range(n - 1):
        place[:, cur] = far  # joined: no edge leads there
        np.minimum(best, place[cur], out=best)
        best[cur] = far
        cur = int(best.argmin())
        e = best[cur]
        edges.append((int(i[e] + j[e]) - cur, cur))
    return edges


def spanning_tree(points: np.ndarray) -> list[tuple[int, int]]:
    """Minimum spanning tree of distinct points by Prim, edges by (squared length, smaller index, larger index); in order of joining."""
    n = len(points)
    if n < 2:
        return []
    if n <= DENSE:
        return _dense_tree(points)
    name = lambda k, p: (min(k, p), max(k, p))
    axes = [np.ascontiguousarray(c) for c in points.T]
    best, parent = np.full(n, np.inf), np.full(n, -1)
    inside = np.zeros(n, bool)
    cur, edges = n - 1, []
    for _ in range(n - 1):
        inside[cur], best[cur] = True, np.inf
        d = reduce(np.add, ((c - c[cur]) ** 2 for c in axes))
        d[inside] = np.inf
        nearer = d < best
        for k in np.flatnonzero((d == best) & ~inside).tolist():  # a tie goes to the smaller name
            nearer[k] = name(k, cur) < name(k, int(parent[k]))
        best[nearer], parent[nearer] = d[nearer], cur
        least = np.flatnonzero(best == best.min()).tolist()
        cur = least[0] if len(least) == 1 else min(least, key=lambda k: name(k, int(parent[k])))
        edges.append((int(parent[cur]), cur))
    return edges


def _dense_cover(pts: np.ndarray, d: float) -> np.ndarray:
    near = _distances(pts) < d * d
    size, left, out = near.sum(1), np.ones(len(pts), bool), []
    while size[k := int(size.argmax())] > 1:
        members = np.flatnonzero(near[k] & left)
        out.append(pts[members].mean(0))
        left[members] = False
        size -= near[members].sum(0)
    # each of the rest is taken alone, in the order of the first points that reach them
    only = (near[size == 1] & left).argmax(1)
    _, first = np.unique(only, return_index=True)
    out.extend(pts[only[np.sort(first)]])
    return np.array(out)


def simplify(points: np.ndarray, d: float = 6.0) -> np.ndarray:
    """Greedy cover: the centre of mass of the largest remaining neighbourhood (nearer than ``d``), until all are covered.

    Points are taken as a set; of equally large neighbourhoods that of the smallest point comes first.
    """
    pts = np.unique(np.asarray(points, float), axis=0)
    if not len(pts):
        return pts
    if len(pts) <= DENSE:
        return _dense_cover(pts, d)
    # neighbours by grid cells of side d: only points of adjoining cells are compared
    cell = np.floor(pts / d).astype(np.int64)
    cells: dict[tuple, list[int]] = defaultdict(list)
    for k, c in enumerate(map(tuple, cell.tolist())):
        cells[c].append(k)
    near: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pts)
    for c, own in cells.items():
        around = np.sort(np.concatenate([cells[n] for o in product((-1, 0, 1), repeat=len(c)) if (n := tuple(a + b for a, b in zip(c, o, strict=True))) in cells]))
        for at in range(0, len(own), 256):  # some at a time: a cell may hold most points
            part = own[at : at + 256]
            hit = ((pts[part][:, None, :] - pts[around][None, :, :]) ** 2).sum(2) < d * d
            for k, h in zip(part, hit, strict=True):
                near[k] = around[h]
    size, left, out = np.array([len(n) for n in near]), np.ones(len(pts), bool), []
    while left.any():
        k = int(size.argmax())
        members = near[k][left[near[k]]]
        out.append(pts[members].mean(0))
        left[members] = False
        for m in members.tolist():
            size[near[m]] -= 1
    return np.array(out)
