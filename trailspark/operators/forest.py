"""Graphs of many keys at once, by rounds of joins: components, spanning forests, diameters of trees.

Every round, each component picks its least edge to another one. Edges are totally
ordered, so picks form trees in which just one pair of components picks each other;
pointers along picks are doubled until they end at a root, and edges are renamed by
roots. Components at least halve, so rounds and doublings grow with the logarithm,
and a key with very many nodes is spread like many keys with few.

Spanning trees of points find their edges by grid cells. At radius r, points meet
where their cells of side r adjoin, which finds all pairs nearer than r; pairs of
one component need not meet, so only points whose surroundings hold another
component take part. When no such pair is left the radius doubles, for keys that
still have several components. Edges by (squared length, smaller point, larger
point) have just one minimum spanning tree, whoever finds it.

A null key is a key. Self-loops and repeated edges are ignored. Lineage is cut at
every round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Tree, _cut, by_group, columns, keyed, spanning_tree

#: Points of a key up to which one task spans them; results do not depend on it.
LOCAL = 2000
AXES = ("x", "y", "z")


def same(key: Sequence[str], *pairs: tuple) -> list:
    """Join conditions between ``l`` and ``r``, null keys meeting each other."""
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key] + [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in pairs])


def rooted(picks: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, comp, root`` from ``key, comp, to``: where each component's picks end."""
    back = picks.select(*key, F.col("comp").alias("to"), F.col("to").alias("back"))
    up = picks.alias("l").join(back.alias("r"), same(key, ("to", "to")), "left").select(*[f"l.{k}" for k in key], "l.comp", F.when((F.col("r.back") == F.col("l.comp")) & (F.col("l.comp") < F.col("l.to")), F.col("l.comp")).otherwise(F.col("l.to")).alias("root"))
    up, held = up.persist(), []
    while True:
        held.append(up)
        over = up.alias("l").join(up.select(*key, F.col("comp").alias("root"), F.col("root").alias("above")).alias("r"), same(key, ("root", "root")), "left")
        up = over.select(*[f"l.{k}" for k in key], "l.comp", F.coalesce("r.above", "l.root").alias("root"), (F.coalesce(F.col("r.above") != F.col("l.root"), F.lit(False))).alias("moved")).persist()
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    out = _cut(up.drop("moved"))
    for df in [*held, up]:
        df.unpersist()
    return out


def contracted(edges: DataFrame, key: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(picked edges, ``key, node, comp`` of all nodes) of ``edges (key, a, b, order...)`` between components a < b; ``order`` tells edges apart.

    The component is the smallest of its nodes where ``order`` begins with the
    nodes' own numbers; otherwise just one of them.
    """
    nodes = _cut(edges.select(*key, F.explode(F.array("a", "b")).alias("node")).distinct().select(*key, "node", F.col("node").alias("comp")))
    left, picked = _cut(edges.where("a <> b")), []
    while not left.isEmpty():
        both = left.select(*key, F.col("a").alias("comp"), F.struct(*order).alias("o"), F.col("b").alias("to")).unionByName(left.select(*key, F.col("b").alias("comp"), F.struct(*order).alias("o"), F.col("a").alias("to")))
        best = _cut(both.groupBy(*key, "comp").agg(F.min(F.struct("o", "to")).alias("m")).select(*key, "comp", "m.o", "m.to"))
        picked.append(best.select(*key, "o.*").distinct())
        roots = rooted(best.select(*key, "comp", "to"), key)
        named = lambda df, c: df.alias("l").join(roots.alias("r"), same(key, (c, "comp")), "left").select(*[F.coalesce("r.root", f"l.{c}").alias(c) if n == c else F.col(f"l.{n}") for n in df.columns])  # noqa: B023, E731
        nodes = _cut(named(nodes, "comp"))
        renamed = named(named(left, "a"), "b").where("a <> b")
        least, most = F.least("a", "b"), F.greatest("a", "b")
        # of the edges between two components only the least can be picked
        left = _cut(renamed.groupBy(*key, least.alias("a"), most.alias("b")).agg(F.min(F.struct(*order)).alias("o")).select(*key, "a", "b", "o.*"))
    return (reduce(DataFrame.unionByName, picked) if picked else edges.select(*key, *order).limit(0)), nodes


def components(edges: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """``key, node, comp`` of every node of ``edges (key, a, b)``: nodes are of one component where they have one number there."""
    e = edges.select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return contracted(e.withColumns({"lo": F.col("a"), "hi": F.col("b")}), key, ("lo", "hi"))[1]


def forest_sizes(edges: DataFrame, key: Sequence[str], local: int = LOCAL) -> DataFrame:
    """``key, nodes, edges, is_tree``: a tree is connected and has one edge less than nodes (self-loops aside).

    Keys of at most ``local`` edges are walked by one task each, others by rounds.
    """
    e = _cut(edges.select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    counts = e.groupBy(*key).agg(F.count("*").alias("edges"))
    nodes = e.select(*key, F.explode(F.array("a", "b")).alias("node")).groupBy(*key).agg(F.count_distinct("node").alias("nodes"))
    part = lambda c: e.alias("l").join(counts.where(c).alias("r"), same(key), "left_semi")
    kinds = dict(e.dtypes)

    def walk(pdf):
        import pandas as pd

        tree = Tree.of(zip(pdf["a"], pdf["b"], strict=True))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in key), int(len(tree.walk(pdf["a"].iloc[0])[0]) == len(tree.adj))]], columns=[*key, "whole"])

    found = part(f"edges <= {local}").groupBy(*key).applyInPandas(walk, ", ".join(f"{k} {kinds[k]}" for k in key) + ", whole int")
    if not counts.where(f"edges > {local}").isEmpty():
        found = found.unionByName(components(part(f"edges > {local}"), key).groupBy(*key).agg((F.min("comp") == F.max("comp")).cast("int").alias("whole")))
    both = counts.alias("l").join(nodes.alias("r"), same(key)).select(*[f"l.{k}" for k in key], "nodes", "edges").alias("l").join(found.alias("r"), same(key)).select(*[f"l.{k}" for k in key], "nodes", "edges", "whole")
    return both.withColumn("is_tree", (F.col("whole") == 1) & (F.col("edges") == F.col("nodes") - 1)).drop("whole")


def diameters(trees: DataFrame, key: Sequence[str], local: int = LOCAL) -> DataFrame:
    """``key, hops``: the longest path of every tree of ``trees (key, a, b)``; keys of at most ``local`` edges are walked by one task each, others contracted."""
    e = _cut(trees.where("a <> b").select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    size = e.groupBy(*key).agg(F.count("*").alias("n"))
    kinds = dict(e.dtypes)

    def walk(pdf):
        import pandas as pd

        return pd.DataFrame([[*(pdf[k].iloc[0] for k in key), len(Tree.of(zip(pdf["a"], pdf["b"], strict=True)).longest_path()) - 1]], columns=[*key, "hops"])

    part = lambda c: e.alias("l").join(size.where(c).alias("r"), same(key), "left_semi")
    near = part(f"n <= {local}").groupBy(*key).applyInPandas(walk, ", ".join(f"{k} {kinds[k]}" for k in key) + ", hops long")
    return near if size.where(f"n > {local}").isEmpty() else near.unionByName(contracted_diameters(part(f"n > {local}"), key))


def contracted_diameters(trees: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same by raking leaves and compressing chains.

    A node holds the longest way into what was raked onto it (``h``), an edge the
    chain it stands for: its length, the longest ways into what hung on it from
    either end (``ia``, ``ib``), and both the longest path seen so far (``best``).
    A round rakes all leaves, then takes out nodes of two edges whose hash is a
    local minimum; both together leave a constant share, so rounds grow with the
    logarithm of the nodes.
    """
    zero = F.lit(0).cast("long")
    e = _cut(trees.where("a <> b").select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumns({"len": F.lit(1).cast("long"), "ia": zero, "ib": zero, "best": zero}))
    h = _cut(e.select(*key, F.explode(F.array("a", "b")).alias("node")).distinct().withColumns({"h": zero, "best": zero}))
    ks, done = [F.col(k) for k in key], []
    rounds = 0
    while not e.isEmpty():
        rounds += 1
        arcs = e.select(*ks, F.col("a").alias("node"), F.col("b").alias("to"), "len", F.col("ia").alias("near"), F.col("ib").alias("far"), "best").unionByName(
            e.select(*ks, F.col("b").alias("node"), F.col("a").alias("to"), "len", F.col("ib").alias("near"), F.col("ia").alias("far"), "best")
        )
        degree = arcs.groupBy(*key, "node").agg(F.count("*").alias("degree"), F.min("to").alias("one"), F.max("to").alias("two"))
        state = _cut(h.alias("l").join(degree.alias("r"), same(key, ("node", "node"))).select(*[f"l.{k}" for k in key], "l.node", "l.h", "l.best", "degree", "one", "two"))
        # leaves; of a tree that is one edge the larger node is the leaf
        leaf = state.where("degree = 1").select(*key, F.col("node").alias("leaf"), "h", F.col("best").alias("seen"))
        at = arcs.alias("l").join(leaf.alias("r"), same(key, ("node", "leaf"))).select(*[f"l.{k}" for k in key], "l.node", "l.to", "l.len", "l.near", "l.far", "l.best", "r.h", "r.seen")
        ends = state.where("degree = 1").select(*key, F.col("node").alias("other"))
        at = _cut(at.alias("l").join(ends.alias("r"), same(key, ("to", "other")), "left").where("other is null or node > to").select(*[f"l.{k}" for k in key], "l.node", "l.to", "l.len", "l.near", "l.far", "l.best", "l.h", "l.seen"))
        way = F.greatest(F.col("far"), F.col("len") + F.col("h"))  # from the other end
        seen = F.greatest("best", "seen", F.col("near") + F.col("h"))
        brought = at.select(*key, F.col("to").alias("node"), way.alias("way"), seen.alias("seen")).groupBy(*key, "node").agg(F.max("seen").alias("seen"), F.slice(F.sort_array(F.collect_list("way"), asc=False), 1, 2).alias("ways"))
        first, second = F.element_at("ways", 1), F.coalesce(F.try_element_at("ways", F.lit(2)), zero)
        joined = state.alias("l").join(brought.alias("r"), same(key, ("node", "node")), "left").select(*[f"l.{k}" for k in key], "l.node", "l.h", "l.best", "r.seen", "r.ways")
        grown = joined.select(*key, "node", F.greatest("h", F.coalesce(first, zero)).alias("h"), F.greatest("best", F.coalesce("seen", zero), F.when(F.col("ways").isNotNull(), F.greatest(first + second, first + F.col("h")))).alias("best"))
        gone = at.select(*key, "node")
        h = _cut(grown.alias("l").join(gone.alias("r"), same(key, ("node", "node")), "left_anti"))
        left = e.alias("l").join(gone.alias("r"), same(key, ("a", "node")), "left_anti").alias("l").join(gone.alias("r"), same(key, ("b", "node")), "left_anti")
        left = _cut(left)
        # chains: of the nodes with two edges those whose hash is below that of both neighbours, if these have two as well
        arcs = left.select(*ks, F.col("a").alias("node"), F.col("b").alias("to"), "len", F.col("ia").alias("near"), F.col("ib").alias("far"), "best").unionByName(
            left.select(*ks, F.col("b").alias("node"), F.col("a").alias("to"), "len", F.col("ib").alias("near"), F.col("ia").alias("far"), "best")
        )
        inner = arcs.groupBy(*key, "node").agg(F.count("*").alias("degree"), F.min("to").alias("one"), F.max("to").alias("two")).where("degree = 2 and one <> two")
        lot = lambda c: F.xxhash64(F.lit(rounds), F.col(c))  # noqa: B023, E731
        order = lambda c: F.struct(lot(c), F.col(c))
        rivals = inner.select(*key, F.explode(F.array("one", "two")).alias("node"), F.col("node").alias("rival")).alias("l").join(inner.select(*key, "node").alias("r"), same(key, ("node", "node"))).select(*[f"l.{k}" for k in key], "l.node", "l.rival").where(order("rival") < order("node")).select(*key, "node")
        out = inner.select(*key, "node").alias("l").join(rivals.alias("r"), same(key, ("node", "node")), "left_anti")
        out = _cut(out.alias("l").join(h.alias("r"), same(key, ("node", "node"))).select(*[f"l.{k}" for k in key], "l.node", "r.h", F.col("r.best").alias("seen")))
        spans = arcs.alias("l").join(out.alias("r"), same(key, ("node", "node"))).select(*[f"l.{k}" for k in key], "l.node", "h", "seen", F.struct("l.to", "l.len", "l.near", "l.far", "l.best").alias("arc"))
        two = spans.groupBy(*key, "node", "h", "seen").agg(F.min("arc").alias("p"), F.max("arc").alias("q"))
        new = two.select(
            *ks, F.col("p.to").alias("a"), F.col("q.to").alias("b"), (F.col("p.len") + F.col("q.len")).alias("len"),
            F.greatest("p.far", F.col("p.len") + F.col("h"), F.col("p.len") + F.col("q.near")).alias("ia"), F.greatest("q.far", F.col("q.len") + F.col("h"), F.col("q.len") + F.col("p.near")).alias("ib"),
            F.greatest("p.best", "q.best", "seen", F.col("p.near") + F.col("q.near"), F.col("h") + F.col("p.near"), F.col("h") + F.col("q.near")).alias("best"),
        )
        rest = left.alias("l").join(out.select(*key, "node").alias("r"), same(key, ("a", "node")), "left_anti").alias("l").join(out.select(*key, "node").alias("r"), same(key, ("b", "node")), "left_anti")
        e = _cut(rest.unionByName(new))
        h = _cut(h.alias("l").join(out.select(*key, "node").alias("r"), same(key, ("node", "node")), "left_anti"))
        # trees of which one node is left are finished
        open_ = e.select(*key).distinct()
        done.append(_cut(h.alias("l").join(open_.alias("r"), same(key), "left_anti").groupBy(*key).agg(F.max("best").alias("hops"))))
        h = _cut(h.alias("l").join(open_.alias("r"), same(key), "left_semi"))
    return reduce(DataFrame.unionByName, done) if done else trees.select(*key, zero.alias("hops")).limit(0)


def by_rounds(points: DataFrame, key: str) -> DataFrame:
    """``key, lo, hi``: the spanning tree of each key's distinct points ``(key, id, x, y, z)``, ids in order of the points."""
    n = F.count("*").alias("n")
    size = points.groupBy(key).agg(n, *[(F.max(c) - F.min(c)).alias(f"_{c}") for c in AXES])
    # about the distance of neighbours if points lay evenly along the longest side
    r = F.greatest(*[F.col(f"_{c}") for c in AXES]) / F.pow(F.col("n"), F.lit(1 / 3)) / 2
    left = _cut(points.join(size.where("n > 1").select(key, r.alias("r")), key).withColumn("comp", F.col("id")))
    tree = []
    while not left.isEmpty():
        cells = [F.floor(F.col(c) / F.col("r")).cast("long").alias(f"_{c}") for c in AXES]
        placed = left.select("*", *cells)
        names = [f"_{c}" for c in AXES]
        around = F.explode(F.array(*[F.struct(*[(F.col(c) + F.lit(o)).alias(c) for c, o in zip(names, step, strict=True)]) for step in product((-1, 0, 1), repeat=3)]))
        # cells whose surroundings hold several components
        held = placed.groupBy(key, *names).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        mixed = held.select(key, around.alias("c"), "lo", "hi").groupBy(key, "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select(key, "c.*")
        near = placed.join(mixed, [key, *names], "left_semi")
        far = near.select(key, F.col("id").alias("id2"), F.col("comp").alias("comp2"), *[F.col(c).alias(f"{c}2") for c in AXES], around.alias("c")).select(key, "id2", "comp2", *[f"{c}2" for c in AXES], "c.*")
        d2 = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in AXES])
        pairs = near.join(far, [key, *names]).where("comp < comp2").withColumn("d2", d2).where("d2 < r * r")
        lo, hi = F.least("id", "id2"), F.greatest("id", "id2")
        edges = pairs.groupBy(key, F.col("comp").alias("a"), F.col("comp2").alias("b")).agg(F.min(F.struct("d2", lo.alias("lo"), hi.alias("hi"))).alias("m")).select(key, "a", "b", "m.*")
        picked, named = contracted(_cut(edges), [key], ("d2", "lo", "hi"))
        tree.append(_cut(picked.select(key, "lo", "hi")))
        moved = left.alias("l").join(named.alias("r"), same([key], ("comp", "node")), "left").select(*[F.coalesce("r.comp", "l.comp").alias("comp") if c == "comp" else F.col(f"l.{c}") for c in left.columns])
        moved = _cut(moved)
        several = moved.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(key)
        left = _cut(moved.join(several, key, "left_semi").withColumn("r", F.col("r") * 2))
    return reduce(DataFrame.unionByName, tree) if tree else points.select(key, F.col("id").alias("lo"), F.col("id").alias("hi")).limit(0)


def spanning_trees(points: DataFrame, key: str = "track_id", local: int = LOCAL) -> DataFrame:
    """``key, ax, ay, az, bx, by, bz``: the minimum spanning tree of each key's distinct points, smaller end first.

    Points without a key or a coordinate are left out. Keys of at most ``local`` points
    are spanned by one task each, larger ones by rounds.
    """
    p = points.where(" and ".join(f"{c} is not null" for c in (key, *AXES))).select(key, *[F.col(c).cast("double").alias(c) for c in AXES]).distinct()
    p = _cut(p.orderBy(key, *AXES)).withColumn("id", F.monotonically_increasing_id())
    size = p.groupBy(key).agg(F.count("*").alias("n"))
    small, large = (p.alias("l").join(size.where(c).alias("r"), same([key]), "left_semi") for c in (f"n <= {local}", f"n > {local}"))
    spec = f"{key} {dict(points.dtypes)[key]}, ax double, ay double, az double, bx double, by double, bz double"

    def run(t: pa.Table) -> pa.Table:
        at = columns(t.sort_by("id"), AXES)
        edges = np.array(spanning_tree(at), int).reshape(-1, 2)
        return keyed(t, [key], {f"{end}{c}": at[pick(edges, 1), k] for end, pick in (("a", np.min), ("b", np.max)) for k, c in enumerate(AXES)})

    near = by_group(small, [key], run, spec)
    if size.where(f"n > {local}").isEmpty():
        return near
    ends = by_rounds(large, key)
    for c, to in (("lo", "a"), ("hi", "b")):
        ends = ends.join(large.select(key, F.col("id").alias(c), *[F.col(x).alias(f"{to}{x}") for x in AXES]), [key, c])
    return near.unionByName(ends.select(key, "ax", "ay", "az", "bx", "by", "bz"))
