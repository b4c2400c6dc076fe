"""Connected components of a distributed edge list, and written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def written(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared checkpoint folder; lineage is cut there."""
    spark = df.sparkSession
    common.ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked(pairs: DataFrame) -> tuple:
    """Rows, and 128 bits that tell tables of distinct pairs apart."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi")), F.bit_xor(F.xxhash64("hi", F.lit(7), "lo"))).first())


#: Edges that one task ties at a time, 16 bytes each.
EDGES = 1 << 19


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node that each reaches by these."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = lo < hi
        x, y = x[apart], y[apart]
        np.minimum.at(label, hi[apart], lo[apart])
        while (label[label] < label).any():
            label = label[label]
    return nodes, nodes[label]


def tied(pairs: DataFrame, most: int) -> DataFrame:
    """``lo, hi``: the same components by fewer pairs. A task ties ``most`` of its pairs at a time: every node to the least that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            node, least = least_reached(a, b)
            return pa.RecordBatch.from_arrays([pa.array(least[least < node]), pa.array(node[least < node])], ["lo", "hi"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield stars()
                held.clear()
        if held:
            yield stars()

    return pairs.mapInArrow(run, "lo long, hi long")


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """``node, label`` for every node of ``edges (a, b)``, numbers without nulls: the smallest node it reaches.

    Tasks tie their own edges first. Up to ``most`` pairs that are left go to one
    task, a bounded one; more alternate large-star and small-star steps until as
    few are left or nothing changes. Each round's table is written to the shared
    folder. Rounds grow with the logarithm of the largest component's diameter.
    Labels don't depend on ``most``.
    """
    pairs = written(tied(edges.where("a <> b").select(F.col("a").cast("long").alias("lo"), F.col("b").cast("long").alias("hi")), most))
    n = pairs.count()
    before = None
    while n > most:
        if before is None:
            pairs = written(pairs.distinct())
            before = marked(pairs)
        # large star: neighbours above a node join the least of its neighbourhood
        both = pairs.unionByName(pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))  # lo: centre, hi: neighbour
        least = both.groupBy("lo").agg(F.least(F.min("hi"), F.col("lo")).alias("m"))
        large = both.where("hi > lo").join(least, "lo").select(F.col("m").alias("lo"), F.col("hi")).where("lo <> hi").distinct()
        # small star: a node and its lower neighbours join the least of them
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e")).select("e.lo", "e.hi").where("lo <> hi").distinct()
        pairs = written(small)
        after = marked(pairs)
        # finished when nothing changes: every upper node has one label and no label is an upper node
        if after == before:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        before, n = after, after[0]
    if not n:
        return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    # one task takes all that is left in one go
    return written(tied(pairs.coalesce(1), most + 1)).select(F.col("hi").alias("node"), F.col("lo").alias("label"))
