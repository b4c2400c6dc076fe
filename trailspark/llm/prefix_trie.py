"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations
that start with it, and the smallest of them owns it. What a conversation owns is
a suffix of its path, since fewer members share a longer prefix. With k the first
depth that a conversation owns, the tokens that sharing saves below a node are,
over its members, all tokens of their turns from there on minus the tokens of
those that they own: the tokens of depths before k. So one group-by of prefixes,
once k is known, sums everything a node reports.

1. A turn is a SHA-256 digest and its number of code points; texts stay where
   they are. A walk along each conversation chains the digests, so a prefix is
   128 bits of a SHA-256, its parent the 128 bits before.
2. Owners are minima by prefix, counted map-side first (a window by prefix would
   bring all conversations of the root, or of a common first turn, to one task).
   Windows along each owner's nodes mark the first and the last one it owns.
3. Occurrences meet k by conversation; a window along the conversation adds what
   lies before k; the group-by of prefixes sums tokens, leaves and children.
4. The ids that end at a node are joined in blocks of ``BLOCK`` ids, so that a
   node where very many end moves and hashes in few long rows.

Null conv_id: of no conversation, left out. Null turns come first; equal turns
are ordered by role, then by digest; null role or text: empty; repeated rows are
turns of their own. A conversation without turns ends at the root. Empty table:
no nodes. The walk and the window hold one row of a conversation at a time (the
window spills), so a very long one costs time, not memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import written
from .lookup import looked_up

BLOCK = 4096
WALKED = "conv_id long, depth long, a long, b long, up_a long, up_b long, chars long, above long, is_last boolean"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, digest, chars``: each conversation's turns, numbered from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.length(text).cast("long").alias("chars"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return t.select("conv_id", F.row_number().over(order).cast("long").alias("at"), "digest", "chars")


def rebuilt(conversations: DataFrame, span: int = 100, most: int = 5) -> DataFrame:
    """Paths ``conv_id, part, at, digest, chars``, by part and number: h = crc32(id) % (most + 1) turns of the first conversation of ``span`` ids, then the own turns after h.

    Part -1 is a mark for every conversation, so that those without turns have a path.
    """
    own = written(turns(conversations))
    convs = own.groupBy("conv_id").count().select("conv_id", (F.col("conv_id") - F.col("conv_id") % span).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"))
    heads = own.where((F.col("conv_id") % span == 0) & (F.col("at") <= most)).select(F.col("conv_id").alias("base"), "at", "digest", "chars")
    borrowed = convs.where("conv_id <> base and h > 0").join(heads, "base").where("at <= h").select("conv_id", F.lit(0).alias("part"), "at", "digest", "chars")
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    kept = own.where((F.col("conv_id") % span == 0) | (F.col("at") > h)).select("conv_id", F.lit(1).alias("part"), "at", "digest", "chars")
    marks = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return borrowed.unionByName(kept).unionByName(marks)


def paths(conversations: DataFrame) -> DataFrame:
    """The same columns for conversations as they are."""
    own = turns(conversations)
    marks = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return own.select("conv_id", F.lit(1).alias("part"), "at", "digest", "chars").unionByName(marks.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("chars")))


def walked(path: DataFrame) -> DataFrame:
    """``WALKED``: one row for every prefix of every path; ``above``: code points before its last turn."""
    common.ship(path.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None  # of the path: id, depth, digest, parent's digest, code points of the turn, code points before it
        for batch in batches:
            rows: list[tuple] = []
            for i, part, digest, chars in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if at is not None:
                    rows.append((*at, part < 0))
                if part < 0:
                    at = (i, 0, hashlib.sha256(b"").digest(), b"", 0, 0)
                else:
                    at = (i, at[1] + 1, hashlib.sha256(at[2] + digest).digest(), at[2], chars, at[5] + at[4])
            if rows:
                yield packed(rows)
        if at is not None:
            yield packed([(*at, True)])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        i, depth, digest, up, chars, above, last = zip(*rows, strict=True)
        here, over = (np.frombuffer(b"".join(d[:16].ljust(16, b"\0") for d in x), np.int64).reshape(-1, 2) for x in (digest, up))
        return common.as_arrow(WALKED, {"conv_id": i, "depth": depth, "a": here[:, 0], "b": here[:, 1], "up_a": over[:, 0], "up_b": over[:, 1], "chars": chars, "above": above, "is_last": last})

    return path.select("conv_id", "part", "at", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").mapInArrow(run, WALKED)


def ends(walk: DataFrame) -> DataFrame:
    """``a, b, ends_sha256`` of the nodes at which conversations end."""
    blocks = walk.where("is_last").groupBy("a", "b", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if node == (a, b):
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["a", "b", "ends_sha256"])
                done = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], ["a", "b", "ends_sha256"])

    return blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(run, "a long, b long, ends_sha256 string")


def trie(path: DataFrame) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    walk = written(walked(path))
    nodes = written(
        walk.groupBy("a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.count_if("is_last").alias("n_ends"), F.min("depth").alias("depth"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"))
    )
    # along what a conversation owns: the first node and its parent, and whether the last one has no children
    along = Window.partitionBy("owner").orderBy("depth")
    marked = nodes.withColumn("is_first", F.row_number().over(along) == 1).withColumn("is_end", F.lead("depth").over(along).isNull())
    tops = written(
        marked.groupBy("owner").agg(
            F.max(F.when(F.col("is_first"), F.col("depth"))).alias("k"), F.max(F.when(F.col("is_first"), F.col("up_a"))).alias("a"), F.max(F.when(F.col("is_first"), F.col("up_b"))).alias("b"),
            F.max(F.when(F.col("is_end") & (F.col("n_ends") == F.col("n")), 1).otherwise(0)).alias("leaf"),
        )
    )
    total = nodes.agg(F.sum("n")).first()[0] or 0
    under = looked_up(tops.where("k > 0"), nodes.select("a", "b", F.col("owner").alias("above_owner"), "n"), ["a", "b"], ["above_owner"], "n", total)
    owned = under.select(F.col("owner").alias("conv_id"), "k", "leaf", "above_owner").unionByName(tops.where("k = 0").select(F.col("owner").alias("conv_id"), "k", "leaf", F.lit(None).cast("long").alias("above_owner")))
    met = walk.join(owned, "conv_id", "left")
    own = F.col("k").isNotNull() & (F.col("depth") >= F.col("k"))
    shared = F.sum(F.when(~own, F.col("chars")).otherwise(0)).over(Window.partitionBy("conv_id"))
    met = met.withColumn("saved", F.when(~own, shared - F.col("above")).otherwise(0))
    found = met.groupBy("a", "b").agg(
        F.max(F.when(own, F.col("conv_id"))).alias("conv_id"), F.max("depth").alias("depth"), F.max(F.when(own, F.when(F.col("depth") > F.col("k"), F.col("conv_id")).otherwise(F.col("above_owner")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"), F.count_if(~F.col("is_last") & F.col("k").isNotNull() & (F.col("depth") + 1 >= F.col("k"))).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    return found.join(ends(walk), ["a", "b"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
