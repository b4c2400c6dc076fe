"""Filter interaction audit: a packed bitmap index, counted for every set of filters applied before.

Whether a document is kept, removed, or removed for a second reason by a filter
depends only on which filters ran before, not on their order. So 32 prefix sets
(80 pairs of a set and a next filter) answer all 120 orders.

Each partition packs its rows into uint64 words: one bitset a filter (failing
rows), one for either label, and one of the rows that are there. Rows lie by part
and parts begin at a word, so a part's bitset is the run of its words: work and
memory follow the rows, however many parts there are. AND-NOT of the failing rows
of a set gives its survivors; popcounts by run of words give a part's counts.
Spark adds the counts of all partitions, and 600 rows a part spell the orders out.

Duplicates are told by SHA-256: first ids by digest are counted map-side first;
rows meet them with common digests broadcast, so a text that a third of all rows
have is no larger a task. Only ids, digests and flags move, never texts.

Null text: empty (a text like any other). Null lang: the part "". Null doc_id:
neither a duplicate nor a first id. Repeated rows of an id count each and are not
each other's duplicates. Labels: of an id with several label rows any 1 counts;
null or missing is no 1. Empty table: no rows. Long texts are cut into words a
chunk at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import written
from .lookup import looked_up

FILTERS = "ABCDE"
#: Bytes of a text that are cut into words at a time; rows that are packed at a time.
CHUNK, ROWS = 1 << 20, 1 << 16
SPACE = re.compile(rb"[\x20\x09-\x0d]")
UPPER, MARKS, LATER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
COUNTS = "part string, before int, filter int, n_before long, removed long, good_lost long, toxic_lost long, fails long, unique_fails long"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``CHUNK`` bytes."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + CHUNK) if len(text) - at > CHUNK else None
        to = cut.end() if cut else len(text)
        yield text[at:to].split()
        at = to


def failing(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    n, distinct = 0, set()
    for some in words(text):
        n += len(some)
        distinct.update(some)
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, LATER))
    marked = len(text.translate(None, MARKS)) < len(text)
    return (n < 200) + 2 * (100 * len(distinct) < 50 * n) + 4 * (100 * upper > 3 * points) + 8 * marked


def flagged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every document, filters A to D in the mask."""
    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch.column(2).cast(pa.large_binary())
            each = [(hashlib.sha256(t).digest(), failing(t)) for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([e[0] for e in each], pa.binary()), pa.array([e[1] for e in each], pa.int32())], ["doc_id", "part", "digest", "mask"])

    return d.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def bitmap_counts(part: np.ndarray, mask: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """For rows with parts numbered from 0, each by (pair, part): the columns of ``COUNTS`` after the first three; pairs in the order of ``PAIRS``."""
    order = np.argsort(part, kind="stable")
    size = np.bincount(part)
    n_words = -(-size // 64)
    first = np.cumsum(n_words) - n_words  # of each part's run of words
    at = np.empty(len(part), np.int64)
    at[order] = np.arange(len(part)) + np.repeat(64 * first - (np.cumsum(size) - size), size)
    bits = np.zeros((len(FILTERS) + 3, 64 * int(n_words.sum())), bool)
    bits[0, at] = True
    for f in range(len(FILTERS)):
        bits[1 + f, at] = mask >> f & 1
    bits[-2, at], bits[-1, at] = good, toxic
    rows, *fails, g, t = packed(bits)
    survivors = [rows]
    for s in range(1, 1 << len(FILTERS)):
        low = (s & -s).bit_length() - 1
        survivors.append(survivors[s & (s - 1)] & ~fails[low])
    of_part = lambda words: np.add.reduceat(np.bitwise_count(words).astype(np.int64), first, axis=-1)
    every = (1 << len(FILTERS)) - 1
    before = np.stack([survivors[s] for s, _ in PAIRS])
    fail = np.stack([fails[f] for _, f in PAIRS])
    gone = before & fail
    alone = np.stack([survivors[every & ~(1 << f)] for _, f in PAIRS]) & fail
    return [of_part(x) for x in (before, gone, gone & g, gone & t, fail, alone)]


#: (set of filters that ran before, the next filter).
PAIRS = [(s, f) for s in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not s >> f & 1]


def prefix_counts(rows: DataFrame) -> DataFrame:
    """``COUNTS`` summed over all partitions of ``rows (part, mask, good, toxic)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                names = some.column(0).dictionary_encode()
                got = bitmap_counts(names.indices.to_numpy().astype(np.int64), *(some.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)))
                n = len(names.dictionary)
                yield common.as_arrow(COUNTS, {"part": names.dictionary.to_pylist() * len(PAIRS), "before": np.repeat([s for s, _ in PAIRS], n), "filter": np.repeat([f for _, f in PAIRS], n)} | dict(zip([c.split(" ")[0] for c in COUNTS.split(", ")][3:], (x.ravel() for x in got), strict=True)))

    return rows.mapInArrow(run, COUNTS).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("n_before", "removed", "good_lost", "toxic_lost", "fails", "unique_fails")])


def orders(spark) -> DataFrame:
    """``filter_order, step, before, filter``: 120 orders of five steps."""
    rows = [("".join(FILTERS[f] for f in o), k + 1, sum(1 << f for f in o[:k]), f) for o in itertools.permutations(range(len(FILTERS))) for k, f in enumerate(o)]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    flags = written(flagged(docs))
    firsts = written(flags.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    later = F.when(F.col("doc_id") > F.col("first_id"), 1 << FILTERS.index("E")).otherwise(0)
    rows = looked_up(flags, firsts, ["digest"], ["first_id"], "n", total).select("doc_id", "part", (F.col("mask") + later).alias("mask"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    told = rows.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    counts = prefix_counts(told.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
    # of the 120 orders, those in which just this set comes before this filter
    n = len(FILTERS)
    ways = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    counts = counts.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "filter")))
    return counts.join(F.broadcast(orders(docs.sparkSession)), ["before", "filter"]).select(
        "part", "filter_order", "step", (F.col("n_before") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
