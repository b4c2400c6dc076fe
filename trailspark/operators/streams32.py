"""Streams of 32-bit random numbers: a permuted congruential generator (64-bit state, xorshift and rotation), one stream a row.

A stream is told by a seed and a sequence number, both taken modulo 2**64. Draws
come in chunks: the generator jumps ahead in log(n) steps, so a long stream
spreads over tasks and no task walks through the draws of another. All streams of
a batch advance together in numpy.

A null seed or sequence counts as 0; repeated rows get equal numbers. Negative
numbers of draws give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the generator: multiplier, and bits of the output function.
MULTIPLIER = 6364136223846793005
CHUNK = 4096
SPEC = "stream long, draw long, value long"


def seeded(seed: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and increment of each stream: one step from 0, the seed added, one step more."""
    with np.errstate(over="ignore"):
        inc = (sequence.astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        return (inc + seed.astype(np.uint64)) * np.uint64(MULTIPLIER) + inc, inc


def ahead(state: np.ndarray, inc: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """States after so many steps, by squaring the step."""
    with np.errstate(over="ignore"):
        mul, add = np.full(len(state), MULTIPLIER, np.uint64), inc.copy()
        left = steps.astype(np.uint64).copy()
        while left.any():
            odd = (left & np.uint64(1)).astype(bool)
            state = np.where(odd, state * mul + add, state)
            add = add * mul + add
            mul = mul * mul
            left >>= np.uint64(1)
        return state


def output(state: np.ndarray) -> np.ndarray:
    """The 32-bit number of a state."""
    mixed = ((state >> np.uint64(18) ^ state) >> np.uint64(27)).astype(np.uint32)
    turn = (state >> np.uint64(59)).astype(np.uint32)
    return mixed >> turn | mixed << (-turn.astype(np.int64) & 31).astype(np.uint32)


def draws(state: np.ndarray, inc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` numbers of each stream, by row, and the states after them."""
    out = np.empty((len(state), n), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n):
            out[:, k] = output(state)
            state = state * np.uint64(MULTIPLIER) + inc
    return out, state


def bounded(state: int, inc: int, bound: int) -> tuple[int, int]:
    """A number below ``bound`` without bias (numbers under 2**32 mod bound are drawn again), and the state after it."""
    if bound < 1:
        raise ValueError("no number is below the bound")
    least = (1 << 32) % bound
    s, i = np.array([state], np.uint64), np.array([inc], np.uint64)
    while True:
        out, s = draws(s, i, 1)
        if int(out[0, 0]) >= least:
            return int(out[0, 0]) % bound, int(s[0])


def streams(df: DataFrame, n: int, key: str = "stream", seed: str = "seed", sequence: str = "sequence") -> DataFrame:
    """``stream, draw, value``: the first ``n`` numbers of each row's stream."""
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"), F.lit(CHUNK).cast("long")))
    parts = df.select(F.col(key).cast("long").alias("stream"), whole(seed).alias("seed"), whole(sequence).alias("sequence"), first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, i = seeded(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)))
            at = batch.column(3).to_numpy(zero_copy_only=False)
            s = ahead(s, i, at)
            for to in range(0, batch.num_rows, 256):
                rows = slice(to, to + 256)
                out, _ = draws(s[rows], i[rows], min(CHUNK, n))
                draw = at[rows][:, None] + np.arange(out.shape[1])
                keep = draw < n
                which = pa.array(np.repeat(np.arange(to, to + len(out)), keep.sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(draw[keep]), pa.array(out[keep].astype(np.int64))], ["stream", "draw", "value"])

    return parts.limit(0).select("stream", F.lit(0).cast("long").alias("draw"), F.lit(0).cast("long").alias("value")) if n < 1 else parts.mapInArrow(run, SPEC)
