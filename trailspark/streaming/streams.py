"""Streaming forms: last-write-wins points, displacements of arriving frames, tumbling means by lag."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(points: DataFrame, event_time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One row for each track and frame, the last written: a frame that comes again within ``late`` replaces what is held.

    Rows of a frame no further than ``late`` apart are one session, whose state is
    the latest row (equal times: the largest); it is emitted when the watermark
    passes its end.
    """
    rest = [c for c in points.columns if c not in ("track_id", "t", event_time)]
    at = F.col(event_time)
    last = points.withWatermark(event_time, late).groupBy(F.session_window(event_time, late), "track_id", "t").agg(F.max(F.struct(at, *rest)).alias("last"))
    return last.select("track_id", "t", "last.*")


def window_means(displacements: DataFrame, event_time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean displacement and its square by lag over tumbling windows of event time."""
    d = displacements.withWatermark(event_time, late)
    return d.groupBy(F.window(event_time, size), "lag").agg(F.avg("disp").alias("mean_disp"), F.avg(F.col("disp") * F.col("disp")).alias("mean_disp_sq"), F.count("*").alias("n"))


def arriving_displacements(points: DataFrame, lags: int = 12) -> DataFrame:
    """``track_id, t1, t2, disp`` for each arriving point against the last ``lags`` frames of its track, kept as state.

    State is bounded by ``lags`` points a track. Points of a track may come in
    any order within a batch; a frame that comes again replaces what is kept.
    """
    out = "track_id long, t1 long, t2 long, disp double"
    state = "ts array<long>, xs array<double>, ys array<double>, zs array<double>"

    def step(key, batches: Iterator, held) -> Iterator:
        import pandas as pd

        kept = {t: (x, y, z) for t, x, y, z in zip(*held.get, strict=True)} if held.exists else {}
        rows = []
        for t, *p in sorted(tuple(r) for pdf in batches for r in pdf[["t", "x", "y", "z"]].itertuples(index=False, name=None)):
            for t0, q in sorted(kept.items()):
                if 0 < t - t0 <= lags:
                    rows.append((key[0], t0, t, sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5))
            kept[t] = tuple(p)
            kept = {k: v for k, v in kept.items() if k > max(kept) - lags}
        held.update(tuple(map(list, zip(*((t, *p) for t, p in sorted(kept.items())), strict=True))))
        yield pd.DataFrame(rows, columns=["track_id", "t1", "t2", "disp"])

    return points.groupBy("track_id").applyInPandasWithState(step, out, state, "append", "NoTimeout")
