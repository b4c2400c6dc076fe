"""Quality: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (lengths, shares of character classes, repetition of
words and lines) are binned by quantiles; trees grow on histograms of gradients
and are flattened into arrays (feature, threshold, left, right, value), which
numpy walks for all rows at once, one level at a time.

Fitted on at most ``MAX_TRAIN`` labelled rows (a documented bound); scores cover
every row. An empty or null text is a row of zeros and has a score like any
other. Ties in gain go to the first feature and lowest threshold. Without
training rows, or with one class, every score is the smoothed base rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import held_out, training_rows

MAX_TRAIN = 6000
SPEC = "doc_id long, score double"
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "newline", "high_byte", "period", "comma", "bang", "bar", "hash_percent", "star_dollar_amp",
    "braces", "other_punct", "distinct_words", "top_word", "same_as_previous", "distinct_lines", "words_per_line", "words_with_symbol_end", "longest_word", "longest_run", "top_line",
    "short_words", "capital_words", "at_sign", "slash", "equals",
)


def _classes() -> np.ndarray:
    """Class of each byte, by rule."""
    groups = [b"\n", b" \t\r", bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256)), b".", b",", b"!", b"|", b"#%", b"*$&", b"{}[]()<>", b"@", b"/\\", b"=", b"?;:'\"-+_~^`"]
    out = np.full(256, len(groups))
    for k, g in enumerate(groups):
        out[np.frombuffer(g, np.uint8)] = k
    return out


_CLASS = _classes()


def statistics(text: str) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    by_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=17) / n
    ws = text.split()
    lines = [x for x in text.split("\n") if x]
    k = max(len(ws), 1)
    counts, by_line = Counter(ws), Counter(lines)
    same = sum(map(str.__eq__, ws, ws[1:]))
    tail = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,")
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    short = sum(c for w, c in counts.items() if len(w) < 3)
    runs = np.flatnonzero(np.diff(np.frombuffer(raw, np.uint8).astype(np.int16)))
    longest = int(np.diff(np.r_[-1, runs, n - 1]).max())
    b = by_class
    return [
        np.log1p(n), np.log1p(len(ws)), sum(len(w) * c for w, c in counts.items()) / k, b[2], b[3], b[1], b[0], b[4], b[5], b[6], b[7], b[8], b[9], b[10],
        b[11], b[15], len(counts) / k, max(counts.values(), default=0) / k, same / k, len(by_line) / max(len(lines), 1), len(ws) / max(len(lines), 1), tail / k, max(map(len, counts), default=0), min(longest, 200),
        max((len(x) * c for x, c in by_line.items() if c > 1), default=0) / n, short / k, capital / k, b[12], b[13], b[14],
    ]


@dataclass
class Trees:
    """Flattened trees: a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(go, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, penalty: float = 1.0, least: float = 3.0) -> Trees:
    """Boosted trees for a 0/1 target; second-order gains on histograms."""
    y = np.asarray(y, float)
    rate0 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate0 / (1 - rate0)))
    cols: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    done = lambda: Trees(np.array(roots, int), np.array(cols["feature"], int), np.array(cols["threshold"], float), np.array(cols["left"], int), np.array(cols["right"], int), np.array(cols["value"], float), depth, base)
    if len(set(y.tolist())) < 2:
        return done()
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    margin = np.full(n, base)

    def add(**kw) -> int:
        k = len(cols["feature"])
        for name, v in ({"feature": 0, "threshold": 0.0, "left": k, "right": k, "value": 0.0} | kw).items():
            cols[name].append(v)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        me = add()
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if level < depth and hs >= 2 * least / 4:
            flat = (binned[rows] + np.arange(d) * bins).ravel()
            hg = np.bincount(flat, weights=np.repeat(g[rows], d), minlength=d * bins).reshape(d, bins).cumsum(1)
            hh = np.bincount(flat, weights=np.repeat(h[rows], d), minlength=d * bins).reshape(d, bins).cumsum(1)
            ok = (hh >= least / 4) & (hs - hh >= least / 4)
            gain = np.where(ok, hg**2 / (hh + penalty) + (gs - hg) ** 2 / (hs - hh + penalty) - gs**2 / (hs + penalty), -1)
            k = int(gain.argmax())
            if gain.flat[k] > best[0]:
                best = (float(gain.flat[k]), k // bins, k % bins)
        j, b = best[1:]
        if j < 0 or b >= len(edges[j]):
            cols["value"][me] = -rate * gs / (hs + penalty)
            margin[rows] += cols["value"][me]
            return me
        go = binned[rows, j] <= b
        cols["feature"][me], cols["threshold"][me] = j, edges[j][b]
        cols["left"][me] = grow(rows[go], g, h, level + 1)
        cols["right"][me] = grow(rows[~go], g, h, level + 1)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0))
    return done()


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Trees:
    rows = training_rows(docs, labels, "quality", 3, 1, most)
    x = np.array([statistics(r.text) for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.y for r in rows], float))


def quality(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield common.as_arrow(SPEC, {"doc_id": batch.column(0), "score": shared.value.scores(x)})

    return common.id_text(docs).mapInArrow(run, SPEC).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
