"""Toxicity: averaged subword embeddings into a linear softmax, trained jointly in numpy.

A word is its own hashed vector and those of its character n-grams (with word
borders), so an unseen misspelling shares most of its vectors with the words it
was made from. A passage is the mean of its words' vectors; the softmax over
(clean, toxic) reads that mean. A document is scored by passages of ``PASSAGE``
words, half overlapping, and takes the highest passage score, so a long document
is not diluted; the same pooling is used in training, where (after some rounds on
whole texts) the passage with the highest score carries the gradient.

As the softmax is linear, a word's share of a passage's margin is one number;
whole texts are scored from those numbers with prefix sums.

Fitted on at most ``MAX_TRAIN`` labelled rows of at most ``MAX_CHARS`` characters
(a documented bound; those of lowest hashed id, texts over ``MAX_TEXT`` left out); scores cover every row. Empty or null texts, and texts
without words, get the score of the bias alone. Repeated rows get equal scores;
there are no ties to break. Without training rows, or with one class only, every
score is the smoothed base rate.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
#: Hashed counters of the words' training documents.
COUNTERS = 1 << 22
DIM = 8
PASSAGE = 2
MAX_TRAIN = 5000
#: Characters of all training texts, and of one of them.
MAX_CHARS, MAX_TEXT = 40_000_000, 4_000_000
EPOCHS = 45
#: Documents a word must be in to have vectors of its own in training (fewer where there are under 1000 training rows for each).
LEAST_DOCS = 5
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 300_000


def grams(found: list[str], low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word (itself, then its character n-grams), flat, and how many each has."""
    code = np.frombuffer("".join(f"<{w}>" for w in found).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 2
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(code))  # symbols of the word from here on
    owner = np.repeat(np.arange(len(found)), size)
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        # whole words: a polynomial of their code points
        power = left.astype(np.uint64) * np.uint64(2) + np.uint64(1)
        whole = np.add.reduceat(common.mix64(code * step + power), end - size)
        rows, owners = [common.mix64(whole) % np.uint64(BUCKETS)], [np.arange(len(found))]
        h = code.copy()
        for n in range(2, high + 1):
            nxt = np.zeros_like(code)
            nxt[: max(len(code) - n + 1, 0)] = code[n - 1 :]
            h = h * step + nxt
            if n >= low:
                ok = left >= n
                rows.append(np.uint64(BUCKETS) + common.mix64(h[ok] + np.uint64(n)) % np.uint64(BUCKETS))
                owners.append(owner[ok])
    flat, who = np.concatenate(rows).astype(np.int64), np.concatenate(owners)
    return flat[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(found))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    """The margin (toxic minus clean) of each embedding row, and the bias."""

    margin: np.ndarray
    bias: float
    memo: dict = field(default_factory=dict)

    def learn(self, found: set[str]) -> None:
        """Remember the margins of words not met before."""
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        fresh = list(found.difference(self.memo))
        if fresh:
            flat, size = grams(fresh)
            means = np.add.reduceat(self.margin[flat], np.cumsum(size) - size) / size
            self.memo.update(zip(fresh, means.tolist(), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        """Probability of toxic of each text: that of its worst passage."""
        lists = [words(t) for t in texts]
        self.learn(set().union(*lists))
        get, out = self.memo.__getitem__, []
        for ws in lists:
            if not ws:
                out.append(_sigmoid(self.bias))
                continue
            m = np.fromiter(map(get, ws), float, len(ws))
            starts, sizes = windows(len(m))
            c = np.r_[0.0, np.cumsum(m)]
            out.append(_sigmoid(float(((c[starts + sizes] - c[starts]) / sizes).max()) + self.bias))
        return out


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the passages of n words; the last is moved back to be full."""
    if n <= PASSAGE:
        return np.zeros(1, int), np.array([max(n, 1)])
    starts = np.unique(np.r_[np.arange(0, n - PASSAGE, max(PASSAGE // 2, 1)), n - PASSAGE])
    return starts, np.full(len(starts), PASSAGE)


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.6, least: int = LEAST_DOCS, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax by Adam on full batches."""
    labels = np.asarray(labels, float)
    base = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(2 * BUCKETS), float(np.log(base / (1 - base))))
    # words are taken twice rather than held, and counted by hash: the driver keeps numbers only
    keep, counts = [], np.zeros(COUNTERS, np.uint16)
    for i, t in enumerate(texts):
        at = np.array(sorted({zlib.crc32(w.encode()) % COUNTERS for w in words(t)}), np.int64)
        counts[at] += 1
        if len(at):
            keep.append(i)
    labels = labels[keep]
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(2 * BUCKETS), float(np.log(base / (1 - base))))
    # a word of too few documents has no vector of its own here: it stands as row 0, which stays zero
    least = min(least, max(2, len(keep) // 1000 + 1))
    ids: dict[str, int] = {}
    for i in keep:
        for w in sorted(set(words(texts[i])).difference(ids)):
            if counts[zlib.crc32(w.encode()) % COUNTERS] >= least:
                ids[w] = len(ids) + 1
    known = list(ids)
    seqs = [np.array([ids.get(w, 0) for w in words(texts[i])], np.int32) for i in keep]
    del ids
    flat, size = grams(["\0", *known])
    n_words = len(known) + 1
    owner = np.repeat(np.arange(n_words), size)
    first = np.cumsum(size) - size
    order = np.argsort(flat, kind="stable")
    used, used_at = np.unique(flat[order], return_index=True)
    # passages of all documents over one word stream
    stream, length = np.concatenate(seqs), np.array([len(s) for s in seqs])
    base_at = np.cumsum(length) - length
    wins = [windows(n) for n in length]
    count = np.array([len(s) for s, _ in wins])
    start = np.concatenate([(s + b).astype(np.int32) for (s, _), b in zip(wins, base_at, strict=True)])
    span = np.concatenate([z.astype(np.int32) for _, z in wins])
    del wins
    doc_first = np.r_[0, np.cumsum(count)[:-1]]
    # whole texts as distinct words with their shares
    kinds = [np.unique(s, return_counts=True) for s in seqs]
    whole_n = np.array([len(k) for k, _ in kinds])
    whole = np.concatenate([k for k, _ in kinds]), np.repeat(np.arange(len(seqs), dtype=np.int32), whole_n), np.concatenate([(c / c.sum()).astype(np.float32) for _, c in kinds]), np.cumsum(whole_n) - whole_n
    del seqs, kinds
    common.give_back()

    def worst(margin: np.ndarray) -> np.ndarray:
        """The passage of highest margin of each document, the first of equals; some documents at a time."""
        out = []
        for a in range(0, len(length), 200):
            b = min(a + 200, len(length))
            lo, hi = doc_first[a], doc_first[b - 1] + count[b - 1]
            t0, t1 = base_at[a], base_at[b - 1] + length[b - 1]
            c = np.r_[0.0, np.cumsum(margin[stream[t0:t1]])]
            at, n = start[lo:hi] - t0, span[lo:hi]
            z = (c[at + n] - c[at]) / n
            top = np.flatnonzero(z == np.repeat(np.maximum.reduceat(z, doc_first[a:b] - lo), count[a:b]))
            whose, nth = np.unique(np.searchsorted(doc_first, top + lo, side="right"), return_index=True)
            out.append(top[nth] + lo)
        return np.concatenate(out)

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (2 * BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [emb, soft, bias]
    m1 = [np.zeros_like(p) for p in params]
    m2 = [np.zeros_like(p) for p in params]
    weight = np.where(labels > 0, 0.5 / max(base, 1e-3), 0.5 / max(1 - base, 1e-3)) / len(labels)
    for step in range(1, epochs + 1):
        vec = np.stack([np.add.reduceat(emb[flat, k], first) for k in range(DIM)], 1) / size[:, None].astype(np.float32)
        vec[0] = 0
        if step <= epochs // 3:  # whole texts first, to find where to look
            w_id, d_id, part, edge = whole
        else:  # the passage with the highest margin stands for its document
            pick = worst((vec @ (soft[:, 1] - soft[:, 0])).astype(float))
            n = span[pick]
            edge = np.cumsum(n) - n
            d_id = np.repeat(np.arange(len(pick)), n)
            w_id = stream[np.repeat(start[pick], n) + (np.arange(n.sum()) - np.repeat(edge, n))]
            part = np.repeat((1 / n).astype(np.float32), n)
        mean = np.stack([np.add.reduceat(vec[w_id, k] * part, edge) for k in range(DIM)], 1)
        logit = mean @ soft + bias
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        err = p.copy()
        err[np.arange(len(labels)), labels.astype(int)] -= 1
        err *= weight[:, None]
        g_mean = err @ soft.T
        g_vec = np.zeros_like(vec)
        for k in range(DIM):
            g_vec[:, k] = np.bincount(w_id, weights=g_mean[d_id, k] * part, minlength=n_words)
        g_vec[0] = 0
        g_vec /= size[:, None]
        g_emb = np.zeros_like(emb)
        for k in range(DIM):
            g_emb[used, k] = np.add.reduceat(g_vec[owner[order], k], used_at)
        grads = [g_emb, mean.T @ err, err.sum(0)]
        for k, g in enumerate(grads):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            params[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        emb, soft, bias = params
    margin = (emb @ (soft[:, 1] - soft[:, 0])).astype(float)
    unused = np.ones(len(margin), bool)
    unused[used] = False
    margin[unused] = 0  # rows that no training word has carry no evidence
    return Model(margin, float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, most: int) -> list:
    """At most ``most`` labelled rows (text, target) whose crc32 remainder isn't ``held``, and at most ``MAX_CHARS`` characters: those of lowest hashed id."""
    crc = F.crc32(F.col("doc_id").cast("string")) % modulus
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (crc != held))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # at most ``most`` rows of two numbers: a broadcast of a proven bound
    found = common.id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).where(F.length("text") <= MAX_TEXT)
    # one task has ``most`` rows at most
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    found = found.withColumn("sum", F.sum(F.length("text")).over(before)).where(F.col("sum") <= MAX_CHARS).drop("sum")
    return found.orderBy("doc_id").collect()


def held_out(modulus: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))


SPEC = "doc_id long, score double"


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    rows = training_rows(docs, labels, "toxic", 5, 0, most)
    model = fit([r.text for r in rows], np.array([r.y for r in rows], float))
    del rows
    common.give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margin.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value[0].astype(float), shared.value[1])
        for batch in common.slices(batches, chars=2_000_000):
            yield common.as_arrow(SPEC, {"doc_id": batch.column(0), "score": m.scores(batch.column(1).to_pylist())})

    return common.id_text(docs, id_col, text_col).mapInArrow(run, SPEC)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    return score(docs, train(docs, labels, most)).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they were."""
    model = train(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast((model.margin.astype(np.float32), model.bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value[0].astype(float), shared.value[1])
        for batch in common.slices(batches, chars=2_000_000):
            yield batch.filter(pa.array([s < 0.5 for s in m.scores([t or "" for t in batch.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
