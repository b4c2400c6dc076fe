"""Benchmark decontamination: a BM25 index of test items, block-max WAND, and verification.

Test items are indexed once (lower-cased words, BM25 weights divided by the
item's score for its own text, so a passage that holds all of an item scores 1
or more). Every passage of every document is a query: passages of an item are
twice as long as its step (``STEP`` words, doubled until the item fits) and
overlap by half, so each copy of an item lies whole in one, and no item changes
another's passages. Block-max WAND retrieves every item that scores above
``SCORE``; nothing is cut at a top k. Before that, passages are set aside whose words cannot reach the
threshold whatever the item: words common among the items are grouped so that
they never reach it alone, and the block maxima of the other words bound the
rest. That is block-max WAND's own bound, taken for all passages of a slice at
once in numpy.

A candidate counts when the shares of the item's question and answer found in
the passage are high enough: ``WORDS``-word shingles of the item but its last
sentence, and of its last sentence (single words where it is shorter).

The index is sent to every task in shards: items of one step, at most ``SHARD``
words, a bound that does not grow with the input: more items mean more shards,
each a pass. Document frequencies, their number and mean length are those of
all items, so shards change no score.

Null or empty items match nothing; null or empty texts are clean. Repeated
items or rows give their own rows. Ties need no rule: all above the threshold
are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import written

K1, B = 1.2, 0.75
SCORE = 0.5
WORDS = 5
QUESTION, ANSWER = 0.6, 0.5
STEP = 64
#: Words of the items of a shard (one item at least).
SHARD = 800_000
BLOCK = 16
#: Items in a range of the bounds taken for all passages.
RANGE = 2
WORD = re.compile(r"\w+")
SPEC = "doc_id long, row long, item_id long, score double, question_overlap double, answer_overlap double"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(ws: list[str], n: int = WORDS) -> set:
    n = min(n, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def halves(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence, or the last third where there is one sentence."""
    parts = [w for s in re.split(r"[.?!:\n]+", text) if (w := words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    ws = parts[0] if parts else []
    cut = len(ws) - len(ws) // 3
    return ws[:cut], ws[cut:]


@dataclass(frozen=True)
class Shard:
    """Items of one step, and what holds for all items: their number, mean length, and the document frequencies of the shard's words."""

    items: list[tuple[int, str]]
    step: int
    n: int
    mean: float
    df: dict[str, int]


def as_shard(items: list[tuple[int, str]]) -> Shard:
    """A shard that is all there is."""
    lists = [words(t or "") for _, t in items]
    return Shard(items, step_of(max(map(len, lists), default=0)), len(lists), sum(map(len, lists)) / max(len(lists), 1), Counter(w for ws in lists for w in set(ws)))


def step_of(n: int) -> int:
    step = STEP
    while step < n:
        step *= 2
    return step


class Index:
    """Inverted lists with block maxima. Weights are shares of an item's own score."""

    def __init__(self, shard: Shard, threshold: float = SCORE):
        self.threshold, self.step = threshold, shard.step
        items, df = shard.items, shard.df
        self.ids = [i for i, _ in items]
        lists = [words(t or "") for _, t in items]
        n, mean = max(shard.n, 1), max(1.0, shard.mean)
        self.term = {w: k for k, w in enumerate(df)}
        idf = {w: float(np.log(1 + (n - c + 0.5) / (c + 0.5))) for w, c in df.items()}
        posts: dict[int, list[tuple[int, float]]] = defaultdict(list)
        share = []
        for d, ws in enumerate(lists):
            norm = K1 * (1 - B + B * len(ws) / mean)
            w = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in Counter(ws).items()}
            own = sum(w.values()) or 1.0
            share.append({self.term[t]: v / own for t, v in w.items()})
            for t, v in share[-1].items():
                posts[t].append((d, v))
        self.docs = [[d for d, _ in posts[t]] for t in range(len(df))]
        self.weights = [[v for _, v in posts[t]] for t in range(len(df))]
        self.best = np.array([max(w) for w in self.weights]) if df else np.zeros(0)
        self.block = [[max(w[k : k + BLOCK]) for k in range(0, len(w), BLOCK)] for w in self.weights]
        # maxima by ranges of items, as flat arrays: what a word adds at most to any item of a range
        self.ranges = -(-len(lists) // RANGE)
        # common words, most frequent first, as long as no item reaches a quarter of the threshold by them alone
        held, common_terms, bound = np.zeros(len(lists)), [], 0.0
        for t in sorted(range(len(df)), key=lambda t: -len(self.docs[t])):
            d = np.array(self.docs[t])
            after = held[d] + np.array(self.weights[t])
            if after.max() > threshold / 4 or len(d) < 2:
                break
            held[d] = after
            common_terms.append(t)
            bound = max(bound, float(after.max()))
        self.rare = self.best.copy()
        self.rare[common_terms] = 0
        self.rest = threshold - bound
        flat_t, flat_r, flat_w = [], [], []
        for t in range(len(df)):
            if self.rare[t]:
                top: dict[int, float] = {}
                for d, v in zip(self.docs[t], self.weights[t], strict=True):
                    top[d // RANGE] = max(top.get(d // RANGE, 0.0), v)
                flat_t += [t] * len(top)
                flat_r += top.keys()
                flat_w += top.values()
        self.range_at, self.range_max = np.array(flat_r, np.int64), np.array(flat_w, float)
        self.range_n = np.bincount(np.array(flat_t, np.int64), minlength=len(df))
        self.range_first = np.cumsum(self.range_n) - self.range_n
        parts = [halves(t or "") for _, t in items]
        self.question = [shingles(q) for q, _ in parts]
        self.answer = [shingles(a) for _, a in parts]
        self.sizes = [(min(WORDS, len(q)), min(WORDS, len(a))) for q, a in parts]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item whose weights over these distinct terms reach the threshold: block-max WAND."""
        docs, weights, blocks, limit = self.docs, self.weights, self.block, self.threshold - 1e-9
        cursors = [[docs[t][0], 0, t] for t in terms]  # current item, place in the list, term
        best, found = self.best, []
        last = len(self.ids)
        cursors.sort()
        while cursors:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += best[c[2]]
                if bound >= limit:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            # maxima of the blocks that could hold d
            upper, until = 0.0, last
            for c in cursors[: pivot + 1]:
                lst, p = docs[c[2]], c[1]
                b = bisect_left(lst, d, p) // BLOCK
                if b < len(blocks[c[2]]):
                    upper += blocks[c[2]][b]
                    until = min(until, lst[min((b + 1) * BLOCK, len(lst)) - 1] + 1)
            if upper < limit:
                # no item before the end of these blocks, or before the next cursor, can do
                target = max(d + 1, min(until, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else last))
                moved = range(pivot + 1)
            elif cursors[0][0] == d:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += weights[c[2]][c[1]]
                if score >= limit:
                    found.append((d, score))
                target, moved = d + 1, range(pivot + 1)
            else:
                target, moved = d, [k for k in range(pivot + 1) if cursors[k][0] < d]
            for k in moved:
                c = cursors[k]
                lst, p = docs[c[2]], c[1]
                p = bisect_left(lst, target, p)
                c[0], c[1] = (lst[p], p) if p < len(lst) else (last, p)
            cursors = sorted(c for c in cursors if c[0] < last)
        return found

    def overlaps(self, item: int, passage: list[str]) -> tuple[float, float]:
        q, a = self.sizes[item]
        share = lambda want, n: len(want & shingles(passage, n)) / len(want) if want else 1.0
        return share(self.question[item], q), share(self.answer[item], a)


def passages(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, list[str]]]:
    """(text, first word, end, words of the text) of the passages that may reach the threshold."""
    get = index.term.get
    lists = [words(t) for t in texts]
    size = np.array([len(ws) for ws in lists], np.int64)
    step = index.step
    terms = np.fromiter((get(w, -1) for ws in lists for w in ws), np.int64, int(size.sum()))
    owner = np.repeat(np.arange(len(lists)), size)
    first = np.cumsum(size) - size
    blocks = np.maximum(-(-size // step), 1)  # half passages
    block_first = np.cumsum(blocks) - blocks
    block = block_first[owner] + (np.arange(len(terms)) - first[owner]) // step
    hit = terms >= 0
    hit[hit] = index.rare[terms[hit]] > 0
    t, b, n_terms = terms[hit], block[hit], np.int64(len(index.term) + 1)
    # passage k is the half passages k and k + 1; each distinct term counts once
    pairs = np.unique(np.r_[b * n_terms + t, (b[b > block_first[owner[hit]]] - 1) * n_terms + t[b > block_first[owner[hit]]]])
    where, term = np.divmod(pairs, n_terms)
    n = index.range_n[term]
    at = np.repeat(index.range_first[term], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    key, which = np.unique(np.repeat(where, n) * index.ranges + index.range_at[at], return_inverse=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    bound = np.bincount(which, weights=index.range_max[at], minlength=len(key))
    for k in np.unique(key[bound >= index.rest - 1e-9] // max(index.ranges, 1)).tolist():
        d = int(np.searchsorted(block_first, k, side="right")) - 1
        at = int(k - block_first[d]) * step
        yield d, at, min(at + 2 * step, int(size[d])), lists[d]


def hits(docs: DataFrame, items: Shard, score: float = SCORE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """Candidates of one shard with their overlaps, the best passage of each row and item: one that passes both thresholds, if any does."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    built: dict[int, Index] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index = built.get(0) or built.setdefault(0, Index(shared.value, score))
        row = TaskContext.get().partitionId() << 40
        for batch in common.slices(batches):
            ids, found = batch.column(0).to_pylist(), {}
            for d, at, to, ws in passages(index, batch.column(1).to_pylist()):
                passage = ws[at:to]
                terms = list({index.term[w] for w in passage if w in index.term})
                for item, s in index.search(terms):
                    q, a = index.overlaps(item, passage)
                    found[d, item] = max(found.get((d, item), (False,)), (q >= question and a >= answer, min(q, a) + q + a, q, a, s))
            rows = [(ids[d], row + d, index.ids[i], s, q, a) for (d, i), (_, _, q, a, s) in found.items()]
            row += len(ids)
            yield common.as_arrow(SPEC, {f.split(" ")[0]: [r[k] for r in rows] for k, f in enumerate(SPEC.split(", "))})

    return common.id_text(docs).mapInArrow(run, SPEC)


def shards(bench: DataFrame, most: int = SHARD) -> Iterator[Shard]:
    """The items that hold words, each shard collected when it is needed."""
    spark = bench.sparkSession
    common.ship(spark)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            n = [len(words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array([step_of(x) for x in n], pa.int64())], ["item_id", "text", "n", "step"])

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [(s, p, w) for t, s, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in sorted(set(words(t)))]
            yield common.as_arrow("step long, part long, w string", {"step": [f[0] for f in found], "part": [f[1] for f in found], "w": [f[2] for f in found]})

    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.mapInArrow(measured, "item_id long, text string, n long, step long").where("n > 0")
    # a row for each step: as many as the logarithm of the longest item
    steps = items.groupBy("step").agg(F.count("*").alias("items"), F.sum("n").alias("words")).orderBy("step").collect()
    n, total = sum(r["items"] for r in steps), sum(r["words"] for r in steps)
    parts = {r["step"]: max(1, -(-r["words"] // most)) for r in steps}
    part = F.pmod(F.xxhash64("item_id", "text"), F.coalesce(*(F.when(F.col("step") == s, k) for s, k in parts.items()), F.lit(1)))
    collected = lambda rows: [(r.item_id, r.text) for r in rows.orderBy("item_id", "text").collect()]
    if sum(parts.values()) <= 1:
        if steps:
            yield as_shard(collected(items))
        return
    dealt = written(items.withColumn("part", part))
    terms = written(dealt.select("text", "step", "part").mapInArrow(worded, "step long, part long, w string"))
    df = written(terms.groupBy("w").agg(F.count("*").alias("df")))
    for step, k in parts.items():
        for p in range(k):
            mine = (F.col("step") == step) & (F.col("part") == p)
            own = terms.where(mine).select("w").distinct().join(df, "w").collect()
            found = collected(dealt.where(mine))
            if found:
                yield Shard(found, step, n, total / n, {r.w: r.df for r in own})


def candidates(docs: DataFrame, bench: DataFrame, score: float = SCORE, shard: int = SHARD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """Every (row, item) above the BM25 threshold: ``doc_id, row, item_id, score, question_overlap, answer_overlap``."""
    none = docs.sparkSession.createDataFrame([], SPEC)
    found = [hits(docs, items, score, question, answer) for items in shards(bench, shard)]
    return reduce(DataFrame.unionByName, found) if found else none


def leaks(docs: DataFrame, bench: DataFrame, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """The verified (row, item) pairs."""
    return candidates(docs, bench, question=question, answer=answer).where((F.col("question_overlap") >= question) & (F.col("answer_overlap") >= answer))


def keep_uncontaminated(docs: DataFrame, bench: DataFrame, question: float = QUESTION, answer: float = ANSWER, shard: int = SHARD) -> DataFrame:
    """Rows of ``docs`` without a verified leak, all columns as they were; decided row by row, without a shuffle."""
    common.ship(docs.sparkSession)
    at = docs.columns.index("text")
    for items in shards(bench, shard):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        built: dict[int, Index] = {}

        def run(batches: Iterator[pa.RecordBatch], shared=shared, built=built) -> Iterator[pa.RecordBatch]:
            index = built.get(0) or built.setdefault(0, Index(shared.value, SCORE))
            for batch in common.slices(batches):
                keep = np.ones(batch.num_rows, bool)
                for d, first, to, ws in passages(index, [t or "" for t in batch.column(at).to_pylist()]):
                    if keep[d]:
                        passage = ws[first:to]
                        found = index.search(list({index.term[w] for w in passage if w in index.term}))
                        keep[d] = not any(q >= question and a >= answer for q, a in (index.overlaps(i, passage) for i, _ in found))
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
