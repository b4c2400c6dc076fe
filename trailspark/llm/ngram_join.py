"""N-gram Jaccard join: T-occurrence search by DivideSkip, in blocks of documents that can be linked.

A document is its set of hashed word shingles; two link when their Jaccard
similarity reaches ``num / den``. In a block, shingles have inverted lists; a
query document of s shingles needs T = ceil(num * s / den) hits. DivideSkip sets
the longest lists aside, heap-merges the short ones for documents that already
have T less their number, and probes the long lists for those by binary search.
Lengths settle what overlap is required. Pairs whose documents are already in
one component are not searched: components are the result.

Blocks, so that each document meets all it can link with, once:

1. Equal sets are one class (by a 64-bit sum of hashes); classes are joined.
2. Linked sets differ in at most D elements, which follows from the threshold
   and a ladder of sizes. Cut by hash range into D + 1 segments, they agree in
   one at least, so classes are dealt by (size step, segment, contents). Where
   the segment is empty, its contents say nothing, and a second cut refines it.
   Only such signatures are shuffled; a task that meets one in several classes
   ties these itself and passes on one.
3. Classes tied by signatures form blocks (distributed components). Those over
   ``BLOCK`` are cut again, by prefixes of their elements in order of exact
   rarity. Blocks up to ``BLOCK`` are searched whole, in one task each. Larger
   ones (long families of near copies) are searched in parts, then representatives of the parts'
   components, again in parts, until these no longer merge; only where a block
   is still in several components the rest is searched: documents outside the
   largest component are queries against all of the block, tile by tile.

A Bloom filter of fixed size over one document of each class in a block spares
the sets of all others; false positives only cost time, and a full filter spares
nothing.

Null and empty texts, and texts without words, have no shingles, link with
nothing and are their own component. Texts with fewer words than a shingle are
one shingle. Rows of equal id and text are one node; a null id takes part but is
no component's id unless it is alone in it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, written
from .suffix_dedup import _BASE, _INVERSE, _VALUE, dealt, packed, rows_of, unpacked

BLOCK = 1024
#: Postings up to which short lists are merged by a heap, and long lists probed at a time.
HEAP, PROBES = 4096, 64
DOCS_PER_BUCKET = 4000
BLOOM_BITS = 1 << 23
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Shingler:
    """Sets of hashed shingles. Words are hashed from the bytes of a whole slice: prefix sums of a polynomial, mixed with the length."""

    def __init__(self, words: int):
        self.n = words
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n + 1:
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
                self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _INVERSE, np.uint64)])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word of all texts, and words of each text: A-Z lower-cased, ASCII white space between."""
        raws = [t.encode() for t in texts]
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        data = _LOWER[np.frombuffer(b"\n".join([*raws, b""]), np.uint8)]  # each text ends with white space
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
        self.powers(len(data))
        letter = ~_SPACE[data]
        edge = np.diff(np.r_[False, letter, False].astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            prefix = np.r_[np.uint64(0), np.cumsum(_VALUE[data] * self.up[: len(data)], dtype=np.uint64)]
            h = common.mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64) * _STEP)
        bounds = np.r_[0, np.cumsum(size + 1)]
        return h, np.diff(np.searchsorted(start, bounds))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        flat, size = self.words(texts)
        n, out, at = self.n, [], 0
        with np.errstate(over="ignore"):
            acc = np.full(max(len(flat) - n + 1, 0), n, np.uint64)
            for k in range(n):
                acc = common.mix64(acc * _STEP + flat[k : k + len(acc)])
            for s in size.tolist():
                if s >= n:
                    out.append(_distinct(acc[at : at + s - n + 1]))
                elif s:
                    h = np.full(1, s, np.uint64)
                    for k in range(s):
                        h = common.mix64(h * _STEP + flat[at + k : at + k + 1])
                    out.append(h)
                else:
                    out.append(np.zeros(0, np.uint64))
                at += s
        return out


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=keep[1:])
    return a[keep]


def class_id(s: np.ndarray) -> int:
    """64 bits of a set, as a signed number."""
    with np.errstate(over="ignore"):
        h = np.uint64(len(s)) * _STEP + common.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(common.mix64(np.array([h]))[0].astype(np.int64))


class Ladder:
    """Steps of sizes (each half as large again), and how sets are cut in each step.

    Linked sets, the smaller of which is in a step, differ in at most D elements,
    so of m segments m - D are equal. A set with fewer empty segments than that
    agrees with each partner in one that isn't empty; m leaves room for the empty
    ones expected of hashed elements.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        floor, self.floors = 1, [1]
        while floor < 1 << 40:
            floor = max(floor + 1, floor * 3 // 2)
            self.floors.append(floor)
        self.differ, self.cuts = [], []
        for lo, hi in zip(self.floors, self.floors[1:], strict=False):
            u = hi - 1
            d = (u + u * den // num) * (den - num) // (den + num)
            m = d + 1
            while d and m < 3 * d + 4:
                void = m * np.exp(-lo / m)
                # large sets should hardly ever need the second cut, for small ones it is cheap
                if m - d >= np.ceil(void + (0 if m < 16 else 2 if m < 64 else 4) * void**0.5):
                    break
                m += max(1, m // 50)
            self.differ.append(d)
            self.cuts.append(m)
        self.tags = common.mix64(np.arange(1, len(self.cuts) + 1, dtype=np.uint64) * _STEP)

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def own(self, size: np.ndarray) -> np.ndarray:
        """Step of each size (1 or more)."""
        return np.searchsorted(self.floors, size, side="right") - 1

    def lower(self, size: np.ndarray) -> np.ndarray:
        """Lowest step in which a smaller partner can be."""
        return self.own(np.maximum(-(-self.num * size // self.den), 1))


def _segment_sums(s: np.ndarray, owner: np.ndarray, m: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, segment, signature) of the non-empty segments; elements ascend within owners, arrays are by element."""
    with np.errstate(over="ignore"):
        seg = (s >> np.uint64(32)) * m.astype(np.uint64) >> np.uint64(32)
        new = np.r_[True, (seg[1:] != seg[:-1]) | (owner[1:] != owner[:-1])]
        first = np.flatnonzero(new)
        total = np.add.reduceat(common.mix64(s + tag), first)
        return owner[first], seg[first].astype(np.int64), common.mix64((total ^ tag[first]) * _STEP + seg[first])


def signatures(sets: list[np.ndarray], ladder: Ladder) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all sets; linked sets have a signature in common."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(size)
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step, low = ladder.own(size[full]), ladder.lower(size[full])
    # a set enters its own step and those of its smaller partners
    reps = step - low + 1
    who = np.repeat(full, reps)
    at_step = np.repeat(step, reps) - (np.arange(len(who)) - np.repeat(np.cumsum(reps) - reps, reps))
    flat = np.concatenate([sets[k] for k in who.tolist()])
    owner = np.repeat(np.arange(len(who)), size[who])
    cuts, differ = np.array(ladder.cuts), np.array(ladder.differ)
    own, seg, sig = _segment_sums(flat, owner, cuts[at_step][owner], ladder.tags[at_step][owner])
    sigs, owners = [sig], [who[own]]
    filled = np.bincount(own, minlength=len(who))
    void = cuts[at_step] - filled
    for k in np.flatnonzero(void >= cuts[at_step] - differ[at_step]).tolist():
        # too many empty segments to be sure of a common one: each of them is refined by a second cut
        m, tag = int(cuts[at_step[k]]), ladder.tags[at_step[k]]
        with np.errstate(over="ignore"):
            other = np.sort(common.mix64(sets[who[k]] ^ np.uint64(0x2545F4914F6CDD1D)))
            n = len(other)
            _, seg2, inner = _segment_sums(other, np.zeros(n, np.int64), np.full(n, m), np.full(n, tag))
            empty = np.setdiff1d(np.arange(m), seg[own == k]).astype(np.uint64)
            marks = common.mix64(empty * _STEP ^ tag)
            empty2 = np.setdiff1d(np.arange(m), seg2).astype(np.uint64)
            found = np.r_[common.mix64(inner[None, :] * _STEP + marks[:, None]).ravel(), common.mix64(empty2[None, :] * _STEP + common.mix64(marks)[:, None]).ravel()]
        sigs.append(found)
        owners.append(np.full(len(found), who[k]))
    return np.concatenate(sigs), np.concatenate(owners)


class Lists:
    """Inverted lists of a block, and DivideSkip over them."""

    def __init__(self, sets: list[np.ndarray], ladder: Ladder, mu: float = 0.0085):
        self.sets, self.ladder, self.mu = sets, ladder, mu
        size = np.array([len(s) for s in sets])
        flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        kinds, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(inverse, kind="stable")  # documents ascend within a list
        first = np.cumsum(count) - count
        self.docs, self.first, self.count = doc[order], first, count
        self.inverse, self.at = inverse, np.cumsum(size) - size
        self.keys = inverse[order] * np.int64(len(sets)) + self.docs  # (list, document), ascending
        self.size = size

    def search(self, q: int, skip) -> list[int]:
        """Documents that link with ``q``, without those for which ``skip`` holds."""
        s = int(self.size[q])
        if not s:
            return []
        return self.lookup(self.inverse[self.at[q] : self.at[q] + s], s, skip, q)

    def lookup(self, lists: np.ndarray, s: int, skip, q: int = -1) -> list[int]:
        """``lists``: ids of the inverted lists of the query's shingles that the block has; ``s``: all its shingles."""
        need = -(-self.ladder.num * s // self.ladder.den)
        if len(lists) < need:
            return []
        longest = int(self.count[lists].max())
        lists = lists[np.argsort(self.count[lists], kind="stable")]
        aside = min(need - 1, int(need / (self.mu * np.log2(longest + 1) + 1)))
        short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
        docs, first, count = self.docs, self.first, self.count
        least = need - aside
        if int(count[short].sum()) <= HEAP:
            seen: dict[int, int] = {}
            for d in heapq.merge(*(docs[first[k] : first[k] + count[k]].tolist() for k in short)):
                seen[d] = seen.get(d, 0) + 1
            cand, hits = np.fromiter(seen.keys(), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen))
        else:  # the same merge, by sorting
            cand, hits = np.unique(np.concatenate([docs[first[k] : first[k] + count[k]] for k in short.tolist()]), return_counts=True)
        num, den = self.ladder.num, self.ladder.den
        v = self.size[cand]
        ok = (hits >= least) & (cand != q) & (v * den >= num * s) & (s * den >= num * v)
        ok[ok] = np.fromiter((not skip(d) for d in cand[ok].tolist()), bool, int(ok.sum()))
        cand, hits, v = cand[ok], hits[ok], v[ok]
        want = -(-num * (s + v) // (den + num))
        found: list[int] = []
        # binary probes of the long lists, some at a time; who has enough or can't reach it leaves
        for at in range(0, len(long_), PROBES):
            if not len(cand):
                break
            part = long_[at : at + PROBES]
            key = part[:, None] * np.int64(len(self.size)) + cand[None, :]
            place = np.minimum(np.searchsorted(self.keys, key.ravel()), len(self.keys) - 1)
            hits = hits + (self.keys[place] == key.ravel()).reshape(key.shape).sum(0)
            done = hits >= want
            found += cand[done].tolist()
            stay = ~done & (hits + (len(long_) - at - len(part)) >= want)
            cand, hits, want = cand[stay], hits[stay], want[stay]
        return found + cand[hits >= want].tolist()


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def link_block(sets: list[np.ndarray], ladder: Ladder) -> list[int]:
    """Component (index of its first document) of each document of a block."""
    u = Union(len(sets))
    if len(sets) > 1:
        lists = Lists(sets, ladder)
        for q in range(len(sets)):
            for d in lists.search(q, lambda d, q=q: u.find(d) == u.find(q)):
                u.join(q, d)
    return [u.find(k) for k in range(len(sets))]


_SIGS = "bucket long, sig binary, cid binary, n binary, a binary, b binary"
SIG_BYTES = 5


def tied(docs: DataFrame, words: int, ladder: Ladder, buckets: int) -> DataFrame:
    """``a, b``: classes with a signature in common, as stars."""

    def stars(sig: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which rows lead their signature, distinct pairs of leader and other)."""
        order = np.lexsort((cid, sig))
        sig, cid = sig[order], cid[order]
        first = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
        hub = cid[first][np.cumsum(first) - 1] if len(sig) else cid
        pairs = np.stack([hub[~first], cid[~first]], 1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).reshape(-1, 2)
        return order[first], pairs

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for batch in common.slices(batches):
            once = {class_id(s): s for s in make.sets(batch.column(0).to_pylist()) if len(s)}
            sig, who = signatures(list(once.values()), ladder)
            cid = np.fromiter(once, np.int64, len(once))[who]
            bucket = (sig >> np.uint64(8 * SIG_BYTES)) % np.uint64(buckets)
            lead, ends = stars(sig, cid)
            # by bucket and class: a class's number stands once before its signatures
            lead = lead[np.lexsort((cid[lead], bucket[lead]))]
            b, c, g = bucket[lead].astype(np.int64), cid[lead], packed(sig[lead], SIG_BYTES)
            new = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (c[1:] != c[:-1])]) if len(b) else np.zeros(0, np.int64)
            n = np.diff(np.r_[new, len(b)])
            rows = {r["bucket"]: r | {"a": b"", "b": b""} for r in dealt(b[new], {"cid": c[new], "n": n.astype(np.uint32)})}
            for r in dealt(b, {"sig": g}):
                rows[r["bucket"]].update(r)
            for r in dealt((common.mix64(ends[:, 1].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), {"a": ends[:, 0], "b": ends[:, 1]}):
                rows.setdefault(r["bucket"], {"bucket": r["bucket"], "sig": b"", "cid": b"", "n": b""}).update(r)
            yield rows_of(_SIGS, list(rows.values()))

    def meet(t: pa.Table) -> pa.Table:
        sig = unpacked(b"".join(t["sig"].to_pylist()), SIG_BYTES)
        cid, a, b = (np.frombuffer(b"".join(t[k].to_pylist()), "<i8") for k in ("cid", "a", "b"))
        _, pairs = stars(sig, np.repeat(cid, np.frombuffer(b"".join(t["n"].to_pylist()), "<u4")))
        return pa.table({"a": np.r_[a, pairs[:, 0]], "b": np.r_[b, pairs[:, 1]]})

    return docs.select("text").mapInArrow(deal, _SIGS).groupBy("bucket").applyInArrow(meet, "a long, b long")


def bloom_words(ids: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """``w, v``: 64-bit words of a Bloom filter of ``ids (id)``; at most ``bits / 64`` rows, however many ids there are."""
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    return ids.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}L) & 63 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))


def bloom(ids: DataFrame, bits: int = BLOOM_BITS) -> bytes:
    """The same as bytes for Python workers."""
    out = np.zeros(bits // 64, np.int64)
    for r in bloom_words(ids, bits).toLocalIterator():
        out[r.w] = r.v
    return out.tobytes()


def chosen(batches: Iterator[pa.RecordBatch], bits: bytes, make: Shingler, given: set) -> Iterator[dict[int, np.ndarray]]:
    """Sets by class, a slice at a time, of rows ``bit, text`` whose bit is set; each class once."""
    mask = np.frombuffer(bits, np.int64)
    for batch in batches:
        bit = batch.column(0).to_numpy()
        for part in common.slices([batch.filter(pa.array((mask[bit >> 6] >> (bit & 63) & 1).astype(bool)))]):
            found = {class_id(s): s for s in make.sets(part.column(1).to_pylist()) if len(s)}
            found = {c: s for c, s in found.items() if c not in given}
            given.update(found)
            if found:
                yield found


def with_bit(docs: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    return docs.select(F.pmod(F.xxhash64(_key()), F.lit(bits)).alias("bit"), "text")


def chosen_sets(docs: DataFrame, words: int, filter_bits: bytes) -> DataFrame:
    """``cid, s``: sets of the documents whose id the filter lets pass, each class once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in chosen(batches, shared.value, Shingler(words), set()):
            yield common.as_arrow("cid long, s binary", {"cid": list(found), "s": [x.tobytes() for x in found.values()]})

    return with_bit(docs).mapInArrow(run, "cid long, s binary")


def _key():
    """An id for every row; rows without one share it."""
    return F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def search_blocks(members: DataFrame, ladder: Ladder, groups: int) -> DataFrame:
    """``cid, label`` of ``members (block, cid, s)``: each block searched whole, several blocks to a task."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("cid", "ascending")])
        block, cid, sets = t["block"].to_numpy(), t["cid"].to_numpy(), arrays(t["s"])
        new = np.r_[True, (cid[1:] != cid[:-1]) | (block[1:] != block[:-1])]  # a class comes once from each task of the scan
        block, cid, sets = block[new], cid[new], [s for s, k in zip(sets, new.tolist(), strict=True) if k]
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        label = cid.copy()
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(block)], strict=True):
            label[a:b] = cid[a + np.array(link_block(sets[a:b], ladder))]
        return pa.table({"block": block, "cid": cid, "label": label})

    return members.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("g").applyInArrow(run, "block long, cid long, label long")


def search_tiles(queries: DataFrame, records: DataFrame, ladder: Ladder) -> DataFrame:
    """``a, b``: labels that a link joins. Both sides: ``block, tile, part, label, cid, s``; a group is a pair of parts."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = set()
        if left.num_rows and right.num_rows:
            q, r = left["label"].to_pylist(), right["label"].to_pylist()
            lists = Lists(arrays(right["s"]), ladder)
            kinds = np.unique(np.concatenate(lists.sets))
            for lab, s in zip(q, arrays(left["s"]), strict=True):
                at = np.minimum(np.searchsorted(kinds, s), len(kinds) - 1)
                own = at[kinds[at] == s]
                for d in lists.lookup(own, len(s), lambda d, lab=lab: r[d] == lab or (min(lab, r[d]), max(lab, r[d])) in pairs):
                    pairs.add((min(lab, r[d]), max(lab, r[d])))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return queries.groupBy("block", "qp", "rp").cogroup(records.groupBy("block", "qp", "rp")).applyInArrow(run, "a long, b long")


_RARE = "bucket long, cid binary, n binary, h binary, often binary, direct_c binary, direct_h binary"
H_BYTES = 6
#: Classes of one slice from which on a shingle counts as frequent.
OFTEN = 64


def shared_shingles(docs: DataFrame, words: int, filter_bits: bytes, buckets: int) -> DataFrame:
    """``cid, h, df`` of the shingles that two classes or more of the chosen documents have; ``h`` by its low bits and bucket, ``df`` -1 for frequent ones.

    A slice that finds a shingle in many classes says so once and passes these
    classes on itself, so no task sees a hot shingle more than ``OFTEN`` times a slice.
    """
    mask = np.uint64((1 << 8 * H_BYTES) - 1)
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in chosen(batches, shared.value, Shingler(words), set()):
            h = np.concatenate(list(found.values()))
            c = np.repeat(np.array(list(found), np.int64), [len(x) for x in found.values()])
            bucket = ((h >> np.uint64(8 * H_BYTES)) % np.uint64(buckets)).astype(np.int64)
            kinds, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            often = count >= OFTEN
            many = often[inverse]
            rows: dict[int, dict] = {}
            blank = dict.fromkeys(("cid", "n", "h", "often", "direct_c", "direct_h"), b"")
            put = lambda found: [rows.setdefault(r["bucket"], dict(blank)).update(r) for r in found]  # noqa: B023, E731
            order = np.lexsort((c[~many], bucket[~many]))
            b1, c1, h1 = bucket[~many][order], c[~many][order], packed(h[~many][order] & mask, H_BYTES)
            new = np.flatnonzero(np.r_[True, (b1[1:] != b1[:-1]) | (c1[1:] != c1[:-1])]) if len(b1) else np.zeros(0, np.int64)
            put(dealt(b1[new], {"cid": c1[new], "n": np.diff(np.r_[new, len(b1)]).astype(np.uint32)}))
            put(dealt(b1, {"h": h1}))
            k = kinds[often]
            put(dealt(((k >> np.uint64(8 * H_BYTES)) % np.uint64(buckets)).astype(np.int64), {"often": packed(k & mask, H_BYTES)}))
            # settled rows keep their bucket's number in the hash, and go anywhere even
            full = (h[many] & mask) | (bucket[many].astype(np.uint64) << np.uint64(8 * H_BYTES))
            put(dealt((common.mix64(c[many].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), {"direct_c": c[many], "direct_h": full}))
            yield rows_of(_RARE, list(rows.values()))

    def meet(t: pa.Table) -> pa.Table:
        own = np.uint64(t["bucket"][0].as_py()) << np.uint64(8 * H_BYTES)
        whole = lambda k, kind: np.frombuffer(b"".join(t[k].to_pylist()), kind)
        h = unpacked(b"".join(t["h"].to_pylist()), H_BYTES)
        c = np.repeat(whole("cid", "<i8"), whole("n", "<u4"))
        often = unpacked(b"".join(t["often"].to_pylist()), H_BYTES)
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.zeros(0, bool)
        h, c = h[once], c[once]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(h)])
        df = np.where(np.isin(h[first], often), -1, n)
        df = np.repeat(df, n)
        keep = df != 1
        direct_h = whole("direct_h", "<u8")
        return pa.table({
            "cid": np.r_[c[keep], whole("direct_c", "<i8")], "h": np.r_[h[keep] | own, direct_h].astype(np.int64),
            "df": np.r_[df[keep], np.full(len(direct_h), -1)].astype(np.int64),
        })

    return with_bit(docs).mapInArrow(deal, _RARE).groupBy("bucket").applyInArrow(meet, "cid long, h long, df long")


def refined(docs: DataFrame, words: int, members: DataFrame, ladder: Ladder, buckets: int) -> DataFrame:
    """``cid, block``: smaller blocks of the ``members (cid, id, n)`` of large ones, by prefixes in order of exact rarity.

    ``id``: a document of the class, ``n``: its shingles. A set of n elements
    links only with sets that have one of its n - ceil(num n / den) + 1 rarest
    elements among their own rarest; elements that no other class has come first,
    so a set with enough of them links with nothing and leaves.
    """
    found = shared_shingles(docs, words, bloom(members.select("id")), buckets)
    rare = F.when(F.col("df") < 0, F.lit(1 << 40)).otherwise(F.col("df"))
    lists = found.select("cid", rare.alias("df"), "h").groupBy("cid").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("shared"))
    left = F.col("n") - F.ceil(F.col("n") * ladder.num / ladder.den) + 1 - (F.col("n") - F.size("shared"))
    keys = lists.join(members.select("cid", "n"), "cid").where(left > 0).select("cid", F.explode(F.slice("shared", F.lit(1), left.cast("int"))).alias("e"))
    keys = written(keys.select(F.col("e.h").alias("h"), "cid"))
    hubs = keys.groupBy("h").agg(F.min("cid").alias("hub"), F.max("cid").alias("top")).where("hub <> top").select("h", "hub")
    return blocks_of(components(keys.join(hubs, "h").select(F.col("hub").alias("a"), F.col("cid").alias("b")).where("a <> b").distinct()))


def blocks_of(found: DataFrame) -> DataFrame:
    """``cid, block`` of components, their least members included."""
    return found.unionByName(found.select(F.col("label").alias("node"), "label").distinct()).select(F.col("node").alias("cid"), F.col("label").alias("block"))


def linked_classes(docs: DataFrame, rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``cid, label`` of every class that links with another: the least class of its component. ``rows``: ``doc_id, cid`` of ``docs``."""
    ladder, n_docs = Ladder(num, den), rows.count()
    buckets, groups = max(4, -(-n_docs // DOCS_PER_BUCKET)), max(8, -(-n_docs // 2000))
    blocks = written(blocks_of(components(tied(docs, words, ladder, buckets))))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
    members = blocks.join(sizes, "block")
    if not sizes.where(F.col("n") > BLOCK).isEmpty():
        large = written(owners(rows, members.where(F.col("n") > BLOCK)))
        finer = refined(docs, words, large, ladder, buckets)
        blocks = written(members.where(F.col("n") <= BLOCK).select("cid", "block").unionByName(finer))
        sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
        members = blocks.join(sizes, "block")
    # one document of each class in a block gives its set; texts are not read again after this
    sets = chosen_sets(docs, words, bloom(owners(rows, blocks).select("id")))
    # one search over both: small blocks whole, large ones in parts by class
    part = F.when(F.col("n") > BLOCK, F.xxhash64("block", F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / BLOCK)))).otherwise(F.col("block"))
    labels = written(search_blocks(sets.join(members.select("cid", part.alias("block")), "cid"), ladder, groups).select("cid", "label"))
    large = sizes.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return labels
    return merge_large(labels, blocks.join(large, "block").select("block", "cid"), sets, ladder, groups)


def owners(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``cid, id, n``: the least document of each class and its shingles."""
    return rows.join(classes.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.min(_key()).alias("id"), F.max("n_shingles").alias("n"))


def merge_large(labels: DataFrame, large: DataFrame, sets: DataFrame, ladder: Ladder, groups: int) -> DataFrame:
    """Labels of large blocks, merged over their parts."""
    large = written(large)
    kept = written(sets.join(large, "cid").groupBy("block", "cid").agg(F.first("s").alias("s")))
    rounds, before = 0, None
    while True:
        # the least class of each component stands for it
        reps = kept.join(labels.select("cid", "label"), "cid").where("cid = label").select("block", "cid", "s")
        counts = reps.groupBy("block").agg(F.count("*").alias("n"))
        total = counts.where("n > 1").agg(F.sum("n")).first()[0] or 0
        if total == 0:
            return labels
        if before is not None and 2 * total > before:
            break
        before, rounds = total, rounds + 1
        part = F.pmod(F.xxhash64("cid", F.lit(rounds)), F.ceil(F.col("n") / BLOCK))
        found = search_blocks(reps.join(counts.where("n > 1"), "block").select(F.xxhash64("block", part).alias("block"), "cid", "s"), ladder, groups)
        onward = found.where("cid <> label").select(F.col("cid").alias("label"), F.col("label").alias("onward"))
        labels = written(labels.join(onward, "label", "left").select("cid", F.coalesce("onward", "label").alias("label")))
    # blocks still in several components: all outside the largest against all of the block
    whole = kept.join(labels, "cid")
    per = whole.groupBy("block", "label").agg(F.count("*").alias("n"))
    open_ = per.groupBy("block").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("k")).where("k > 1")
    open_ = open_.select("block", F.col("top.label").alias("top"), F.ceil(F.col("total") / BLOCK).alias("rps"), F.ceil((F.col("total") - F.col("top.n")) / BLOCK).alias("qps"))
    rows = written(whole.join(open_, "block"))
    queries = rows.where("label <> top").select("block", "label", "s", F.pmod(F.xxhash64("cid"), F.col("qps")).alias("qp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rps") - 1)).alias("rp"))
    records = rows.select("block", "label", "s", F.pmod(F.xxhash64("cid"), F.col("rps")).alias("rp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qps") - 1)).alias("qp"))
    merged = components(search_tiles(queries, records, ladder))
    return labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("onward")), "label", "left").select("cid", F.coalesce("onward", "label").alias("label"))


def class_rows(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, cid`` of every row."""
    spec = "doc_id long, n_shingles long, cid long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for batch in common.slices(batches):
            sets = make.sets(batch.column(1).to_pylist())
            yield common.as_arrow(spec, {"doc_id": batch.column(0), "n_shingles": [len(s) for s in sets], "cid": [class_id(s) if len(s) else None for s in sets]})

    return docs.mapInArrow(run, spec)


def ngram_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    d = common.id_text(docs)
    rows = written(class_rows(d, words))
    labels = linked_classes(d, rows, words, num, den)
    # least document of each class (partial sums first), then of each component
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least")).join(labels, "cid", "left").select("cid", F.coalesce("label", "cid").alias("label"), "least")
    of = classes.join(classes.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("cid", "component_id")
    alone = rows.where("cid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("cid is not null").join(of, "cid").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of linked rows, that of least id, all columns as they were.

    Rows without an id all stay. Of rows of one id one stays where their texts link, else all.
    """
    found = written(ngram_join(docs, words, num, den))
    gone = found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    # only rows that a filter of fixed size can't clear are dealt out for the exact check; texts of the others stay where they are
    words_of = F.broadcast(bloom_words(gone.select(F.col("_gone").alias("id"))).select(F.col("w").alias("_w"), F.col("v").alias("_v")))
    bit = f"pmod(xxhash64(cast(doc_id as bigint)), {BLOOM_BITS}L)"
    marked = docs.withColumn("_at", F.expr(f"shiftright({bit}, 6)")).join(words_of, F.col("_at") == F.col("_w"), "left")
    maybe = F.expr(f"coalesce(_v, 0L) & shiftleft(1L, cast({bit} & 63 as int))") != 0
    clear = marked.where(~maybe).select(*docs.columns)
    doubted = marked.where(maybe).select(*docs.columns)
    kept = clear.unionByName(doubted.join(gone, doubted["doc_id"] == gone["_gone"], "left_anti"))
    again = found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("component_id").alias("k")).where("n > 1 and k = 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return kept
    again = written(again)
    once = kept.join(again, kept["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, kept["doc_id"] == again["_again"], "left_anti").unionByName(once)
