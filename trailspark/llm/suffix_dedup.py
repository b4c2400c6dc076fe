"""Substring dedup by a hash-compared suffix sort.

A byte goes when a string of ``LENGTH`` bytes over it also starts in a document
of smaller id. Such strings are found by sorting suffixes: prefix polynomial
hashes (mod 2**64, over random byte values) give the hash of any stretch at
once, a binary search over lengths finds the common extension of two suffixes,
so a comparison takes log(LENGTH) steps, and a bottom-up mergesort orders them.
Neighbours with a common extension of ``LENGTH`` form a class, verified byte by
byte against collisions; all but the class's smallest document lose the bytes.

Only suffixes that can matter are sorted, and each in one task:

1. Equal texts are one text, told by SHA-256: all but the smallest id go whole.
   Map-side sums leave one copy of a text for each task of the scan.
2. Each window of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte string of
   least hash (the first of equals), a choice that depends on the window's bytes
   alone. Anchor hashes alone are dealt out first; those of one text only drop.
3. For anchors of several texts the windows that chose them (one stretch of at
   most ``2 * LENGTH - GRAM`` bytes) are dealt by anchor and sorted there.

Hot passages: a task that meets an anchor in several texts, or a stretch in
several documents, settles that itself and passes on one row for all, so a
task downstream sees a hot key at most once a slice. No pairs are formed.
Buckets are sized by the bytes of all texts, so long texts make more of them.

Texts are told apart by 40 bits of a hash where only candidates depend on it: a
passage of two texts alone is missed if these agree in all 40.

Empty and null texts, and those under ``LENGTH`` bytes, lose nothing. A null id
is larger than any other. Rows of equal id never remove bytes of each other;
repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.operators.graph import spread

from . import common
from .components import written

LENGTH, GRAM = 50, 16
#: Bytes of text for each bucket of anchors and of stretches, and for a slice in Python; slices that deal stretches are larger, for fewer rows.
ANCHOR_BYTES, STRETCH_BYTES, SLICE = 3_000_000, 2_000_000, 2_000_000
#: Windows hashed at a time, and the low bits of their keys that hold positions.
CHUNK, POSITION = 1 << 17, 18
NULL_ID = (1 << 63) - 1


def gram_hashes(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on, or from those at ``at`` (GRAM is two words of eight bytes)."""
    words = np.ndarray((len(data) - 7,), np.uint64, buffer=data, strides=(1,))
    n = len(data) - GRAM + 1
    a, b = (words[:n], words[8 : 8 + n]) if at is None else (words[at], words[at + 8])
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def slide_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by doubling."""
    out, span = a, 1
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    n = len(a) - w + 1
    return np.minimum(out[:n], out[w - span : w - span + n])


def anchors(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes and positions, the first and last window that chose each, and the text of each; ``data``: texts in a row, by start and size."""
    total, w = len(data) - LENGTH + 1, LENGTH - GRAM + 1
    inside = np.zeros(max(total, 0), bool)
    for a, n in zip(start.tolist(), size.tolist(), strict=True):
        if n >= LENGTH:
            inside[a : a + n - LENGTH + 1] = True
    found = []
    low = np.uint64((1 << POSITION) - 1)
    for a in range(0, total, CHUNK):
        window = np.flatnonzero(inside[a : a + CHUNK])
        if len(window):
            # the high bits of a hash, then its place: the least key is the first string of least hash
            key = gram_hashes(data[a : min(a + CHUNK, total) + LENGTH - 1]) & ~low
            key |= np.arange(len(key), dtype=np.uint64)
            pos = (slide_min(key, w)[window] & low).astype(np.int64)
            head = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
            tail = np.r_[head[1:], len(pos)] - 1
            found.append(np.stack([pos[head], window[head], window[tail]]) + a)
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    p, first, last = np.concatenate(found, 1)
    new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])  # an anchor whose windows lie in two chunks
    p, first, last = p[new], first[new], last[np.r_[new[1:], len(p)] - 1]
    return gram_hashes(data, p), p, first, last, np.searchsorted(start, p, side="right") - 1


def stretch_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each stretch, of ``GRAM`` bytes or more."""
    out = common.mix64(size.astype(np.uint64))
    for k in range(0, 2 * LENGTH, GRAM):
        open_ = np.flatnonzero(size > k)
        with np.errstate(over="ignore"):
            out[open_] = common.mix64(out[open_] * np.uint64(0x9E3779B97F4A7C15) + gram_hashes(data, at[open_] + np.minimum(k, size[open_] - GRAM)))
    return out


# Byte values of the polynomial, and its odd base with its inverse mod 2**64.
_VALUE = common.mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Suffixes:
    """Suffixes of a byte buffer, compared over their first ``LENGTH`` bytes through prefix hashes."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.bytes = buffer
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n - 1, 0), _BASE, np.uint64)])[:n]
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _INVERSE, np.uint64)])
            self.prefix = np.r_[np.uint64(0), np.cumsum(_VALUE[buffer] * up, dtype=np.uint64)]

    def hash(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[at + length] - self.prefix[at]) * self.down[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffix pairs, at most ``LENGTH``."""
        out = np.full(len(a), LENGTH, np.int64)
        with np.errstate(over="ignore"):
            # two hashes are equal where what their ends add is what their beginnings take away, which no length changes
            fa, fb, da, db = self.prefix[a], self.prefix[b], self.down[a], self.down[b]
            differ = np.flatnonzero((self.prefix[a + LENGTH] - fa) * da != (self.prefix[b + LENGTH] - fb) * db)
            a, b, da, db = a[differ], b[differ], da[differ], db[differ]
            apart = fa[differ] * da - fb[differ] * db
            low, open_ = np.zeros(len(a), np.int64), LENGTH  # the extension is in low .. low + open_ - 1
            while open_ > 1:
                half = open_ >> 1
                mid = low + half
                same = self.prefix[a + mid] * da - self.prefix[b + mid] * db == apart
                low = np.where(same, mid, low)
                open_ -= half
        out[differ] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        at = np.minimum(n, LENGTH - 1)
        return (n < LENGTH) & (self.bytes[a + at] < self.bytes[b + at])

    def sort(self, items: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes at ``items`` within runs of equal ``group`` (given grouped): a mergesort of all groups at once."""
        n = len(items)
        perm = np.arange(n)
        if not n:
            return perm
        # a radix step on the first eight bytes leaves only suffixes that share them to the mergesort
        eight = self.bytes[items[:, None] + np.arange(8)].view(">u8").ravel()
        perm = np.lexsort((eight, group))
        group, eight = group[perm], eight[perm]
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (eight[1:] != eight[:-1])])
        size = np.diff(np.r_[first, n])
        # places of runs of two or more, where these begin and how many they are
        at = np.flatnonzero(np.repeat(size > 1, size))
        g0, gs = np.repeat(first, size)[at], np.repeat(size, size)[at]
        hot = np.zeros(n, bool)
        width = 1
        while width < size.max():
            longer = np.flatnonzero(gs > width)
            at, g0, gs = at[longer], g0[longer], gs[longer]
            local = at - g0
            run = local // (2 * width) * (2 * width)
            # pairs of runs that are in order already need no merge
            seam = at[local - run == width]
            seam = seam[self.less(items[perm[seam]], items[perm[seam - 1]])]
            hot[seam - width] = True
            act = np.flatnonzero(hot[g0 + run])
            hot[seam - width] = False
            local, run, begin, act = local[act], run[act], (g0 + run)[act], at[act]
            right = np.flatnonzero(local - run >= width)
            # where each of a right run belongs in its left run, of equals after those; the rest follows by counting
            base = begin[right]
            lo, hi = np.zeros(len(right), np.int64), np.full(len(right), width, np.int64)
            mine = items[perm[act[right]]]
            open_ = np.arange(len(right))
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                go = ~self.less(mine[open_], items[perm[base[open_] + mid]])
                lo[open_] = np.where(go, mid + 1, lo[open_])
                hi[open_] = np.where(go, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            to = act.copy()
            to[right] = act[right] - width + lo
            # those of a left run move on by the elements that come before them
            left = np.flatnonzero(local - run < width)
            to[left] += np.searchsorted(base + lo, act[left], side="right") - np.searchsorted(base, begin[left])
            nxt = perm.copy()
            nxt[to] = perm[act]
            perm = nxt
            width *= 2
        return perm

    def classes(self, items: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted order and the class of each place in it; members are verified by their bytes."""
        perm = self.sort(items, group)
        s = items[perm]
        new = np.ones(len(s), bool)
        if len(s) > 1:
            near = np.flatnonzero(group[1:] == group[:-1])
            eq = near[self.common(s[near], s[near + 1]) >= LENGTH]
            window = np.arange(LENGTH)
            for k in range(0, len(eq), 100_000):
                part = eq[k : k + 100_000]
                ok = (self.bytes[s[part][:, None] + window] == self.bytes[s[part + 1][:, None] + window]).all(1)
                new[part[ok] + 1] = False
        return perm, np.cumsum(new) - 1


def dealt(bucket: np.ndarray, fields: dict[str, np.ndarray]) -> list[dict]:
    """One row for each bucket with the fields' values as bytes."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
    to = np.r_[cut[1:], len(b)] if len(b) else []
    ordered = {k: v[order] for k, v in fields.items()}
    return [{"bucket": int(b[i])} | {k: v[i:j].tobytes() for k, v in ordered.items()} for i, j in zip(cut, to, strict=True)]


def rows_of(spec: str, rows: list[dict]) -> pa.RecordBatch:
    return common.as_arrow(spec, {f.split(" ")[0]: [r[f.split(" ")[0]] for r in rows] for f in spec.split(", ")})


def whole(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def packed(values: np.ndarray, size: int) -> np.ndarray:
    """Low ``size`` bytes of each value, as fixed strings."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).view(f"V{size}").ravel()


def unpacked(raw: bytes, size: int) -> np.ndarray:
    a = np.zeros((len(raw) // size, 8), np.uint8)
    a[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return a.view("<u8").ravel()


_HASHES = "bucket long, decided binary, open_h binary, open_t binary, direct_h binary, direct_t binary"
#: Bytes of an anchor's hash beside its bucket, which comes from all of it, and of a text's hash.
H_BYTES, T_BYTES = 5, 5
H_MASK, T_MASK = (1 << 8 * H_BYTES) - 1, (1 << 8 * T_BYTES) - 1


def shared_anchors(base: DataFrame, buckets: int) -> DataFrame:
    """``t, h``: for each text (by the low bits of its hash) its anchors that another text has too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, chars=SLICE):
            h, _, _, _, who = anchors(*common.text_bytes(batch.column(0)))
            t = (batch.column(1).to_numpy().astype(np.uint64) & np.uint64(T_MASK))[who]
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])  # copies within the slice
            h, t = h[keep], t[keep]
            first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
            size = np.diff(np.r_[np.flatnonzero(first), len(h)])
            many = np.repeat(size > 1, size)
            sets = (
                ("decided", h[many & first], None),
                ("open", h[~many], t[~many]),
                ("direct", h[many], t[many]),
            )
            rows: dict[int, dict] = {}
            blank = {"decided": b"", "open_h": b"", "open_t": b"", "direct_h": b"", "direct_t": b""}
            for name, hh, tt in sets:
                # settled rows go anywhere even: by text
                b = (common.mix64(tt if name == "direct" else hh) % np.uint64(buckets)).astype(np.int64)
                fields = {name: packed(hh, H_BYTES)} if tt is None else {f"{name}_h": packed(hh, H_BYTES), f"{name}_t": packed(tt, T_BYTES)}
                for r in dealt(b, fields):
                    rows.setdefault(r["bucket"], dict(blank)).update(r)
            yield rows_of(_HASHES, list(rows.values()))

    def meet(table: pa.Table) -> pa.Table:
        get = lambda name, size: unpacked(b"".join(table[name].to_pylist()), size)
        decided, h, t = get("decided", H_BYTES), get("open_h", H_BYTES), get("open_t", T_BYTES)
        order = np.argsort(h, kind="stable")
        h, t = h[order], t[order]
        if len(h):
            cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[cut, len(h)])
            several = (np.minimum.reduceat(t, cut) != np.maximum.reduceat(t, cut)) | np.isin(h[cut], decided)
            keep = np.repeat(several, size)
            h, t = h[keep], t[keep]
        h, t = np.r_[h, get("direct_h", H_BYTES)], np.r_[t, get("direct_t", T_BYTES)]
        return pa.table({"t": t.astype(np.int64), "h": h.astype(np.int64)})

    return base.select("text", "th").mapInArrow(deal, _HASHES).groupBy("bucket").applyInArrow(meet, "t long, h long")


_STRETCHES = "bucket long, h binary, doc binary, t binary, start binary, anchor binary, size binary, bytes binary, done binary"
#: A settled stretch of a text: low bits of its hash, its document, start and stop.
_DONE = np.dtype([("t", "<u4"), ("doc", "<i8"), ("start", "<u4"), ("stop", "<u4")])


def merged(d: np.ndarray) -> np.ndarray:
    """Stretches (t, doc, start, stop) with touching ones of a text joined."""
    if not len(d):
        return np.zeros(0, _DONE)
    d = d[np.lexsort((d[:, 2], d[:, 1], d[:, 0]))]
    # ends so far within a text: shift each text beyond the one before
    key = np.cumsum(np.r_[0, (d[1:, :2] != d[:-1, :2]).any(1)]) << 33
    reach = np.maximum.accumulate(d[:, 3] + key)
    head = np.flatnonzero(np.r_[True, d[1:, 2] + key[1:] > reach[:-1]])
    out = np.zeros(len(head), _DONE)
    out["t"], out["doc"], out["start"] = d[head, 0], d[head, 1], d[head, 2]
    out["stop"] = (reach - key)[np.r_[head[1:], len(d)] - 1]
    return out


def later_copies(data: np.ndarray, at: np.ndarray, size: np.ndarray, h: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which stretches equal one of a smaller document, anchor included; verified byte by byte."""
    hashed = stretch_hashes(data, at, size)
    order = np.lexsort((doc, anchor, size, hashed, h))
    new = np.ones(len(h), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (h[a] != h[b]) | (hashed[a] != hashed[b]) | (size[a] != size[b]) | (anchor[a] != anchor[b])
    rep = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.flatnonzero(doc[order] > doc[rep])
    mine, other = order[later], rep[later]
    raw = data.tobytes()
    same = np.fromiter((raw[x : x + n] == raw[y : y + n] for x, y, n in zip(at[mine].tolist(), at[other].tolist(), size[mine].tolist(), strict=True)), bool, len(mine))
    out = np.zeros(len(h), bool)
    out[mine[same]] = True
    return out


def doubled(texts: DataFrame, buckets: int) -> DataFrame:
    """``t, owner, start, stop``: bytes of ``texts (text, th, owner, hs)`` that texts of smaller owners have."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, chars=3 * SLICE):
            data, text_at, text_size = common.text_bytes(batch.column(0))
            t32 = batch.column(1).to_numpy().astype(np.uint64) & np.uint64(0xFFFFFFFF)
            owner, hints = batch.column(2).to_numpy(), batch.column(3)
            # (anchor, text) pairs as numbers: a slice has under 2 ** 18 texts of LENGTH bytes
            n_hints = np.diff(np.asarray(hints.offsets))
            wanted = np.sort((hints.flatten().to_numpy().astype(np.uint64) << np.uint64(18)) | np.repeat(np.arange(len(owner), dtype=np.uint64), n_hints))
            h, p, first, last, who = anchors(data, text_at, text_size)
            mine = ((h & np.uint64(H_MASK)) << np.uint64(18)) | who.astype(np.uint64)
            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, mine), max(len(wanted) - 1, 0))] == mine) if len(wanted) else np.zeros(0, np.int64)
            h, p, first, last, who = (x[hit] for x in (h, p, first, last, who))
            size, doc, t, start = last - first + LENGTH, owner[who], t32[who].astype(np.int64), first - text_at[who]
            gone = later_copies(data, first, size, h, p - first, doc)
            done = np.stack([t[gone], doc[gone], start[gone], start[gone] + size[gone]], 1)
            rows: dict[int, dict] = {}
            blank = dict.fromkeys(("h", "doc", "t", "start", "anchor", "size", "bytes", "done"), b"")
            k = np.flatnonzero(~gone)
            b = (common.mix64(h[k]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            k, b = k[order], b[order]
            fields = {"h": packed(h[k], H_BYTES), "doc": doc[k], "t": t[k].astype(np.uint32), "start": start[k].astype(np.uint32), "anchor": (p - first)[k].astype(np.uint8), "size": size[k].astype(np.uint8)}
            raw, at = data.tobytes(), 0
            for r in dealt(b, fields):
                n = len(r["size"])
                part = k[at : at + n]
                strings = b"".join(raw[x : x + m] for x, m in zip(first[part].tolist(), size[part].tolist(), strict=True))
                rows[r["bucket"]] = dict(blank) | r | {"bytes": pa.Codec("zstd", 5).compress(strings, asbytes=True)}
                at += n
            d = merged(done)
            for r in dealt((common.mix64(d["t"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), {"done": d.view(f"V{_DONE.itemsize}")}):
                rows.setdefault(r["bucket"], dict(blank)).update(r)
            yield rows_of(_STRETCHES, list(rows.values()))

    def meet(table: pa.Table) -> pa.Table:
        done = whole(table["done"], _DONE)
        found = [np.stack([done[k].astype(np.int64) for k in ("t", "doc", "start", "stop")], 1)]
        h = unpacked(b"".join(table["h"].to_pylist()), H_BYTES)
        if len(h):
            doc, t, start = whole(table["doc"], "<i8"), whole(table["t"], "<u4").astype(np.int64), whole(table["start"], "<u4").astype(np.int64)
            anchor, size = whole(table["anchor"], "u1").astype(np.int64), whole(table["size"], "u1").astype(np.int64)
            long = [int(np.frombuffer(x, np.uint8).sum()) for x in table["size"].to_pylist()]
            data = np.frombuffer(b"".join(pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(table["bytes"].to_pylist(), long, strict=True) if n), np.uint8)
            found.append(over(data, h, doc, t, start, anchor, size))
        out = np.concatenate(found)
        return pa.table({"t": out[:, 0], "owner": out[:, 1], "start": out[:, 2], "stop": out[:, 3]})

    # buckets take long for what they weigh, being compressed, so they are not joined into few tasks
    return spread(texts.select("text", "th", "owner", "hs").mapInArrow(deal, _STRETCHES), "bucket").groupBy("bucket").applyInArrow(meet, "t long, owner long, start long, stop long")


def over(data: np.ndarray, h: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, anchor: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(text, document, start, stop) of what smaller documents hold, for stretches grouped by anchor hash."""
    at = np.cumsum(size) - size
    # equal stretches whole: all but those of the smallest document go without a search
    gone = later_copies(data, at, size, h, anchor, doc)
    settled = np.stack([th[gone], doc[gone], start[gone], start[gone] + size[gone]], 1)
    keep = np.flatnonzero(~gone)
    _, inverse, count = np.unique(h[keep], return_inverse=True, return_counts=True)
    keep = keep[count[inverse] > 1]
    if not len(keep):
        return settled
    raw = data.tobytes()
    data = np.frombuffer(b"".join(raw[x : x + m] for x, m in zip(at[keep].tolist(), size[keep].tolist(), strict=True)), np.uint8)
    h, doc, th, start, anchor, size = (x[keep] for x in (h, doc, th, start, anchor, size))
    at = np.cumsum(size) - size
    suffixes = Suffixes(data)
    n = size - LENGTH + 1
    who = np.repeat(np.arange(len(h)), n)
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    # equal windows have equal anchors at equal offsets: groups of (anchor, offset)
    _, hid = np.unique(h, return_inverse=True)
    group = hid[who] * np.int64(2 * LENGTH) + anchor[who] - j
    order = np.argsort(group, kind="stable")
    who, j, group = who[order], j[order], group[order]
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    several = np.repeat(np.diff(np.r_[cut, len(group)]) > 1, np.diff(np.r_[cut, len(group)]))
    who, j, group = who[several], j[several], group[several]
    if not len(who):
        return settled
    perm, cls = suffixes.classes(at[who] + j, group)
    who, j = who[perm], j[perm]
    first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
    least = np.minimum.reduceat(doc[who], first)[cls]
    gone = doc[who] > least
    who, j = who[gone], j[gone]
    if not len(who):
        return settled
    order = np.lexsort((j, who))
    who, j = who[order], j[order]
    head = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (j[1:] != j[:-1] + 1)])
    tail = np.r_[head[1:], len(who)] - 1
    w = who[head]
    return np.concatenate([settled, np.stack([th[w], doc[w], start[w] + j[head], start[w] + j[tail] + LENGTH], 1)])


def substring_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Every row with what it loses; ``with_text`` adds the remaining text (bytes that are no whole characters are replaced)."""
    d = common.id_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    base = d.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text", "n_bytes", F.xxhash64("text").alias("th"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    total = d.agg(F.sum("n_bytes")).first()[0] or 0
    # one row for each text that can lose bytes; a task of the scan hands on each text once
    texts = base.where(F.col("n_bytes") >= LENGTH).groupBy("th", "sha").agg(F.min("doc").alias("owner"), F.first("text").alias("text"))
    keys = written(base.where(F.col("n_bytes") >= LENGTH).groupBy("th", "sha").agg(F.min("doc").alias("owner")))
    hints = shared_anchors(base, max(4, -(-total // ANCHOR_BYTES))).groupBy("t").agg(F.collect_list("h").alias("hs"))
    hinted = keys.join(hints, F.col("th").bitwiseAND(F.lit(T_MASK)) == hints["t"]).select("th", "sha", "hs")
    lost = doubled(texts.join(hinted, ["th", "sha"]), max(4, -(-total // STRETCH_BYTES)))
    spans = lost.groupBy("t", "owner").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = keys.join(spans, (F.col("th").bitwiseAND(F.lit(0xFFFFFFFF)) == spans["t"]) & (keys["owner"] == spans["owner"])).select("th", "sha", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    spec = "th long, sha binary, owner long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, chars=SLICE):
            rows = []
            for th, sha, owner, text, starts, stops in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int32)
                np.add.at(gone, np.array(starts), 1)
                np.add.at(gone, np.array(stops), -1)
                mask = np.cumsum(gone)[:-1] > 0
                left = raw[~mask].tobytes()
                runs = int((mask[1:] & ~mask[:-1]).sum() + mask[0])
                row = {"th": th, "sha": sha, "owner": owner, "n_removed": int(mask.sum()), "n_spans": runs, "kept_sha256": hashlib.sha256(left).hexdigest()}
                rows.append(row | ({"kept": left.decode(errors="replace")} if with_text else {}))
            yield rows_of(spec, rows)

    # the same columns of ``texts`` as above, so that they are dealt out once for both
    cuts = texts.join(spans, ["th", "sha"]).select("th", "sha", "owner", "text", "starts", "stops").mapInArrow(cut, spec)
    # a table of texts as numbers, written so that both sides of the last join can be split where a text is hot
    settled = written(keys.join(cuts.drop("owner"), ["th", "sha"], "left"))
    copy = F.col("doc") > F.col("owner")
    out = {
        "n_removed": F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)).cast("long")),
        "n_spans": F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long"),
        "kept_sha256": F.when(copy, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))),
    }
    if with_text:
        out["text"] = F.when(copy, "").otherwise(F.coalesce("kept", "text"))
    rows = base if with_text else base.drop("text")
    return rows.join(settled, ["th", "sha"], "left").select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", *(c.alias(k) for k, c in out.items()))
