"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

A document is its token ids and the id 1; it is cut into pieces of at most
``CAPACITY`` ids, whole ones from its start. Pieces are dealt at random (by a
hash of document, start, checksum and task; of equal pieces of a task, which are
interchangeable, by their number too, so repeated rows spread and a task that
runs again deals the same whatever the order of its rows) over groups of about
as many as ``GROUP`` documents have; in a group the longest piece goes first, into the
first sequence with room, found in a tournament tree whose inner nodes hold the
largest free capacity below them. Only sizes are shuffled, never texts.

Ids are those of the library for the vocabulary: its merge ranks are run by the
faster of two implementations that give equal ids (held to each other in the
tests); a text that this one can't take goes to the other.

Empty or null texts are one piece of one id. Ties in length go by document,
start, checksum and the document's ids. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
GROUP = 4096
END = 1
VOCABULARY = "byte_bpe_50k"
#: Stands for a missing id where pieces are dealt.
NO_ID = (1 << 63) - 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long"
SPEC = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FirstFit:
    """Bins of equal capacity, the first with room found in a tree of maxima."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def put(self, size: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        free, node = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        offset = self.capacity - free[node]
        free[node] -= size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            best = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == best:
                break
            free[node] = best
        return bin_, offset


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, given in the order to place them (decreasing for first-fit decreasing)."""
    whole = sum(n == capacity for n in lengths)
    tree = FirstFit(capacity, max(1, len(lengths) - whole))
    out, filled = [], 0
    for n in lengths:
        if n == capacity:
            out.append((filled, 0))  # a full sequence of its own needs no search
            filled += 1
        else:
            b, o = tree.put(n)
            out.append((whole + b, o))
    return out


_encoders: dict[str, tuple] = {}


def encoder(vocabulary: str = VOCABULARY):
    """text -> ids, one per worker."""
    if vocabulary not in _encoders:
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        with open(P.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        slow = Tokenizer.from_file(P.path(f"{vocabulary}.json"))
        special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding(vocabulary, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
            except Exception:  # noqa: BLE001  the pattern engine's own limits; the other implementation has none
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def pieces(docs: DataFrame, groups: int, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every row with their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, seen = encoder(vocabulary), {}
        task = common.mix64(np.array([TaskContext.get().partitionId()], np.uint64))
        for batch in common.slices(batches):
            rows: list[list] = [[] for _ in range(5)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), END).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    for col, v in zip(rows, (i, at, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        col.append(v)
            key = np.broadcast_to(task, len(rows[0]))
            for values in ([NO_ID if i is None else i for i in rows[0]], *rows[1:]):
                key = common.mix64(key + np.array(values, np.int64).astype(np.uint64))
            turn = []
            for k in key.tolist():
                turn.append(seen.get(k, 0))
                seen[k] = turn[-1] + 1
            group = (common.mix64(key + np.array(turn, np.uint64)) % np.uint64(groups)).astype(np.int64)
            yield common.as_arrow(PIECES, dict(zip((f.split(" ")[0] for f in PIECES.split(", ")), (*rows, group), strict=True)))

    return common.id_text(docs).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece of every row with its sequence and offset."""
    groups = max(1, -(-docs.count() // group))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        placed = np.array(pack(t["length"].to_pylist(), capacity), np.int64).reshape(-1, 2)
        g = t["grp"][0].as_py()
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array((g << 32) + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))

    return pieces(docs, groups, capacity, vocabulary).groupBy("grp").applyInArrow(fit, SPEC)


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, ids, and the share of padding."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), (1 - F.sum("n") / (F.count("*") * capacity)).alias("padding"))
