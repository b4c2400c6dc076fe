"""Token counts by rank-synchronous array merging.

Texts are cut into the pre-tokens of the byte-level vocabulary; the distinct
pre-tokens of a slice that were not counted before are laid out as ragged numpy
arrays of symbol ids. In each step every sequence finds its pair of lowest rank
and all its occurrences (left to right, not overlapping) merge at once, over
all sequences together. A sequence without a mergeable pair leaves; its
surviving symbols are its count.

Pre-tokens follow the library's Unicode tables. Texts whose code points are all
below ``SAFE`` are cut by the pattern; for these the tables of the pattern engine
and of the library agree (held by the tests). All others are cut by the library's own
pre-tokenizer, long ones in stretches that end before a space, where a pre-token
ends in any case.

Special tokens: the library matches their strings inside texts by default, each
as one token; texts are split on them first.
Empty or null text: no tokens. Ties cannot arise: ranks are unique.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from . import common

#: Vocabulary file of the public byte-level BPE; a parameter of every function.
VOCABULARY = "byte_bpe_50k.json"
SPEC = "doc_id long, n_bytes long, n_tokens long"
#: Pre-tokens remembered by a worker; the memory bound, not a limit on inputs.
REMEMBERED = 200_000
#: Code points below this are letters, numbers or spaces to the pattern engine and the library alike; in UTF-8 their bytes are below ``SAFE_BYTE``.
SAFE, SAFE_BYTE = 0x540, 0xD5
#: Characters from which on the library's pre-tokenizer gets a text in stretches.
STRETCH = 100_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule: printable bytes stand for themselves, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in printable}
    spare = 256
    for b in range(256):
        if chr(b) not in names or b not in printable:
            names[chr(spare)] = b
            spare += 1
    return names


#: A letter before a space: between them a pre-token ends.
EDGE = regex.compile(r"[A-Za-z](?= )")


class Merger:
    """Merge table of a vocabulary as sorted arrays, and the memo of counted pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        self.by_rank = made
        self.base = np.zeros(256, np.int64)
        for ch, b in byte_alphabet().items():
            self.base[b] = vocab[ch]
        self.pattern = regex.compile(pattern)
        cutter = spec["pre_tokenizer"]
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=cutter["add_prefix_space"], use_regex=cutter["use_regex"])
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("content")]
        self.special_cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo: dict[str, int] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a huge number where the pair is no merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int64(1) << 40)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each byte string."""
        n = len(words)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        lens = np.fromiter(map(len, words), np.int64, n)
        sym = self.base[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(n), lens)
        never = np.int64(1) << 40
        # rank of the pair that starts at each symbol; a sequence's last symbol starts none
        rank = np.full(len(sym), never)
        if len(sym) > 1:
            inner = seq[:-1] == seq[1:]
            rank[:-1][inner] = self.rank_of(sym[:-1][inner], sym[1:][inner])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            ended = low >= never
            if ended.any():
                out[seq[starts[ended]]] = sizes[ended]
                stay = np.repeat(~ended, sizes)
                sym, seq, rank = sym[stay], seq[stay], rank[stay]
                low, sizes = low[~ended], sizes[~ended]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, sizes)
            # runs of the same symbol pair with itself: take every second start, left to right
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():
                run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
                at = at[nth % 2 == 0]
            sym[at] = self.by_rank[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new_of = np.cumsum(keep) - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            # only pairs that touch a merged symbol have a new rank
            touched = new_of[at]
            touched = np.unique(np.r_[touched, touched[touched > 0] - 1])
            last = touched == len(sym) - 1
            t = touched[~last]
            same = seq[t] == seq[t + 1]
            rank[touched] = never
            rank[t[same]] = self.rank_of(sym[t[same]], sym[t[same] + 1])
        return out

    def cut_up(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw) or raw.max() < SAFE_BYTE:
            return self.pattern.findall(text)
        out, at = [], 0
        while at < len(text):
            end = EDGE.search(text, at + STRETCH)
            to = end.start() + 1 if end else len(text)
            part = text[at:to]
            out += [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
            at = to
        return out

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, extra = [], []
        for text in texts:
            pieces = self.special_cut.split(text) if self.special_cut is not None and any(s in text for s in self.special) else [text]
            extra.append(len(pieces) - 1)
            parts.append([t for p in pieces for t in self.cut_up(p)])
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        fresh = list(set().union(*parts) - self.memo.keys())
        self.memo.update(zip(fresh, self.counts([w.encode() for w in fresh]).tolist(), strict=True))
        get = self.memo.__getitem__
        return [sum(map(get, p)) + e for p, e in zip(parts, extra, strict=True)]


_mergers: dict[tuple[str, str], Merger] = {}


def merger(vocabulary: str = VOCABULARY) -> Merger:
    """One per worker and vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    if (path, vocabulary) not in _mergers:
        _mergers[path, vocabulary] = Merger(path, public_tokenizers.PATTERN)
    return _mergers[path, vocabulary]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; no shuffle, no state across rows but a bounded memo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in common.slices(batches, chars=2_000_000):
            texts = batch.column(1).to_pylist()
            yield common.as_arrow(SPEC, {"doc_id": batch.column(0), "n_bytes": pc.binary_length(batch.column(1)).cast(pa.int64()), "n_tokens": m.texts(texts)})

    return common.id_text(docs, id_col, text_col).mapInArrow(run, SPEC)
