"""HTML extraction: page structure, and a host suffix array for what pages repeat.

A page becomes blocks of words (a block ends at block-level tags; ``<br>`` is
white space). Structure settles what it can: scripts, styles, menus, headers,
footers, asides, forms, notices, adverts and reader comments go, by element,
role, or the words of class and id. Inside an article formulas, what stands in
for media, and hidden elements are text like any other. A page with text in one article (or else
one main element) is vouched for by structure.

The runs of a host have their say on every page. A page is one token stream of
all its blocks, with block marks; the host's suffix array, by prefix doubling,
gives every run of ``RUN`` tokens or more that occurs on ``PAGES`` distinct pages
or more. Of several articles (teasers, say) those go that are covered by half or
more. Where all are, one or several, they are teasers if the uncovered words of
the blocks around them outnumber theirs, which then are the text, and the text
otherwise. Pages without an article lose the covered runs of their open blocks
and keep the unique ones.

A large host is looked at in parts, dealt by host and page; the part size changes
no result. Each part has its suffix array, and classes of equal runs of the parts
meet by 128-bit hashes, where their pages are added (hashes stand for tokens).
Few runs need to meet: each has an anchor, the least hash of its strings of
``ANCHOR`` tokens, which equal runs share. Parts first send their anchors, five
bytes each, and then only runs whose anchor may lie on enough pages.

Null or empty html: empty text. Pages cut short: an unfinished tag at the end is
no text. Null urls form a host of their own. Repeated rows get equal results
unless they are of one page id (a page does not repeat itself).
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import written

RUN, PAGES, ANCHOR = 8, 3, 4
#: Pages of a host that are looked at together; results do not depend on it.
HOST_PART = 1500
SPEC = "page_id long, url string, text string, n_chars long, n_repeated long"

# Fixed values of the markup language and of common naming.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "select", "textarea", "title"}
CHROME = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head"}
BLOCK = set(
    "address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
HINTS = set(
    "ad ads adsbygoogle adv advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion related replies reply search share sharing sidebar signup sitefooter siteheader sitenav social sponsor sponsored subscribe subscription toolbar topbar topnav widget".split()
)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def attributes(raw: str, in_main: bool = False) -> tuple[bool, bool]:
    """(chrome, main) as told by an element's attributes; inside an article a header is its own."""
    chrome = main = False
    for m in ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            found = {*PART.findall(value.lower()), *(w.lower() for w in CAMEL.findall(value))}
            chrome |= not HINTS.isdisjoint(found - {"header"} if in_main else found)
            continue
        value = value.lower()
        if name == "role":
            chrome |= value in ROLES
            main |= value == "main"
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            chrome |= not in_main
        elif name == "itemprop":
            main |= value == "articlebody"
    return chrome, main


class Block(NamedTuple):
    """Words, standing (0 chrome, 1 open, 2 in the main element, 3 in an article), and the number of the innermost such element (0: none)."""

    text: str
    standing: int
    region: int


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order."""
    out: list[Block] = []
    parts: list[str] = []
    skip, depth = "", 0  # the element being left out, and how deep in elements of its name
    main: list[tuple[str, int]] = []  # open elements that hold the article, and their numbers
    opened: list[str] = []  # elements inside the innermost of them that have its name
    regions = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                article = next((r for name, r in main if name == "article"), 0)
                out.append(Block(text, 0, 0) if skip else Block(text, 3, article) if article else Block(text, 2, main[0][1]) if main else Block(text, 1, 0))

    pos, n = 0, len(page)
    while pos < n:
        m = TAG.search(page, pos)
        if m is None:
            parts.append(page[pos:])
            break
        if m.start() > pos:
            parts.append(page[pos : m.start()])
        pos = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not close:
            if attrs and attrs.rstrip().endswith("/") and name == "svg":
                continue
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else n
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK or name == "body" or name == "head":
            flush()
        if name in VOID:
            continue
        if skip:
            if close:
                if name == skip:
                    depth -= 1
                    if not depth:
                        flush()
                        skip = ""
                elif name == "body" or (main and name == main[-1][0] and name != skip):
                    flush()
                    skip = ""
                    if name != "body":
                        main.pop()
            elif name == skip:
                if name in ("p", "li"):  # these end where the next begins
                    skip = ""
                else:
                    depth += 1
            elif name == "body" or (skip == "p" and name in BLOCK):
                skip = ""
            if skip or close:
                continue
        if close:
            if main and name == main[-1][0]:
                if opened and opened[-1] == name:
                    opened.pop()
                else:
                    flush()
                    main.pop()
            continue
        chrome, is_main = attributes(attrs, bool(main)) if attrs and not attrs.isspace() else (False, False)
        if name in CHROME or (name == "header" and not main) or (chrome and name not in ("body", "html", *MAIN) or chrome and name == "article" and main):
            flush()
            skip, depth = name, 1
        elif name in MAIN or is_main:
            flush()
            regions += 1
            main.append((name, regions))
        elif main and name == main[-1][0]:
            opened.append(name)
    flush()
    return out


def vouched(found: list[Block]) -> list[Block] | None:
    """The blocks of the one article, or else main element, that has text; None where there are several or none."""
    best = max((b.standing for b in found), default=0)
    kept = [b for b in found if b.standing == best]
    return kept if best >= 2 and len({b.region for b in kept}) == 1 else None


def joined(kept: list[str]) -> str:
    return "\n\n".join(kept)


def suffix_array(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, by prefix doubling to at least ``depth`` tokens, and each position's class by its first ``depth`` tokens."""
    n = len(stream)
    _, rank = np.unique(stream, return_inverse=True)
    k, classes = 1, None
    while True:
        if k >= depth and classes is None:
            classes = rank.copy()
            break
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        step = min(k, depth - k) if depth > k else k
        if step < k:  # a last, shorter step reaches the depth exactly
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 2) + nxt, return_inverse=True)
        k += step
    return np.argsort(classes, kind="stable"), classes


def repeated(pages: list[np.ndarray], owners: list, run: int = RUN, least: int = PAGES) -> list[np.ndarray]:
    """For each page's tokens, which lie in a run of ``run`` tokens that ``least`` distinct owners have."""
    out = [np.zeros(len(p), bool) for p in pages]
    total = sum(map(len, pages))
    if total < run or len(set(owners)) < least:
        return out
    ids = {o: k for k, o in enumerate(dict.fromkeys(owners))}
    size = np.array([len(p) + 1 for p in pages])
    stream = np.concatenate([np.r_[p, -1 - k] for k, p in enumerate(pages)])  # a separator that occurs once
    owner = np.repeat([ids[o] for o in owners], size)
    order, classes = suffix_array(stream, run)
    # distinct owners of each class, over neighbours in suffix order
    pairs = np.unique(classes[order] * np.int64(len(ids)) + owner[order])
    many = np.bincount(pairs // len(ids), minlength=int(classes.max()) + 1) >= least
    starts = np.flatnonzero(many[classes])
    diff = np.zeros(len(stream) + 1, np.int64)
    np.add.at(diff, starts, 1)
    np.add.at(diff, np.minimum(starts + run, len(stream)), -1)
    covered = np.cumsum(diff[:-1]) > 0
    at = np.cumsum(size) - size
    return [covered[a : a + len(p)] for a, p in zip(at, pages, strict=True)]


MARK = "\n"
#: Odd multipliers of the tokens of a run, for each half of its hash.
FACTORS = np.frombuffer(hashlib.shake_128(b"runs").digest(16 * RUN), np.uint64).reshape(2, RUN) | np.uint64(1)


def token_streams(pages: list[list[str]]) -> tuple[list[np.ndarray], list[str]]:
    """Each page's tokens as numbers, and the tokens by number; pages are texts of blocks."""
    ids: dict[str, int] = {MARK: 0}
    streams = []
    for found in pages:
        words = [w for text in found for w in (*text.split(" "), MARK)]
        streams.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
    return streams, list(ids)


def run_hashes(streams: list[np.ndarray], tokens: list[str], size: int = RUN) -> list[np.ndarray]:
    """For each page, the hashes (two columns) of its runs of ``size`` tokens, by start."""
    each = np.frombuffer(b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in tokens), np.uint64).reshape(-1, 2)
    out = []
    for stream in streams:
        n = max(len(stream) - size + 1, 0)
        found = np.zeros((n, 2), np.uint64)
        for k in range(size if n else 0):
            found += each[stream[k : k + n]] * FACTORS[:, k]
        out.append(found)
    return out


def anchors(streams: list[np.ndarray], tokens: list[str]) -> list[np.ndarray]:
    """For each page, the anchors of its runs, by start: the least hash of a run's strings of ``ANCHOR`` tokens."""
    out = []
    for found in run_hashes(streams, tokens, ANCHOR):
        each, n = found[:, 0], max(len(found) - RUN + ANCHOR, 0)
        out.append(np.minimum.reduce([each[k : k + n] for k in range(RUN - ANCHOR + 1)]))
    return out


def owners_of(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and how many distinct owners have each."""
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]][: len(values)]
    fresh = new | np.r_[True, owner[1:] != owner[:-1]][: len(values)]
    start = np.flatnonzero(new)
    return values[start], np.add.reduceat(fresh.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)


def numbered(owners: list) -> np.ndarray:
    ids = {o: k for k, o in enumerate(dict.fromkeys(owners))}
    return np.array([ids[o] for o in owners], np.int64)


def run_counts(pages: list[list[str]], owners: list, wanted=None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of the pages as hashes, and how many distinct owners have each: the classes of the pages' suffix array.

    ``wanted``: which of the given anchors' runs are asked for; all, where not given.
    """
    streams, tokens = token_streams(pages)
    if sum(map(len, streams)) < RUN:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    size = np.array([len(p) + 1 for p in streams])
    stream = np.concatenate([np.r_[p, -1 - k] for k, p in enumerate(streams)])
    _, classes = suffix_array(stream, RUN)
    # starts of runs that end on their page
    at = np.cumsum(size) - size
    starts = np.concatenate([np.arange(a, a + max(n - RUN, 0)) for a, n in zip(at, size, strict=True)])
    hashes, owner = np.concatenate(run_hashes(streams, tokens)), np.repeat(numbered(owners), np.maximum(size - RUN, 0))
    if wanted is not None:
        asked = wanted(np.concatenate(anchors(streams, tokens)))
        starts, hashes, owner = starts[asked], hashes[asked], owner[asked]
    found, n = owners_of(classes[starts], owner)
    _, first = np.unique(classes[starts], return_index=True)
    return hashes[first], n


LOW = np.uint64((1 << 40) - 1)


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^40, five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def salted(values: np.ndarray, host: str) -> np.ndarray:
    """Hashes of a host's strings, apart from those of other hosts."""
    name = np.frombuffer(hashlib.blake2b(host.encode(), digest_size=16).digest(), np.uint64)
    return common.mix64(values ^ (name if values.ndim == 2 else name[0]))


def covered_by(hashes: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """Which of a page's ``n`` tokens lie in a run among ``known``, which is sorted."""
    diff = np.zeros(n + 1, np.int64)
    if len(known) and len(hashes):
        at = np.minimum(np.searchsorted(known[:, 0], hashes[:, 0]), len(known) - 1)
        starts = np.flatnonzero((known[at] == hashes).all(1))
        np.add.at(diff, starts, 1)
        np.add.at(diff, starts + RUN, -1)
    return np.cumsum(diff[:-1]) > 0


def main_texts(pages: list[list[Block]], owners: list, known: tuple[np.ndarray, str] | None = None) -> list[tuple[str, int]]:
    """(text, repeated tokens) of the pages of one host; of a part of one, given the salted hashes of the host's repeated runs and its name."""
    streams, tokens = token_streams([rest(p) for p in pages])
    if known is None:
        marks = repeated(streams, owners)
    else:
        runs, name = known
        runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        marks = [covered_by(salted(h, name), len(x), runs) for h, x in zip(run_hashes(streams, tokens), streams, strict=True)]
    return [(joined(decided(found, covered)), int(covered.sum())) for found, covered in zip(pages, marks, strict=True)]


def decided(found: list[Block], covered: np.ndarray) -> list[str]:
    """The texts that a page keeps, given which of its tokens repeat."""
    best, at, masks = max((b.standing for b in found), default=0), 0, []
    for b in found:
        n = b.text.count(" ") + 1
        masks.append(covered[at : at + n])
        at += n + 1
    around = [[w for w, c in zip(b.text.split(" "), m.tolist(), strict=True) if not c] for b, m in zip(found, masks, strict=True) if 1 <= b.standing and (b.standing < best or best == 1)]
    around = [w for w in around if w]
    if best >= 2:
        share: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for b, m in zip(found, masks, strict=True):
            if b.standing == best:
                share[b.region][0] += int(m.sum())
                share[b.region][1] += len(m)
        own = {r for r, (c, n) in share.items() if 2 * c < n}
        if own or sum(map(len, around)) <= sum(n for _, n in share.values()):
            return [b.text for b in found if b.standing == best and b.region in (own or share)]
    return [" ".join(w) for w in around]


def rest(found: list[Block]) -> list[str]:
    """What the runs are looked for in: the texts of all blocks."""
    return [b.text for b in found]


def stored(found: list[Block]) -> bytes:
    return MARK.join(f"{b.standing} {b.region} {b.text}" for b in found).encode("utf-8", "surrogatepass")


def restored(data: bytes) -> list[Block]:
    each = (line.split(" ", 2) for line in data.decode("utf-8", "surrogatepass").split(MARK)) if data else ()
    return [Block(text, int(standing), int(region)) for standing, region, text in each]


def host(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)


def extract(pages: DataFrame, part: int = HOST_PART) -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated`` of every row; ``n_repeated``: tokens that lie in repeated runs of the host."""
    spark = pages.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("host", host(F.col("url")))
    hosts = written(p.groupBy("host").agg(F.ceil(F.count("*") / part).alias("parts")))
    n_parts = hosts.where("parts > 1").agg(F.sum("parts")).first()[0] or 0
    # a page's rows stay together; one number stands for host and part, so that Spark deals by both
    deal = F.when(F.col("page_id").isNotNull(), F.xxhash64("page_id")).otherwise(F.xxhash64("url", "html"))
    p = p.join(hosts, "host").select(F.xxhash64("host", F.pmod(deal, F.col("parts"))).alias("grp"), "host", "page_id", "url", "parts", "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in common.slices(batches, text="html"):
            held = [stored(blocks(h)) for h in batch.column(5).to_pylist()]
            sizes = pa.array([len(h) for h in held], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sizes, pa.array([codec.compress(h, asbytes=True) if h else b"" for h in held], pa.binary())], ["grp", "host", "page_id", "url", "size", "held"])

    def dealt(which: str) -> DataFrame:
        return p.where(which).mapInArrow(parse, "grp long, host string, page_id long, url string, size long, held binary").groupBy("grp")

    def owners(t: pa.Table) -> list:
        return [i if i is not None else f"row {k}" for k, i in enumerate(t["page_id"].to_pylist())]

    def parsed(t: pa.Table) -> list[list[Block]]:
        codec = pa.Codec("zstd")
        return [restored(codec.decompress(h, n, asbytes=True)) if n else [] for h, n in zip(t["held"].to_pylist(), t["size"].to_pylist(), strict=True)]

    def by_host(t: pa.Table) -> list[tuple[str, pa.Table]]:  # hosts whose numbers are equal stay apart
        each: dict[str, list[int]] = defaultdict(list)
        for k, name in enumerate(t["host"].to_pylist()):
            each[name].append(k)
        return [(name, t.take(rows)) for name, rows in each.items()]

    def texts(t: pa.Table, known: tuple[np.ndarray, str] | None = None) -> pa.Table:
        found = main_texts(parsed(t), owners(t), known)
        return pa.table({"page_id": t["page_id"], "url": t["url"], "text": pa.array([f[0] for f in found], pa.string()), "n_chars": pa.array([len(f[0]) for f in found], pa.int64()), "n_repeated": pa.array([f[1] for f in found], pa.int64())})

    def whole(t: pa.Table) -> pa.Table:
        return pa.concat_tables([texts(of) for _, of in by_host(t)])

    settled = dealt("parts = 1").applyInArrow(whole, SPEC)
    if not n_parts:
        return settled
    parted = dealt("parts > 1")
    buckets = max(16, -(-n_parts // 16))  # some four million anchors each

    def sent(t: pa.Table) -> pa.Table:
        values, counts = [], []
        for name, of in by_host(t):
            found = anchors(*token_streams([rest(f) for f in parsed(of)]))
            value, n = owners_of(np.concatenate(found), np.repeat(numbered(owners(of)), list(map(len, found))))
            values.append(salted(value, name))
            counts.append(np.minimum(n, PAGES))
        value, n = np.concatenate(values), np.concatenate(counts)
        bucket = (value >> np.uint64(40)).astype(np.int64) % buckets
        at = [np.flatnonzero(bucket == b) for b in range(buckets)]
        return pa.table({"bucket": pa.array(range(buckets), pa.int32()), "grp": np.full(buckets, t["grp"][0].as_py(), np.int64), "anchors": pa.array([packed(value[i] & LOW) for i in at], pa.binary()), "counts": pa.array([n[i].astype(np.uint8).tobytes() for i in at], pa.binary())})

    def often(t: pa.Table) -> pa.Table:
        """Of each part, the anchors that lie on enough pages of all parts."""
        each = [unpacked(a) for a in t["anchors"].to_pylist()]
        value, at = np.unique(np.concatenate(each), return_inverse=True)
        enough = np.bincount(at, np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint8), len(value)) >= PAGES
        marks = np.split(enough[at], np.cumsum([len(e) for e in each])[:-1])
        return pa.table({"grp": t["grp"], "bucket": t["bucket"], "anchors": pa.array([packed(e[m]) for e, m in zip(each, marks, strict=True)], pa.binary())})

    def counts(t: pa.Table, some: pa.Table) -> pa.Table:
        kept = {b: np.sort(unpacked(a)) for b, a in zip(some["bucket"].to_pylist(), some["anchors"].to_pylist(), strict=True)}
        known = np.sort(np.concatenate([(np.uint64(b) << np.uint64(40)) | v for b, v in kept.items()]))
        parts = []
        for name, of in by_host(t):

            def wanted(value: np.ndarray, name: str = name) -> np.ndarray:
                value = salted(value, name)
                return np.isin((((value >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40)) | (value & LOW), known)

            found, n = run_counts([rest(f) for f in parsed(of)], owners(of), wanted)
            mixed = salted(found, name)
            parts.append(pa.table({"grp": np.full(len(n), t["grp"][0].as_py(), np.int64), "h1": mixed[:, 0].astype(np.int64), "h2": mixed[:, 1].astype(np.int64), "n": n}))
        return pa.concat_tables(parts)

    def marked(t: pa.Table, runs: pa.Table) -> pa.Table:
        known = np.stack([runs[c].to_numpy().astype(np.uint64) for c in ("h1", "h2")], 1)
        return pa.concat_tables([texts(of, (known, name)) for name, of in by_host(t)])

    some = parted.applyInArrow(sent, "bucket int, grp long, anchors binary, counts binary").groupBy("bucket").applyInArrow(often, "grp long, bucket int, anchors binary")
    # a run of a host has at most one row of each part
    total = F.sum("n").over(Window.partitionBy("h1", "h2"))
    runs = parted.cogroup(some.groupBy("grp")).applyInArrow(counts, "grp long, h1 long, h2 long, n long").withColumn("n", total).where(F.col("n") >= PAGES).select("grp", "h1", "h2")
    return settled.unionByName(parted.cogroup(runs.groupBy("grp")).applyInArrow(marked, SPEC))
