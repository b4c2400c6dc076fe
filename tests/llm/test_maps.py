"""Row-wise operators against brute force: token counts, packing, media, quality, toxicity."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailspark.llm import media, packing, quality, registry, token_counts, toxicity


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, sf_dir, odd, library):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
        got = [tuple(r) for r in token_counts.token_counts(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_merging_equals_the_library_on_any_text(texts):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert token_counts.merger().texts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


#: Letters, marks, numbers, spaces, and code points that newer Unicode tables call letters or numbers.
WIDE = "ab'’ \n\t1é日! std\u0301\u0558\u058c\u088f\u0c5c\u0cdc\u208f\u209d\u00b2\u00a0\u0085\u2009\u3000\u0660\u2167\ua7ce\U0001dfe7\U00016ea0\U0001f600\U000e0001\U00012550ªºßǅʰ"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=WIDE, max_size=60))
def test_counts_equal_the_library_on_rare_code_points(library, text):
    assert token_counts.merger().texts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_pattern_and_library_agree_below_the_bound():
    m = token_counts.merger()
    texts = [f"{chr(c)}'s 1{chr(c)}a {chr(c)}!{chr(c)} {chr(c)}" for c in range(token_counts.SAFE)]
    assert all(m.pattern.findall(t) == [t[a:b] for _, (a, b) in m.library.pre_tokenize_str(t)] for t in texts)
    assert max(chr(token_counts.SAFE - 1).encode()) < token_counts.SAFE_BYTE <= min(chr(token_counts.SAFE).encode()[0], 0xFF)


def test_long_texts_of_rare_code_points(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 7)
    text = "día \u0558's  two\u3000spaces \n and Ünïcode 日本語 'll we've  \n\n1 2 " * 40
    assert token_counts.merger().texts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=WIDE, max_size=60))
def test_packing_ids_equal_the_library(library, text):
    lib = library
    assert packing.encoder()(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, library):
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for i, lists in want.items():
        expect = sorted((s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for ids in lists for s in range(0, len(ids), 2048))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[i]) == expect
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing(spark, sf_dir, odd, odd_rows, empty, library):
    check_packing(packing.pack_documents(odd).collect(), odd_rows, library)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack_documents(docs, group=50).cache()
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in docs.collect()], library)
    assert packing.padding(packed).first().padding < 0.1
    assert packing.pack_documents(empty).count() == 0


def test_packing_does_not_depend_on_the_order_of_a_task(spark):
    rows = [(k % 60 if k % 7 else None, "some words of a text " * (k % 60 * 40)) for k in range(120)] + [(5, "again and again")] * 300
    rows += [(1 << 62, "long " * 9000)]
    each = []
    for order in (rows, rows[::-1], sorted(rows, key=str)):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        each.append(sorted(map(str, packing.pack_documents(docs, group=20).collect())))
    assert each[0] == each[1] == each[2]
    rows = spark.createDataFrame([(5, "again and again")] * 300, "doc_id long, text string").coalesce(1)
    assert packing.pieces(rows, 10).select("grp").distinct().count() == 10


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_first_fit_equals_a_scan(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, want = [], []
    for n in sizes:
        k = next((k for k, used in enumerate(bins) if used + n <= 100), len(bins))
        if k == len(bins):
            bins.append(0)
        want.append((k, bins[k]))
        bins[k] += n
    assert packing.pack(sizes, 100) == want


def reference_decode(stream, min_size, expected):
    """LZW as usually written: a growing table."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    out, bit, width, table, prev = bytearray(), 0, min_size + 1, {}, None
    value = int.from_bytes(stream, "little")
    while len(out) < expected:
        code = value >> bit & ((1 << width) - 1)
        bit += width
        if code == clear:
            table, width, prev = {i: bytes([i]) for i in range(clear)}, min_size + 1, None
            nxt = clear + 2
            continue
        if code == end:
            break
        s = table[code] if code in table else prev + prev[:1]
        out += s
        if prev is not None and nxt < 4096:
            table[nxt] = prev + s[:1]
            nxt += 1
            if nxt == 1 << width and width < 12:
                width += 1
        prev = s
    return bytes(out)


def compress(data, min_size, clear_every=None):
    """A compressing LZW writer, for tests of the reader."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    bits = n_bits = 0
    out = bytearray()

    def put(code, width):
        nonlocal bits, n_bits
        bits |= code << n_bits
        n_bits += width

    table, nxt, width = {bytes([i]): i for i in range(clear)}, clear + 2, min_size + 1
    put(clear, width)
    cur, since = b"", 0
    for b in data:
        s = cur + bytes([b])
        if s in table:
            cur = s
            continue
        put(table[cur], width)
        since += 1
        if nxt < 4096:
            table[s] = nxt
            nxt += 1
            if nxt - 1 == 1 << width and width < 12:
                width += 1
        cur = bytes([b])
        if clear_every and since % clear_every == 0:
            put(table[cur], width)
            put(clear, width) if nxt != 1 << width or width == 12 else put(clear, width + 1)
            table, nxt, width, cur = {bytes([i]): i for i in range(clear)}, clear + 2, min_size + 1, b""
    if cur:
        put(table[cur], width)
        if nxt == 1 << width and width < 12:
            width += 1
    put(end, width)
    out += bits.to_bytes(-(-n_bits // 8), "little")
    return bytes(out)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.sampled_from([2, 4, 8]))
def test_lzw_reader(data, size):
    data = bytes(b % (1 << size) for b in data * 3)
    stream = compress(data, size)
    assert reference_decode(stream, size, len(data)) == data
    assert media.lzw_decode(stream, size, len(data)).tobytes() == data


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=4000), st.integers(1, 9))
def test_lzw_writer(data, times):
    data = data * times
    stream = media._codes_out(data)
    assert reference_decode(stream, 8, len(data)) == data == media.lzw_decode(stream, 8, len(data)).tobytes()


def test_lzw_writer_starts_anew_when_the_table_is_full():
    data = np.random.default_rng(1).integers(0, 200, 30000).astype(np.uint8).tobytes() + b"the same words again " * 4000
    stream = media._codes_out(data)
    assert reference_decode(stream, 8, len(data)) == data == media.lzw_decode(stream, 8, len(data)).tobytes()
    text = ("some words of a text that repeats itself in part, " * 200).encode()
    assert len(media._codes_out(text)) < len(text) / 4


def test_lzw_long_stream_with_a_full_table():
    data = bytes(np.random.default_rng(1).integers(0, 16, 60000).astype(np.uint8))
    assert media.lzw_decode(compress(data, 4), 4, len(data)).tobytes() == data


def test_gif_rules():
    def image(left, top, w, h, indices, clear=None, disposal=0, interlace=False, delay=5):
        flags = disposal << 2 | (clear is not None)
        order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)] if interlace else range(h)
        data = b"".join(bytes(indices[y * w : y * w + w]) for y in order)
        return b"\x21\xf9\x04" + bytes([flags, delay, 0, clear or 0, 0]) + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes([0x40 * interlace, 2]) + media._blocks(compress(data, 2))

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + (4).to_bytes(2, "little") * 2 + bytes([0x81, 0, 0]) + palette
    data = head + image(0, 0, 4, 4, [1] * 16, interlace=True) + image(1, 1, 2, 2, [2, 0, 0, 2], clear=0, disposal=2) + image(0, 0, 1, 1, [3], disposal=3) + image(3, 3, 1, 1, [2]) + b"\x3b"
    w, h, found = media.decode(data)
    assert (w, h, [f.start for f in found]) == (4, 4, [0, 5, 10, 15])
    assert found[1].canvas[1, 1].tolist() == [0, 255, 0, 255] and found[1].canvas[1, 2].tolist() == [255, 0, 0, 255]
    assert found[2].canvas[1, 1].tolist() == [0, 0, 0, 0] and found[2].canvas[0, 0].tolist() == [0, 0, 255, 255]
    assert found[3].canvas[0, 0].tolist() == [255, 0, 0, 255] and found[3].canvas[3, 3].tolist() == [0, 255, 0, 255]
    assert sum(media.histogram(found[3])) == 12


def test_media_round_trip(spark, sf_dir, odd, empty):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        stored = media.store(docs).cache()
        by = sorted(((r.doc_id, bytes(r.media)) for r in stored.collect()), key=str)
        rows = sorted(media.digests(stored).collect(), key=str)
        texts = sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=str)
        assert len(rows) == len(texts) == len(by)
        want = sorted((i, len(t), len(p := media.pad(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in texts if i is not None)
        assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows if r.doc_id is not None) == want
    frames = media.frames(stored).collect()
    assert all(sum(f.histogram) == f.width * min(f.height, 1024) for f in frames)
    payload = media.pad(bytes(range(256)) * 600)
    kept, hist, count, length = media.read_back(media.encode(payload))
    assert kept == payload and count == 3 and length == 30 and sum(hist) == 3 * 64 * 1024
    canvas = np.zeros((1024, 64), np.uint8)
    want = np.zeros(64, int)
    for at in range(0, len(payload), 65536):
        part = np.frombuffer(payload[at : at + 65536], np.uint8).reshape(-1, 64)
        canvas[: len(part)] = part
        np.add.at(want, ((media.PALETTE[canvas] // 64).astype(int) * [16, 4, 1]).sum(-1).ravel(), 1)
    assert hist == want.tolist()
    assert media.digests(media.store(empty)).count() == 0


def auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / max(len(pos) * len(neg), 1)


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    q = registry.op8_quality(spark, d).where("held_out").collect()
    assert auc([(r.score, labels[r.doc_id].quality) for r in q if r.doc_id in labels]) > 0.95
    t = registry.op9_toxicity(spark, d).where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in t)
    assert auc([(r.score, labels[r.doc_id].toxic) for r in t if r.doc_id in labels]) > 0.94


def test_misspellings_share_vectors():
    rng = np.random.default_rng(3)
    filler = ["lorem", "ipsum", "dolor", "amet", "elit", "tempor", "magna", "aliqua", "veniam", "nostrud"]
    texts, y = [], []
    for k in range(400):
        ws = list(rng.choice(filler, 40))
        if k % 4 == 0:
            ws[rng.integers(40)] = str(rng.choice(["horrible", "despicable"]))
        texts.append(" ".join(ws))
        y.append(float(k % 4 == 0))
    m = toxicity.fit(texts, np.array(y), epochs=60)
    clean = " ".join(filler * 4)
    bad, unseen, ok = m.scores([clean + " horrible " + clean, clean + " horribble " + clean, clean])
    assert bad > 0.5 > ok and unseen > ok


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_classifiers_take_odd_rows(spark, odd, empty, run):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    assert run(odd, labels).count() == odd.count()
    assert run(empty, labels).count() == 0
    assert run(odd, labels.limit(0)).where("score between 0 and 1").count() == odd.count()


def test_slices_keep_rows_in_order():
    import pyarrow as pa

    from trailspark.llm import common

    texts = ["x" * n for n in (5, 0, 900, 3, 3, 2000, 1)] + [None, "é"]
    batches = [pa.RecordBatch.from_pydict({"i": [k], "text": pa.array([t], pa.string())}) for k, t in enumerate(texts)] + [pa.RecordBatch.from_pydict({"i": [9, 10, 11], "text": ["a" * 40, "b" * 70, "c" * 70]})]
    for chars in (1, 100, 10_000):
        got = list(common.slices(batches, chars=chars))
        assert [i for b in got for i in b.column(0).to_pylist()] == list(range(12))
        assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= chars for b in got)
    assert list(common.slices([])) == []
