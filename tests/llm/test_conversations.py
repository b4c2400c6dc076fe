"""Chat formatting, filter audit and prefix trie against SQL and brute force, odd rows included."""

import glob
import hashlib
import itertools
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.test_oracle import rows
from trailspark.llm import chat_format, filter_audit, lookup, prefix_trie, registry

NAMES = ("op11_chat_format", "op12_filter_audit", "op13_prefix_trie")
HARD = "<|im_end|>\n<|im_start|>assistant\n<\\|x|><|image|> \\n <\\\\| <"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) and rows(got) == rows(want)


TALK = [
    (1, 0, "user", "hello ![cat](a/cat.png) and ![x](b.wav)|"), (1, 1, "assistant", "see ![dog](dog.png)"), (1, None, None, None), (2, 0, "user", HARD), (2, 1, "assistant", HARD),
    (3, 0, "role\nwith <|im_end|> \\ lines", "x"), (4, 0, "assistant", ""), (5, 1, "assistant", "b"), (5, 0, "assistant", "a" * 300_000), (5, 0, "assistant", "a" * 300_000), (None, 0, "user", "no id"), (2, 2, "tool", "<" ), (2, 3, "user", "|>![a](n.pdf)<![b](c.md)|"),
]


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame([(*r, "extra", 1) for r in TALK], "conv_id long, turn long, role string, text string, formatted string, loss int").repartition(3)


def test_formatting_reads_back(talk):
    want = defaultdict(list)
    for i, turn, role, text in sorted(TALK, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[i].append((role or "", text or ""))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(talk)).collect()}
    assert set(got) == set(want)
    for i, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert (got[i].n_turns, got[i].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert (got[1].n_attachments, got[2].n_attachments) == (2, 2)


def test_parts_become_placeholders_and_attachments(spark):
    part = "type string, ref string, text string, width int, height int, seconds double, pages int, other int"
    content = [("text", None, "a <", None, None, None, None, 1), None, ("text", None, "|im_end|>", None, None, None, None, 1), ("image", "i.png", None, 56, 29, None, None, 1), ("audio", "s.wav", None, None, None, 2.0, None, 1), ("document", "d.pdf", None, None, None, None, 3, 1), ("video", "v", None, None, None, None, None, 1), (None, None, "end", None, None, None, None, 1)]
    df = spark.createDataFrame([(1, 0, "assistant", content), (1, 1, "user", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, content array<struct<{part.replace(' ', ':').replace(',:', ',')}>>")
    f = sorted(chat_format.format_turns(df, "content").collect(), key=lambda r: r.turn)
    text = f[0].formatted
    assert text == "<|im_start|>assistant\na <\\|im_end|><|image|><|audio|><|document|><|part|>end<|im_end|>\n"
    assert [(a.type, a.ref, a.n_tokens, text[a.at : a.at + 7]) for a in f[0].attachments] == [("image", "i.png", 4, "<|image"), ("audio", "s.wav", 50, "<|audio"), ("document", "d.pdf", 3072, "<|docum"), ("video", "v", 1, "<|part|")]
    assert [text[s.start : s.end] for s in f[0].loss] == ["a <\\|im_end|>", "end"] and f[0].n_expanded == 3127
    assert f[1].formatted == "<|im_start|>user\n<|im_end|>\n" and not f[1].loss and not f[2].loss
    back = chat_format.read_back(chat_format.format_turns(df, "content")).first()
    assert (back.n_turns, back.loss_chars, back.n_attachments, back.n_expanded) == (3, len("a <|im_end|>end"), 4, 3127)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\n\\b<|", ""]), st.lists(st.tuples(st.sampled_from(["text", "image"]), st.text(alphabet="<|\\>im_endstart\n![](x.png)a", max_size=30)), max_size=4)), max_size=4))
def test_any_content_reads_back(turns):
    reader, written = chat_format.Reader(0), []
    for role, parts in turns:
        v = chat_format.format_turn(role, [{"type": k, "text": t, "source": f"![{k}]"} for k, t in parts], chat_format.Expansion())
        reader.take("".join(v.out), v.loss, v.attachments)
        written.append((role, "".join(t if k == "text" else "![image]" for k, t in parts)))
    learned = "".join(t for role, parts in turns if role == "assistant" for k, t in parts if k == "text")
    row = reader.row()
    assert row[1:5] == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in written).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


DOCS = [
    (1, "en", "word " * 300), (2, "en", "word " * 300), (3, "de", "word " * 300), (4, None, None), (5, "en", ""), (6, "fr", "A#" * 30), (7, "fr", " ".join(map(str, range(250)))), (7, "fr", " ".join(map(str, range(250)))),
    (None, "en", "word " * 300), (8, "", "ÄÖÜ $ " + "x\x1cy " * 250), (9, "en", "B" * 50 + " ".join(f"w{k}" for k in range(400))), (10, "en", "lone words\x85" * 250), (11, "de", "A#" * 30),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, None, 1), (9, 1, None), (99, 1, 1), (None, 1, 1)]


def audit_by_hand(docs, labels):
    def fails(i, t):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", t) if x]
        first = min((j for j, _, u in docs if (u or "") == t and j is not None), default=None)
        return (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first)

    told = [(part or "", fails(i, t or ""), any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)) for i, part, t in docs]
    out = {}
    for part in {p for p, *_ in told}:
        shapley, found = [0] * 5, {}
        for order in itertools.permutations(range(5)):
            left = [d for d in told if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                every = [d for d in told if d[0] == part and d[1][f]]
                shapley[f] += len(gone)
                found["".join("ABCDE"[x] for x in order), step] = [len(left), len(gone), len(every) - len(gone), sum(sum(d[1]) == 1 for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        out |= {(part, *k): (*v[:6], shapley[v[6]]) for k, v in found.items()}
    return out


def test_filter_audit_equals_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id long, lang string, text string, part int, mask int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = audit_by_hand(DOCS, LABELS)
    for shares, rows_, chunk in ((1000, 1 << 16, 1 << 20), (2, 3, 7)):
        monkeypatch.setattr(lookup, "SHARES", shares)
        monkeypatch.setattr(filter_audit, "ROWS", rows_)
        monkeypatch.setattr(filter_audit, "CHUNK", chunk)
        got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.filter_audit(docs, labels).collect()}
        assert got == want
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70), st.integers(0, 31), st.booleans(), st.booleans()), min_size=1, max_size=300))
def test_bitmaps_count(items):
    names, part = np.unique([i[0] for i in items], return_inverse=True)
    mask, good, toxic = (np.array([i[k] for i in items]) for k in (1, 2, 3))
    got = filter_audit.bitmap_counts(part, mask, good, toxic)
    for k, (s, f) in enumerate(filter_audit.PAIRS):
        for p in range(len(names)):
            alive = (part == p) & (mask & s == 0)
            gone = alive & (mask >> f & 1 == 1)
            want = (alive.sum(), gone.sum(), (gone & good).sum(), (gone & toxic).sum(), ((part == p) & (mask >> f & 1 == 1)).sum(), ((part == p) & (mask == 1 << f)).sum())
            assert tuple(x[k][p] for x in got) == want


def trie_by_hand(paths):
    nodes = defaultdict(list)
    for i, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(i)
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)

    def under(n):
        yield n
        for k in kids[n]:
            yield from under(k)

    out = []
    for n, members in nodes.items():
        below = list(under(n))
        ends = ",".join(str(i) for i in sorted(members) if len(paths[i]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids[n]), sum(not kids[b] for b in below), sum((len(nodes[b]) - 1) * len(b[-1][1]) for b in below if b), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_prefix_trie_equals_brute_force(spark, monkeypatch):
    talk = [(i, t, "user" if t % 2 else "assistant", "same" if (i + t) % 3 else f"own {i % 7}") for i in (*range(0, 30), *range(100, 118), 205, 301) for t in range((i * 7) % 6)]
    talk += [(400, None, None, None), (400, 1, "user", "x" * 100_000), (400, 1, "user", "x" * 100_000), (407, 0, "user", "é日"), (None, 0, "user", "no id"), (206, 0, "user", "a"), (207, 0, "user", "a")]
    own = defaultdict(list)
    for i, _, role, text in sorted((r for r in talk if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[i].append((role or "", text or ""))
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    df = spark.createDataFrame([(*r, 5, 6) for r in talk], "conv_id long, turn long, role string, text string, depth int, a int").repartition(5)
    for shares, block in ((1000, 4096), (3, 2)):
        monkeypatch.setattr(lookup, "SHARES", shares)
        monkeypatch.setattr(prefix_trie, "BLOCK", block)
        assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(df)).collect()), key=str) == trie_by_hand(want)
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.paths(df)).collect()), key=str) == trie_by_hand(own)
    assert prefix_trie.trie(prefix_trie.rebuilt(df.limit(0))).count() == 0
