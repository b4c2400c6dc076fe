"""Joins, searches and dedup against brute force."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailspark.llm import decontaminate, ngram_join, registry, suffix_dedup


def linked(rows, words, num, den):
    """Components by comparing all sets that share a shingle."""
    sets = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set()))
    u, inverted = ngram_join.Union(len(rows)), {}
    for i, s in enumerate(sets):
        hits = {}
        for g in s:
            for j in inverted.get(g, ()):
                hits[j] = hits.get(j, 0) + 1
            inverted.setdefault(g, []).append(i)
        for j, k in hits.items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                u.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = u.find(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if not (least.get(r) is None and d is None) else None
    return sorted([(d, len(sets[i]), least[u.find(i)]) for i, (d, _) in enumerate(rows)], key=str)


def joined(df, *args):
    return sorted((tuple(r) for r in ngram_join.ngram_join(df, *args).collect()), key=str)


def families(n=250):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.choice([3, 8, 20, 60, 150]))] for _ in range(20)]
    rows = []
    for i in range(n):
        f = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(f))
            f[k] = rng.choice(["zz", "yy", f[k].upper(), f"xx{i}"])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(f)))
    return rows


@pytest.mark.parametrize(("words", "num", "den", "block"), [(3, 90, 100, 1024), (5, 80, 100, 1024), (2, 60, 100, 8)])
def test_join_equals_brute_force(spark, monkeypatch, words, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = families()
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words, num, den) == linked(rows, words, num, den)


def test_join_of_the_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in registry.op1_ngram_join(spark, sf_dir).collect()), key=str) == linked(rows, 3, 90, 100)


def test_join_of_odd_rows(spark, odd, odd_rows, empty):
    assert joined(odd, 3, 90, 100) == linked(odd_rows, 3, 90, 100)
    assert joined(empty) == []
    kept = ngram_join.keep_one(odd).select("doc_id", "lang").collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 8, None], key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=2, max_size=12), st.sampled_from([(90, 100), (80, 100), (50, 100)]))
def test_divide_skip_finds_every_link(sets, ratio):
    ladder = ngram_join.Ladder(*ratio)
    arrays = [np.sort(ngram_join.common.mix64(np.array(sorted(s), np.uint64))) for s in sets]
    lists = ngram_join.Lists(arrays, ladder)
    for q, s in enumerate(sets):
        want = {d for d, t in enumerate(sets) if d != q and ladder.linked(len(s & t), len(s), len(t))}
        assert set(lists.search(q, lambda d: False)) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([(90, 100), (80, 100)]))
def test_linked_sets_share_a_signature(n, seed, ratio):
    rng, ladder = np.random.default_rng(seed), ngram_join.Ladder(*ratio)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    extra = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for gone in range(0, n // 4 + 1, max(1, n // 12)):
        for new in range(0, n // 4 + 1, max(1, n // 12)):
            b = np.sort(np.r_[rng.permutation(a)[: len(a) - gone], extra[:new]])
            if len(b) and ladder.linked(len(a) - gone, len(a), len(b)):
                sig, who = ngram_join.signatures([a, b], ladder)
                assert set(sig[who == 0]) & set(sig[who == 1])


def removed(rows):
    """What each row loses, by a table of every string."""
    first = {}
    for d, t in rows:
        raw, d = (t or "").encode(), suffix_dedup.NULL_ID if d is None else d
        for k in range(len(raw) - 49):
            first[raw[k : k + 50]] = min(d, first.get(raw[k : k + 50], d))
    out = []
    for doc, t in rows:
        raw, d = (t or "").encode(), suffix_dedup.NULL_ID if doc is None else doc
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < d:
                gone[k : k + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int(np.sum(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0
        out.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def deduped(df):
    return sorted((tuple(r) for r in suffix_dedup.substring_dedup(df).collect()), key=str)


def test_substrings_equal_brute_force(spark, sf_dir, odd, odd_rows, empty):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([60, 120, 300]))) for _ in range(12)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice(base)[rng.randint(0, 30) : rng.randint(40, 300)] for _ in range(rng.randint(0, 4)))
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice([t, t, t, None, base[0], "ab" * rng.randint(10, 200)])))
    assert deduped(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == removed(rows)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in registry.op5_substring_dedup(spark, sf_dir).collect()), key=str) == removed(docs)
    assert deduped(odd) == removed(odd_rows) and deduped(empty) == []
    kept = {r.doc_id: r.text for r in suffix_dedup.substring_dedup(spark.createDataFrame(rows[:30], "doc_id long, text string"), with_text=True).collect()}
    want = {d: h for d, _, _, _, h in removed(rows[:30])}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[d] for d, t in kept.items() if d not in (7, None) and "\ufffd" not in t)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=60, max_size=400), st.integers(1, 4), st.integers(0, 2**32))
def test_suffix_sort(data, letters, seed):
    rng = np.random.default_rng(seed)
    buffer = np.frombuffer(bytes(b % letters for b in data), np.uint8)
    items, group = rng.integers(0, len(buffer) - 49, 80), np.sort(rng.integers(0, 3, 80))
    perm, cls = suffix_dedup.Suffixes(buffer).classes(items, group)
    keys = [(int(group[i]), buffer[items[i] : items[i] + 50].tobytes()) for i in perm]
    assert keys == sorted(keys)
    assert cls.tolist() == np.cumsum([k > 0 and keys[k] != keys[k - 1] for k in range(len(keys))]).tolist()


def test_suffix_merges_place_one_side_only(monkeypatch):
    """Of two runs that are merged only one side's elements are searched for, and each level takes the runs that are longer."""
    rng = np.random.default_rng(2)
    buffer = np.concatenate([np.r_[np.zeros(20, np.uint8), rng.integers(0, 3, 40, np.uint8)] for _ in range(1024)] + [rng.integers(0, 256, 60, np.uint8) for _ in range(2048)])
    items, group, compared = np.arange(3072) * 60, np.r_[np.zeros(1024, int), np.arange(1, 2049)], []
    s, less = suffix_dedup.Suffixes(buffer), suffix_dedup.Suffixes.less
    monkeypatch.setattr(suffix_dedup.Suffixes, "less", lambda self, a, b: compared.append(len(a)) or less(self, a, b))
    keys = [buffer[i : i + 50].tobytes() for i in items[s.sort(items, group)][:1024]]
    assert keys == sorted(keys)
    # 10 levels of 512 searches in runs of 1, 2, .. 512, beside one comparison a seam
    assert sum(compared) <= sum(512 * (k + 1) for k in range(10)) + 1024


@settings(max_examples=60, deadline=None)
@given(st.integers(50, 300), st.sampled_from(["a", "ab", "abc ", "abcdefghij"]), st.integers(0, 2**32))
def test_anchors(n, letters, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(letters) for _ in range(k)).encode() for k in (n, 0, rng.randint(0, 60), n)]
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = suffix_dedup.gram_hashes(data) >> np.uint64(suffix_dedup.POSITION)
    want = {s: (s + int(np.argmin(h[s : s + 35])), k) for k in range(4) for s in range(start[k], start[k] + size[k] - 49)}
    for chunk in (1 << 17, 64):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(suffix_dedup, "CHUNK", chunk)
            got = {s: (p, k) for _, p, a, b, k in zip(*suffix_dedup.anchors(data, start, size), strict=True) for s in range(a, b + 1)}
        assert got == want


def test_block_max_wand_equals_scoring_all(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for threshold in (0.1, 0.3, 0.5):
        index = decontaminate.Index(decontaminate.as_shard(items), threshold)
        rng = random.Random(1)
        vocabulary = list(index.term)
        for _ in range(60):
            _, text = rng.choice(items)
            ws = decontaminate.words(text)[: rng.randint(1, 60)] + rng.sample(vocabulary, 25)
            terms = list({index.term[w] for w in ws})
            score = np.zeros(len(items))
            for t in terms:
                score[index.docs[t]] += index.weights[t]
            want = {d: s for d, s in enumerate(score) if s >= threshold - 1e-9}
            got = dict(index.search(terms))
            assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_no_passage_is_set_aside_that_reaches_the_threshold(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    index = decontaminate.Index(decontaminate.as_shard(items))
    kept = {(d, at) for d, at, _, _ in decontaminate.passages(index, texts)}
    for d, t in enumerate(texts):
        ws = decontaminate.words(t)
        for at in range(0, max(len(ws), 1), index.step):
            found = index.search(list({index.term[w] for w in ws[at : at + 2 * index.step] if w in index.term}))
            assert not found or (d, at) in kept


def test_leaks_hold_all_verbatim_items(spark, sf_dir, odd, empty):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flat = lambda t: " " + " ".join(decontaminate.words(t)) + " "
    texts, items = [(r.doc_id, flat(r.text)) for r in docs.collect()], [(r.item_id, flat(r.text)) for r in bench.collect()]
    want = {(d, i) for d, t in texts for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in registry.op2_decontamination(spark, sf_dir).collect()}
    assert want and want <= got and len(got) <= 1.1 * len(want)
    assert {(r.doc_id, r.item_id) for r in decontaminate.candidates(docs, bench, shard=300).where("question_overlap >= 0.6 and answer_overlap >= 0.5").collect()} == got
    kept = {r.doc_id for r in decontaminate.keep_uncontaminated(docs, bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in got}
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.keep_uncontaminated(odd, bench).count() == odd.count()
    assert decontaminate.leaks(empty, bench).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (None, " ! ")], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.leaks(docs, none.limit(0)).count() == 0


def scored(texts, items, score):
    """Every (document, item) whose best passage reaches the score, by scoring all passages."""
    lists = [decontaminate.words(t or "") for _, t in items]
    held = [k for k, ws in enumerate(lists) if ws]
    n, mean = len(held), sum(len(lists[k]) for k in held) / len(held)
    df = {}
    for k in held:
        for w in set(lists[k]):
            df[w] = df.get(w, 0) + 1
    out = {}
    for k in held:
        ws, step = lists[k], 64
        while step < len(ws):
            step *= 2
        weight = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(ws)}
        q, a = decontaminate.halves(items[k][1])
        for d, t in texts:
            doc = decontaminate.words(t or "")
            for at in range(0, max(len(doc), 1), step):
                part = doc[at : at + 2 * step]
                s = sum(weight.get(w, 0) for w in set(part)) / sum(weight.values())
                if s >= score - 1e-9:
                    share = []
                    for half in (q, a):
                        m = min(5, len(half))
                        grams = {tuple(half[i : i + m]) for i in range(len(half) - m + 1)} if m else set()
                        share.append(len(grams & {tuple(part[i : i + m]) for i in range(len(part) - m + 1)}) / len(grams) if grams else 1.0)
                    key = (share[0] >= 0.6 and share[1] >= 0.5, min(share) + sum(share), *share, s)
                    out[d, items[k][0]] = max(out.get((d, items[k][0]), (False,)), key)
    return sorted((d, i, round(v[4], 9), round(v[2], 9), round(v[3], 9)) for (d, i), v in out.items())


def test_candidates_equal_scoring_all_whatever_the_shards(spark, sf_dir):
    rng = random.Random(2)
    base = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items = [*base[:25], (100, " ".join(t for _, t in base[25:29])), (101, base[3][1]), (102, None), (103, "one")]
    texts = []
    for d in range(60):
        ws = " ".join(rng.choice(items[:27])[1] for _ in range(rng.randint(1, 4))).split()
        for _ in range(rng.randint(0, len(ws) // 3)):
            ws[rng.randrange(len(ws))] = "other"
        texts.append((d, " ".join(ws)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = scored(texts, items, 0.5)
    assert any(w[1] == 100 for w in want) and len(want) > 100
    for shard in (10**6, 300):
        got = decontaminate.candidates(docs, bench, shard=shard).collect()
        assert sorted((r.doc_id, r.item_id, round(r.score, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9)) for r in got) == want


def test_a_leak_is_not_hidden_by_a_passage_that_fails(spark, monkeypatch):
    at = iter([(1.0, 0.45), (0.6, 0.5)])
    index = SimpleNamespace(term={"word": 0}, ids=[7], search=lambda _: [(0, 1.0)], overlaps=lambda *_: next(at))
    monkeypatch.setattr(decontaminate, "Index", lambda *_: index)
    monkeypatch.setattr(decontaminate, "passages", lambda *_: iter([(0, 0, 1, ["word"]), (0, 0, 1, ["word"])]))
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    kept = {}
    frame = SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, spec: kept.update(run=run))
    monkeypatch.setattr(decontaminate.common, "id_text", lambda docs: frame)
    decontaminate.hits(frame, decontaminate.as_shard([(7, "word")]))
    (out,) = kept["run"](iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["word"]})]))
    assert [(r["question_overlap"], r["answer_overlap"]) for r in out.to_pylist()] == [(0.6, 0.5)]


def test_join_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(registry.SQL["op1_ngram_join"]).fetchall()
    assert sorted(tuple(r) for r in registry.op1_ngram_join(spark, sf_dir).collect()) == sorted(want)


def test_components_do_not_depend_on_what_a_task_takes(spark):
    from trailspark.llm.components import components

    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)]
    edges += [(7, 7), (-5, 9), (9, -5), (1 << 62, 100)] + [(5000, 5001 + k) for k in range(50)]
    rng.shuffle(edges)
    least = {}
    for a, b in edges:
        if a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    want = {(k, v) for k, v in least.items() if k != v}
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for most in (1, 40, 1 << 19):
        got = components(table, most).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert components(table.where("a = b")).count() == 0
