"""Personal data and page text against brute force."""

import hashlib
import html
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailspark.llm import html_text, pii, registry

# The patterns as the contract states them.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TRAPS = [
    "a@b.c@d.e x.@y.z a@b.c.@x.y .@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.1.1.1.", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 0000000000000", "+1 (555) 123-4567 4111111111111111 +12 + 3 +1-2-3-4-5-6-7-8-9 +1 ()",
    "ééé 日本 x@y.zz é1.2.3.4é +49 30 1234567", "@@a@@b.c @ a@ b.c a@b a@-.-", "9" * 5000 + " " + "1 " * 3000 + "4111111111111111", "a" * 20000 + "@b.cc", "1.2.3.4" * 50, "10.0.0.1 0.0.0.0 000.0.00.1", None, "",
]


def check(df, rows):
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in df.collect()}
    want = set()
    for i, t in rows:
        found = base(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want.add((i, hashlib.sha256(text.encode()).hexdigest(), *(sum(f[0] == k for f in found) for k in BASE)))
    assert got == want


def test_base_spans_equal_the_patterns(spark, sf_dir, odd, odd_rows, empty):
    rows = list(enumerate(TRAPS))
    check(pii.digests(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(registry.op3_pii(spark, "/root/testdata/sf0.01"), docs)
    check(pii.digests(odd), odd_rows)
    assert pii.digests(odd).count() == len(odd_rows) and pii.digests(empty).count() == 0


def test_added_spans_are_secrets_and_base_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    secret = re.compile(r'AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}|token = "[0-9a-f]{40}"')
    want = {(i, m.start()) for i, t in text.items() for m in secret.finditer(t)}
    got = set()
    for r in pii.digests(docs).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [tuple([k, int(a), int(b)]) for k, a, b in spans if k != "secret"] == base(text[r.doc_id])
        got |= {(r.doc_id, int(a)) for k, a, _ in spans if k == "secret"}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_rare_secrets_are_found_whatever_their_ids(spark):
    docs = spark.range(5200).withColumn("rank", F.row_number().over(Window.orderBy(F.xxhash64("id").desc())))
    text = F.when(F.col("rank") <= 40, F.concat(F.lit("the password="), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 18), F.lit(" is set"))).otherwise("see part abcdefghijkl-7")
    docs = docs.select(F.col("id").alias("doc_id"), text.alias("text")).cache()
    assert pii.digests(docs).where("spans like 'secret%'").count() == 40
    assert pii.redact(docs).where("text like '%[SECRET]%'").count() == 40


def test_redaction(spark):
    rows = [(1, "mail a.b@c.dd or +1 (555) 123-4567!", 5), (2, None, 0), (3, "nothing", 7), (4, "é 10.0.0.1 é", 1)]
    model = pii.Model(0.0, (), float("inf"))
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, spans long"), model).collect()}
    clash = spark.createDataFrame([(1, "a.b@c.dd", "x", "y")], "row long, text string, email string, m_ip string")
    assert [tuple(r) for r in pii.redact(clash, model).collect()] == [(1, "[EMAIL]", "x", "y")]
    assert got == {1: "mail [EMAIL] or [PHONE]!", 2: None, 3: "nothing", 4: "é [IP] é"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    done = pii.redact(docs).cache()
    assert done.count() == docs.count() and done.columns == docs.columns
    assert not any(base(r.text) for r in done.collect())


def test_planted_secrets_are_learnt_and_calibrated_on_other_documents(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert model.stages and model.precision >= 0.95 and model.recall >= 0.9


@pytest.mark.parametrize("block", [4096, 7])
def test_redaction_equals_cutting(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "BLOCK", block)
    model = pii.Model(0.0, (), float("inf"))
    texts = [*(t for t in TRAPS if t is None or len(t) < 6000), "+1 234 567 8901@x.yz and 1.2.3.4" * 30, "é 日本 " * 50 + "a@b.cc 10.0.0.1 4111 1111 1111 1111" * 9]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        for kind, a, b in sorted(base(t), key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert got[i] == (None if t is None else "".join(out) + t[at:])


def test_redaction_is_near_linear(spark):
    import time

    text = "write to a.b@c.dd or 10.0.0.1, card 4111 1111 1111 1111, token = 0a1b2c3d4e5f60718293 and +1 (555) 123-4567; " * 1500
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = pii.train(spark.createDataFrame([(k, f"words {k} of a text") for k in range(200)], "doc_id long, text string"))
    began = time.time()
    (row,) = pii.redact(df, model).collect()
    assert row.text.count("[EMAIL]") == 1500 and row.text.count("[CARD]") == 1500 and row.text.count("[SECRET]") == 1500 and time.time() - began < 30


def test_no_python_in_the_plan(spark, sf_dir):
    plan = registry.op3_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_trees_apply_alike_in_both_forms(spark):
    rng = np.random.default_rng(2)
    cells = [(tuple(int(v) for v in rng.integers(0, 5, 6)), float(rng.integers(0, 9)), float(rng.integers(0, 9))) for _ in range(40)]
    b, stages = pii.boost(cells, 5)
    df = spark.createDataFrame([c[0] for c in cells], ", ".join(f"f{k} int" for k in range(6)))
    got = [r.m for r in df.select(pii.margin_column([F.col(f"f{k}") for k in range(6)], b, stages).alias("m")).collect()]
    assert got == pytest.approx([pii.margin_of(c[0], b, stages) for c in cells])
    assert pii.boost([((1,), 3.0, 0.0)])[1] == []


def plain(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    out = []
    for part in re.split(r"</?(?:p|h1)\b[^>]*(?:>|\Z)", inner[1] if inner else ""):
        part = re.sub(r"<[a-zA-Z/!][^>]*(>|\Z)", lambda m: " " if "br" in m[0] else "", part)
        part = " ".join(html.unescape(part).split())
        out += [part] if part else []
    return "\n\n".join(out)


def test_pages_equal_their_articles(spark):
    d = "/root/testdata/sf0.01"
    page = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = registry.op10_html_text(spark, d).collect()
    assert len(got) == len(page)
    assert all(r.text == plain(page[r.page_id]) and r.n_chars == len(r.text) for r in got)


def texts(pages, owners=None):
    return html_text.main_texts([html_text.blocks(p) for p in pages], owners or list(range(len(pages))))


def test_page_structure():
    page = (
        '<html><head><title>T</title></head><body><header>Site</header><div id="sidebar-left">x<div>y</div></div><div class="cookie-notice">ok?</div><main><header><h1>A</h1></header>'
        '<p>One<p class="ad">Buy<p>Two &amp; <b>t</b>hree<br>four &lt;x&gt;</p><form>f<input></form><script>if (a < b) "</p>"</script><div class="comments"><article>c1</article></div><ul><li>i<li>j</ul></main><p>out</p><footer>f</footer></body>'
    )
    text = texts([page])[0][0]
    assert text == "A\n\nOne\n\nTwo & three four <x>\n\ni\n\nj"
    inner = "<main><div>note</div><article class='post'><div class='article-header'><h1>A</h1></div><p>x</p></article></main>"
    assert texts([inner])[0][0] == "A\n\nx"
    assert texts(["", "<p", "plain", "<!-- x", "<p>a < b & c &am"]) == [("", 0), ("", 0), ("plain", 0), ("", 0), ("a < b & c &am", 0)]


def test_formulas_stand_ins_and_hidden_elements_of_an_article_are_text():
    inner = "<p>Let <math><mi>x</mi> <mo>=</mo> 2</math>.</p><p hidden>Later</p><video>no player</video><p><span aria-hidden=true>so</span> on</p><object>a plan</object><audio>a song</audio>"
    page = f"<body><div hidden>menu</div><article>{inner}<svg><text>drawn</text></svg><script>x()</script></article><p aria-hidden='true'>end</p></body>"
    kept = html_text.vouched(html_text.blocks(page))
    assert [b.text for b in kept] == ["Let x = 2.", "Later", "no player", "so on", "a plana song"]


def test_repeated_runs_leave_pages_without_an_article():
    chrome = "read our daily letter and write to us at the desk below"
    pages = [f"<body><div>{chrome}</div><div>s{k} story of its own with words {k * 7} and more {k}</div><div>tail {k}</div></body>" for k in range(4)]
    for k, (text, n) in enumerate(texts(pages)):
        assert text == f"s{k} story of its own with words {k * 7} and more {k}\n\ntail {k}" and n
    assert texts(pages[:2])[0][0].startswith(chrome)
    assert texts(pages, [1, 1, 1, 1])[0][0].startswith(chrome)


def test_teasers_go_and_a_single_article_stays():
    teaser = "<article>read more about the new bridge over the river today</article>"
    own = [" ".join(f"{word}{k}" for word in ("a", "story", "of", "its", "own")) for k in range(3)]
    assert [t for t, _ in texts([f"{teaser}<article>{x}</article>" for x in own])] == own
    assert [t for t, _ in texts([teaser] * 4)] == ["read more about the new bridge over the river today"] * 4
    both = [teaser + "<article>and a second one that all the pages of it have</article>"] * 3
    assert all(t.count("\n\n") == 1 for t, _ in texts(both))


def test_an_empty_article_leaves_the_open_blocks():
    pages = [f"<main> <!-- later --></main><div>{'all the rights of this small page are kept' if k < 3 else 'x'}</div><p>{k} is told</p>" for k in range(4)]
    assert [t for t, _ in texts(pages)] == ["0 is told", "1 is told", "2 is told", "x\n\n3 is told"]


def test_repeats_equal_brute_force():
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 3, rng.integers(0, 40)) for _ in range(9)]
    owners = [0, 1, 2, 3, 4, 5, 5, 6, 7]
    got = html_text.repeated(pages, owners, 4, 3)
    runs = {}
    for p, o in zip(pages, owners, strict=True):
        for i in range(len(p) - 3):
            runs.setdefault(tuple(p[i : i + 4]), set()).add(o)
    for p, g in zip(pages, got, strict=True):
        want = np.zeros(len(p), bool)
        for i in range(len(p) - 3):
            if len(runs[tuple(p[i : i + 4])]) >= 3:
                want[i : i + 4] = True
        assert (want == g).all()


def test_repeats_are_counted_across_parts_of_a_host(spark):
    notice = "all the rights of this small page are kept"
    rows = [(k % 9 if k != 4 else None, f"http://a.b/{k}", f"<div>{notice if k < 3 or k == 4 else 'x'} {k} own words</div><p>{' '.join(f'w{k + j}' for j in range(9))}</p>") for k in range(12)]
    df = spark.createDataFrame([*rows, (1, None, "<p>"), (None, None, None)], "page_id long, url string, html string")
    want = sorted(html_text.extract(df, part=100).collect(), key=str)
    assert sum((r.n_repeated or 0) >= 9 for r in want) == 4 and not any(notice in r.text for r in want)
    for part in (1, 5):
        assert sorted(html_text.extract(df, part=part).collect(), key=str) == want


def test_extraction_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    notices = [" ".join(f"n{k}{j}" for j in range(8 + k)) for k in range(6)]
    rows = []
    for k in range(90):
        own = " ".join(f"o{k}x{j}" for j in range(int(rng.integers(1, 12))))
        say = [f"<div>{notices[j]}</div>" for j in rng.choice(6, 2, replace=False)]
        body = rng.choice([f"<p>{own}</p>", f"<article>{own}</article>", f"<article>{notices[0]}</article><article>{own}</article>", f"<main>{own}</main><nav>menu</nav>"])
        rows.append((int(rng.integers(0, 80)), f"http://h{k % 3 if k < 60 else 9}.org/{k}", say[0] + body + say[1]))
    parsed = [html_text.blocks(h) for _, _, h in rows]
    pages_of = {}
    for (i, u, _), found in zip(rows, parsed, strict=True):
        ws = [w for t in html_text.rest(found) for w in (*t.split(" "), "\n")]
        for a in range(len(ws) - 7):
            pages_of.setdefault((u.split("/")[2], tuple(ws[a : a + 8])), set()).add(i)
    want = []
    for (i, u, _), found in zip(rows, parsed, strict=True):
        whole = html_text.vouched(found)
        kept = [b.text for b in whole or ()]
        if whole is None:
            ws = [(w, n) for n, b in enumerate(found) for w in (*b.text.split(" "), "\n")]
            gone = {a + x for a in range(len(ws) - 7) for x in range(8) if len(pages_of[u.split("/")[2], tuple(w for w, _ in ws[a : a + 8])]) >= 3}
            left = [" ".join(w for k, (w, m) in enumerate(ws) if m == n and w != "\n" and k not in gone) for n in range(len(found))]
            best = max(b.standing for b in found)
            if best == 1:
                kept = [t for t, b in zip(left, found, strict=True) if b.standing == 1 and t]
            else:
                n_all = {b.region: len(b.text.split(" ")) for b in found if b.standing == best}
                n_left = {b.region: len(t.split()) for t, b in zip(left, found, strict=True) if b.standing == best}
                own = {r for r in n_all if 2 * (n_all[r] - n_left[r]) < n_all[r]} or set(n_all)
                kept = [b.text for b in found if b.standing == best and b.region in own]
        want.append((i, u, "\n\n".join(kept), len("\n\n".join(kept))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for part in (1000, 7):
        assert sorted(tuple(r)[:4] for r in html_text.extract(df, part=part).collect()) == sorted(want)
    plain_texts = sorted((i, u, "\n\n".join(b.text for b in found if b.standing == max(x.standing for x in found))) for (i, u, _), found in zip(rows, parsed, strict=True))
    assert sum(a[2] != b[2] for a, b in zip(plain_texts, sorted(want), strict=True)) > 30  # what the runs decide


def test_odd_pages(spark):
    rows = [(1, "http://a.b/c", "<article><p>x</p></article>", 1, "h"), (2, None, None, 2, "h"), (None, "junk", "<p>y", 3, "h"), (1, "http://a.b/c", "<article><p>x</p></article>", 1, "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, part long, host string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(df, part=1).collect()), key=str)
    assert got == sorted([(1, "http://a.b/c", "x", 1), (2, None, "", 0), (None, "junk", "y", 1), (1, "http://a.b/c", "x", 1)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def test_an_article_that_all_pages_have_is_a_teaser():
    teaser = "<article>read more about the new bridge over the river today</article>"
    own = [" ".join(f"{word}{k}" for word in "this is the story that a page of the host has for its own".split()) for k in range(4)]
    assert [t for t, _ in texts([f"<div>{x}</div>{teaser}" for x in own])] == own
    # few words around a copied article are none
    assert {t for t, _ in texts([f"{teaser}<div>page {k} of 4</div>" for k in range(4)])} == {"read more about the new bridge over the river today"}


def test_runs_are_looked_for_on_every_page_at_any_part_size(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = [sorted(map(tuple, html_text.extract(pages, part=part).collect())) for part in (10_000, 9)]
    assert got[0] == got[1] and len(got[0]) == pages.count()
    each = {}
    for r in pages.collect():
        each.setdefault(r.url.split("/")[2].lower(), []).append(r)
    want = {}
    for rows in each.values():
        found, on = [[w for b in html_text.blocks(r.html) for w in (*b.text.split(" "), "\n")] for r in rows], {}
        for r, ws in zip(rows, found, strict=True):
            for a in range(len(ws) - 7):
                on.setdefault(tuple(ws[a : a + 8]), set()).add(r.page_id)
        for r, ws in zip(rows, found, strict=True):
            want[r.page_id] = len({a + x for a in range(len(ws) - 7) if len(on[tuple(ws[a : a + 8])]) >= 3 for x in range(8)})
    assert {r[0]: r[4] for r in got[0]} == want and sum(n > 0 for n in want.values()) > 9


def test_anchors_of_equal_runs_are_equal():
    rng = np.random.default_rng(8)
    pages = [[" ".join(f"w{v}" for v in rng.integers(0, 3, rng.integers(0, 40)))] for _ in range(9)] + [[]]
    streams, tokens = html_text.token_streams(pages)
    seen = {}
    for s, found in zip(streams, html_text.anchors(streams, tokens), strict=True):
        assert len(found) == max(len(s) - 7, 0)
        for a, h in enumerate(found.tolist()):
            assert seen.setdefault(tuple(s[a : a + 8]), h) == h
    all_runs, n = html_text.run_counts(pages, list(range(10)))
    assert len(all_runs) == len(n) == len(seen) and n.max() > 1
    v = rng.integers(0, 1 << 40, 50).astype(np.uint64)
    assert (html_text.unpacked(html_text.packed(v)) == v).all() and len(html_text.packed(v)) == 250
