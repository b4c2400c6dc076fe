"""Personal data: base rules and boosted candidates, in DataFrame functions only.

Base spans (fixed patterns, leftmost and non-overlapping per kind, failing ones
dropped): email, ip, card, phone. The method adds spans that look like secrets:
two high-recall generators propose overlapping spans (any long token with a
digit, and whatever follows a telling word and a sign of assignment); boosted
trees score them from binned format and context features; a threshold calibrated
for precision selects. Of overlapping added spans the longer-reaching first one
stands.

There are no labels of personal data, so the trees learn from planted examples
whose label is known because they were made: for each document, keys, hex
digests and passwords, and decoys (numbers, dates, identifiers of words), before
and after the document's own words. Three quarters of the documents fit the
trees; the threshold and the recall that is reported come from the others.

All work on rows is in built-in functions. Positions come from lengths: what
``split`` leaves between matches and the matches themselves alternate, so starts
are running sums (taken in blocks, to stay near linear). The trees are fitted
from a table of counts by feature bins, of bounded size, and are applied as a
sum of CASE expressions. Redaction goes by blocks of ``BLOCK`` characters.

Patterns carry a guard against rescans: a match starts after a character of
another class or where the last match ended, which cannot change the leftmost
match but keeps long runs linear.

Null text: no spans, digest of the empty string. Repeated rows get equal
results. An empty table has no model and no spans.
"""

from __future__ import annotations

import math
from functools import partial
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PRECISION = 0.95
KINDS = ("email", "ip", "card", "phone")
#: Gate (cheap, for whole texts), pattern and check of each kind.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){12}", r"(?:\G|(?<![0-9]))[0-9]++(?:[ -][0-9]++)*+"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Words that announce a secret.
TELLING = ("password", "passwd", "secret", "token", "apikey", "api_key", "access_key", "auth")
GENERATORS = {
    "token": (r"[0-9]", r"(?:\G|(?<![A-Za-z0-9_/+-]))(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{12,}+"),
    "told": (r"[=:]", r"(?i)(?:" + "|".join(TELLING) + r")\s{0,2}[=:]\s{0,2}[\"']?[^\s\"'<>]{6,}+"),
}
CONTEXT = 24
#: Characters of a text that redaction rewrites at a time.
BLOCK = 4096
SPAN = "struct<kind:string,start:int,end:int,value:string>"
_NONE = f"CAST(array() AS array<{SPAN}>)"


def running(lens: Column, block: int = 64) -> Column:
    """Sums up to and with each element, in blocks so that appending stays cheap."""
    n = F.size(lens)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(lens, b * block + 1, F.lit(block)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
    base = F.aggregate(sums, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    return F.flatten(F.zip_with(blocks, F.slice(base, 1, F.size(sums)), lambda x, b0: F.slice(F.aggregate(x, F.array(b0), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))), 2, F.size(x))))


def _span(kind: str, match: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (end - F.length(match)).cast("int").alias("start"), end.cast("int").alias("end"), match.alias("value"))


def located(d: DataFrame, kept: list[str], asked: dict[str, tuple[str, str, str]], before: bool = False) -> DataFrame:
    """Columns ``kept`` and one of all matches, in order, for each name in ``asked`` (gate, pattern, kind); ``before`` adds what stands before each: the text since the last match, and that match.

    In steps, so that no match or length is taken twice.
    """
    text, strings = F.col("text"), F.expr("CAST(array() AS array<string>)")
    found = {n: F.when(text.contains(gate) if gate == "@" else text.rlike(gate), F.regexp_extract_all(text, F.lit(p), 0)).otherwise(strings) for n, (gate, p, _) in asked.items()}
    d = d.select(*kept, *(c.alias(f"m_{n}") for n, c in found.items()))
    between = {n: F.when(F.size(f"m_{n}") > 0, F.slice(F.split(text, p, -1), F.lit(1), F.size(f"m_{n}"))).otherwise(strings) for n, (_, p, _) in asked.items()}
    d = d.select("*", *(c.alias(f"b_{n}") for n, c in between.items()))
    lens = {n: F.zip_with(f"b_{n}", f"m_{n}", lambda a, b: F.length(a) + F.length(b)) for n in asked}
    d = d.select("*", *(c.alias(f"l_{n}") for n, c in lens.items()))
    d = d.select("*", *(F.when(F.size(f"m_{n}") > 0, running(F.col(f"l_{n}"))).otherwise(F.expr("CAST(array() AS array<int>)")).alias(f"e_{n}") for n in asked))
    out = []
    for n, (_, _, kind) in asked.items():
        spans = F.zip_with(f"m_{n}", f"e_{n}", partial(_span, kind))
        if before:
            last = F.zip_with(f"b_{n}", F.slice(F.concat(F.array(F.lit("")), F.col(f"m_{n}")), F.lit(1), F.size(f"m_{n}")), lambda b, m: F.right(F.concat(m, b), F.lit(CONTEXT)))
            spans = F.zip_with(spans, last, lambda s, b: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), b.alias("before")))
        out.append(spans.alias(n))
    return d.select(*kept, *out)


def valid(kind: str, span: Column) -> Column:
    v = span["value"]
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(d: DataFrame, kept: list[str]) -> DataFrame:
    """Columns ``kept`` and the valid spans of each kind."""
    found = located(d, kept, {k: (gate, p, k) for k, (gate, p) in PATTERNS.items()})
    return found.select(*kept, *(F.filter(F.col(k), partial(valid, k)).alias(k) for k in KINDS))


def proposals(d: DataFrame, kept: list[str]) -> DataFrame:
    """Columns ``kept`` and the candidates of each generator."""
    return located(d, kept, {g: (gate, p, "secret") for g, (gate, p) in GENERATORS.items()}, before=True)


def features(span: Column, told: bool) -> list[Column]:
    """Small integers: bins of format and context of a candidate."""
    v = span["value"]
    value = F.regexp_replace(v, r"(?i)^.*?[=:]\s{0,2}[\"']?", "") if told else v
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda p: F.floor(F.length(F.regexp_replace(value, p, "")) * 8 / n).cast("int")
    context = F.lit(1) if told else F.lower(span["before"]).rlike("(?:" + "|".join(TELLING) + r")\W*$").cast("int")
    return [
        F.least(F.floor(n / 4), F.lit(12)).cast("int"),
        share("[^0-9]"),
        share("[^A-Z]"),
        context,
        value.rlike(r"^(?:AKIA|ASIA|ghp_|sk_|xox[bp]-)").cast("int"),
        F.least(F.length(F.regexp_replace(F.regexp_replace(value, r"[0-9]+", "9"), "[^9]", "")), F.lit(6)).cast("int"),
    ]


@dataclass(frozen=True)
class Stage:
    """A tree of depth two: feature and cut at the root and below; four leaves."""

    root: tuple[int, int]
    low: tuple[int, int]
    high: tuple[int, int]
    leaves: tuple[float, float, float, float]


def boost(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = 12, rate: float = 0.4, penalty: float = 1.0) -> tuple[float, list[Stage]]:
    """Depth-two boosting on (bins, positives, negatives) counts. Ties in gain: first feature, lowest cut."""
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    base = math.log((pos + 1) / (neg + 1))
    if not pos or not neg:
        return base, []
    margin = [base] * len(cells)
    width = len(cells[0][0])
    cuts = [(j, v) for j in range(width) for v in sorted({c[0][j] for c in cells})[:-1]]

    def best(rows: list[int], g: list[float], h: list[float]) -> tuple[tuple[int, int], float]:
        gs, hs = sum(g[r] for r in rows), sum(h[r] for r in rows)
        top, at = 1e-9, (0, 1 << 20)
        for j, v in cuts:
            gl = hl = 0.0
            for r in rows:
                if cells[r][0][j] <= v:
                    gl += g[r]
                    hl += h[r]
            gain = gl * gl / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs * gs / (hs + penalty)
            if gain > top + 1e-12:
                top, at = gain, (j, v)
        return at, top

    stages = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [p[k] * (c[1] + c[2]) - c[1] for k, c in enumerate(cells)]
        h = [p[k] * (1 - p[k]) * (c[1] + c[2]) for k, c in enumerate(cells)]
        every = list(range(len(cells)))
        root, _ = best(every, g, h)
        sides = [[r for r in every if cells[r][0][root[0]] <= root[1]], [r for r in every if cells[r][0][root[0]] > root[1]]]
        below, leaves = [], []
        for side in sides:
            cut, _ = best(side, g, h)
            below.append(cut)
            for part in ([r for r in side if cells[r][0][cut[0]] <= cut[1]], [r for r in side if cells[r][0][cut[0]] > cut[1]]):
                w = -rate * sum(g[r] for r in part) / (sum(h[r] for r in part) + penalty)
                leaves.append(w)
                for r in part:
                    margin[r] += w
        stages.append(Stage(root, below[0], below[1], tuple(leaves)))
    return base, stages


def margin_of(bins: tuple[int, ...], base: float, stages: list[Stage]) -> float:
    total = base
    for s in stages:
        high = bins[s.root[0]] > s.root[1]
        cut = s.high if high else s.low
        total += s.leaves[2 * high + (bins[cut[0]] > cut[1])]
    return total


def margin_column(bins: list[Column], base: float, stages: list[Stage]) -> Column:
    total = F.lit(base)
    for s in stages:
        low = F.when(bins[s.low[0]] <= s.low[1], s.leaves[0]).otherwise(s.leaves[1])
        high = F.when(bins[s.high[0]] <= s.high[1], s.leaves[2]).otherwise(s.leaves[3])
        total = total + F.when(bins[s.root[0]] <= s.root[1], low).otherwise(high)
    return total


@dataclass(frozen=True)
class Model:
    """Trees, threshold, and the precision and recall on planted examples that the trees did not see."""

    base: float
    stages: tuple[Stage, ...]
    threshold: float
    precision: float = 0.0
    recall: float = 0.0


def selected(model: Model, told: bool, span: Column) -> Column:
    return margin_column(features(span, told), model.base, list(model.stages)) >= model.threshold


def calibrate(cells: list, base: float, stages: list[Stage], precision: float = PRECISION) -> float:
    """Lowest margin from which on, over the counts, the precision holds; infinite where none does."""
    scored = sorted(((margin_of(b, base, stages), p, n) for b, p, n in cells), reverse=True)
    pos = neg = 0.0
    at = math.inf
    for k, (m, p, n) in enumerate(scored):
        pos, neg = pos + p, neg + n
        if (k + 1 == len(scored) or scored[k + 1][0] < m - 1e-12) and pos and pos / (pos + neg) >= precision:
            at = m
    return at - 1e-9


EXAMPLES = 2


def examples(docs: DataFrame) -> DataFrame:
    """``s, secret, held``: planted candidates, ``EXAMPLES`` for each document; ``held``: of the documents for calibration."""
    d = common.id_text(docs).select(F.xxhash64("doc_id", "text").alias("seed"), F.substring("text", 1, 64).alias("head"))
    d = d.select("seed", "head", F.explode(F.sequence(F.lit(0), F.lit(EXAMPLES - 1))).alias("i"))
    d = d.select("head", "i", F.pmod("seed", F.lit(4)).alias("part"), F.sha2(F.concat_ws(":", F.col("seed").cast("string"), F.col("i").cast("string")), 256).alias("hex"), F.pmod(F.xxhash64("seed", "i"), F.lit(1 << 20)).cast("int").alias("r"))
    pick = lambda by, *values: F.element_at(F.array(*(F.lit(v) for v in values)), F.pmod(F.floor(F.col("r") / by), F.lit(len(values))).cast("int") + 1)
    upto = lambda c, low, high: F.substring(c, F.lit(1), F.lit(low) + F.pmod(F.col("r"), F.lit(high - low + 1)))
    hex_, mixed = F.col("hex"), F.regexp_replace(F.base64(F.unhex("hex")), "[^A-Za-z0-9]", "")
    digits = F.translate(hex_, "abcdef", "749135")
    word = F.lower(F.regexp_extract("head", "([A-Za-z]{4,12})", 1))
    named = F.concat_ws("-", F.when(word == "", "chapter").otherwise(word), pick(7, "section", "figure", "release", "appendix", "edition"), F.substring(digits, F.lit(1), 1 + F.pmod(F.col("r"), F.lit(3))))
    secrets = [upto(hex_, 16, 64), F.upper(upto(hex_, 16, 64)), upto(mixed, 16, 40), F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.concat(F.lit("ghp_"), upto(mixed, 30, 36))]
    decoys = [upto(digits, 12, 20), named, F.upper(named), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.concat(F.substring(digits, 7, 2), F.lit("T"), F.substring(digits, 9, 4))), F.concat_ws("/", F.lit("v2"), named, F.substring(digits, 1, 6))]
    secret = F.col("i") < EXAMPLES // 2
    choose = lambda made: F.element_at(F.array(*made), F.pmod(F.floor(F.col("r") / 11), F.lit(len(made))).cast("int") + 1)
    # most secrets follow a telling word, few decoys do
    told = F.pmod(F.floor(F.col("r") / 64), F.lit(10)) < F.when(secret, 7).otherwise(1)
    lead = F.when(told, F.concat(pick(3, *TELLING), pick(5, "=", ": ", ' = "'))).otherwise(F.concat(F.right("head", F.lit(CONTEXT)), F.lit(" ")))
    span = F.struct(F.when(secret, choose(secrets)).otherwise(choose(decoys)).alias("value"), lead.alias("before"))
    return d.select(span.alias("s"), secret.alias("secret"), (F.col("part") == 0).alias("held"))


def train(docs: DataFrame) -> Model:
    """Fit and calibrate on the examples planted for all documents."""
    bins = features(F.col("s"), False)
    names = [f"f{k}" for k in range(len(bins))]
    labelled = examples(docs).where(F.col("s.value").rlike("[0-9]")).select(*(b.alias(n) for b, n in zip(bins, names, strict=True)), "secret", "held")
    # rows of this table: at most the product of the bins
    table = labelled.groupBy(*names, "held").agg(F.count_if("secret").alias("pos"), F.count_if(~F.col("secret")).alias("neg")).orderBy(*names, "held").collect()
    every = [(r.held, tuple(r[n] for n in names), float(r.pos), float(r.neg)) for r in table]
    if not every:
        return Model(0.0, (), math.inf)
    base, stages = boost([c[1:] for c in every if not c[0]] or [c[1:] for c in every])
    held = [c[1:] for c in every if c[0]] or [c[1:] for c in every]
    if not stages:
        return Model(base, (), math.inf)
    threshold = calibrate(held, base, stages)
    taken = [(p, n) for b, p, n in held if margin_of(b, base, stages) >= threshold]
    pos, neg = sum(p for p, _ in taken), sum(n for _, n in taken)
    return Model(base, tuple(stages), threshold, pos / max(pos + neg, 1), pos / max(sum(p for _, p, _ in held), 1))


def without_overlaps(spans: Column) -> Column:
    """Of spans sorted by start and falling end, those that start at or after the end of the last one kept."""
    state = F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("kept"))
    return F.aggregate(spans, state, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["kept"], F.array(s)).alias("kept"))), lambda a: a["kept"])


def in_order(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))


def chosen(d: DataFrame, kept: list[str], model: Model) -> DataFrame:
    """Columns ``kept`` and ``secret``: the selected candidates in order, overlapping ones included."""
    if math.isinf(model.threshold):
        return d.select(*kept, F.expr(_NONE).alias("secret"))
    plain = lambda s: F.struct(*(s[k].alias(k) for k in ("kind", "start", "end", "value")))
    picked = [F.transform(F.filter(F.col(g), partial(selected, model, g == "told")), plain) for g in GENERATORS]
    return proposals(d, kept).select(*kept, in_order(F.concat(*picked)).alias("secret"))


def spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, text`` and arrays of spans: ``email, ip, card, phone, secret``; offsets in code points, ends exclusive."""
    model = model or train(docs)
    kept = ["doc_id", "text"]
    found = chosen(base_spans(common.id_text(docs), kept), [*kept, *KINDS], model)
    return found.select(*kept, *KINDS, F.when(F.size("secret") > 0, without_overlaps(F.col("secret"))).otherwise(F.expr(_NONE)).alias("secret"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Counts, the base digest and all spans of every row."""
    base = F.concat(*(F.col(k) for k in KINDS))
    return spans(docs, model).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("secret"))).alias("spans"),
    )


def redacted(found: DataFrame, kept: list[str]) -> DataFrame:
    """Columns ``kept`` and ``done``: ``text`` with each stretch of overlapping ``spans``, which are in order, replaced by the kind of its first.

    Block by block: in each the spans that start there are cut out; a stretch that
    began before reaches in by its end.
    """
    text = F.col("text")
    d = found.select(*kept, "spans", F.when(F.size("spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)).alias("blocks"))
    d = d.select("*", F.transform("blocks", lambda b, k: F.struct(
        b.alias("b"), (k * BLOCK).alias("from"),
        F.filter("spans", lambda s: (s["start"] >= k * BLOCK) & (s["start"] < (k + 1) * BLOCK)).alias("own"),
        F.greatest(F.array_max(F.transform(F.filter("spans", lambda s: s["start"] < k * BLOCK), lambda s: s["end"])), k * BLOCK).alias("at"),
    )).alias("cut"))
    label = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))

    def rewritten(c: Column) -> Column:
        piece = lambda a, z: F.substring(c["b"], a - c["from"] + 1, F.greatest(z - a, F.lit(0)))
        state = F.struct(c["at"].alias("at"), F.expr("CAST(array() AS array<string>)").alias("parts"))
        step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(piece(a["at"], s["start"]), label(s))).alias("parts"))
        )
        end = c["from"] + F.length(c["b"])
        return F.aggregate(c["own"], state, step, lambda a: F.concat(F.array_join(a["parts"], ""), piece(F.least(a["at"], end), end)))

    return d.select(*kept, F.when(F.size("spans") == 0, text).otherwise(F.array_join(F.transform("cut", rewritten), "")).alias("done"))


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with spans replaced in the text; null stays null, other columns as they are."""
    common.ship(docs.sparkSession)
    model = model or train(docs.select(F.lit(None).cast("long").alias("doc_id") if "doc_id" not in docs.columns else F.col("doc_id"), F.col(text_col).alias("text")))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = chosen(base_spans(d, ["row", "text"]), ["row", "text", *KINDS], model)
    found = found.select("row", "text", in_order(F.concat(*KINDS, "secret")).alias("spans"))
    done = redacted(found, ["row", "text"])
    whole = F.when(F.col("row")[text_col].isNotNull(), F.col("done"))
    return done.select(*((whole if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
