"""Operator 8 [native], personal data by boosted trees over proposed spans.

Generators with high recall propose overlapping spans of four kinds. Strict checks decide
the base spans, which always stay. Every other proposal is tested for evidence of its own
(`_evident`): an address that is one once (at) and (dot) are read as signs, or has spaces
about its @ after a mail word; a number of 9 to 15 digits with a bracketed area code, or
after a phone word. Such proposals, cut to what the evidence covers, are always taken, so
that a text's spans do not depend on the corpus around it. Boosted trees score the rest by
format (digits, separators, brackets, length) and context (neighbouring characters, a cue
word before it, other kinds in the text). They learn the evidence from all proposals but the
base spans. Thresholds are calibrated on documents the trees did not learn from: the lowest
score from which at least PRECISION of the proposals are evident, with at least SUPPORT.

Features are few and discrete, so the corpus is summed into one count for each feature
pattern (some thousands of rows at most, whatever the corpus) and trees are grown on those
counts. Trees become SQL CASE expressions. Everything over rows is DataFrame functions.

Offsets are in code points, ends exclusive. A null text is empty and has no spans (redact()
leaves it null); a long text is searched whole; of matches that overlap within a kind the
leftmost counts, those of two kinds all count; repeated rows repeat their result (and their
counts); without proposals nothing is added; every other column, whatever its name, passes
redact() unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone")
PRECISION, SUPPORT = 0.95, 50
ROUNDS, RATE = 12, 0.4
MARK, OTHER = "\ue000", "\ufffd"

#: Possessive forms of the contract's patterns; they match the same and never recurse.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": BASE["ip"],
    "card": BASE["card"],
    "phone": r"(?<![0-9])[+(]?[0-9][\x20().0-9-]{6,24}[0-9](?![0-9])",
}
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CUES = r"(?i)(tel|phone|call|fax|mobile|card|visa|pay|account|ip|host|server|address|mail|email|contact|reach|write)\W*$"
_DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)"
_DOMAIN = rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*?{_DOT}[A-Za-z]{{2,}}+(?![A-Za-z0-9-]|{_DOT}[A-Za-z0-9])"
#: By kind: forms that are evidence by themselves, forms that are after a cue word, those words.
EVIDENCE = {
    "email": (rf"^[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?{_DOMAIN}", rf"^[A-Za-z0-9._%+-]++\x20?@\x20?{_DOMAIN}", r"(?i)(mail|address|contact|reach|write)\W*$"),
    "phone": (r"^(?:\+?[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"^[0-9]{2,15}(?:[\x20.-]?[0-9]{2,4}){0,5}(?![0-9])", r"(?i)\b(tel|telephone|phone|call|fax|mobile)\W*$"),
}
BYTE = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
STEP = 128
SPAN = "array<struct<s:int,e:int,t:string>>"


def _spans(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches: marked in the text, split at the marks, offsets summed.

    STEP parts at a time are summed in a short array, so that the work on a text with many
    matches grows little faster than their number.
    """
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    none = F.array().cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        span = F.struct(acc["at"].alias("s"), end.alias("e"), x.alias("t"))
        return F.struct(end.alias("at"), (acc["k"] + 1).alias("k"), F.when(acc["k"] % 2 == 1, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def some(parts: Column, acc: Column, first: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), F.lit(0).alias("k"), none.alias("out"))
        return F.aggregate(F.slice(parts, first, STEP), begin, add, lambda own: F.struct(own["at"].alias("at"), F.concat(acc["outs"], F.array(own["out"])).alias("outs")))

    def total(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("outs"))
        return F.aggregate(F.sequence(F.lit(1), F.size(parts), F.lit(STEP)), begin, lambda acc, first: some(parts, acc, first), lambda acc: F.flatten(acc["outs"]))

    found = F.get(F.transform(F.array(F.split(marked, MARK, -1)), total), F.lit(0))  # a lambda's argument is computed once
    return F.when(text.rlike(needs), found).otherwise(none)


def _digits(t: Column) -> Column:
    return F.length(F.regexp_replace(t, "[^0-9]", ""))


def _strict(kind: str, c: Column) -> Column:
    t = c["t"]
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: p.rlike(BYTE))
    if kind == "card":
        return _digits(t).between(13, 19) & F.call_function("luhn_check", F.regexp_replace(t, "[^0-9]", ""))
    if kind == "phone":
        return _digits(t).between(9, 15)
    return F.lit(True)


def _proposed(kind: str, c: Column) -> Column:
    t = c["t"]
    return {"card": _digits(t).between(12, 20), "phone": _digits(t).between(7, 16)}.get(kind, F.lit(True))


def _around(c: Column, text: Column) -> Column:
    """Up to twelve characters before a span."""
    return F.substring(text, F.greatest(c["s"] - 11, F.lit(1)), F.least(c["s"], F.lit(12)))


def _evident(kind: str, c: Column, text: Column) -> Column:
    """The part of a proposal, from its start, that is personal data by evidence other than the strict pattern; else empty."""
    if kind not in EVIDENCE:
        return F.lit("")
    alone, cued, words = EVIDENCE[kind]
    part = lambda pattern: F.regexp_extract(c["t"], pattern, 0)
    found = F.when(part(alone) != "", part(alone)).when(_around(c, text).rlike(words), part(cued)).otherwise("")
    return F.when(_digits(found).between(9, 15), found).otherwise("") if kind == "phone" else found


def _only(test, kind: str):
    return lambda c: test(kind, c)


FEATURES = ("digits", "spaced", "dashed", "bracket", "dotted", "size", "before", "after", "cue", "company")


def _features(kind: str, c: Column, text: Column, company: Column) -> list[Column]:
    t = c["t"]
    before = F.when(c["s"] > 0, F.substring(text, c["s"], F.lit(1))).otherwise("")
    after = F.substring(text, c["e"] + 1, F.lit(1))
    sort = lambda x: F.when(x == "", 0).when(x.rlike(r"\s"), 1).when(x.rlike(r"[\p{L}]"), 2).when(x.rlike("[0-9]"), 3).otherwise(4)
    values = (F.least(_digits(t), F.lit(20)), t.contains(" ").cast("int"), t.contains("-").cast("int"), t.rlike(r"[()\[\]]").cast("int"), t.contains(".").cast("int"), F.least(F.length(t) / 8, F.lit(4)).cast("int"), sort(before), sort(after), _around(c, text).rlike(CUES).cast("int"), company.cast("int"))
    return [v.cast("int").alias(n) for v, n in zip(values, FEATURES, strict=True)]


def proposals(docs: DataFrame) -> DataFrame:
    """docs with `base` (kind, s, e) and `more` (kind, s, e, passes: is a base span, evident, features) added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({f"_base_{k}": F.filter(_spans(text, BASE[k], NEEDS[k]), _only(_strict, k)) for k in KINDS})
    found = found.withColumns({f"_more_{k}": F.filter(_spans(text, LOOSE[k], NEEDS[k]), _only(_proposed, k)) for k in KINDS})
    own = {k: F.col(f"_base_{k}") for k in KINDS}
    base = F.concat(*[F.expr(f"transform(_base_{k}, c -> struct({i} as kind, c.s as s, c.e as e))") for i, k in enumerate(KINDS)])

    def one(i: int, k: str) -> Column:
        others = sum((F.size(own[o]) for o in KINDS if o != k), F.lit(0)) > 0
        def row(c: Column) -> Column:
            sure = F.length(_evident(k, c, text))
            passes = F.exists(own[k], lambda b: (b["s"] == c["s"]) & (b["e"] == c["e"]))
            end = F.when((sure > 0) & ~passes, c["s"] + sure).otherwise(c["e"])
            return F.struct(F.lit(i).alias("kind"), c["s"].alias("s"), end.alias("e"), passes.alias("passes"), (sure > 0).alias("evident"), *_features(k, c, text, others))

        return F.transform(F.col(f"_more_{k}"), row)

    return found.withColumns({"base": base, "more": F.concat(*[one(i, k) for i, k in enumerate(KINDS)])}).drop(*[f"_{p}_{k}" for p in ("base", "more") for k in KINDS])


def _grow(rows: np.ndarray, gradients: np.ndarray, weights: np.ndarray, depth: int) -> tuple:
    """A regression tree over rows of features: (feature, cut, low, high) or a leaf's value."""
    g, h = float(gradients.sum()), float(weights.sum())
    leaf = g / (h + 1.0)
    if not depth or len(rows) < 2:
        return (leaf,)
    best, split = g * g / (h + 1.0) + 1e-6, None
    for f in range(len(FEATURES)):
        for cut in np.unique(rows[:, f])[1:].tolist():
            low = rows[:, f] < cut
            gl, hl = float(gradients[low].sum()), float(weights[low].sum())
            gain = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0)
            if gain > best:
                best, split = gain, (f, cut)
    if split is None:
        return (leaf,)
    low = rows[:, split[0]] < split[1]
    return (*split, *(_grow(rows[side], gradients[side], weights[side], depth - 1) for side in (low, ~low)))


def _value(tree: tuple, row: tuple) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0]


def _sql(tree: tuple, c: str) -> str:
    return f"{tree[0]!r}D" if len(tree) == 1 else f"if({c}.{FEATURES[tree[0]]} < {tree[1]}, {_sql(tree[2], c)}, {_sql(tree[3], c)})"


def boosted(rows: list[tuple], good: list[int], bad: list[int], rounds: int = ROUNDS, depth: int = 2) -> tuple[float, list[tuple]]:
    """Second-order boosting of the log loss over feature patterns with counts."""
    prior = math.log((sum(good) + 1) / (sum(bad) + 1))
    x, a, b = np.array(rows), np.array(good, float), np.array(bad, float)
    scores, trees = np.full(len(rows), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        tree = _grow(x, a * (1 - p) - b * p, (a + b) * p * (1 - p), depth)
        trees.append(tree)
        scores = scores + RATE * np.array([_value(tree, r) for r in rows])
    return prior, trees


def learns() -> Column:
    """`learns`, whether trees are grown on a text's proposals; the others set the thresholds."""
    return (F.pmod(F.xxhash64("text"), F.lit(4)) > 0).alias("learns")


def fit(found: DataFrame, precision: float = PRECISION, support: int = SUPPORT) -> dict[int, tuple[str, float]]:
    """For each kind: the score as SQL over c, and the score from which proposals are taken; found has text or learns()."""
    counted = found.select("learns" if "learns" in found.columns else learns(), F.explode("more").alias("c")).where("not c.passes").groupBy("learns", "c.kind", "c.evident", *[f"c.{f}" for f in FEATURES]).count().collect()  # by feature pattern
    models = {}
    for i in range(len(KINDS)):
        tables: list[dict[tuple, list[int]]] = [{}, {}]
        for r in counted:
            if r.kind == i:
                tables[r.learns].setdefault(tuple(r[f] for f in FEATURES), [0, 0])[r.evident] += r["count"]
        held, taught = ({k: t[k] for k in sorted(t)} for t in tables)
        if not taught or not held:
            continue
        prior, trees = boosted(list(taught), [v[1] for v in taught.values()], [v[0] for v in taught.values()])
        score = lambda r, p=prior, ts=trees: p + RATE * sum(_value(t, r) for t in ts)
        good = total = 0
        threshold = None
        ranked = sorted(((score(r), v) for r, v in held.items()), key=lambda x: -x[0])
        for k, (s, v) in enumerate(ranked):
            good, total = good + v[1], total + v[0] + v[1]
            if (k + 1 == len(ranked) or ranked[k + 1][0] < s) and total >= support and good >= precision * total:
                threshold = s
        if threshold is not None:
            models[i] = (f"{prior!r}D + {RATE!r}D * (" + " + ".join(_sql(t, "c") for t in trees) + ")", threshold - 1e-9)
    return models


def with_spans(found: DataFrame, models: dict[int, tuple[str, float]]) -> DataFrame:
    """`spans` (kind, s, e), sorted: the base spans and the proposals that reach their kind's threshold."""
    taken = "false" if not models else "case c.kind " + " ".join(f"when {i} then {sql} >= {t!r}D" for i, (sql, t) in models.items()) + " else false end"
    added = F.expr(f"transform(filter(more, c -> not c.passes and (c.evident or {taken})), c -> struct(c.kind as kind, c.s as s, c.e as e))")
    return found.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", added)))).drop("more")


def detect(docs: DataFrame) -> DataFrame:
    """docs with `base` and `spans`; proposals are found once and stored with their rows."""
    found = stored(proposals(docs), "pii-spans")
    return with_spans(found, fit(found))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are one, named by the first.

    Proposals are stored without texts to learn from, and found again where texts are replaced:
    a second search costs less than a stored copy of every text.
    """
    rows = docs.select(F.struct("*").alias("row"), "text")
    if len(docs.columns) > 1:  # the text is moved once
        rows = rows.withColumn("row", F.col("row").dropFields("text"))
    found = proposals(rows)
    found = with_spans(found, fit(stored(found.select(learns(), "more"), "pii-spans")))
    names = "element_at(array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]'), x.kind + 1)"
    cut = F.expr(
        "aggregate(array_sort(transform(spans, x -> struct(x.s as s, x.e as e, x.kind as kind))), struct(0 as at, cast(array() as array<string>) as out), "
        f"(acc, x) -> struct(greatest(acc.at, x.e) as at, if(x.s < acc.at, acc.out, concat(acc.out, array(concat(substring(text, acc.at + 1, x.s - acc.at), {names})))) as out), "
        "acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))"
    ).alias("text")
    clean = F.when(F.size("spans") > 0, cut).otherwise(F.col("text")).alias("text")
    return found.select(*[clean if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def _listed(spans: str) -> str:
    return f"concat_ws(',', transform({spans}, x -> concat_ws(':', element_at(array('email', 'ip', 'card', 'phone'), x.kind + 1), x.s, x.e)))"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    found = stored(proposals(docs).withColumn("text", F.xxhash64("text")), "pii-spans")
    out = with_spans(found, fit(found))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long) n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.expr(f"sha2({_listed('array_sort(base)')}, 256) base_sha256"), F.expr(f"{_listed('spans')} spans"))
