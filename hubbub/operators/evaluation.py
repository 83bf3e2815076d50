"""Predicted cards against gold signals, groupings against labelled pairs, run accounting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import COSINES
from ..plans.store import stored
from . import cards as gate
from .grouping import assigned


def candidate_matches(cards: DataFrame, gold: DataFrame) -> DataFrame:
    """Card and gold signal pairs of one case and type whose evidence overlaps, by an equi-join on the cited ids."""
    c = cards.select("case_id", "system", "signal_id", "type", F.explode(F.array_distinct("evidence")).alias("id"))
    g = gold.select("case_id", "gold_no", "type", F.explode(F.array_distinct("relevant_message_ids")).alias("id"))
    return c.join(g, ["case_id", "type", "id"]).groupBy("case_id", "system", "signal_id", "gold_no").agg(F.count("*").alias("overlap"))


def match_gold(cards: DataFrame, gold: DataFrame) -> DataFrame:
    """case_id, system, signal_id, gold_no: each card in the order of signal_id takes the untaken gold with most overlap.

    The order matters, so a case's few cards are matched in one group of rows.
    """

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        for _, own in rows.sort_values(["signal_id", "overlap", "gold_no"], ascending=[True, False, True]).groupby("signal_id", sort=False):
            free = own[~own["gold_no"].isin(taken)]
            if len(free):
                out.append(free.iloc[0])
                taken.add(free.iloc[0]["gold_no"])
        return pd.DataFrame(out, columns=rows.columns)[["case_id", "system", "signal_id", "gold_no"]]

    return candidate_matches(cards, gold).groupBy("case_id", "system").applyInPandas(greedy, "case_id string, system string, signal_id string, gold_no int")


def score_cases(checked: DataFrame, gold: DataFrame, cases: DataFrame) -> DataFrame:
    """Counts for each (case, system): checked cards (with ok), gold signals, cases (case_id, must_abstain)."""
    matches = match_gold(checked, gold)
    trigger = F.coalesce("trigger.event_id", F.lit("unknown"))
    rows = checked.select("case_id", "system", "signal_id", "type", "ok", trigger.alias("said")).join(matches, ["case_id", "system", "signal_id"], "left")
    rows = rows.join(gold.select("case_id", "gold_no", F.coalesce("trigger_event_id", F.lit("unknown")).alias("want")), ["case_id", "gold_no"], "left")
    counts = rows.groupBy("case_id", "system").agg(
        F.count("*").alias("n_cards"), F.count_if(F.col("gold_no").isNotNull() & (F.col("said") == F.col("want"))).alias("trigger_correct"), F.count("gold_no").alias("trigger_scored"),
        F.count_if(F.col("gold_no").isNull()).alias("unmatched"), F.count_if(~F.col("ok")).alias("unsupported"), F.countDistinct("gold_no").alias("recall_hits"), F.count_if(F.col("type") != "none").alias("substantive"),
    )
    n_gold = gold.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    found = counts.join(n_gold, "case_id", "left").join(cases.select("case_id", "must_abstain"), "case_id", "left")
    return found.withColumn("n_gold", F.coalesce("n_gold", F.lit(0))).withColumn("abstain_correct", F.when(F.col("must_abstain"), F.col("substantive") == 0)).drop("substantive")


def score_systems(scores: DataFrame) -> DataFrame:
    """Pooled rates of each system: ratios of sums, null where nothing is counted."""

    def rate(a: str, b: str):
        return F.try_divide(F.sum(a), F.sum(b))

    return scores.groupBy("system").agg(
        F.count("*").alias("cases"), F.sum("n_cards").alias("cards"), rate("trigger_correct", "trigger_scored").alias("trigger_accuracy"), rate("unmatched", "n_cards").alias("unmatched_rate"), rate("unsupported", "n_cards").alias("unsupported_rate"),
        rate("recall_hits", "n_gold").alias("signal_recall"), F.count_if("abstain_correct").alias("abstention_correct"), F.count_if("must_abstain").alias("abstention_cases"),
    )


def mute_systems(scores: DataFrame) -> DataFrame:
    """Systems that gave no card in any case."""
    return scores.groupBy("system").agg(F.sum("n_cards").alias("n_cards")).where("n_cards = 0").select("system")


def pair_scores(labels: DataFrame, predicted: DataFrame, scope: list[str]) -> DataFrame:
    """Pair precision, recall and F1 of a grouping (scope, event_id, key) for each scope and pooled (null scope).

    labels: scope, event_id, intent; rows labelled unsure or not at all do not count. Pairs
    are counted from group sizes, never formed. Messages are joined and counted once, by a
    digest of their key; the three kinds of pairs come from these counts, which are stored.
    """
    said = predicted.select(*scope, "event_id", F.unhex(F.md5(F.col("key").cast("string"))).alias("key"))
    rows = labels.where("intent is not null and intent <> 'unsure'").join(said, [*scope, "event_id"], "left")
    rows = stored(rows.groupBy(*scope, "intent", "key").agg(F.count("*").alias("n")), "counts")
    pairs = F.col("n") * (F.col("n") - 1) / 2

    def total(df: DataFrame, by: list[str], name: str) -> DataFrame:
        return df.groupBy(*scope, *by).agg(F.sum("n").alias("n")).select(*scope, F.lit(name).alias("what"), pairs.alias("pairs"))

    grouped = rows.where("key is not null")
    all_pairs = total(grouped, ["intent", "key"], "tp").unionAll(total(grouped, ["key"], "said")).unionAll(total(rows, ["intent"], "true"))
    base = all_pairs.rollup(F.struct(*scope).alias("scope")).agg(*[F.sum(F.when(F.col("what") == w, F.col("pairs")).otherwise(0.0)).alias(w) for w in ("tp", "said", "true")])
    precision, recall = F.try_divide("tp", "said"), F.try_divide("tp", "true")
    return base.select(*[F.col(f"scope.{c}").alias(c) for c in scope], "tp", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), F.col("said") + F.col("true")).alias("f1"))


def score_arms(labels: DataFrame, arms: dict[str, DataFrame], scope: list[str]) -> DataFrame:
    """pair_scores of several groupings (scope, event_id, key) of the same labelled messages, by arm."""
    out = None
    for name, predicted in arms.items():
        rows = pair_scores(labels, predicted, scope).withColumn("arm", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def case_overlap(cases: DataFrame) -> DataFrame:
    """Overlapping case windows (case_id, fixture, start, end) of one capture, with the share of the shorter one."""
    minute = 60_000
    slots = cases.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / minute), F.floor(F.col("end") / minute))))
    other = slots.select("fixture", "slot", F.col("case_id").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"))
    both = slots.join(other, ["fixture", "slot"]).where("case_id < other and start < e and s < end").select("fixture", "case_id", "other", "start", "end", "s", "e").distinct()
    shared = F.least("end", "e") - F.greatest("start", "s")
    return both.select("fixture", "case_id", "other", F.try_divide(shared, F.least(F.col("end") - F.col("start"), F.col("e") - F.col("s"))).alias("share"))


def trigger_census(checked: DataFrame, events: DataFrame) -> DataFrame:
    """Cards of each channel by where their trigger lies (abstained, unknown, missing or an event type), and how many of them passed."""
    tid = F.coalesce("trigger.event_id", F.lit("unknown"))
    rows = checked.select("channel", "type", "ok", tid.alias("event_id")).join(events.select("channel", "event_id", F.col("type").alias("kind")), ["channel", "event_id"], "left")
    source = F.when(F.col("type") == "none", "abstained").when(F.col("event_id") == "unknown", "unknown").otherwise(F.coalesce("kind", F.lit("missing")))
    return rows.groupBy("channel", source.alias("source")).agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))


def trajectory_counts(runs: DataFrame) -> DataFrame:
    """Tool calls, model calls and gate results of runs (agent, trace_id, steps array<struct<kind, tool, ok>>), by agent."""

    def steps(kind: str):
        return F.size(F.filter("steps", lambda s: s["kind"] == kind))

    each = runs.select("agent", steps("tool").alias("tools"), steps("model").alias("models"), F.size(F.filter("steps", lambda s: (s["kind"] == "gate") & s["ok"])).alias("ok"), F.size(F.filter("steps", lambda s: (s["kind"] == "gate") & ~s["ok"])).alias("rejected"))
    return each.groupBy("agent").agg(F.count("*").alias("runs"), F.sum("tools").alias("tool_calls"), F.sum("models").alias("model_calls"), F.sum("ok").alias("gate_ok"), F.sum("rejected").alias("gate_rejected"))


def trigger_violations(checked: DataFrame, events: DataFrame, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """trigger_census() of several runs side by side (`by` may name a column of the run), with how often each code was broken."""
    tid = F.coalesce("trigger.event_id", F.lit("unknown"))
    kinds = events.select("channel", "event_id", F.col("type").alias("kind"))
    rows = checked.select(*by, *[c for c in ["channel"] if c not in by], "type", "ok", "violations", tid.alias("event_id")).join(kinds, ["channel", "event_id"], "left")
    source = F.when(F.col("type") == "none", "abstained").when(F.col("event_id") == "unknown", "unknown").otherwise(F.coalesce("kind", F.lit("missing")))
    rows = rows.withColumn("source", source)
    return rows.select(*by, "source", F.explode("violations").alias("code")).groupBy(*by, "source", "code").agg(F.count("*").alias("n"))


def run_budgets(runs: DataFrame) -> DataFrame:
    """By agent: runs, those that may call tools (they have max_steps), and their most frequent max_steps (the smallest of equally frequent ones; 0 without)."""
    counts = runs.groupBy("agent", "max_steps").agg(F.count("*").alias("n"))
    known = F.col("max_steps").isNotNull()
    most = F.min(F.when(known, F.struct((-F.col("n")).alias("less"), "max_steps")))
    return counts.groupBy("agent").agg(F.sum("n").alias("runs"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("tool_runs"), F.coalesce(most["max_steps"], F.lit(0)).alias("budget"))


def tool_calls(runs: DataFrame) -> DataFrame:
    """By agent: calls of each tool (what: tool), and the number of runs with so many calls (what: calls)."""
    tools = F.filter("steps", lambda s: s["kind"] == "tool")
    by_tool = runs.select("agent", F.explode(F.transform(tools, lambda s: s["tool"])).alias("value")).select("agent", F.lit("tool").alias("what"), "value")
    rows = by_tool.unionByName(runs.select("agent", F.lit("calls").alias("what"), F.size(tools).cast("string").alias("value")))
    return rows.groupBy("agent", "what", "value").agg(F.count("*").alias("n"))


def usage_ledger(calls: DataFrame) -> DataFrame:
    """Calls and tokens of a response cache (model, provider, prompt_tokens, completion_tokens) by model and provider."""
    return calls.groupBy("model", "provider").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def budget_state(calls: DataFrame, prices: DataFrame, cap_usd: float) -> DataFrame:
    """What each provider's calls (model, provider, prompt_tokens, completion_tokens) have cost by prices (model, prompt_usd, completion_usd a million tokens) against a cap.

    Columns: calls, unpriced (calls of a model without a price), spent_usd, remaining_usd, allowed. Estimates, not bills.
    """
    cost = (F.coalesce("prompt_tokens", F.lit(0)) * F.col("prompt_usd") + F.coalesce("completion_tokens", F.lit(0)) * F.col("completion_usd")) / 1e6
    rows = calls.join(prices, "model", "left").withColumn("usd", F.coalesce(cost, F.lit(0.0)))
    spent = rows.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if(F.col("prompt_usd").isNull()).alias("unpriced"), F.sum("usd").alias("spent"))
    return spent.select("provider", "calls", "unpriced", F.round("spent", 4).alias("spent_usd"), F.round(F.greatest(F.lit(0.0), cap_usd - F.col("spent")), 4).alias("remaining_usd"), (F.col("spent") < cap_usd).alias("allowed"))


def spanning_forest(cosines: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest of the graph whose edges are the cosines of threshold or more, by Prim's method on whole rows."""
    n = len(cosines)
    best, parent, waiting = np.full(n, -np.inf), np.full(n, -1), np.ones(n, bool)
    edges = []
    for _ in range(n):
        i = int(np.argmax(np.where(waiting, best, -np.inf)))
        if not waiting[i] or best[i] < threshold:
            i = int(np.argmax(waiting))  # the next tree's root
        else:
            edges.append((int(parent[i]), i))
        waiting[i] = False
        nearer = waiting & (cosines[i] > best)
        best[nearer], parent[nearer] = cosines[i][nearer], i
    return edges


def cluster_edges(vectors: DataFrame, scope: list[str], threshold: float, block: int = 1024, forest: bool = False) -> DataFrame:
    """Pairs (scope, a, b, cosine) of one scope's vectors (id, vector) with cosine of threshold or more.

    With forest, each task hands out a maximum spanning forest of its pairs alone: at every
    threshold from this one up, the forests' edges connect what all pairs connect, and a
    block of n vectors has fewer than n of them.

    A scope is cut into blocks and each task multiplies two of them, so none holds a whole
    scope; all of a scope's vectors are compared, as single-link clusters need. A zero
    vector is like nothing.
    """
    rows = vectors.select(*scope, "id", "vector")
    sizes = rows.groupBy(*scope).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    rows = rows.join(sizes, scope).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("at", o).alias("x"), F.greatest("at", o).alias("y"))))
    dealt = rows.withColumn("m", meets).select(*scope, "m.x", "m.y", "at", "id", "vector")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, y = int(group["x"].iloc[0]), int(group["y"].iloc[0])
        left, right = group[group["at"] == x], group[group["at"] == y]

        def unit(v: pd.Series) -> np.ndarray:
            m = np.stack(v.to_list()).astype(np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

        if not len(left) or not len(right):
            return group.iloc[:0][scope].assign(a=0, b=0, cosine=0.0)
        cosines = unit(left["vector"]) @ unit(right["vector"]).T
        if forest and x == y:
            np.fill_diagonal(cosines, -np.inf)
            pairs = spanning_forest(cosines, threshold)
        elif forest:
            n, m = cosines.shape
            both = np.full((n + m, n + m), -np.inf)
            both[:n, n:], both[n:, :n] = cosines, cosines.T
            pairs = [(min(p), max(p) - n) for p in spanning_forest(both, threshold)]
        i, j = np.array(pairs, int).reshape(-1, 2).T if forest else np.nonzero(cosines >= threshold)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = a != b if forest or x != y else a < b
        found = pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": cosines[i, j][keep]})
        for k, c in enumerate(scope):
            found.insert(k, c, group[c].iloc[0])
        return found

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*scope).schema)
    return dealt.groupBy(*scope, "x", "y").applyInPandas(compare, f"{kinds}, a long, b long, cosine double")


def arm_exact(chat: DataFrame, scope: list[str]) -> DataFrame:
    """A grouping by equal canonical texts; an empty one is a group of its own."""
    canon = T.canonical(F.col("text"))
    return chat.select(*scope, "event_id", F.when(canon != "", canon).otherwise(F.concat(F.lit("~"), F.col("event_id").cast("string"))).alias("key"))


def arm_token_prefix(chat: DataFrame, scope: list[str]) -> DataFrame:
    """The grouping by reaction, prefix and token; messages outside are groups of one, without a row."""
    return assigned(chat, scope).select(*scope, "event_id", "key")


def arm_embeddings(vectors: DataFrame, scope: list[str], thresholds: tuple[float, ...] = COSINES, rounds: int = 60) -> DataFrame:
    """threshold, scope, id, key: single-link clusters of each scope's vectors at every threshold; key is the smallest id.

    The clusters of all thresholds are cuts of maximum spanning forests, found once, so few
    edges are looked at again. Each round every vector takes the smallest label among its
    neighbours and then its label's own label; rounds are written out, so a lost executor
    costs one of them.
    """
    edges = cluster_edges(vectors, scope, min(thresholds), forest=True)
    each = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("cosine") >= t))
    edges = stored(edges.withColumn("threshold", each).select("threshold", *scope, "a", "b"), "edges")
    by = ["threshold", *scope]
    both = edges.unionAll(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    labels = vectors.select(*scope, F.col("id")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).select(*by, "id", F.col("id").alias("key"))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("id")).agg(F.min("key").alias("near"))
        found = labels.join(near, [*by, "id"], "left").select(*by, "id", "key", F.least("key", "near").alias("low"))
        own = found.select(*by, F.col("id").alias("low"), F.least("low", "key").alias("lower"))
        after = stored(found.join(own, [*by, "low"], "left").select(*by, "id", F.least("low", "lower").alias("key"), (F.least("low", "lower") < F.col("key")).alias("moved")), "labels")
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"clusters are not settled after {rounds} rounds")


def gold_selfcheck(gold: DataFrame, cases: DataFrame, events: DataFrame) -> DataFrame:
    """Gold signals as cards of their case's window through the gate: case_id, gold_no, ok, violations, trigger_is_chat.

    gold: case_id, gold_no, type, trigger_event_id, relevant_message_ids; cases: case_id, channel, start, end.
    """
    rows = gold.join(cases.select("case_id", "channel", "start", "end"), "case_id")
    trigger = F.struct(F.lit("speech").alias("kind"), F.col("trigger_event_id").alias("event_id"), F.lit(None).cast("string").alias("quote"))
    made = rows.select("channel", F.concat("case_id", F.lit("/"), F.col("gold_no").cast("string")).alias("signal_id"), "type", F.lit("").alias("title"), F.array("start", "end").alias("window_ms"), trigger.alias("trigger"), F.col("relevant_message_ids").alias("evidence"), F.lit(None).cast("map<string, double>").alias("distribution"), "case_id", "gold_no")
    checked = gate.check_cards(made, events)
    return checked.select("case_id", "gold_no", "ok", "violations", F.coalesce(F.col("trigger_event.type") == "chat_message", F.lit(False)).alias("trigger_is_chat"))
