"""Gate lookups, numbered users, captures with fields of their own, coordinated copies, links, windows without data, runs and budgets."""

import random
from collections import Counter

import duckdb
import pytest

from hubbub.operators import cards, context, evaluation, metrics, moderation, windows
from hubbub.plans import extra_queries
from hubbub.sources import parsing
from hubbub.sources.events import CHAT, SPEECH, read_captures

EVENT = "channel string, event_id string, type string, ts_ms long, end_ms long, author string, text string, final boolean"
CARD = "channel string, " + cards.CARD
SF = "/root/testdata/sf0.001"


def rows_of(spark, *rows):
    return spark.createDataFrame([(c, i, t, ts, ts, a, x, True) for c, i, t, ts, a, x in rows], EVENT)


def test_gate_needs_no_signal_id(spark):
    """Cards without an id, with one id in a channel, equal cards and events given twice."""
    happened = rows_of(spark, ("c", "tr", SPEECH, 1000, None, "which word"), ("c", "m1", CHAT, 2000, "a", "forest"), ("c", "m2", CHAT, 2100, "b", "base"), (None, "m9", CHAT, 2200, "b", "x"), ("c", "m1", CHAT, 2000, "a", "forest"))

    def card(signal, evidence, trigger="tr", channel="c", quote="which word"):
        return (channel, signal, "reaction", "t", [0, 5000], ("speech", trigger, quote), evidence, {"x": 1.0})

    made = [card(None, ["m1"]), card(None, ["ghost"]), card("s", ["m1", "m2"]), card("s", ["ghost", "m1"]), card("s", ["m1"], "ghost", quote=""), card("q", ["m1"]), card("q", ["m1"]), card("n", ["m9"], "unknown", None)]
    told = [[], ["E_UNKNOWN_MSG"], [], ["E_UNKNOWN_MSG"], ["E_UNKNOWN_TRIGGER"], [], [], []]
    checked = cards.check_cards(spark.createDataFrame(made, CARD), happened).collect()
    key = lambda channel, signal, evidence, trigger: (str(channel), str(signal), tuple(evidence), trigger)
    want = Counter((key(m[0], m[1], m[6], m[5][1]), tuple(v)) for m, v in zip(made, told))
    assert Counter((key(r.channel, r.signal_id, r.evidence, r.trigger.event_id), tuple(r.violations)) for r in checked) == want
    assert all(r.status == ("rejected" if r.violations else "verified") for r in checked)
    circular = [(*card(s, ["m1", "m2"], "m1", quote="")[:5], ("chat", "m1", ""), ["m1", "m2"], None) for s in (None, None, "z")]
    assert cards.gate_rescore(spark.createDataFrame([*circular, *made], CARD), happened).count() == 3


def test_users_are_numbered_once(spark):
    logins = spark.createDataFrame([(x,) for x in ["Bo", "al", "bo", None, "cy", "É"]], "login string")
    first = parsing.user_dimension(logins)
    assert {r.login: r.user_id for r in first.collect()} == {"al": 1, "bo": 2, "cy": 3, "é": 4}
    more = spark.createDataFrame([(f"u{k:03}",) for k in range(500)] + [("AL",)], "login string")
    second = parsing.user_dimension(more, first)
    ids = {r.login: r.user_id for r in second.collect()}
    assert ids["al"] == 1 and sorted(ids.values()) == list(range(1, 505)) and ids["u000"] == 5
    third = parsing.user_dimension(more, second)
    assert {r.login: r.user_id for r in third.collect()} == ids and third.count() == 504
    assert parsing.user_dimension(logins.where("false")).count() == 0


def test_captures_keep_other_fields(spark, tmp_path):
    (tmp_path / "ch").mkdir()
    (tmp_path / "ch" / "chat.jsonl").write_text('{"id": "m1", "ts_ms": 5, "author": "a", "text": "hi", "badges": {"sub": 3}, "color": "#f00", "reply": null}\n{"ts_ms": 6, "text": "yo"}\nnot json\n\n')
    (tmp_path / "ch" / "transcript.jsonl").write_text('{"ts_ms": 7, "text": "said", "extra": 1}\n')
    found = {r.ts_ms: r for r in read_captures(spark, str(tmp_path)).collect()}
    assert found[5].meta == {"badges": '{"sub":3}', "color": "#f00"} and found[6].meta == {} and found[7].meta is None and len(found) == 3


def test_coordinated_by_brute_force(spark):
    rng = random.Random(9)
    texts = ["this is a long enough text to count", "another text that is repeated by many", "short", "a text with many words said by few people"]
    rows = [(rng.choice("xy"), f"e{k:04}", CHAT, rng.randrange(0, 400) * 700, f"u{rng.randrange(5)}" if k % 3 else f"v{rng.randrange(60)}", texts[min(3, int(rng.expovariate(1)))]) for k in range(420)]
    told = []
    for channel in "xy":
        found = []
        for text in texts:
            posts = sorted((r[3], r[1], r[4]) for r in rows if r[0] == channel and r[5] == text)
            for start, _, _ in posts:
                seen = [p for p in posts if start <= p[0] <= start + 30_000]
                if len({p[2] for p in seen}) >= 4 and len(text) >= 20:
                    found.append((-len({p[2] for p in seen}), start, text, len(seen), [p[1] for p in seen]))
                    break
        told += [(channel, text, start, -n, count, k, ids) for k, (n, start, text, count, ids) in enumerate(sorted(found), 1)]
    got = moderation.coordinated(rows_of(spark, *rows)).collect()
    assert sorted((r.channel, r.key, r.first_ts_ms, r.authors, r["count"], r["rank"], r.event_ids) for r in got) == sorted(told) and len(told) >= 4


def test_links_have_ids_and_samples(spark):
    rows = [("c", f"m{k:02}", CHAT, k, f"u{k % 3}", f"see www.site.com/{k}") for k in range(20)] + [("c", "z", CHAT, 99, None, "also other.org"), ("c", "n", CHAT, 99, "a", None)]
    top, other = moderation.links(rows_of(spark, *rows)).orderBy("rank").collect()
    assert (top.host, top["count"], top.authors, top.event_ids, top.samples) == ("site.com", 20, 3, [f"m{k:02}" for k in range(12)], [f"see www.site.com/{k}" for k in range(3)])
    assert (other.host, other.event_ids) == ("other.org", ["z"])
    assert moderation.linked(rows_of(spark, *rows)).count() == 21


def test_windows_without_data(spark):
    rows = rows_of(spark, ("c", "a", CHAT, 1000, "u", "x"), ("c", "b", CHAT, 250_000, "u", "x"), (None, "b", CHAT, 5, "u", "x"))
    found = {(r.channel, r.window_s, r.end_ms): (r.msg_count, r.summary) for r in context.every_window(context.summary_counts(rows)).where("window_s = 60").collect()}
    none = (0, "no data in this window")
    assert found == {("c", 60, 60_000): (1, None), ("c", 60, 120_000): none, ("c", 60, 180_000): none, ("c", 60, 240_000): none, ("c", 60, 300_000): (1, None), (None, 60, 60_000): (1, None)}


def test_runs_and_budgets(spark):
    runs = spark.createDataFrame([("a", 3), ("a", 3), ("a", 2), ("a", 2), ("a", None), ("b", None)], "agent string, max_steps int")
    assert {tuple(r) for r in evaluation.run_budgets(runs).collect()} == {("a", 5, 4, 2), ("b", 1, 0, 0)}
    calls = spark.createDataFrame([("m", "p", 1_000_000, 0), ("m", "p", None, 500_000), ("x", "q", 5, 5)], "model string, provider string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("m", 1.0, 4.0)], "model string, prompt_usd double, completion_usd double")
    assert {tuple(r) for r in evaluation.budget_state(calls, prices, 3.0).collect()} == {("p", 2, 0, 3.0, 0.0, False), ("q", 1, 1, 0.0, 3.0, True)}


def test_full_rail_without_cards(spark):
    rows = rows_of(spark, ("c", "a", CHAT, 1000, "u", "LOL"), ("c", "b", CHAT, 1500, "u", "what game is this?"), ("c", "s", SPEECH, 61_500, None, "hi"))
    found = {r.win: (r.messages, r.groups, r.grouped, r.singletons, r.questions) for r in metrics.full_rail(windows.tiled(rows)).collect()}
    assert found == {1000: (2, 1, 1, 1, 1), 61_000: (0, 0, 0, 0, 0)}


@pytest.mark.parametrize("name", sorted(extra_queries.QUERIES))
def test_extra_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = extra_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = con.execute(extra_queries.ORACLE_SQL[name])
    at = [[d[0] for d in answer.description].index(c) for c in columns]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(plain(r[k]) for k in at) for r in answer.fetchall())


def test_clusters_by_spanning_forests(spark, monkeypatch):
    """Clusters at every threshold from forests of blocks equal those of all pairs."""
    rng = random.Random(12)
    vectors = [(w, k, [rng.gauss(0, 1) for _ in range(3)]) for w in "vw" for k in range(40)] + [("w", 99, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "win string, id long, vector array<double>")
    told = set()
    for t in (0.9, 0.97, 0.995):
        for w in "vw":
            own = {i: v for s, i, v in vectors if s == w}
            unit = {i: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v] for i, v in own.items()}
            label = {i: i for i in own}
            for _ in own:
                for a in own:
                    for b in own:
                        if a != b and sum(x * y for x, y in zip(unit[a], unit[b])) >= t:
                            label[a] = label[b] = min(label[a], label[b])
            told |= {(t, w, i, k) for i, k in label.items()}
    for block in (7, 1024):
        edges = evaluation.cluster_edges
        monkeypatch.setattr(evaluation, "cluster_edges", lambda *a, b=block, f=edges, **k: f(*a, block=b, **k))
        got = evaluation.arm_embeddings(df, ["win"], (0.9, 0.97, 0.995)).collect()
        monkeypatch.setattr(evaluation, "cluster_edges", edges)
        assert {(r.threshold, r.win, r.id, r.key) for r in got} == told
    assert evaluation.cluster_edges(df, ["win"], 0.9, 1024, forest=True).count() <= 78
