"""What the reviewer's third round found: disk of the card queries, work of the ticks and arms."""

import os
import random
from collections import Counter

import pytest

from hubbub.operators import board, grouping, windows
from hubbub.plans import registry, store
from hubbub.sources.events import CHAT, SPEECH

EVENT = "channel string, event_id string, type string, ts_ms long, end_ms long, author string, text string, final boolean"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """A shared folder of its own."""
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


@pytest.mark.parametrize("name", ["check_card", "group_labels_prompt", "full_rail", "debrief_markdown", "rolling_groups", "score_arms"])
def test_events_are_not_stored(spark, shared, name):
    """Tables stored on the way hold groups, cards and keys, not the messages again."""
    registry.QUERIES[name](spark, SF).collect()
    assert not [t for t in os.listdir(shared) if "text" in spark.read.parquet(str(shared / t)).columns]


def test_tiles_move_no_text(spark):
    """Also where Spark does not know that channels are few."""
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = windows.tiled(registry._events(spark, SF))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_matched_trigger_by_brute_force(spark):
    """The last event that says the word: equal times, ids and types are told apart by text."""
    rng = random.Random(5)
    words = ["forest", "forge", "base", "castle", "river"]
    said = [("c", f"s{rng.randrange(4)}", SPEECH, rng.randrange(6) * 1000, None, " ".join(rng.sample(words, 2)) if k % 9 else None) for k in range(60)]
    chat = [("c", f"m{k:03}", CHAT, rng.randrange(6000), "a", rng.choice(words) + " " + rng.choice(words)) for k in range(40)]
    events = windows.tiled(spark.createDataFrame([(c, i, t, ts, ts, a, x, True) for c, i, t, ts, a, x in [*said, *chat]], EVENT))
    groups = registry.grouping.group_chat(events.where("type = 'chat_message'")).collect()
    told = {}
    for g in groups:
        word = g.key[2:]
        hits = [(r[3], r[2], r[1], r[5]) for r in said if r[5] and r[3] <= g.first_ts_ms and any(w == word if g.key[0] == "t" else w[:4] == word for w in r[5].split())]
        if hits:
            told[g.win, g.key] = max(hits)
    found = board.trigger_matched(spark.createDataFrame(groups), events.where("type <> 'chat_message'")).collect()
    assert {(r.win, r.key): (r.matched.ts_ms, r.matched.type, r.matched.event_id, r.matched.text) for r in found} == told and told


def test_blocks_drop_what_no_tick_groups(spark):
    """Words and prefixes too rare for any part of a block go before messages are copied; others keep them."""
    texts = ["forest walk", "forest run", "forest sit", "river", "base", "based", "LOL"] + ["castle"] * 4
    rows = spark.createDataFrame([("c", 0, f"m{k:02}", k, x) for k, x in enumerate(texts)], "channel string, block int, event_id string, ts_ms long, text string")
    canon = rows.withColumn("canon", grouping.T.canonical(grouping.F.col("text")))
    found = grouping.may_group(grouping.shape(grouping.dealt(canon, ["channel", "block"])), ["channel", "block"]).collect()
    assert Counter((r.text, r.reaction, r.head, tuple(r.tokens)) for r in found) == {
        ("forest walk", False, None, ("forest",)): 1, ("forest run", False, None, ("forest",)): 1, ("forest sit", False, None, ("forest",)): 1,
        ("LOL", True, None, ()): 1, ("castle", False, "cast", ("castle",)): 4,
    }
