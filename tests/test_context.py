"""Parsing, questions, cards, scores and streams against hand-made cases."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hubbub.operators import cards, context, evaluation, questions, windows
from hubbub.sources import parsing
from hubbub.sources.events import CHAT, FRAME, SPEECH, load_meta, read_captures
from hubbub.streaming import feeds

EVENT = "channel string, event_id string, type string, ts_ms long, end_ms long, author string, text string, final boolean"
CARD = "channel string, " + cards.CARD


def events(spark, *rows):
    return spark.createDataFrame([("c", i, t, ts, ts + 500, None, x, True) for i, t, ts, x in rows], EVENT)


GATE = (("tr_1", SPEECH, 1000, "which word is it"), ("msg_1", CHAT, 2000, "forest"), ("msg_2", CHAT, 2100, "forest"), ("msg_3", CHAT, 9000, "base"), ("msg_4", CHAT, 5000, "edge"))


def codes(spark, kind, evidence, trigger=None, quote=None, version="reaction-v2", window=(0, 5000)):
    card = spark.createDataFrame([("c", "s", kind, "t", list(window), ("speech", trigger, quote), evidence, None)], CARD)
    return cards.check_cards(card, events(spark, *GATE), version).first().violations


def test_gate(spark):
    assert codes(spark, "reaction", ["msg_1"], "tr_1", "which word") == []
    assert codes(spark, "reaction", []) == ["E_NO_EVIDENCE"] and codes(spark, "reaction", None) == ["E_NO_EVIDENCE"]
    assert codes(spark, "reaction", ["ghost", "tr_1", "msg_4"]) == ["E_UNKNOWN_MSG", "E_EVIDENCE_NOT_A_MESSAGE", "E_MSG_OUT_WINDOW"]
    assert codes(spark, "reaction", ["msg_1"], "ghost") == ["E_UNKNOWN_TRIGGER"]
    assert codes(spark, "reaction", ["msg_1"], "unknown") == []
    assert codes(spark, "reaction", ["msg_1"], "msg_2") == ["E_TRIGGER_LATE"]
    assert codes(spark, "reaction", ["msg_1"], "tr_1", "nothing of the sort") == ["E_QUOTE_MISMATCH"]
    assert codes(spark, "reaction", ["msg_1", "msg_2"], "msg_1") == []
    assert codes(spark, "reaction", ["msg_1", "msg_2"], "msg_1", version="strict-v1") == ["E_CIRCULAR_EVIDENCE"]
    assert codes(spark, "audience_answer", ["msg_1", "msg_2"], "msg_1") == ["E_CIRCULAR_EVIDENCE"]
    assert codes(spark, "reaction", ["msg_1"], "msg_1") == ["E_CIRCULAR_EVIDENCE"]
    assert codes(spark, "none", ["msg_1"], "tr_1") == ["E_NONE_WITH_EVIDENCE", "E_NONE_WITH_TRIGGER"]
    assert codes(spark, "none", []) == []
    with pytest.raises(ValueError):
        codes(spark, "none", [], version="v9")


def test_cards_are_parsed_and_capped(spark):
    good = '{"cards": [{"signal_id": "a", "type": "reaction"}, 7, {"signal_id": "b", "type": "odd", "distribution": "one"}, {"type": "none"}]}'
    rows = cards.parse_cards(spark.createDataFrame([("c", good), ("e", "no json"), ("f", None)], "channel string, reply string"))
    assert {r.channel for r in rows.where("parse_error is not null").collect()} == {"e", "f"}
    assert [(r.signal_id, r.dropped) for r in cards.capped(rows, ["channel"], 1).collect()] == [("a", 1)]


def test_poll(spark):
    def draft(votes):
        return cards.poll_drafts(spark.createDataFrame([("c", "s", "audience_answer", "t", [0, 1], None, [], votes)], CARD)).collect()

    (row,) = draft({"b": 3.0, "a": 3.0, "c": 9.0})
    assert [(o.label, o.share) for o in row.options] == [("c", 0.6), ("a", 0.2), ("b", 0.2)] and row.question == "t"
    (row,) = draft({k: float(i + 1) for i, k in enumerate("abcdefg")})
    assert len(row.options) == 5 and "options left out: b, a" in row.warnings
    assert draft({"a": 1.0}) == [] and draft({"a": 0.0, "b": 0.0}) == [] and draft(None) == []


def test_parsing(spark):
    lines = ["@id=x;tmi-sent-ts=5;display-name=Bob;user-type= :bob!b@c PRIVMSG #ch :see: this", "PING :x", "@id=x;bad;tmi-sent-ts=5 :b!b@c PRIVMSG #ch :t", "@id=;tmi-sent-ts=5 :b!b@c PRIVMSG #ch :t", None]
    rows = parsing.parse_irc(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.event_id, r.ts_ms, r.login, r.text) for r in rows] == [("x", 5, "bob", "see: this")]
    words = [("c", 0, 0, 100, "a", "one"), ("c", 1, 200, 300, "a", "two"), ("c", 2, 350, 400, "b", "three"), ("c", 3, 450, 500, "a", "four"), ("c", 4, 3500, 3600, "a", "five")]
    segments = parsing.words_to_segments(spark.createDataFrame(words, "channel string, pos int, start_ms long, end_ms long, speaker string, word string"))
    assert [r.text for r in segments.orderBy("ts_ms").collect()] == ["one two", "three", "four", "five"]
    replies = ['{"results": {"utterances": [{"start": 1.0, "end": 2.0, "transcript": " hi  there ", "speaker": 0}]}}', '{"results": {"channels": [{"alternatives": [{"words": [{"word": "yo", "start": 0.5, "end": 0.7}]}]}]}}', "bad"]
    found = parsing.stt_segments(spark.createDataFrame([("c", 1000, r) for r in replies], "channel string, start_ms long, json string"))
    assert [(r.ts_ms, r.text) for r in found.orderBy("ts_ms").collect()] == [(1500, "yo"), (2000, "hi there")]
    frames = spark.createDataFrame([("/f/000002.jpg",), ("/f/000001.jpg",), ("/f/1756399998000.jpg",)], "path string")
    assert sorted(r.ts_ms for r in parsing.stamp_frames(frames.withColumn("folder", F.lit("/f/")), 100, 10).collect()) == [100, 10100, 1756399998000]
    captions = spark.createDataFrame([("The image shows a cat",), ("3/10",), (None,)], "t string").select(parsing.clean_caption_legacy(F.col("t")).alias("c"))
    assert [r.c for r in captions.collect()] == ["a cat", None, None]


def test_answers_need_two_shared_words_and_come_later(spark):
    asked = spark.createDataFrame([("c", "q", 1000, ["what game is coming tonight"])], "channel string, key string, ts_ms long, variants array<string>")
    speech = events(spark, ("s0", SPEECH, 900, "game coming"), ("s1", SPEECH, 2000, "a game"), ("s2", SPEECH, 3000, "the game coming soon"), ("s3", SPEECH, 130_000, "game coming"))
    assert [(r.answer_id, r.shared) for r in questions.answered_by(asked, speech).collect()] == [("s2", ["coming", "game"])]
    assert questions.answered_by(asked, speech, as_of=3100).count() == 0


def test_tiles_and_windows(spark):
    spans = spark.createDataFrame([("a", 1000, 4000), ("b", 0, 2500), ("c", 500, 500)], "channel string, start long, end long")
    tiles = {(r.channel, r.lo, r.hi) for r in questions.tile_cli(spans, 1000).collect()}
    assert len(tiles) == 7 and ("b", 2000, 2500) in tiles and ("c", 500, 1500) in tiles
    with pytest.raises(ValueError):
        questions.tile_cli(spans, 0)
    with pytest.raises(ValueError):
        context.bounded_window(events(spark), CHAT, 0, 180_001)
    assert context.visible_context(events(spark, ("f", FRAME, 1, " "), ("s", SPEECH, 1, "x" * 300)).withColumn("win", F.lit(0))).first().text == "x" * 239 + "…"


def test_interim_rows_go(spark):
    rows = events(spark, ("a", SPEECH, 1000, "part"), ("b", SPEECH, 900, "whole")).withColumn("final", F.col("event_id") == "b").withColumn("arrival", F.when(F.col("event_id") == "b", 2).otherwise(1))
    assert [r.event_id for r in context.interim_replacement(rows).collect()] == ["b"]


def test_scores(spark):
    labels = spark.createDataFrame([("w", i, x) for i, x in enumerate(["a", "a", "b", "unsure"])], "win string, event_id long, intent string")
    one = spark.createDataFrame([("w", i, "k") for i in range(4)], "win string, event_id long, key string")
    pooled = evaluation.pair_scores(labels, one, ["win"]).where("win is null").first()
    assert (pooled.tp, round(pooled.precision, 3), pooled.recall) == (1.0, 0.333, 1.0)
    made = spark.createDataFrame([("k", "s", f"s{i}", "reaction", ["m1", "m2"], True, ("x", "t1", None)) for i in (1, 2)], "case_id string, system string, signal_id string, type string, evidence array<string>, ok boolean, trigger struct<kind: string, event_id: string, quote: string>")
    gold = spark.createDataFrame([("k", 1, "reaction", "t1", ["m1"])], "case_id string, gold_no int, type string, trigger_event_id string, relevant_message_ids array<string>")
    scored = evaluation.score_cases(made, gold, spark.createDataFrame([("k", False)], "case_id string, must_abstain boolean")).first()
    assert (scored.n_cards, scored.trigger_correct, scored.unmatched, scored.recall_hits) == (2, 1, 1, 1)
    vectors = spark.createDataFrame([("w", 1, [1.0, 0.0]), ("w", 2, [0.99, 0.14]), ("w", 3, [0.0, 1.0]), ("w", 4, [0.0, 0.0])], "win string, id long, vector array<double>")
    for block in (1, 2, 100):
        assert [(r.a, r.b) for r in evaluation.cluster_edges(vectors, ["win"], 0.9, block).collect()] == [(1, 2)]


def test_streams_equal_batches(spark, tmp_path):
    rows = events(spark, ("a", CHAT, 1000, "x"), ("b", CHAT, 61_000, "y"), ("a", CHAT, 1000, "x"))
    rows.write.parquet(str(tmp_path / "in"))
    for name, make, mode in (("dedupe", feeds.stream_dedupe, "append"), ("counts", feeds.tumbling_counts, "complete"), ("new", feeds.stream_new_chatters, "append")):
        query = make(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(60)
    assert spark.table("dedupe").count() == 2 and spark.table("new").count() == 1
    assert {r.win for r in spark.table("counts").collect()} == {0, 60_000}
    folder = str(tmp_path / "up")
    write = feeds.upsert_batches(folder, ["channel"])
    for number in (0, 1, 1):
        write(rows.select("channel", F.lit(number).alias("n")), number)
    assert [r.n for r in feeds.latest(spark.read.parquet(folder).select("channel", "n", "version"), ["channel"]).collect()] == [1]


def _stream(spark, tmp_path, name, rows, make, mode="append"):
    rows.write.parquet(str(tmp_path / name))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
    query = make(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_of_words(spark, tmp_path):
    words = [("c", 0, 0, 100, "a", "one"), ("c", 1, 200, 300, "a", "two"), ("c", 2, 350, 400, "b", "three"), ("c", 3, 450, 500, "a", "four"), ("c", 4, 3500, 3600, "a", "five"), ("d", 0, 90_000, 90_100, "a", "late")]
    words = [(c, k, a + 1000, b + 1000, s, w) for c, k, a, b, s, w in words]  # a stream's watermark starts at 0
    rows = spark.createDataFrame(words, "channel string, pos int, start_ms long, end_ms long, speaker string, word string")
    found = _stream(spark, tmp_path, "segments", rows, feeds.stream_words_to_segments)
    batch = parsing.words_to_segments(rows).where("channel = 'c'").collect()
    assert sorted((r.ts_ms, r.end_ms, r.text, r.speaker) for r in found if r.channel == "c") == sorted((r.ts_ms, r.end_ms, r.text, r.speaker) for r in batch)


class FakeState:
    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_timers():
    state, frame = FakeState(), lambda *ids: iter([pd.DataFrame({"ts_ms": range(len(ids)), "event_id": list(ids), "type": ["chat_message"] * len(ids)})])
    rows = lambda *a: [tuple(r[1:]) for r in pd.concat(list(feeds.flush_messages(("c",), *a))).itertuples(index=False)]
    assert rows(frame("a", "b"), state) == [] and state.timeout == 1000
    assert rows(frame("c", "d"), state) == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c")]
    state.hasTimedOut = True
    assert rows(iter([]), state) == [(1, 1, "d")] and state.value == (2, [])
    for spoken, after in ((False, ["quiet"]), (True, None)):
        state, joined = FakeState(), iter([pd.DataFrame({"type": ["chat_message" if spoken else "join"]})])
        assert len(pd.concat(list(feeds.note_quiet(("c",), joined, state)))) == 0 and (state.timeout == 12_000) is not spoken
        if after:
            state.hasTimedOut = True
            assert list(next(feeds.note_quiet(("c",), iter([]), state))["status"]) == after and state.value == (True,)


def test_appended_counts_and_forgetful_chatters(spark, tmp_path):
    rows = events(spark, ("a", CHAT, 1000, "x"), ("b", CHAT, 61_000, "y"), ("c", CHAT, 400_000, "z"))
    assert {(r.win, r.n) for r in _stream(spark, tmp_path, "appended", rows, feeds.tumbling_counts)} == {(0, 1), (60_000, 1)}
    ticks = {(r.tick, r.n) for r in _stream(spark, tmp_path, "ticks", rows, feeds.sliding_counts)}
    assert {t for t, _ in ticks} == {*range(2000, 61_001, 2000), *range(62_000, 121_001, 2000)} and {n for _, n in ticks} == {1}


def test_captures(spark, tmp_path):
    (tmp_path / "cap" / "ch").mkdir(parents=True)
    (tmp_path / "cap" / "other").mkdir()
    (tmp_path / "cap" / "ch" / "chat.jsonl").write_text('{"id": "m1", "ts_ms": 5, "author": "a", "text": "hi"}\n\n{"ts_ms": 6, "text": "yo"}\n')
    (tmp_path / "cap" / "ch" / "transcript.jsonl").write_text('{"ts_ms": 7, "text": "said"}\n')
    (tmp_path / "cap" / "ch" / "meta.json").write_text('{"channel": "c",\n "enriched": true, "duration_s": 9.5}')
    found = {r.event_id: r for r in read_captures(spark, str(tmp_path / "cap")).collect()}
    assert len(found) == 3 and found["m1"].channel == "ch" and {r.type for r in found.values()} == {CHAT, SPEECH}
    assert all(r.end_ms == r.ts_ms and r.final for r in found.values())
    (meta,) = load_meta(spark, str(tmp_path / "cap")).collect()
    assert (meta.fixture_id, meta.channel, meta.enriched, meta.duration_s, meta.provenance) == ("ch", "c", True, 9.5, None)


def test_debrief_documents(spark):
    rows = [("c", "s1", "reaction", "wave", [0, 5000], ("speech", "tr_1", "which word"), ["msg_1", "msg_2"], {"forest": 3.0, "base": 1.0}), ("c", "s2", "warning", None, [0, 5000], None, ["msg_1"], None)]
    made, happened = spark.createDataFrame(rows, CARD), events(spark, *GATE)
    sections = cards.debrief_sections(made, happened)
    texts = {r.channel: r.document for r in cards.debrief_markdown(sections, cards.recurring_themes(made, min_cards=1), spark.createDataFrame([("c",), ("quiet",)], "channel string")).collect()}
    assert "## Reaction waves\n### `00:00:00` wave\n- **base** 1 (25%) · **forest** 3 (75%)\n- Cause (speech `tr_1`): “which word”\n- Evidence: 2 messages (`msg_1`, `msg_2`)" in texts["c"]
    assert "## Audience answers\n_Nothing in this run._" in texts["c"] and "warning *(window start)*\n- Cause: **not established**" in texts["c"] and "| forest | 1 |" in texts["c"]
    assert "## No verified signals" in texts["quiet"]


def test_mute_systems_and_masked_exports(spark):
    scores = spark.createDataFrame([("a", "x", 0), ("b", "x", 0), ("a", "y", 0), ("b", "y", 2)], "case_id string, system string, n_cards int")
    assert [r.system for r in evaluation.mute_systems(scores).collect()] == ["x"]
    rows = spark.createDataFrame([("me", "said", ("speech", "t1", "word", "me"))], "author string, text string, trigger struct<kind: string, event_id: string, quote: string, author: string>")
    masked = cards.mask_export(rows)
    assert masked.columns == ["text", "trigger"] and masked.first().asDict(True) == {"text": "[withheld]", "trigger": {"kind": "speech", "event_id": "t1", "quote": "[withheld]"}}


def test_slices_are_half_open(spark):
    asked = spark.createDataFrame([("c", 1000, 2000), ("c", 2000, 70_000), ("c", 5, 5), ("d", 0, 10**6)], "channel string, start long, end long")
    rows = windows.slices(events(spark, ("a", CHAT, 999, "x"), ("b", CHAT, 1000, "x"), ("d", CHAT, 2000, "x"), ("e", CHAT, 69_999, "x"), ("f", CHAT, 70_000, "x")), asked)
    assert sorted((r.start, r.event_id) for r in rows.collect()) == [(1000, "b"), (2000, "d"), (2000, "e")]
