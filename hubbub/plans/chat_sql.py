"""DuckDB SQL for the queries over canonical texts: the same results by other means.

DuckDB's patterns have no back-references, so repeats are found by comparing characters at
fixed distances and are cut in the order in which a scan from the left meets them.
"""

from __future__ import annotations

from ..functions import fixed
from ..sources import events as E

EVENTS = f"ev AS ({E.DUCKDB_VIEW}), tiled AS (SELECT *, origin + (ts_ms - origin) // 60000 * 60000 AS win FROM (SELECT *, min(ts_ms) OVER (PARTITION BY channel) AS origin FROM ev))"


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}"
_HITS = ", ".join(f"sum(CAST(c = c{u} AS INTEGER)) OVER (PARTITION BY i ORDER BY pos ROWS BETWEEN CURRENT ROW AND {2 * u - 1} FOLLOWING) AS h{u}, min(CASE WHEN c = c{u} THEN NULL ELSE pos END) OVER (PARTITION BY i ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos AS r{u}" for u in (2, 3, 4))
#: canon_of(text, canon) for every text of ev. The tables hold no character whose NFKC form differs and but one, ß, that folds to more than its lower case.
CANON = (
    rf"c_texts AS (SELECT row_number() OVER () AS i, text, regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\p{{P}}', ' ', 'g'), '[\s\x0b\x85\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM (SELECT DISTINCT text FROM ev)), "
    "c_all AS (SELECT i, unnest(string_split(t, '')) AS c, unnest(range(len(t))) AS pos FROM c_texts), "
    "c_two AS (SELECT i, c, row_number() OVER (PARTITION BY i ORDER BY pos) AS pos FROM (SELECT *, lag(c, 1) OVER w AS b1, lag(c, 2) OVER w AS b2 FROM c_all WINDOW w AS (PARTITION BY i ORDER BY pos)) WHERE NOT coalesce(c = b1 AND c = b2, false)), "
    f"c_hit AS (SELECT i, pos, {_HITS} FROM (SELECT *, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3, lead(c, 4) OVER w AS c4 FROM c_two WINDOW w AS (PARTITION BY i ORDER BY pos))), "
    "c_cut AS (SELECT i, pos, u, pos + u * (1 + r // u) AS after FROM (SELECT i, pos, CASE WHEN h2 = 4 THEN 2 WHEN h3 = 6 THEN 3 ELSE 4 END AS u, CASE WHEN h2 = 4 THEN r2 WHEN h3 = 6 THEN r3 ELSE r4 END AS r FROM c_hit WHERE h2 = 4 OR h3 = 6 OR h4 = 8)), "
    "c_next AS (SELECT a.*, b.pos AS then_pos FROM c_cut a ASOF LEFT JOIN c_cut b ON a.i = b.i AND a.after <= b.pos), "
    "c_scan AS (SELECT i, min(pos) AS pos FROM c_cut GROUP BY i UNION ALL SELECT n.i, n.then_pos FROM c_scan s JOIN c_next n ON n.i = s.i AND n.pos = s.pos WHERE n.then_pos IS NOT NULL), "
    "c_gone AS (SELECT n.i, unnest(range(n.pos + 2 * u, after)) AS pos FROM c_scan s JOIN c_next n ON n.i = s.i AND n.pos = s.pos), "
    "c_three AS (SELECT i, string_agg(c, '' ORDER BY pos) AS t FROM c_two ANTI JOIN c_gone USING (i, pos) GROUP BY i), "
    rf"c_parts AS (SELECT i, regexp_extract_all(t, '[{_WORD}]+|[^{_WORD}]+') AS s FROM c_three), "
    "c_last AS (SELECT i, array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda k: NOT (coalesce(s[k] = s[k - 2] AND s[k - 1] = ' ' AND k > 2, false) OR coalesce(s[k] = ' ' AND s[k + 1] = s[k - 1] AND k > 1, false))), lambda k: s[k]), '') AS canon FROM c_parts), "
    "canon_of AS (SELECT text, coalesce(canon, '') AS canon FROM c_texts LEFT JOIN c_last USING (i)), "
    f"tokens_of AS (SELECT text, list_filter(string_split(canon, ' '), lambda w: len(w) >= 3 AND w NOT IN ({_list(fixed.STOPWORDS)})) AS tokens FROM canon_of)"
)
TEXTS = f"WITH RECURSIVE {EVENTS}, {CANON}"
_REACTION = f"(canon NOT IN ('', '∅') AND (regexp_matches(replace(canon, ' ', ''), '{fixed.LAUGHTER}') OR NOT regexp_matches(canon, '{fixed.WORDISH}')))"


def grouped(rows: str, scope: str, p: str, samples: int = 3) -> str:
    """CTEs {p}assigned(scope, event_id, key) and {p}groups over rows (scope, event_id, ts_ms, text)."""
    j = f"USING ({scope}, "
    return (
        f"{p}r AS (SELECT r.*, canon, tokens, {_REACTION} AS reaction, CASE WHEN NOT {_REACTION} AND NOT contains(canon, ' ') AND len(canon) >= 4 AND regexp_matches(canon, '{fixed.WORDISH}') THEN concat('p:', substring(canon, 1, 4)) END AS prefix FROM {rows} r JOIN canon_of c ON c.text IS NOT DISTINCT FROM r.text JOIN tokens_of k ON k.text IS NOT DISTINCT FROM r.text), "
        f"{p}a AS (SELECT *, CASE WHEN reaction THEN '∎reaction' WHEN prefix IS NOT NULL AND count(*) OVER (PARTITION BY {scope}, prefix) >= 4 THEN prefix END AS own FROM {p}r), "
        f"{p}t AS (SELECT {scope}, event_id, unnest(list_distinct(tokens)) AS token FROM {p}a WHERE own IS NULL), "
        f"{p}c AS (SELECT *, count(*) OVER (PARTITION BY {scope}, token) AS n FROM {p}t), "
        f"{p}f AS (SELECT {scope}, event_id, own AS key FROM {p}a WHERE own IS NOT NULL UNION ALL SELECT {scope}, event_id, concat('t:', (min((-n, token)))[2]) FROM {p}c WHERE n >= 3 GROUP BY {scope}, event_id), "
        f"{p}s AS (SELECT {scope}, key, count(*) AS n FROM {p}f GROUP BY ALL), "
        f"{p}h AS (SELECT {scope}, concat('p:', substring(key, 3, 4)) AS key, (min((-n, key)))[2] AS target FROM {p}s WHERE key LIKE 't:%' GROUP BY ALL), "
        f"{p}m AS (SELECT {scope}, event_id, coalesce(target, key) AS key FROM {p}f LEFT JOIN {p}h {j}key)), "
        f"{p}assigned AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY {scope}, key) AS n FROM {p}m) WHERE n >= CASE WHEN key LIKE 'p:%' THEN 4 WHEN key LIKE 't:%' THEN 3 ELSE 1 END), "
        f"{p}x AS (SELECT * FROM {p}r JOIN {p}assigned {j}event_id)), "
        f"{p}v AS (SELECT {scope}, key, text, min((ts_ms, event_id)) AS seen FROM {p}x GROUP BY ALL), "
        f"{p}y AS (SELECT {scope}, key, list(text ORDER BY seen) [1:{samples}] AS samples FROM {p}v GROUP BY ALL), "
        f"{p}groups AS (SELECT {scope}, key, count(*) AS count, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms, any_value(samples) AS samples, CASE WHEN key = '∎reaction' THEN 'reaction' WHEN key LIKE 'p:%' THEN 'prefix' ELSE 'token' END AS rule, "
        f"CASE WHEN key = '∎reaction' THEN 'reaction wave' WHEN key LIKE 'p:%' THEN concat(substring(key, 3), '…') ELSE substring(key, 3) END AS label FROM {p}x JOIN {p}y {j}key) GROUP BY ALL)"
    )


SCOPE = "channel, win"
CHATS = f"{TEXTS}, chats AS (SELECT channel, win, event_id, ts_ms, author, text FROM tiled WHERE type = 'chat_message')"
GROUPS = f"{CHATS}, {grouped('chats', SCOPE, 'g_')}"


_SAMPLES = "array_to_string(samples, chr(10)) AS samples"
#: Groups with the last event of their window that precedes them (p) or that says their word (m).
ATTRIBUTED = (
    f"{GROUPS}, ctx AS (SELECT t.channel, t.win, ts_ms, type, event_id, t.text, tokens FROM tiled t JOIN tokens_of k ON k.text IS NOT DISTINCT FROM t.text WHERE type <> 'chat_message'), "
    "near AS (SELECT g.channel, g.win, g.key, max((c.ts_ms, c.type, c.event_id, c.text)) AS p, max((c.ts_ms, c.type, c.event_id, c.text)) FILTER (CASE WHEN key LIKE 't:%' THEN list_contains(tokens, substring(key, 3)) WHEN key LIKE 'p:%' THEN list_contains(list_transform(tokens, lambda w: substring(w, 1, 4)), substring(key, 3)) ELSE false END) AS m "
    "FROM g_groups g JOIN ctx c ON c.channel = g.channel AND c.win = g.win AND c.ts_ms <= g.first_ts_ms GROUP BY ALL), "
    "att AS (SELECT g.*, coalesce(m, p) AS trigger, CASE WHEN m IS NOT NULL THEN 'matched' WHEN p IS NOT NULL THEN 'preceding' END AS link FROM g_groups g LEFT JOIN near USING (channel, win, key)), "
    "merged AS (SELECT channel, win, trigger[3] AS trigger_id, min(trigger[1]) AS trigger_ts_ms, max(CAST(link = 'matched' AS INTEGER)) AS m, sum(count) AS count, count(*) AS groups, min((-count, first_ts_ms, key)) AS lead FROM att WHERE trigger IS NOT NULL GROUP BY ALL), "
    "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel, win ORDER BY m DESC, count DESC, lead[2], lead) AS INTEGER) AS rank FROM merged)"
)
_TILES = "every AS (SELECT channel, unnest(range(min(win), max(win) + 1, 60000)) AS win FROM tiled GROUP BY channel)"
_RAIL = (
    "r_n AS (SELECT channel, win, count(*) FILTER (type = 'chat_message') AS messages, count(*) FILTER (type = 'transcript_segment') AS speech_segments, count(*) FILTER (type = 'frame_caption') AS frame_captions FROM tiled GROUP BY ALL), "
    f"r_w AS (SELECT channel, win, count(*) AS reaction_wave FROM chats JOIN canon_of USING (text) WHERE {_REACTION} GROUP BY ALL), "
    "r_b AS (SELECT channel, win, greatest(least((ts_ms - win) // 10000, 5), 0) AS b, count(*) AS n FROM chats GROUP BY ALL), r_r AS (SELECT channel, win, [coalesce(sum(n) FILTER (b = 0), 0), coalesce(sum(n) FILTER (b = 1), 0), coalesce(sum(n) FILTER (b = 2), 0), coalesce(sum(n) FILTER (b = 3), 0), coalesce(sum(n) FILTER (b = 4), 0), coalesce(sum(n) FILTER (b = 5), 0)] AS rate FROM r_b GROUP BY ALL), "
    "r_a AS (SELECT channel, win, coalesce(author, '') AS author, count(*) AS n FROM chats GROUP BY ALL), r_k AS (SELECT *, row_number() OVER (PARTITION BY channel, win ORDER BY n DESC, author) AS k, count(*) OVER (PARTITION BY channel, win) AS m FROM r_a), "
    "r_c AS (SELECT channel, win, max(m) AS unique_chatters, round_even(sum(CASE WHEN k <= greatest(1, floor(m * 0.1)) THEN n ELSE 0 END) / sum(n), 3) AS concentration FROM r_k GROUP BY ALL), "
    "r_f AS (SELECT channel, author, min(win) AS win FROM r_a GROUP BY ALL), r_u AS (SELECT channel, win, count(*) AS new_chatters FROM r_f GROUP BY ALL)"
)
#: Long texts that four authors post within 30 s of a post: the first such post.
_COPIES = (
    "l AS (SELECT channel, event_id, ts_ms, coalesce(author, '') AS author, canon AS key FROM chats JOIN canon_of USING (text) WHERE len(canon) >= 20 AND len(list_filter(string_split(canon, ' '), lambda w: w <> '')) >= 4), "
    "many AS (SELECT channel, key FROM l GROUP BY ALL HAVING count(DISTINCT author) >= 4), ll AS (SELECT l.* FROM l JOIN many USING (channel, key)), "
    "starts AS (SELECT a.channel, a.key, a.ts_ms, count(DISTINCT b.author) AS authors, count(DISTINCT b.event_id) AS count, list(DISTINCT (b.ts_ms, b.event_id)) AS ids FROM ll a JOIN ll b ON a.channel = b.channel AND a.key = b.key AND b.ts_ms BETWEEN a.ts_ms AND a.ts_ms + 30000 GROUP BY ALL HAVING count(DISTINCT b.author) >= 4), "
    "first AS (SELECT channel, key, min((ts_ms, authors, count, ids)) AS s FROM starts GROUP BY ALL), "
    "coord AS (SELECT channel, key, s[1] AS first_ts_ms, CAST(s[2] AS INTEGER) AS authors, s[3] AS count, array_to_string(list_transform(list_sort(s[4]), lambda x: x[2]), ',') AS event_ids, CAST(row_number() OVER (PARTITION BY channel ORDER BY s[2] DESC, s[1], key) AS INTEGER) AS rank FROM first QUALIFY row_number() OVER (PARTITION BY channel ORDER BY s[2] DESC, s[1], key) <= 5)"
)
_HOST = "regexp_replace(lower(regexp_extract(text, '" + fixed.LINK + "', 1)), '^www\\.', '')"
_WH, _AUX = _list(fixed.WH_WORDS), _list(fixed.AUX_WORDS)
_ASKS = (
    "(regexp_matches(text, '\\?[\\s\\p{Z}]*$') OR list_has_any(list_filter(string_split(canon, ' '), lambda w: w <> '') [1:2], [" + _WH + "]) OR coalesce(list_contains([" + _AUX + "], list_filter(string_split(canon, ' '), lambda w: w <> '') [1]), false)) AND len(tokens) > 0"
)
_ASKED = f"{CHATS}, q_rows AS (SELECT channel, event_id, ts_ms, author, text FROM chats JOIN canon_of USING (text) JOIN tokens_of USING (text) WHERE {_ASKS}), {grouped('q_rows', 'channel', 'q_')}"
QUESTIONS = (
    f"{_ASKED}, q_all AS (SELECT channel, key, count, first_ts_ms AS ts_ms, samples AS variants FROM q_groups UNION ALL SELECT channel, concat('q:', event_id), 1, ts_ms, [text] FROM q_rows ANTI JOIN q_assigned USING (channel, event_id)), "
    "asked AS (SELECT *, variants[1] AS text, CAST(row_number() OVER (PARTITION BY channel ORDER BY count DESC, ts_ms, variants[1], key) AS INTEGER) AS rank FROM q_all)"
)
_ANSWERS = (
    "said AS (SELECT channel, ts_ms, event_id, tokens FROM tiled JOIN tokens_of USING (text) WHERE type = 'transcript_segment'), "
    "v AS (SELECT channel, key, ts_ms, unnest(variants) AS text FROM asked), vt AS (SELECT channel, key, ts_ms, list_distinct(flatten(list(tokens))) AS tokens FROM v JOIN tokens_of USING (text) GROUP BY ALL), "
    "hit AS (SELECT vt.channel, vt.key, s.ts_ms, s.event_id, list_sort(list_intersect(vt.tokens, s.tokens)) AS shared FROM vt JOIN said s ON s.channel = vt.channel AND s.ts_ms >= vt.ts_ms + 1 AND s.ts_ms < vt.ts_ms + 120000 AND len(list_intersect(vt.tokens, s.tokens)) >= 2), "
    "ans AS (SELECT channel, key, min((ts_ms, event_id, shared)) AS a FROM hit GROUP BY ALL)"
)
_TICKS = (
    f"{TEXTS}, chats AS (SELECT channel, event_id, ts_ms, text FROM ev WHERE type = 'chat_message'), o AS (SELECT channel, min(ts_ms) AS origin FROM chats GROUP BY ALL), "
    "t_rows AS (SELECT channel, origin + 2000 * unnest(range(greatest(1, (ts_ms - origin + 1999) // 2000), greatest(1, (ts_ms - origin + 61999) // 2000))) AS tick, event_id, ts_ms, text FROM chats JOIN o USING (channel)), "
    f"{grouped('t_rows', 'channel, tick', 't_', 2)}, t_top AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel, tick ORDER BY count DESC, first_ts_ms, key) AS INTEGER) AS rank FROM t_groups QUALIFY rank <= 5)"
)

#: The cards that context_queries makes: one for each group with a trigger, and what one digit of their id's hash breaks.
_KIND = "CASE WHEN m IN ('0', '6') THEN 'reaction' WHEN m = '4' THEN 'none' WHEN key = '∎reaction' THEN 'reaction' ELSE 'audience_answer' END"
CARDS = (
    f"{ATTRIBUTED}, ids AS (SELECT channel, win, key, list(event_id ORDER BY ts_ms, event_id) [1:6] AS evidence FROM g_x GROUP BY ALL), "
    "made AS (SELECT *, concat(channel, '/', win, '/', key) AS signal_id, substring(md5(concat(channel, '/', win, '/', key)), 1, 1) AS m FROM att JOIN ids USING (channel, win, key) WHERE trigger IS NOT NULL), "
    f"cards AS (SELECT channel, win, key, signal_id, {_KIND} AS type, label AS title, CASE WHEN m = '7' THEN win - 60000 ELSE win END AS lo, CASE WHEN m = '7' THEN win ELSE win + 60000 END AS hi, "
    "CASE m WHEN '2' THEN 'ghost' WHEN '9' THEN 'unknown' WHEN '6' THEN evidence[1] WHEN 'a' THEN evidence[len(evidence)] ELSE trigger[3] END AS tid, trigger[2] AS kind, CASE WHEN m = '3' THEN 'nothing of the sort was said' WHEN m = '6' THEN '' ELSE substring(trigger[4], 1, 40) END AS quote, "
    "CASE m WHEN '1' THEN list_append(evidence, 'ghost') WHEN '5' THEN [] WHEN '8' THEN list_append(evidence, trigger[3]) ELSE evidence END AS evidence, samples, count FROM made), "
    "cite AS (SELECT signal_id, unnest(evidence) AS id, unnest(range(len(evidence))) AS place FROM cards), "
    "ev1 AS (SELECT channel, event_id, type, ts_ms, text FROM tiled), "
    "cited AS (SELECT c.signal_id, c.channel, i.id, i.place, e.type AS etype, e.ts_ms, CASE WHEN e.type IS NULL THEN 'E_UNKNOWN_MSG' WHEN e.type <> 'chat_message' THEN 'E_EVIDENCE_NOT_A_MESSAGE' WHEN e.ts_ms < lo OR e.ts_ms >= hi THEN 'E_MSG_OUT_WINDOW' END AS code FROM cards c JOIN cite i USING (signal_id) LEFT JOIN ev1 e ON e.channel = c.channel AND e.event_id = i.id), "
    "sums AS (SELECT c.signal_id, list(code ORDER BY place) FILTER (code IS NOT NULL) AS codes, min(i.ts_ms) FILTER (etype = 'chat_message') AS earliest FROM cards c JOIN cited i USING (signal_id) GROUP BY ALL), "
    "trig AS (SELECT c.*, e.type AS ttype, e.ts_ms AS tts, e.text AS ttext FROM cards c LEFT JOIN ev1 e ON e.channel = c.channel AND e.event_id = c.tid AND c.tid <> 'unknown'), "
    "others AS (SELECT t.signal_id, count(*) AS n, bool_and(coalesce(etype = 'chat_message' AND i.ts_ms > tts, false)) AS later FROM trig t JOIN cited i USING (signal_id) WHERE i.id <> t.tid GROUP BY ALL), "
    + "quoted AS (SELECT *, " + ", ".join(rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\s\x0b\x85\p{{Z}}]', ' ', 'g'), '[\s\x0b\x85\p{{Z}}]+', ' ', 'g')) AS {n}" for c, n in (("quote", "q"), ("ttext", "x"))) + " FROM trig), "
    "rules AS (SELECT u.*, coalesce(codes, []) AS codes, tid <> 'unknown' AS has, coalesce(list_contains(evidence, tid), false) AND tid <> 'unknown' AS circular, type = 'reaction' AND coalesce(ttype = 'chat_message', false) AND coalesce(o.n, 0) > 0 AND coalesce(later, false) AS excused, "
    "coalesce(tts > earliest, false) AS late, ttype IS NOT NULL AND q <> '' AND NOT contains(x, q) AND len(list_filter(string_split(q, ' '), lambda w: list_contains(string_split(x, ' '), w))) / len(string_split(q, ' ')) < 0.6 AS misquoted FROM quoted u LEFT JOIN sums USING (signal_id) LEFT JOIN others o USING (signal_id))"
)


def _checked(excuses: bool) -> str:
    circular = "circular AND NOT excused" if excuses else "circular"
    return (
        f"SELECT *, list_filter(CASE WHEN type = 'none' THEN [CASE WHEN len(evidence) > 0 THEN 'E_NONE_WITH_EVIDENCE' END, CASE WHEN has THEN 'E_NONE_WITH_TRIGGER' END] ELSE list_concat([CASE WHEN len(evidence) = 0 THEN 'E_NO_EVIDENCE' END], codes, "
        f"[CASE WHEN {circular} THEN 'E_CIRCULAR_EVIDENCE' END, CASE WHEN has AND ttype IS NULL THEN 'E_UNKNOWN_TRIGGER' END, CASE WHEN has AND late THEN 'E_TRIGGER_LATE' END, CASE WHEN has AND misquoted THEN 'E_QUOTE_MISMATCH' END]) END, lambda v: v IS NOT NULL) AS violations FROM rules"
    )


CHECKED = f"{CARDS}, gated AS ({_checked(True)}), checked AS (SELECT *, len(violations) = 0 AS ok, CASE WHEN len(violations) > 0 THEN 'rejected' WHEN type = 'none' THEN 'abstained' ELSE 'verified' END AS status FROM gated), verified AS (SELECT * FROM checked WHERE status = 'verified')"
SECTIONS = (
    f"{CHECKED}, origins AS (SELECT channel, min(ts_ms) AS origin FROM tiled GROUP BY ALL), sec AS (SELECT *, coalesce(tts, lo) AS ts_ms, CASE WHEN tts IS NOT NULL THEN 'trigger' ELSE 'window' END AS ts_source, NULLIF(tid, 'unknown') AS trigger_id, len(evidence) AS cited, greatest((coalesce(tts, lo) - origin) // 1000, 0) AS sec FROM verified JOIN origins USING (channel)), "
    "filed AS (SELECT channel, signal_id, type, CAST(row_number() OVER (PARTITION BY channel, type ORDER BY ts_ms, signal_id) AS INTEGER) AS place, ts_ms, ts_source, printf('%02d:%02d:%02d', sec // 3600, sec // 60 % 60, sec % 60) AS timecode, CAST(cited AS INTEGER) AS cited, trigger_id, title FROM sec)"
)
_VOTES = "votes AS (SELECT c.channel, c.signal_id, s AS label, count / CAST(i AS DOUBLE) AS votes FROM (SELECT *, unnest(samples) AS s, unnest(range(1, len(samples) + 1)) AS i FROM {cards}) c), shares AS (SELECT *, sum(votes) OVER (PARTITION BY channel, signal_id) AS total, count(*) OVER (PARTITION BY channel, signal_id) AS options, CAST(row_number() OVER (PARTITION BY channel, signal_id ORDER BY votes DESC, label) AS INTEGER) AS rank FROM votes)"
CARD_SQL = {
    "check_card": f"{CHECKED} SELECT channel, signal_id, type, ok, status, array_to_string(violations, ',') AS violations FROM checked",
    "gate_ledger": f"{CHECKED}, v AS (SELECT channel, lo, unnest(violations) AS code FROM checked), n AS (SELECT channel, lo, code, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT channel, lo, string_agg(concat(code, ' ', n), ',' ORDER BY code) AS codes FROM n GROUP BY ALL), "
    "w AS (SELECT channel, lo, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'abstained') AS abstained, count(*) FILTER (status = 'rejected') AS rejected, avg(CAST(NOT ok AS INTEGER)) AS unsupported_rate FROM checked GROUP BY ALL) SELECT channel, lo AS win, verified, abstained, rejected, unsupported_rate, codes FROM w LEFT JOIN c USING (channel, lo)",
    "gate_rescore": f"{CHECKED}, old AS (SELECT signal_id, len(violations) = 0 AS strict FROM ({_checked(False)})) SELECT channel, signal_id, strict, ok AS reaction FROM checked JOIN old USING (signal_id) WHERE strict <> ok",
    "grounded_cards": f"{CHECKED} SELECT channel, signal_id FROM verified WHERE has AND coalesce(quote, '') <> '' AND len(evidence) > 0",
    "cited_events": f"{CARDS}, a AS (SELECT channel, signal_id, list_filter(list_append(evidence, NULLIF(tid, 'unknown')), lambda x: x IS NOT NULL) [1:6] AS ids FROM cards), b AS (SELECT channel, signal_id, unnest(ids) AS event_id, CAST(unnest(range(len(ids))) AS INTEGER) AS place FROM a) SELECT b.channel, b.event_id, signal_id, place, type AS event_type, ts_ms, text FROM b LEFT JOIN ev1 e ON e.channel = b.channel AND e.event_id = b.event_id",
    "trigger_census": f"{CHECKED} SELECT channel, CASE WHEN type = 'none' THEN 'abstained' WHEN tid = 'unknown' THEN 'unknown' ELSE coalesce(ttype, 'missing') END AS source, count(*) AS n, count(*) FILTER (ok) AS passed FROM checked GROUP BY ALL",
    "debrief_sections": f"{SECTIONS} SELECT * FROM filed",
    "clip_candidates": f"{SECTIONS} SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY cited DESC, ts_ms, signal_id) AS INTEGER) AS rank FROM filed WHERE trigger_id IS NOT NULL QUALIFY rank <= 5",
    "distribution_shares": f"{CARDS}, {_VOTES.format(cards='cards')} SELECT * EXCLUDE (votes, total), votes, total, round_even(votes / total, 3) AS share FROM shares",
    "recurring_themes": f"{CHECKED}, t AS (SELECT channel, signal_id, unnest(string_split(q, ' ')) AS term FROM verified UNION SELECT channel, signal_id, unnest(string_split({{x}}, ' ')) FROM (SELECT channel, signal_id, unnest(samples) AS s FROM verified)) "
    f"SELECT channel, term, count(DISTINCT signal_id) AS cards, array_to_string(list_sort(list(DISTINCT signal_id)), ',') AS signal_ids FROM t WHERE len(term) >= 3 AND NOT regexp_matches(term, '^\\p{{Nd}}+$') AND term NOT IN ({_list(fixed.THEME_STOPWORDS)}) GROUP BY ALL HAVING count(DISTINCT signal_id) >= 2".replace(
        "{x}", r"trim(regexp_replace(regexp_replace(replace(lower(s), 'ß', 'ss'), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\x0b\x85\p{Z}]', ' ', 'g'), '[\s\x0b\x85\p{Z}]+', ' ', 'g'))"
    ),
}

ORACLE_SQL = {
    "group_chat": f"{GROUPS} SELECT * REPLACE (array_to_string(samples, chr(10)) AS samples) FROM g_groups",
    "top_groups": f"{GROUPS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel, win ORDER BY count DESC, first_ts_ms, key) AS INTEGER) AS rank FROM g_groups) SELECT * REPLACE (array_to_string(samples, chr(10)) AS samples) FROM k WHERE rank <= 6",
    "grouped_summary": f"{GROUPS} SELECT channel, win, count(*) AS messages, count(DISTINCT key) AS groups, count(key) AS grouped, count(*) - count(key) AS ungrouped FROM chats LEFT JOIN g_assigned USING (channel, win, event_id) GROUP BY ALL",
    "compression_ratio": f"{CHATS} SELECT channel, win, count(DISTINCT canon) / count(*) AS ratio FROM chats JOIN canon_of USING (text) GROUP BY ALL",
    "reduce_chat": f"{CHATS}, b AS (SELECT channel, win, CASE WHEN canon = '' THEN '∅' ELSE canon END AS key, count(*) AS count, (min((ts_ms, event_id, text)))[3] AS first, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms, array_to_string(list(event_id ORDER BY ts_ms, event_id) [1:5], ',') AS event_ids FROM chats JOIN canon_of USING (text) GROUP BY ALL) "
    "SELECT * EXCLUDE (first), CASE WHEN key = '∅' THEN '(punctuation only)' ELSE first END AS sample FROM b",
    "board": f"{ATTRIBUTED} SELECT channel, win, rank, trigger_id, trigger_ts_ms, CASE WHEN m = 1 THEN 'matched' ELSE 'preceding' END AS link, CAST(count AS BIGINT) AS count, groups, lead[2] AS first_ts_ms, lead[3] AS lead_key FROM ranked WHERE rank <= 6",
    "unattributed": f"{ATTRIBUTED} SELECT channel, win, CAST(row_number() OVER (PARTITION BY channel, win ORDER BY count DESC, first_ts_ms, key) AS INTEGER) AS rank, key, label, count, first_ts_ms FROM att WHERE trigger IS NULL",
    "board_footer": f"{ATTRIBUTED}, {_TILES}, a AS (SELECT channel, win, count(*) AS messages FROM chats GROUP BY ALL), b AS (SELECT channel, win, count(*) AS merged FROM merged GROUP BY ALL), c AS (SELECT channel, win, sum(count) AS grouped, count(*) FILTER (trigger IS NULL) AS unattributed FROM att GROUP BY ALL) "
    "SELECT channel, win, coalesce(messages, 0) AS messages, least(coalesce(merged, 0), 6) AS rows, greatest(coalesce(merged, 0) - 6, 0) AS rows_hidden, coalesce(unattributed, 0) AS unattributed, CAST(coalesce(messages, 0) - coalesce(grouped, 0) AS BIGINT) AS singletons FROM every LEFT JOIN a USING (channel, win) LEFT JOIN b USING (channel, win) LEFT JOIN c USING (channel, win)",
    "rail": f"{CHATS}, {_RAIL} SELECT channel, win, messages, array_to_string(rate, ',') AS rate, CAST(coalesce(list_max(rate), 0) AS BIGINT) AS peak_burst, round_even(coalesce(list_max(rate), 0) / 10.0, 2) AS peak_per_second, coalesce(unique_chatters, 0) AS unique_chatters, coalesce(new_chatters, 0) AS new_chatters, "
    "coalesce(round_even(messages / unique_chatters, 2), 0) AS messages_per_chatter, coalesce(concentration, 0) AS concentration, coalesce(reaction_wave, 0) AS reaction_wave, speech_segments, speech_segments = 0 AS silent, frame_captions "
    "FROM r_n LEFT JOIN r_w USING (channel, win) LEFT JOIN r_r USING (channel, win) LEFT JOIN r_c USING (channel, win) LEFT JOIN r_u USING (channel, win)",
    "coordinated": f"{CHATS}, {_COPIES} SELECT * FROM coord",
    "needs_a_look": f"{CHATS}, {_COPIES}, h AS (SELECT channel, count(DISTINCT {_HOST}) AS n FROM chats WHERE {_HOST} <> '' GROUP BY ALL), j AS (SELECT channel, count(*) AS n FROM chats WHERE regexp_matches(text, '{fixed.INJECTION}') GROUP BY ALL), "
    "hits AS (SELECT channel, 'link' AS kind, least(n, 5) AS hits FROM h UNION ALL SELECT channel, 'injection', least(n, 5) FROM j UNION ALL SELECT channel, 'coordinated', count(*) FROM coord GROUP BY ALL), "
    "a AS (SELECT channel, count(*) AS messages FROM chats GROUP BY ALL), r AS (SELECT * FROM (VALUES (0, 'link', 'Links and invites'), (1, 'coordinated', 'Coordinated repeats'), (2, 'injection', 'Prompt injection')) AS r(place, kind, label)) "
    "SELECT channel, messages, place, kind, label, coalesce(hits, 0) AS hits, CAST(sum(coalesce(hits, 0)) OVER (PARTITION BY channel) AS BIGINT) AS total FROM a CROSS JOIN r LEFT JOIN hits USING (channel, kind)",
    "injection": f"{TEXTS}, r AS (SELECT channel, event_id, author, ts_ms, CAST(row_number() OVER (PARTITION BY channel ORDER BY ts_ms, event_id) AS INTEGER) AS rank FROM ev WHERE type = 'chat_message' AND regexp_matches(text, '{fixed.INJECTION}')) SELECT * FROM r WHERE rank <= 5",
    "inspect": f"{TEXTS}, x AS (SELECT channel, type, ts_ms, canon FROM ev JOIN canon_of ON canon_of.text IS NOT DISTINCT FROM ev.text), a AS (SELECT channel, count(*) AS events, count(*) FILTER (type = 'chat_message') AS chat, count(*) FILTER (type = 'transcript_segment') AS transcript, count(*) FILTER (type = 'frame_caption') AS frames, max(ts_ms) - min(ts_ms) AS span_ms, count(DISTINCT canon) FILTER (type = 'chat_message') AS bursts FROM x GROUP BY ALL) "
    "SELECT *, coalesce(round_even(bursts / nullif(chat, 0), 3), 1) AS compression_ratio FROM a",
    "questions": f"{QUESTIONS} SELECT channel, key, count, ts_ms, array_to_string(variants, chr(10)) AS variants, text, rank FROM asked",
    "stream_questions": f"{QUESTIONS}, {_ANSWERS}, f AS (SELECT asked.*, a IS NOT NULL AS answered, a[2] AS answer_id, a[3] AS shared FROM asked LEFT JOIN ans USING (channel, key)), "
    "p AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY answered, rank) AS INTEGER) AS place, greatest(count(*) OVER (PARTITION BY channel) - 12, 0) AS hidden FROM f) SELECT channel, place, key, text, count, ts_ms, answered, answer_id, array_to_string(shared, ',') AS shared, hidden FROM p WHERE place <= 12",
    "rolling_groups": f"{_TICKS} SELECT channel, tick, key, count, first_ts_ms, last_ts_ms, array_to_string(samples, chr(10)) AS samples, rule, label, rank FROM t_top",
    "tick_changes": f"{_TICKS}, s AS (SELECT channel, tick, string_agg(concat(label, ' ', count), ',' ORDER BY rank) AS groups FROM t_top GROUP BY ALL), b AS (SELECT *, lag(groups) OVER (PARTITION BY channel ORDER BY tick) AS before FROM s) SELECT channel, tick, groups FROM b WHERE before IS DISTINCT FROM groups",
}

ORACLE_SQL |= CARD_SQL
