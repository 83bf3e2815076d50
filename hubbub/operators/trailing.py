"""Groups of the messages of a window by the rules of grouping.py, for tasks that read sorted messages window by window.

Whole windows are grouped one after the other. In a trailing window every message enters and
leaves once; nothing is counted anew at each tick but the few words that enough messages of
the window share. Memory: the messages of one window.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Collection, Iterator
from itertools import islice

import pyarrow as pa

from ..functions.fixed import MIN_PREFIX, MIN_TOKEN, PREFIX_CHARS, REACTION_KEY, STOPWORDS

_STOPWORDS = frozenset(STOPWORDS)

#: What is known of a message, in the order of the columns.
MESSAGE = ("channel", "block", "origin", "lo", "hi", "ts_ms", "text", "reaction", "head", "canon")
BATCH = 8192
GROUPS = "channel string, tick long, key string, count long, first_ts_ms long, last_ts_ms long, samples array<string>, rank int"
LISTS = "channel string, tick long, groups array<struct<key: string, count: long>>"

#: key, count, first_ts_ms, last_ts_ms, samples
Group = tuple[str, int, int, int, list[str | None]]


def joined(words: dict[str, set[int]], prefixes: dict[str, set[int]], reactions: Collection[int]) -> dict[str, Collection[int]]:
    """Messages by key: those of each word, of each shared prefix and the reactions; words that too few share go.

    A prefix group joins the largest word group that begins with the prefix, however small.
    """
    found: dict[str, Collection[int]] = {REACTION_KEY: reactions} if reactions else {}
    kept = {t for t, own in words.items() if len(own) >= MIN_TOKEN}
    if prefixes:
        into: dict[str, tuple[int, str]] = {}
        for t, own in words.items():
            if (start := t[:PREFIX_CHARS]) in prefixes:
                into[start] = min(into.get(start, (0, "")), (-len(own), t))
        for head, own in prefixes.items():
            if head in into:
                t = into[head][1]
                found[f"t:{t}"] = words[t] | own
                kept.discard(t)
            else:
                found[f"p:{head}"] = own
    for t in kept:
        found[f"t:{t}"] = words[t]
    return found


def content_tokens(canon: str) -> list[str]:
    """The different ones of text.content_tokens(), in their order."""
    return list(dict.fromkeys(w for w in canon.split(" ") if len(w) >= 3 and w not in _STOPWORDS))


class Trailing:
    """The messages of one window, added in the order of (time, id), and their groups by the rules of grouping.py."""

    def __init__(self) -> None:
        self.number = 0
        self.live: deque[tuple[int, int]] = deque()
        self.messages: dict[int, tuple] = {}
        self.reactions: set[int] = set()
        self.heads: dict[str, set[int]] = {}
        self.shared: set[str] = set()
        #: messages by word, but those that a reaction or a shared prefix has already
        self.tokens: dict[str, set[int]] = {}
        self.hot: set[str] = set()

    def _say(self, i: int) -> None:
        for t in self.messages[i][3]:
            of = self.tokens.setdefault(t, set())
            of.add(i)
            if len(of) == MIN_TOKEN:
                self.hot.add(t)

    def _unsay(self, i: int) -> None:
        for t in self.messages[i][3]:
            of = self.tokens[t]
            of.remove(i)
            if len(of) == MIN_TOKEN - 1:
                self.hot.discard(t)
            if not of:
                del self.tokens[t]

    def add(self, hi: int, ts_ms: int, text: str | None, reaction: bool, head: str | None, tokens: list[str]) -> None:
        i, self.number = self.number, self.number + 1
        self.live.append((hi, i))
        self.messages[i] = (ts_ms, text, head, tokens, reaction)
        if reaction:
            self.reactions.add(i)
        elif head is None:
            self._say(i)
        else:
            of = self.heads.setdefault(head, set())
            of.add(i)
            if len(of) < MIN_PREFIX:
                self._say(i)
            elif len(of) == MIN_PREFIX:
                self.shared.add(head)
                for j in of:
                    if j != i:
                        self._unsay(j)

    def expire(self, step: int) -> bool:
        """Messages that no tick from step on sees go; whether there were any."""
        live, gone = self.live, False
        while live and live[0][0] < step:
            i, gone = live.popleft()[1], True
            _, _, head, _, reaction = self.messages[i]
            if reaction:
                self.reactions.remove(i)
            elif head is None:
                self._unsay(i)
            else:
                of = self.heads[head]
                of.remove(i)
                if len(of) < MIN_PREFIX - 1:
                    self._unsay(i)
                elif len(of) == MIN_PREFIX - 1:
                    self.shared.discard(head)
                    for j in of:
                        self._say(j)
                if not of:
                    del self.heads[head]
            del self.messages[i]
        return gone

    def _members(self) -> dict[str, Collection[int]]:
        """Messages by key. A message takes the word that most others share, so words are dealt from the most shared on."""
        taken: set[int] = set()
        words: dict[str, set[int]] = {}
        for _, t in sorted((-len(self.tokens[t]), t) for t in self.hot):
            if own := self.tokens[t] - taken:
                words[t] = own
                taken |= own
        return joined(words, {head: self.heads[head] for head in self.shared}, self.reactions)

    def groups(self, k: int, samples: int) -> list[Group]:
        """The first k groups by count, time and key, each with its first distinct texts."""
        said = self.messages
        ranked = sorted((-len(own), said[min(own)][0], key, own) for key, own in self._members().items())[:k]
        out = []
        for n, first, key, own in ranked:
            texts: list[str | None] = []
            if samples:
                for i in sorted(own):
                    if said[i][1] not in texts:
                        texts.append(said[i][1])
                        if len(texts) == samples:
                            break
            out.append((key, -n, first, said[max(own)][0], texts))
        return out


def _ticks(batches: Iterator[pa.RecordBatch], size: int, tick_ms: int, k: int, samples: int) -> Iterator[tuple[str, int, int, list[Group], bool]]:
    """channel, block, tick and groups of every tick that has any, and whether they may differ from those of the tick before in the block."""
    of, window, step, origin = None, Trailing(), 0, 0
    changed, known = True, []

    def upto(end: int) -> Iterator[tuple[str, int, int, list[Group], bool]]:
        nonlocal step, changed, known
        while step < end and window.live:
            changed = window.expire(step) or changed
            known, fresh, changed = window.groups(k, samples) if changed else known, changed, False
            if known:
                yield of[0], of[1], origin + step * tick_ms, known, fresh
            step += 1
        step = max(step, end)

    for batch in batches:
        for channel, block, at, lo, hi, ts_ms, text, reaction, head, canon in zip(*(batch.column(c).to_pylist() for c in MESSAGE), strict=True):
            if of != (channel, block):
                if of:
                    yield from upto((of[1] + 1) * size)
                of, window, step, origin = (channel, block), Trailing(), block * size, at
                changed, known = True, []
            tokens = [] if reaction else content_tokens(canon)
            if not (reaction or head or tokens):
                continue
            if lo > step:
                yield from upto(lo)
            window.add(hi, ts_ms, text, reaction, head, tokens)
            changed = True
    if of:
        yield from upto((of[1] + 1) * size)


def _batches(rows: Iterator[tuple], schema: Callable[[], pa.Schema]) -> Iterator[pa.RecordBatch]:
    """rows in batches; the schema is asked for once there are rows."""
    while part := list(islice(rows, BATCH)):
        of = schema()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), of, strict=True)], schema=of)


def group_rows(size: int, tick_ms: int, k: int, samples: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over MESSAGE, sorted: GROUPS, the first k groups of every tick."""
    schema = pa.schema([("channel", pa.string()), ("tick", pa.int64()), ("key", pa.string()), ("count", pa.int64()), ("first_ts_ms", pa.int64()), ("last_ts_ms", pa.int64()), ("samples", pa.list_(pa.string())), ("rank", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ticks = _ticks(batches, size, tick_ms, k, samples)
        return _batches(((channel, tick, *group, rank) for channel, _, tick, groups, _ in ticks for rank, group in enumerate(groups, 1)), lambda: schema)

    return run


def changed_lists(size: int, tick_ms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over MESSAGE, sorted: LISTS, the keys and counts of each block's first tick with groups and of those that differ from the one before."""
    schema = pa.schema([("channel", pa.string()), ("tick", pa.int64()), ("groups", pa.list_(pa.struct([("key", pa.string()), ("count", pa.int64())])))])

    def differing(ticks: Iterator[tuple[str, int, int, list[Group], bool]]) -> Iterator[tuple]:
        of, before = None, None
        for channel, block, tick, groups, fresh in ticks:
            if not fresh and of == (channel, block):
                continue
            found = [(g[0], g[1]) for g in groups]
            if of != (channel, block) or found != before:
                yield channel, tick, [{"key": key, "count": n} for key, n in found]
            of, before = (channel, block), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(differing(_ticks(batches, size, tick_ms, k, 0)), lambda: schema)

    return run


#: What is known of a message of a window, in the order of the columns.
WINDOW = ("event_id", "ts_ms", "text", "reaction", "head", "canon")


def members(rows: list[tuple]) -> dict[str, Collection[int]]:
    """Messages (WINDOW) of one window by key, as places in rows; those of no group are left out."""
    many = Counter(r[4] for r in rows if r[4] is not None)
    prefixes: dict[str, set[int]] = {head: set() for head, n in many.items() if n >= MIN_PREFIX}
    reactions, others, counts = [], [], Counter()
    for i, (_, _, _, reaction, head, canon) in enumerate(rows):
        if reaction:
            reactions.append(i)
        elif head in prefixes:
            prefixes[head].add(i)
        elif said := content_tokens(canon):
            counts.update(said)
            others.append((i, said))
    hot = {t: (-n, t) for t, n in counts.items() if n >= MIN_TOKEN}
    words: dict[str, set[int]] = {}
    for i, said in others:
        if best := min((hot[t] for t in said if t in hot), default=None):
            words.setdefault(best[1], set()).add(i)
    return joined(words, prefixes, reactions)


def _windows(batches: Iterator[pa.RecordBatch], n: int, fields: dict[str, pa.DataType]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The first n columns of each window and its messages; fields gets the types of the columns."""
    of, rows = None, []
    for batch in batches:
        fields.update((f.name, f.type) for f in batch.schema)
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n] != of:
                if rows:
                    yield of, rows
                of, rows = row[:n], []
            rows.append(row[n:])
    if rows:
        yield of, rows


def _texts(rows: list[tuple], places: list[int], n: int) -> list[str | None]:
    """The first n different texts."""
    return list(islice(dict.fromkeys(rows[i][2] for i in places), n)) if n else []


def window_groups(scope: list[str], samples: int, keep_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over scope and WINDOW, sorted: scope, key, count, first_ts_ms, last_ts_ms, samples and, with keep_ids, evidence."""

    def told(rows: list[tuple], key: str, own: Collection[int]) -> tuple:
        places = sorted(own)
        times = [t for t in (rows[places[0]][1], rows[places[-1]][1]) if t is not None]
        if len(times) == 1 < len(places):
            times = [t for t in (rows[i][1] for i in places) if t is not None]
        ids = ([rows[i][0] for i in places[:keep_ids]],) if keep_ids else ()
        return key, len(places), min(times, default=None), max(times, default=None), _texts(rows, places, samples), *ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[str, pa.DataType] = {}
        found = ((*of, *told(rows, key, own)) for of, rows in _windows(batches, len(scope), fields) for key, own in members(rows).items())
        of = [("key", pa.string()), ("count", pa.int64()), ("first_ts_ms", pa.int64()), ("last_ts_ms", pa.int64()), ("samples", pa.list_(pa.string())), *([("evidence", pa.list_(pa.string()))] if keep_ids else [])]
        return _batches(found, lambda: pa.schema([*((c, fields[c]) for c in scope), *of]))

    return run


def window_keys(scope: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over scope and WINDOW, sorted: scope, event_id and key of every message that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[str, pa.DataType] = {}
        found = ((*of, rows[i][0], key) for of, rows in _windows(batches, len(scope), fields) for key, own in members(rows).items() for i in own)
        return _batches(found, lambda: pa.schema([*((c, fields[c]) for c in scope), ("event_id", pa.string()), ("key", pa.string())]))

    return run


def window_counts(scope: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over scope and WINDOW, sorted: scope, messages, groups, grouped and ungrouped."""

    def counts(rows: list[tuple]) -> tuple[int, int, int, int]:
        sizes = [len(own) for own in members(rows).values()]
        return len(rows), len(sizes), sum(sizes), len(rows) - sum(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[str, pa.DataType] = {}
        found = ((*of, *counts(rows)) for of, rows in _windows(batches, len(scope), fields))
        return _batches(found, lambda: pa.schema([*((c, fields[c]) for c in scope), *((c, pa.int64()) for c in ("messages", "groups", "grouped", "ungrouped"))]))

    return run
