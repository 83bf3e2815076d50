"""Skeletons of usual texts by whole arrays, as text.skeleton() finds them by patterns.

Patterns look at every character several times. Here a batch of texts is one array of code
points: letters are folded and punctuation becomes space by a table, and comparisons with the
array moved by one to four places find where a text repeats a character, syllable or word.
Only there is it looked at again.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE, _SZ = 32, 0xDF
#: Neither punctuation nor part of a word.
_SYMBOLS = "$+<=>^`|~"
_CHARS, _SYLLABLES = re.compile(r"(.)\1\1+"), re.compile(r"(.{2,4}?)\1\1+")
_TABLED = [*range(1, 0x250), *range(0x400, 0x530), 0x2013, 0x2014, 0x2018, 0x2019, 0x201A, 0x201C, 0x201D, 0x201E]


def _table() -> np.ndarray:
    """What a character becomes (ß a first s); 0 for those that are left to the patterns: marks, other symbols, what folds to more than one letter."""
    table = np.zeros(0x2020, np.uint16)
    for code in _TABLED:
        c = chr(code)
        folded, kind = unicodedata.normalize("NFKC", c).casefold(), unicodedata.category(c)
        if c in "\t\n\x0b\x0c\r " or (kind[0] == "P" and folded == c):
            table[code] = _SPACE
        elif kind in ("Ll", "Lu", "Nd") and len(folded) == 1 and unicodedata.category(folded) in ("Ll", "Nd") and ord(folded) < len(table):
            table[code] = ord(folded)
        elif c in _SYMBOLS:
            table[code] = code
    table[_SZ] = ord("s")
    return table


_BECOMES = _table()
_IN_WORD = ~np.isin(np.arange(len(_BECOMES)), [_SPACE, *map(ord, _SYMBOLS)])
_WEIGHTS = np.random.default_rng(0).integers(1, 1 << 62, len(_BECOMES), np.uint64)


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


def _repeats(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a unit of one to four characters stands three times in a row: text (ends at `at`), place, length of the unit; in order."""
    found = []
    for unit, steps in ((1, (1,)), (2, (1, 2)), (3, (1, 2, 2)), (4, (1, 2, 4))):
        if len(c) < 3 * unit:
            break
        same = c[unit:] == c[:-unit]
        for step in steps:
            same = same[step:] & same[:-step]
        start = np.flatnonzero(same)
        text = np.searchsorted(at, start, "right") - 1
        inside = start + 3 * unit <= at[text + 1]
        found.append(np.stack([text[inside], start[inside], np.full(inside.sum(), unit)]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    rows = np.concatenate(found, axis=1)
    return tuple(rows[:, np.lexsort((rows[2], rows[1]))])


def _cut_syllables(text: str, starts: list[int]) -> str:
    """text with repeated syllables cut to two; they begin nowhere but at starts."""
    out, done = [], 0
    for start in starts:
        if start >= done and (m := _SYLLABLES.match(text, start)):
            out += [text[done:start], m[1], m[1]]
            done = m.end()
    return "".join([*out, text[done:]])


def _once(text: str) -> str:
    """text without words that follow themselves; words are parted by single spaces and hold no symbols."""
    words = text.split(" ")
    return " ".join([w for w, before in zip(words, [None, *words], strict=False) if w != before])


def _doubled(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts in which a word may follow itself: equal lengths and sums of letters."""
    if not len(c):
        return np.zeros(0, np.int64)
    word = _IN_WORD[c]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begins, ends = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    first[begins], last[ends] = word[begins], word[ends]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_WEIGHTS[c])))
        sums = total[hi] - total[lo]
    # no text begins or ends with a space
    same = (hi[1:] - lo[1:] == hi[:-1] - lo[:-1]) & (sums[1:] == sums[:-1]) & (lo[1:] - hi[:-1] == 1)
    same &= c[np.minimum(hi[:-1], len(c) - 1)] == _SPACE
    return np.searchsorted(at, lo[1:][same], "right") - 1


def skeletons(texts: pa.Array) -> pa.Array:
    """canonical() of each text, null for those with other than usual characters, those with symbols that repeat a word, and nulls."""
    texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = _sums((raw & 0xC0) != 0x80)[offsets - offsets[0]]
    c = _BECOMES[np.minimum(codes, len(_BECOMES) - 1)]
    if (twice := codes == _SZ).any():
        c, at = np.repeat(c, 1 + twice), _sums(1 + twice)[at]
    other = _sums(c == 0)[at]
    simple = other[1:] == other[:-1]

    # the first space of a run stays, but not at either end of a text
    space = c == _SPACE
    drop = space.copy()
    drop[1:] &= space[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    drop[begins] = space[begins]
    c, at = c[~drop], _sums(~drop)[at]
    ends = at[1:][at[:-1] < at[1:]] - 1
    kept = np.ones(len(c), bool)
    kept[ends] = c[ends] != _SPACE
    c, at = c[kept], _sums(kept)[at]

    text, start, unit = _repeats(c, at)
    again = np.unique(np.concatenate((text, _doubled(c, at))))
    again = again[simple[again]]
    if texts.null_count:
        simple &= texts.is_valid().to_numpy(zero_copy_only=False)
    said = c.astype("<u4").tobytes().decode("utf-32-le")
    size = _sums(1 + (c >= 0x80).astype(np.int8) + (c >= 0x800))[at].astype(np.int32)
    known = pa.StringArray.from_buffers(n, pa.py_buffer(size.tobytes()), pa.py_buffer(said.encode()), pa.py_buffer(np.packbits(simple, bitorder="little").tobytes()))
    if not len(again):
        return known

    cut = []
    low, high = np.searchsorted(text, again, "left"), np.searchsorted(text, again, "right")
    plain = _sums(~_IN_WORD[c] & (c != _SPACE))[at]
    for i, lo, hi in zip(again.tolist(), low.tolist(), high.tolist(), strict=True):
        found = said[at[i] : at[i + 1]]
        if hi > lo:
            found = _SYLLABLES.sub(r"\1\1", _CHARS.sub(r"\1\1", found)) if (unit[lo:hi] == 1).any() else _cut_syllables(found, (start[lo:hi] - at[i]).tolist())
        cut.append(_once(found) if plain[i] == plain[i + 1] else None)
    mask = np.zeros(n, bool)
    mask[again] = True
    return pc.replace_with_mask(known, pa.array(mask), pa.array(cut, pa.string()))
