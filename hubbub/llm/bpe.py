"""Whole-text encoding with the tokenizers library, one call for each new word.

Both vocabularies split a text before white space, between a letter and the punctuation
behind it, and after a single line feed or tab. So a text's ids are the ids of the pieces
cut there, one after another. A batch's texts are cut at once: offsets over the batch's own
bytes, no strings. Arrow's dictionary encoding finds the distinct pieces; only those are
looked up or encoded, and numpy lays their ids out again. New words of letters alone are
encoded JOINED at a time, with a text between them that always is one id of its own. Each
worker keeps the packed ids of the first MAX_KEPT pieces it has met; frequent ones come early.
"""

from __future__ import annotations

import array
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters with the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
MAX_KEPT = 1_000_000
LONGEST_KEPT = 64
CHUNK_BYTES = 4 << 20
JOINED = 500

_WHITE_BYTE = np.zeros(256, bool)
_WHITE_BYTE[[ord(c) for c in WHITE if ord(c) < 128]] = True
_WIDE = [c.encode() for c in WHITE if ord(c) >= 128]
_LEAD = np.zeros(256, bool)
_LEAD[[c[0] for c in _WIDE]] = True
_WIDE_CODES = {size: np.array([int.from_bytes(c, "big") for c in _WIDE if len(c) == size], np.uint32) for size in (2, 3)}

#: Not the apostrophe (contractions), nor < | > (special tokens).
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True

#: A word of letters, with the space before it.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")

_encoders: dict[str, "Encoder"] = {}


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 data belong to white space."""
    white = _WHITE_BYTE[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        ahead = np.concatenate((data, np.zeros(2, np.uint8)))
        for size, codes in _WIDE_CODES.items():
            code = np.zeros(len(lead), np.uint32)
            for k in range(size):
                code = code << np.uint32(8) | ahead[lead + k]
            found = lead[np.isin(code, codes)]
            for k in range(size):
                white[found + k] = True
    return white


def piece_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts that begin at `at` begin."""
    if not len(data):
        return np.empty(0, np.int64)
    white = white_bytes(data)
    fresh = white.copy()
    fresh[1:] &= ~white[:-1]
    fresh[at[:-1][at[1:] > at[:-1]]] = True
    alone = fresh & _WHITE_BYTE[data] & (data != 32)
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    fresh[1:] |= alone[:-1] & ~white[1:]
    fresh[1:] |= letter[:-1] & _PUNCTUATION[data[1:]]
    return np.flatnonzero(fresh)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls and the offsets of its texts in them."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    return held, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text (or one longer text) each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        k = 0
        while k < batch.num_rows:
            end = max(k + 1, min(k + rows, int(np.searchsorted(at, at[k] + most, "right")) - 1))
            yield batch.slice(k, end - k)
            k = end


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for every i in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Encoder:
    """ids of texts, equal to encode(text, add_special_tokens=False).ids of each."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.between = next(((t, ids[0]) for t in ("\n", " 0 ") if len(ids := self._encode([t])[0]) == 1 and self._encode([f"a{t}b{t} c"]) == [sum(self._encode(["a", t, "b", t, " c"]), [])]), None)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of each piece."""
        if self.between is None:
            return dict(zip(pieces, map(_pack, self._encode(pieces)), strict=True))
        text, mark = self.between
        words = [p for p in pieces if _WORD.fullmatch(p)]
        others = [p for p in pieces if not _WORD.fullmatch(p)]
        out = dict(zip(others, map(_pack, self._encode(others)), strict=True))
        for k, ids in zip(range(0, len(words), JOINED), self._encode([text.join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]), strict=True):
            packed, begin = np.array(ids, "<u4"), 0
            data = packed.tobytes()
            for p, end in zip(words[k : k + JOINED], [*np.flatnonzero(packed == mark).tolist(), len(ids)], strict=True):
                out[p] = data[4 * begin : 4 * end]
                begin = end + 1
        return out

    def _packed(self, pieces: list[str]) -> list[bytes]:
        new = [p for p in pieces if p not in self.kept]
        ids = self._new(new)
        if len(self.kept) < MAX_KEPT:
            self.kept.update((p, v) for p, v in ids.items() if len(p) <= LONGEST_KEPT)
        return [ids.get(p) or self.kept.get(p, b"") for p in pieces]

    def ids(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another (each with end_id behind it), and the number of each text."""
        data, at = text_bytes(texts)
        starts = piece_starts(data, at)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        packed = self._packed(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        flat = np.frombuffer(b"".join(packed), "<u4")
        which = pieces.indices.to_numpy()
        counts = sizes[which]
        upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, at)]
        out = flat[spread((np.cumsum(sizes) - sizes)[which], counts)]
        if end_id is None:
            return out, np.diff(upto)
        return np.insert(out, upto[1:], end_id), np.diff(upto) + 1


def _pack(ids: list[int]) -> bytes:
    packed = array.array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
