"""Operator 11, encoding cut at forced boundaries, and decoding.

A merge joins two neighbouring symbols into a token of the vocabulary. So where the last byte
of one symbol and the first byte of the next never stand side by side inside any token, no merge
can ever cross: the place is a certain cut, and the bytes left and right of it are encoded on
their own, in any order, and concatenated. The table of such byte pairs comes from the vocabulary
alone (256 x 256 truth values).

1. White space lies in no token, so texts are first cut before it; Arrow's dictionary encoding
   keeps each distinct piece of a batch once.
2. New pieces are normalised (ASCII by a table, others by the vocabulary's own normaliser) and
   split into words by the classes of their characters; numpy does it for all pieces at once.
3. Words are cut at forced boundaries into fragments. Only the last fragment of a word takes the
   word's end mark, so a fragment is its bytes and whether it ends a word. Distinct new fragments
   are merged by the library's model; a worker keeps the first MAX_KEPT, and as many pieces.
4. The ids of fragments are laid out as pieces, those of pieces as texts.

Long words without white space (base64, DNA, one repeated letter) so fall into short fragments
wherever the vocabulary allows a cut.

Rows: a null text is empty and has no ids; long texts count whole; repeated rows and null ids are
rows like others; columns but doc_id and text are ignored; an empty table gives no rows. Strings
that look like special tokens are special tokens, as the library reads them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LONGEST_KEPT, WHITE, chunks, spread, text_bytes, vocabulary, white_bytes
from .common import table

END = "</w>"
MAX_KEPT = 200_000
#: The pre-tokenizer's pattern that word_starts() implements (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)

_ASCII_CLASS = np.full(128, OTHER, np.uint8)
_ASCII_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_ASCII_CLASS[48:58] = NUMBER
_ASCII_CLASS[65:91] = _ASCII_CLASS[97:123] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_codecs: dict[str, "Codec"] = {}
_names: dict[str, pa.Array] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """inside[a, b]: whether byte b follows byte a inside any of the tokens."""
    inside = np.zeros((256, 256), bool)
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    joined = np.ones(len(flat), bool)
    joined[ends[ends > 0] - 1] = False
    at = np.flatnonzero(joined)
    inside[flat[at], flat[at + 1]] = True
    return inside


def white_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin: at white space, at a text's begin, and behind white space that is more than one blank."""
    if not len(data):
        return np.empty(0, np.int64)
    white = white_bytes(data)
    fresh = white.copy()
    fresh[1:] &= ~white[:-1]
    behind = ~white
    behind[0] = False
    behind[1:] &= white[:-1]
    blank = fresh & (data == 32)
    behind[1:] &= ~blank[:-1]
    fresh |= behind
    fresh[at[:-1][at[1:] > at[:-1]]] = True
    return np.flatnonzero(fresh)


def laid_out(packed: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of packed[which[0]], packed[which[1]], ... one after another, and the number of each."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    flat = np.frombuffer(b"".join(packed), "<u4")
    counts = sizes[which]
    return flat[spread((np.cumsum(sizes) - sizes)[which], counts)], counts


class Codec:
    """ids of texts, as the tokenizers library gives them for the vocabulary file at path."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or split.get("pattern", {}).get("Regex") != PATTERN or told["decoder"]:
            raise ValueError(f"{path} is not a byte-level vocabulary with word ends")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.ending, self.inner = (self._model(told, suffix) for suffix in (END, None))
        self.shown = byte_characters()
        byte_of = {c: b for b, c in enumerate(self.shown)}
        self.table = {b: ord(c) for b, c in enumerate(self.shown)}
        self.inside = pairs_inside([bytes(byte_of[c] for c in t.removesuffix(END)) for t in model["vocab"]])
        if self.inside[32].any() or self.inside[:, 32].any():
            raise ValueError(f"{path} has tokens with white space inside")
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[:128] = _ASCII_CLASS
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fragments: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _model(told: dict, suffix: str | None):
        """The merges alone, with or without the mark of a word's end."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps({**told, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "model": {**told["model"], "end_of_word_suffix": suffix}}))

    def _classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes begin a character, and the class of each byte's character."""
        lead = (data & 0xC0) != 0x80
        kind = _ASCII_CLASS[data & 0x7F]
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            ahead = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
            first, a, b, c = ahead[wide], ahead[wide + 1] & 63, ahead[wide + 2] & 63, ahead[wide + 3] & 63
            code = np.where(first < 0xE0, (first & 31) << 6 | a, np.where(first < 0xF0, (first & 15) << 12 | a << 6 | b, (first & 7) << 18 | a << 12 | b << 6 | c))
            for x in np.unique(code[self.classes[code] == UNKNOWN]).tolist():
                self.classes[x] = self._class_of(chr(x))
            kind[wide] = self.classes[code]
            kind = kind[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        return lead, kind

    def _class_of(self, c: str) -> int:
        """The class that the vocabulary's own splitter gives a character."""
        parts = len(self.splitter.pre_tokenize_str(f"a{c}a"))
        if parts < 3:
            return LETTER if parts == 1 else SPACE
        return OTHER if len(self.splitter.pre_tokenize_str(f"{c}!")) == 1 else NUMBER

    def word_starts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes of normalised data begin a word, and which belong to one."""
        lead, kind = self._classes(data)
        before = np.concatenate(([SPACE], kind[:-1]))
        start = lead & (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        quote = np.flatnonzero((data == 39) & (before != OTHER))
        if len(quote):
            ahead = np.concatenate((data, np.zeros(3, np.uint8)))
            one, two = ahead[quote + 1], ahead[quote + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            start[quote[short | long] + 1] = False
            end = np.concatenate((quote[short] + 2, quote[long] + 3))
            end = end[end < len(data)]
            start[end] |= kind[end] != SPACE
        return start, kind != SPACE

    def _merged(self, fragments: list[bytes]) -> list[bytes]:
        """Packed ids of fragments; the first byte tells whether the fragment ends a word."""
        new = [f for f in fragments if f not in self.fragments]
        ids = {}
        for ends, model in ((1, self.ending), (0, self.inner)):
            some = [f for f in new if f[0] == ends]
            found = model.encode_batch_fast([f[1:].decode("latin-1").translate(self.table) for f in some], add_special_tokens=False)
            ids |= {f: np.array(e.ids, "<u4").tobytes() for f, e in zip(some, found, strict=True)}
        if len(self.fragments) < MAX_KEPT:
            self.fragments.update((f, v) for f, v in ids.items() if len(f) <= LONGEST_KEPT)
        return [ids[f] if f in ids else self.fragments[f] for f in fragments]

    def _normalised(self, pieces: list[str]) -> np.ndarray:
        """The pieces' bytes after normalising, a blank before each."""
        wide = [k for k, p in enumerate(pieces) if not p.isascii()]
        if wide:
            pieces = list(pieces)
            told = self.normalizer.normalize_str(" ".join(pieces[k] for k in wide)).split(" ")
            if len(told) != len(wide):
                told = [self.normalizer.normalize_str(pieces[k]) for k in wide]
            for k, p in zip(wide, told, strict=True):
                pieces[k] = p
        return _LOWER[np.frombuffer((" " + " ".join(pieces)).encode() if pieces else b"", np.uint8)]

    def _plain(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces without white space and special tokens."""
        data = self._normalised(pieces)
        if not len(data):
            return []
        start, word = self.word_starts(data)
        cut = start | ~word
        cut[1:] |= ~self.inside[data[:-1], data[1:]]
        at = np.flatnonzero(cut)
        after = np.append(at[1:], len(data))
        ends = np.append((start | ~word)[at[1:]], True)
        held = word[at]
        mark = np.insert(data, at, ends)
        offsets = (np.append(at, len(data)) + np.arange(len(at) + 1)).astype(np.int32)
        fragments = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(mark)]).dictionary_encode()
        blank = b"\x01 "
        packed = iter(self._merged([f for f in fragments.dictionary.to_pylist() if f != blank]))
        ids, counts = laid_out([b"" if f == blank else next(packed) for f in fragments.dictionary.to_pylist()], fragments.indices.to_numpy())
        upto = np.concatenate(([0], np.cumsum(counts)))
        edges = upto[np.append(np.flatnonzero((data[at] == 32) & ~held & (after - at == 1)), len(at))] * 4
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of pieces, special tokens cut out first."""
        odd = [p for p in pieces if self.special_at and "<" in p and self.special_at.search(p)]
        plain = pieces if not odd else [p for p in pieces if p not in set(odd)]
        out = dict(zip(plain, self._plain([p.strip(WHITE) for p in plain]), strict=True))
        for p in odd:
            parts = [s for s in self.special_at.split(p.strip(WHITE)) if s]
            ids = dict(zip([s for s in parts if s not in self.special], self._plain([s for s in parts if s not in self.special]), strict=True))
            out[p] = b"".join(np.array([self.special[s]], "<u4").tobytes() if s in self.special else ids[s] for s in parts)
        return out

    def _packed(self, pieces: list[str]) -> list[bytes]:
        new = self._new([p for p in pieces if p not in self.pieces])
        if len(self.pieces) < MAX_KEPT:
            self.pieces.update((p, v) for p, v in new.items() if len(p) <= LONGEST_KEPT)
        return [new[p] if p in new else self.pieces[p] for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (strings without nulls), one text after another, and the number of each."""
        data, at = text_bytes(texts)
        starts = white_cuts(data, at)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        ids, counts = laid_out(self._packed(pieces.dictionary.to_pylist()), pieces.indices.to_numpy())
        upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, at)]
        return ids, np.diff(upto)


def codec(path: str) -> Codec:
    """One for each Python worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def names(path: str) -> pa.Array:
    """The token of each id of a vocabulary file, special ones included; decoding needs no more."""
    if path not in _names:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        if told["decoder"]:
            raise ValueError(f"{path} has a decoder of its own")
        found = {i: t for t, i in told["model"]["vocab"].items()} | {t["id"]: t["content"] for t in told["added_tokens"]}
        _names[path] = pa.array([found.get(i) for i in range(max(found) + 1)], pa.string())
    return _names[path]


def decoded(ids: np.ndarray, counts: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The texts: tokens joined by a blank, ids that the vocabulary lacks left out."""
    known = ids < len(tokens)
    which = np.where(known, ids, 0).astype(np.int64)
    found = tokens.take(pa.array(which, mask=~known))
    ends = np.concatenate(([0], np.cumsum(counts)))
    if found.null_count:
        ends = np.concatenate(([0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))))[ends]
        found = found.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ")


def encode(docs: DataFrame, path: str, back: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, packed) of every row; path is a vocabulary file that every executor has.

    With back, also text, the ids decoded in the same worker.
    """
    schema = "doc_id long, ids binary" + ", text string" * back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in chunks(batches):
            ids, counts = own.encode(part.column(1))
            offsets = (np.concatenate(([0], np.cumsum(counts))) * 4).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            texts = [decoded(ids, counts, names(path)).cast(pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([part.column(0), packed, *texts], names=["doc_id", "ids", "text"][: 2 + back])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of rows that encode() gives; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = names(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                held = [v or b"" for v in part.column(1).to_pylist()]
                texts = decoded(np.frombuffer(b"".join(held), "<u4"), np.fromiter(map(len, held), np.int64, len(held)) // 4, own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts.cast(pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    both = encode(table(spark, sf_dir, "documents"), path, back=True)
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
