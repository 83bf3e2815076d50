"""Column builders over chat text. All are built-in functions but NFKC and case folding, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .fixed import AUX_WORDS, EMPTY_KEY, INJECTION, LAUGHTER, LINK, STOPWORDS, WH_WORDS, WORDISH
from .skeletons import skeletons


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


#: Texts of these characters alone are the same in NFKC, and folding their case is lowering it, with ß as ss; what NFKC takes apart is left out.
_PLAIN = r"\A[\x00-\x7F¡-§©«¬®°±¶·»¿-ÿЀ-я–—‘-‚“-„]*\z"


def _lowered(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def folded(text: Column) -> Column:
    """NFKC and case folding; texts of plain characters are lowered without leaving the JVM."""
    plain = text.rlike(_PLAIN)
    return F.when(plain, _lowered(text)).otherwise(_fold(F.when(~plain, text)))


def odd_folded(text: Column) -> Column:
    """folded() of texts with other than plain characters, null for the others: as_folded() gives those theirs where they are needed."""
    return _fold(F.when(~text.rlike(_PLAIN), text))


def as_folded(text: Column, odd: Column) -> Column:
    """folded() of a text and its odd_folded(), by built-in functions alone."""
    return F.coalesce(odd, _lowered(text))


@F.arrow_udf(StructType().add("canon", StringType()).add("folded", StringType()))
def _canonical(texts: pa.Array) -> pa.Array:
    """The skeletons of usual texts; of others, which patterns have to change, what those are to be applied to."""
    canon = skeletons(texts)
    rest = [None if known or t is None else unicodedata.normalize("NFKC", t).casefold() for known, t in zip(canon.is_valid().to_pylist(), texts.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([canon, pa.array(rest, pa.string())], ["canon", "folded"])


def canonical(text: Column) -> Column:
    """A message's skeleton: folded, punctuation gone, runs of characters, syllables and words cut short."""
    found = _canonical(F.coalesce(text, F.lit("")))
    return F.coalesce(found["canon"], skeleton(found["folded"]))


def skeleton(folded_text: Column) -> Column:
    """canonical() of a text that is folded already; built-in functions alone."""
    t = F.trim(F.regexp_replace(folded_text, r"(?U)[\p{P}\s]+", " "))
    t = F.regexp_replace(t, r"(.)\1\1+", "$1$1")
    # no character stands three times in a row any more, so a unit has two at least
    t = F.regexp_replace(t, r"(.{2,4}?)\1\1+", "$1$1")
    return F.regexp_replace(t, r"(?U)\b(\w++)(?:\s+\1\b)+", "$1")


def words(canon: Column) -> Column:
    return F.filter(F.split(canon, " "), lambda w: w != "")


def content_tokens(canon: Column) -> Column:
    return F.filter(words(canon), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))


def is_reaction(canon: Column) -> Column:
    laughs = F.replace(canon, F.lit(" "), F.lit("")).rlike(LAUGHTER)
    return ~canon.isin("", EMPTY_KEY) & (laughs | ~canon.rlike(WORDISH))


def is_question(text: Column, canon: Column) -> Column:
    """Ends with a question mark or opens like one, and has something to say."""
    opening = F.slice(words(canon), 1, 2)
    asks = F.regexp_replace(text, r"(?U)\s+$", "").endswith("?") | F.arrays_overlap(opening, F.array(*map(F.lit, WH_WORDS))) | F.coalesce(F.get(opening, F.lit(0)).isin(AUX_WORDS), F.lit(False))
    return F.coalesce(asks, F.lit(False)) & (F.size(content_tokens(canon)) > 0)


def normalize_quote(text: Column) -> Column:
    t = F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def token_overlap(quote: Column, text: Column) -> Column:
    """Share of the quote's tokens, repeats counted, that the text has."""
    q, t = words(quote), words(text)
    return F.coalesce(F.try_divide(F.size(F.filter(q, lambda w: F.array_contains(t, w))), F.size(q)), F.lit(0.0))


def link_host(text: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), LINK, 1)), r"^www\.", "")
    return F.when(host != "", host)


def is_injection(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(INJECTION)


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("@([A-Za-z0-9_]{3,25})"), F.lit(1))


def timecode(ms: Column) -> Column:
    s = F.greatest(F.floor(ms / 1000), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def truncated(text: Column, n: int) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t)


def event_id(prefix: str, ts_ms: Column, text: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(ts_ms.cast("string"), F.lit("|"), text), 256), 1, 10))


def pseudonym(salt: str, login: Column) -> Column:
    return F.concat(F.lit("u_"), F.substring(F.sha2(F.concat(F.lit(salt + "|"), F.lower(login)), 256), 1, 10))
