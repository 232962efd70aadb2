"""Text normal forms and n-grams: JVM-side where Spark has the function, Arrow UDFs where it has not."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

_BLOCKS = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^<>]{1,500}>")
_INVISIBLE = re.compile("[​‌‍⁠﻿]")
_SPACE = re.compile(r"\s+")


def strip_html_text(text: str) -> str:
    """Script and style blocks and tags become spaces; character references are decoded."""
    return unescape(_TAG.sub(" ", _BLOCKS.sub(" ", text)))


def canonical(text: str | None) -> str | None:
    """Markup out (if there is any), NFKC, invisible characters out, white space to single spaces, trimmed."""
    if text is None:
        return None
    if "<" in text and ">" in text:
        text = strip_html_text(text)
    return _SPACE.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))).strip()


@F.pandas_udf(StringType())
def strip_html(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else strip_html_text(t))


@F.pandas_udf(StringType())
def canonical_text(s: pd.Series) -> pd.Series:
    return s.map(canonical)


@F.pandas_udf(StringType())
def normalized_text(s: pd.Series) -> pd.Series:
    """The canonical text with full case folding."""
    return s.map(lambda t: None if t is None else canonical(t).casefold())


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def extraction_handle(c: Column) -> Column:
    return F.lower(F.ltrim(c, F.lit("@")))


def resolution_handle(c: Column) -> Column:
    """Lower case, leading signs out, runs of separators to one underscore."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "^[@#]+", ""), r"[\s._-]+", "_"), F.lit("_"))


def domain(c: Column) -> Column:
    return F.regexp_replace(F.rtrim(F.lower(c), F.lit(".")), r"^www\.", "")


def url(c: Column) -> Column:
    """http, https and ftp only; trailing punctuation and the fragment out; scheme and host in lower case."""
    t = F.regexp_replace(F.regexp_replace(c, r"[.,;:!?)\]}'\"]+$", ""), r"#.*$", "")
    t = F.when(t.rlike(r"^(?i)www\."), F.concat(F.lit("http://"), t)).otherwise(t)
    head = F.lower(F.regexp_extract(t, r"^((?i)(?:https?|ftp)://[^/?]+)", 1))
    return F.when(head != "", F.concat(head, F.substring(t, F.length(head) + 1, F.length(t))))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def tokens(c: Column) -> Column:
    """Unicode word tokens in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1)


def word_shingles(words: Column, n: int = 3) -> Column:
    """All runs of n words; a shorter text is one shingle, an empty one none."""
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < n, F.array(F.array_join(words, " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    )


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The multiset of raw character n-grams; a shorter text is one gram."""
    return F.when(F.length(c) < n, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n))))


def padded_trigrams(words: Column) -> Column:
    """The set of trigrams of ##word## for search."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 2), lambda i: F.substring(F.concat(F.lit("##"), w, F.lit("##")), i, F.lit(3))))))


@lru_cache(200_000)
def feature_hash(feature: str) -> int:
    """The unsigned 64-bit BLAKE2b hash, big endian."""
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")


def simhash_of(text: str | None) -> int:
    """SimHash of word and padded trigram features (weights 2 and 1), as a signed long; 0 for an empty text."""
    words = re.findall(r"\w+", (text or "").casefold())
    grams: Counter = Counter()
    for w, n in Counter(words).items():
        padded = f"##{w}##"
        grams[f"w:{w}"] += 2 * n
        for i in range(len(padded) - 2):
            grams[f"c:{padded[i : i + 3]}"] += n
    if not grams:
        return 0
    h = np.array([feature_hash(g) for g in grams], np.uint64)
    weight = np.array(list(grams.values()), np.int64)
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    on = (np.where(bits == 1, weight[:, None], -weight[:, None]).sum(axis=0) > 0).astype(np.uint64)
    return int((on << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


@F.pandas_udf(LongType())
def simhash64(s: pd.Series) -> pd.Series:
    return s.map(simhash_of)


def minhash_of(text: str | None, permutations: int = 64, width: int = 3) -> list[int]:
    """MinHash of word shingles: slot s is the least (2s+1)h + (s+1)g modulo 2^64, g the 64-bit golden ratio, as signed
    longs; zeros for an empty text."""
    words = (text or "").lower().split()
    shingles = {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    if not shingles:
        return [0] * permutations
    h = np.array([feature_hash(s) for s in shingles], np.uint64)
    s = np.arange(permutations, dtype=np.uint64)
    slots = (np.uint64(2) * s + np.uint64(1))[:, None] * h[None, :] + ((s + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    return slots.min(axis=1).view(np.int64).tolist()


@F.pandas_udf(ArrayType(LongType()))
def minhash(s: pd.Series) -> pd.Series:
    return s.map(minhash_of)


def signature_jaccard(a: Column, b: Column) -> Column:
    """The share of equal slots."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def lsh_bands(signature: Column, rows: int = 8) -> Column:
    """(band, digest) keys of a 64-slot signature with eight rows a band."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.xxhash64(b, F.slice(signature, b * rows + 1, F.lit(rows))))


def simhash_chunks(c: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(k), F.shiftrightunsigned(c, 16 * k).bitwiseAND(0xFFFF)) for k in range(4)])


#: Signs of an instruction aimed at the reader of the data.
INJECTION = {"ignore": r"(?i)ignore (?:all |any )?(?:previous|prior|above) (?:instructions|directions)", "role": r"(?i)\byou are (?:now|a|an)\b", "prompt": r"(?i)(?:system|developer) (?:prompt|message)"}


def injection_flags(c: Column) -> Column:
    flags = F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in INJECTION.items()])
    return F.filter(flags, lambda x: x.isNotNull())


def neutralize_delimiters(c: Column) -> Column:
    return F.replace(c, F.lit("<<<"), F.lit("< < <"))
