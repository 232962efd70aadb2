"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks the rank of every adjacent pair up by binary
search over the sorted pair keys of the merge table, finds each word's lowest rank, and merges all places of that
pair at once. Words already seen are kept in a bounded cache, so a round only ever sees new words.

Defined results: a null or empty text has no tokens and decodes to the empty text; a special token's string inside
a text becomes that token, as the tokenizer file says; rows that repeat give equal results; texts of any length are
encoded whole; of pairs of one rank, which are one pair, the leftmost is merged first (ties); an empty table gives an
empty result; other columns don't matter, whatever their names, and a null doc_id is a row like any other.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evidentia.llm.common import map_text

#: Fixed value: the published pre-tokenization pattern of byte-level BPE vocabularies. White space is spelt out
#: (Unicode White_Space), as the regex engines differ over \x1c-\x1f.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same split for texts whose characters these classes agree on; RARE finds the others.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
RARE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0100-\U0010ffff]")
#: Words that a process remembers at most.
CACHE = 200_000
NONE = np.iinfo(np.int32).max


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BpeModel:
    """A tokenizer file's vocabulary and merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.width = max([*vocab.values(), *self.special.values()]) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(PATTERN)
        self.stops = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.decimal = [b"%d," % i for i in range(self.width)]
        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}

    def rank_at(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The merge rank of the pairs that start at the given places; NONE where two words meet."""
        key = sym[at] * self.width + sym[at + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[found] == key) & (word[at] == word[at + 1]), self.ranks[found], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Token ids of all words (non-empty bytes) in one list, and where each word's ids end."""
        size = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self.rank_at(sym, word, np.arange(len(sym) - 1))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(best != NONE, length)
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, rank = sym[live], word[live], rank[live]
                best, length = best[best != NONE], length[best != NONE]
                if not len(sym):
                    break
            # Neighbouring places of one pair overlap (a a a): every second one of a run is merged, from the left.
            at = np.flatnonzero(rank == np.repeat(best, length))
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # their places once the right halves are gone
            sym, word, rank = sym[keep], word[keep], rank[keep]
            # Only pairs with a merged symbol have a new rank.
            stale = np.r_[at, at - 1]
            stale = stale[(stale >= 0) & (stale < len(sym))]
            rank[stale] = NONE
            stale = stale[stale < len(sym) - 1]
            rank[stale] = self.rank_at(sym, word, stale)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order].tolist(), np.cumsum(np.bincount(word, minlength=len(words))).tolist()

    def pieces(self, text: str) -> list[str]:
        if self.stops is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for part in self.stops.split(text):
            out += [part] if part in self.special else self.words(part)
        return out

    def words(self, text: str) -> list[str]:
        return (self.split if RARE.search(text) else LATIN).findall(text)

    def learn(self, words: list[str]) -> None:
        """Puts the decimal ids with commas, and the bytes that the ids stand for, of new words into the caches."""
        for w in words:
            if w in self.special:
                self.ids[w], self.raw[w] = self.decimal[self.special[w]], self.bytes[self.special[w]]
        words = [w for w in words if w not in self.special]
        decimal, raw = self.decimal.__getitem__, self.bytes.__getitem__
        for lo in range(0, len(words), 50_000):
            part, start = words[lo : lo + 50_000], 0
            flat, ends = self.encode_words([w.encode() for w in part])
            for w, end in zip(part, ends, strict=True):
                own = flat[start:end]
                self.ids[w], self.raw[w], start = b"".join(map(decimal, own)), b"".join(map(raw, own)), end

    def encode(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        """For each text: its number of tokens, its decimal ids joined by commas, its decoded bytes."""
        out: list[tuple[int, bytes, bytes]] = []
        group: list[list[str]] = []
        room = 0
        for k, t in enumerate(texts, 1):
            group.append(self.pieces(t or ""))
            room += len(group[-1])
            if room > 200_000 or k == len(texts):
                words = set().union(*group)
                new = [w for w in words if w not in self.ids]
                if len(self.ids) + len(new) > CACHE:
                    self.ids.clear()
                    self.raw.clear()
                    new = list(words)
                self.learn(new)
                for p in group:
                    ids = b"".join(map(self.ids.__getitem__, p))
                    out.append((ids.count(b","), ids[:-1], b"".join(map(self.raw.__getitem__, p))))
                group, room = [], 0
        return out


@lru_cache(2)
def model(path: str) -> BpeModel:
    return BpeModel(path)


def encode_ids(text: str | None, path: str) -> list[int]:
    ids = model(path).encode([text])[0][1]
    return [int(x) for x in ids.split(b",")] if ids else []


def decode_ids(ids: list[int], path: str) -> str:
    """The text of a token sequence, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    m = model(path)
    return b"".join(m.bytes[i] for i in ids).decode("utf-8", "replace")


def tokenize(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; with_ids adds the ids themselves.

    path: the tokenizer file, which every executor must be able to open (it comes with an installed package)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = model(path).encode(b.column(1).to_pylist())
        cols = [b.column(0), pa.array([n for n, _, _ in got], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for _, i, _ in got]), pa.array([hashlib.sha256(d.decode("utf-8", "replace").encode()).hexdigest() for _, _, d in got])]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            flat = np.concatenate([np.fromstring(i.decode(), np.int32, sep=",") if i else np.zeros(0, np.int32) for _, i, _ in got])
            cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([n for n, _, _ in got])].astype(np.int32)), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_text(documents, ["doc_id", "text"], run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
