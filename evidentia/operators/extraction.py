"""Entity extraction: text to zero or more typed spans, with checksums where the format has one.

Patterns run in an Arrow-batched map over documents, so spans count code points. Confidence values and the order of
the extractors are fixed; a span found by several extractors keeps the first."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.ner import PLATFORMS, ROLES, by_grammar, by_role

#: The alphabets of Base58 and Bech32.
B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: Top-level domains that make a dotted name a host, and endings that make it a file.
TLDS = frozenset("""com net org edu gov mil int io ai app dev club co info biz mobi name pro ru de uk fr nl it es pt se no fi dk pl cz gr tr ua ro bg rs hr hu at ch be ie il in jp kr cn tw hk sg au nz za ca mx ar br cl pe
xyz top site online club live life world today news blog wiki onion bazar balancer shop store market mall goods pay fund cash coin wallet token win bet casino poker cc tv me cf ga tk ml gq us ca
eu asiajobs careers finance health tech digital systems solutions group""".split())
FILES = frozenset("""txt pdf doc docx xls xlsx ppt pptx csv json xml yml yaml md log bak tmp swp py js ts jsx go rs java c h cpp sh bat ps1 sql ini cfg conf env lock png jpg jpeg gif svg webp mp3 mp4 zip tar gz rar 7z iso img
exe dll so deb rpm apk dmg pkg db sqlite pcap""".split())


def base58_ok(address: str) -> bool:
    """Base58Check: four checksum bytes of the double SHA-256."""
    n = 0
    for c in address:
        k = B58.find(c)
        if k < 0:
            return False
        n = n * 58 + k
    try:
        raw = n.to_bytes(25, "big")
    except OverflowError:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def bech32_ok(address: str) -> bool:
    """The BCH checksum of BIP 173 and 350."""
    low = address.lower()
    if address not in (low, address.upper()) or "1" not in low:
        return False
    part, data = low.rsplit("1", 1)
    if len(data) < 6 or any(c not in BECH for c in data):
        return False
    values = [ord(c) >> 5 for c in part] + [0] + [ord(c) & 31 for c in part] + [BECH.index(c) for c in data]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check in (1, 0x2BC830A3)


def onion_v3_ok(name: str) -> bool:
    """The two checksum bytes of SHA3-256 over the key and version 3."""
    import base64

    raw = base64.b32decode(name.upper())
    return raw[34:] == b"\x03" and hashlib.sha3_256(b".onion checksum" + raw[:32] + b"\x03").digest()[:2] == raw[32:34]


def _rotate(x: int, n: int) -> int:
    return ((x << n) | (x >> (64 - n))) & 0xFFFFFFFFFFFFFFFF if n else x


def keccak256(data: bytes) -> bytes:
    """Keccak with the original padding (hashlib's SHA-3 pads otherwise); round constants and rotations by their rules."""
    rate = 136
    padded = bytearray(data + b"\x01" + bytes(-(len(data) + 1) % rate))
    padded[-1] |= 0x80
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        lfsr = 1
        for _ in range(24):
            c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            d = [c[(x + 4) % 5] ^ _rotate(c[(x + 1) % 5], 1) for x in range(5)]
            a = [[v ^ d[x] for v in a[x]] for x in range(5)]
            x, y, current = 1, 0, a[1][0]
            for t in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                current, a[x][y] = a[x][y], _rotate(current, (t + 1) * (t + 2) // 2 % 64)
            for y in range(5):
                row = [a[x][y] for x in range(5)]
                for x in range(5):
                    a[x][y] = row[x] ^ (~row[(x + 1) % 5] & row[(x + 2) % 5] & 0xFFFFFFFFFFFFFFFF)
            for j in range(7):
                a[0][0] ^= (lfsr & 1) << ((1 << j) - 1)
                lfsr = (lfsr << 1) ^ (0x171 if lfsr >> 7 else 0)
    return b"".join(a[i][0].to_bytes(8, "little") for i in range(4))


def eth_case_ok(digits: str) -> bool:
    """The capitals of an address in mixed case (EIP-55): letters over a hash digit of 8 or more are upper."""
    low = digits.lower()
    marks = keccak256(low.encode()).hex()
    return all(c == (k.upper() if int(m, 16) >= 8 else k) for c, k, m in zip(digits, low, marks, strict=False))


def host_like(name: str, before: str = "") -> bool:
    """Whether a dotted name is a host: by its ending, else by a scheme or www. in the eight characters before."""
    last = name.rsplit(".", 1)[-1].lower()
    if last == "onion" or last in FILES:
        return False  # onion names have their own extractor
    return last in TLDS or before[-8:].lower().endswith(("://", "www.", "//"))


URL = re.compile(r"(?<![\w@])(?:https?://|ftp://|www\.)[^\s<>\"']+", re.I)
EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b")
ONION = re.compile(r"(?<![a-z2-7])([a-z2-7]{56}|[a-z2-7]{16})\.onion\b", re.I)
BASE58 = re.compile(r"(?<![A-Za-z0-9])[13][1-9A-HJ-NP-Za-km-z]{25,34}(?![A-Za-z0-9])")
BECH32 = re.compile(r"(?<![A-Za-z0-9])(?:bc1[02-9ac-hj-np-z]{11,71}|BC1[02-9AC-HJ-NP-Z]{11,71})(?![A-Za-z0-9])")
ETH = re.compile(r"(?<![A-Za-z0-9])0x[0-9a-fA-F]{40}(?![0-9a-zA-Z])")
PGP = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-F]{4}\s{1,2}){9}[0-9A-F]{4}(?![0-9A-Fa-f])")
PGP_RAW = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{40}(?![0-9A-Za-z])")
DOMAIN = re.compile(r"(?<![\w@./-])(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
HANDLE = re.compile(r"(?<![\w@.])@[A-Za-z0-9_][A-Za-z0-9_.-]{2,31}")


def spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """(type, start, end, normal form, confidence), sorted by span; one for each type and span."""
    found: dict[tuple[str, int, int], tuple[str, float]] = {}

    def add(kind: str, lo: int, hi: int, value: str, confidence: float) -> None:
        found.setdefault((kind, lo, hi), (value, confidence))

    for m in EMAIL.finditer(text):
        if host_like(m[0].split("@")[1]):
            add("email", *m.span(), m[0].lower(), 0.9)
    for m in ONION.finditer(text):
        name = m[1].lower()
        if len(name) == 16:
            add("onion", *m.span(), name + ".onion", 0.6)
        elif onion_v3_ok(name):
            add("onion", *m.span(), name + ".onion", 0.98)
    for m in URL.finditer(text):
        value = m[0].rstrip(".,;:!?)]}'\"")
        add("url", m.start(), m.start() + len(value), value, 0.95)
    for m in BECH32.finditer(text):
        if bech32_ok(m[0]):
            add("wallet", *m.span(), m[0].lower(), 0.95)
    for m in BASE58.finditer(text):
        if base58_ok(m[0]):
            add("wallet", *m.span(), m[0], 0.95)
    for m in ETH.finditer(text):
        digits = m[0][2:]
        plain = digits in (digits.lower(), digits.upper())
        if plain or eth_case_ok(digits):
            add("wallet", *m.span(), m[0].lower(), 0.8 if plain else 0.95)
    grouped = [m.span() for m in PGP.finditer(text)]
    for lo, hi in grouped:
        add("pgp", lo, hi, re.sub(r"\s", "", text[lo:hi]), 0.95)
    for m in PGP_RAW.finditer(text):
        if not any(lo <= m.start() < hi for lo, hi in grouped):
            add("pgp", *m.span(), m[0].upper(), 0.8)
    for m in DOMAIN.finditer(text):
        before = text[max(0, m.start() - 8) : m.start()]
        if host_like(m[0], before):
            add("domain", *m.span(), m[0].lower(), 0.95 if before.lower().endswith(("://", "www.", "//")) else 0.9)
    for m in HANDLE.finditer(text):
        add("handle", *m.span(), m[0].lstrip("@").lower(), 0.85)
    for kind, lo, hi, value, confidence, _ in by_grammar(text) + by_role(text):
        add(kind, lo, hi, value, confidence)
    return sorted(((k, lo, hi, v, c) for (k, lo, hi), (v, c) in found.items()), key=lambda x: (x[1], x[2], x[0]))


#: What a text must hold for any extractor to find something; texts without it never reach Python.
ANY = (
    r"(?U)@[A-Za-z0-9]|://|(?i:www\.)|[A-Za-z0-9]\.[A-Za-z]|\.(?i:onion)|(?i:bc1)|[13][1-9A-HJ-NP-Za-km-z]{25}|0x[0-9A-Fa-f]{40}|[0-9A-F]{4}\s{1,2}[0-9A-F]{4}|[0-9A-Fa-f]{40}"
    rf"|@_|\s(?i:{'|'.join(PLATFORMS)})|(?i:{'|'.join(ROLES)})[\s:#@]"
)


def extract(documents: DataFrame) -> DataFrame:
    """doc_id, type, start, end, value, confidence of every entity of every whole text; a null text has none."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "type", "start", "end", "value", "confidence"]

    def run(batches):
        for b in batches:
            rows = [(i, *s) for i, t in zip(b["doc_id"], b["text"], strict=True) if t for s in spans(t)]
            yield pd.DataFrame(rows, columns=columns)

    return documents.select("doc_id", "text").filter(F.col("text").rlike(ANY)).mapInPandas(run, f"doc_id {kind}, type string, start long, end long, value string, confidence double")
