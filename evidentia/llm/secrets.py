"""Secret scans over many versions of many paths, by a ledger of blobs.

A version's text is a blob, named by its SHA-256. The ledger holds, for each blob, which rules of which version have
read it and what they found, so a scan reads one copy of each blob and runs only rules that the ledger lacks for it;
findings are joined back to every version with that content. A rule whose pattern changes gets a new version, and
its old findings are left out from then on.

How texts travel: most blobs have one version and are scanned where they are read. Blobs of several versions (on a
first scan) or unseen ones (later) are marked in a bitmap of bounded size that all tasks see; only texts that it marks
are brought together by blob, copies of a task collapsing before the shuffle. A bitmap that is too small marks more
texts and changes cost only, as both ways scan the same rules.

Defined results: a null text is the empty blob, which has no findings; versions of equal content, repeated rows
included, get equal findings; overlapping findings of different kinds all stay; a text of any length is scanned whole,
in time linear in its length; an empty table gives an empty ledger and no rows; other columns are kept by findings
unless they are called blob or spans, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import map_text, materialize


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern (in the ASCII-lowered text if fold) whose group has at least so many
    characters. hints: one of these is in every match."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False
    hints: tuple[bytes, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern.encode())

    def spans(self, raw: bytes, lowered: bytes) -> Iterable[tuple[int, int]]:
        text = lowered if self.fold else raw
        if self.hints and not any(h in text for h in self.hints):
            return
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: Fixed values of the contract: the first three kinds. The others are published formats of well-known credentials.
#: All of a match's characters are ASCII, or (url) any but ASCII marks, so bytes and characters agree.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", 6, 2, True, (b"password", b"passwd", b"secret", b"token", b"api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, hints=(b"AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=(b"-----BEGIN ",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 40, hints=(b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]+", 24, hints=(b"xox",)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]+", 39, hints=(b"AIza",)),
    Rule("url", 1, r"://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", hints=(b"://",)),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, scanned array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"
#: Bits a marked blob gets in the bitmap, and the greatest bitmap: 2^27 bits are 16 MB.
BITS_PER_BLOB, MOST_BITS = 16, 1 << 27


def scan_text(raw: bytes, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, end exclusive, by start and then by the rules' order."""
    lowered = raw.lower()
    found = sorted((a, k, b) for k, r in enumerate(rules) for a, b in r.spans(raw, lowered))
    if not found:
        return []
    at, done, points = {}, 0, 0
    for p in sorted({p for a, _, b in found for p in (a, b)}):
        points += len(raw[done:p].decode())
        at[p], done = points, p
    return [(rules[k].name, at[a], at[b]) for a, k, b in found]


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def address(versions: DataFrame) -> DataFrame:
    """Every version's blob beside its other columns, without its text."""
    return versions.withColumn("blob", blob_of(F.col("text"))).drop("text")


def pending(addressed: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, versions, todo) of each blob that rules haven't read yet; todo: their names, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = addressed.groupBy("blob").agg(F.count(F.lit(1)).alias("versions"))
    if ledger is None:
        return blobs.withColumn("todo", F.array_join(names, ","))
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))  # as long as the blob's scans
    todo = F.filter(names, lambda r: ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), r))
    return blobs.join(seen, "blob", "left").select("blob", "versions", F.array_join(todo, ",").alias("todo")).filter(F.col("todo") != "")


def bitmap(blobs: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bits) rows of a bitmap that marks the blobs, and its number of bits: at most MOST_BITS."""
    n = max(1, blobs.count())
    bits = min(MOST_BITS, 1 << max(15, math.ceil(math.log2(BITS_PER_BLOB * n))))
    place = F.pmod(F.xxhash64("blob"), F.lit(bits))
    return blobs.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")), bits


def marked(rows: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """rows with the column marked: whether the bitmap marks their blob."""
    rows = rows.withColumn("place", F.pmod(F.xxhash64("blob"), F.lit(bits)))
    position = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1
    # The bitmap has at most MOST_BITS bits, whatever the table's size.
    return rows.join(F.broadcast(marks.withColumnRenamed("bucket", "_bucket")), F.bitmap_bucket_number("place") == F.col("_bucket"), "left").withColumn("marked", F.coalesce(bit, F.lit(False))).drop("place", "_bucket", "bits")


def _scanned(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows of (blob, text, todo) rows."""
    known = {r.name: r for r in rules}

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        chosen: dict[str, list[Rule]] = {}
        todo = b.column("todo").to_pylist()
        lists, spans = [], []
        for raw, names in zip(b.column("text").cast(pa.binary()).to_pylist(), todo, strict=True):
            own = chosen.setdefault(names, [known[x] for x in names.split(",") if x])
            lists.append([r.name for r in own])
            spans.append([{"rule": r, "start": s, "end": e} for r, s, e in scan_text(raw or b"", own)])
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([b.column("blob"), pa.array(lists, pa.list_(pa.string())), pa.array(spans, kind)], names=["blob", "scanned", "spans"])

    return map_text(texts, ["blob", "text", "todo"], scan, LEDGER)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The new rows of the ledger (written to the scratch folder): one for each blob that some rules hadn't read."""
    todo = materialize(pending(versions.select(blob_of(F.col("text")).alias("blob")), ledger, rules), "pending")
    rows = versions.select(blob_of(F.col("text")).alias("blob"), "text")
    first = ledger is None
    rows = marked(rows, *bitmap(todo.filter("versions > 1") if first else todo))
    together = rows.filter("marked").groupBy("blob").agg(F.first("text").alias("text"))
    if first:
        alone = rows.filter("not marked").select("blob", "text")
        every = ",".join(r.name for r in rules)
        return materialize(_scanned(alone.unionByName(together).withColumn("todo", F.lit(every)), rules), "ledger")
    return materialize(_scanned(together.join(todo, "blob"), rules), "ledger")


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every version (its columns but text) with blob and spans, an array of (start, end, kind) of the rules' versions
    by start and then the rules' order."""
    names = F.array(*[F.lit(r.name) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["rule"]).alias("rank"), s["end"].alias("end")))
    found = ledger.select("blob", F.filter(ranked, lambda s: s["rank"] > 0).alias("spans")).filter(F.size("spans") > 0)
    # Written, so that the join's sides are plain exchanges and a blob of very many versions can be split.
    found = materialize(found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")), "found")
    found = found.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(kinds, s["rank"].cast("int")).alias("kind"))).alias("spans"))
    rest = [c for c in versions.columns if c not in ("text", "blob", "spans")]
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    return address(versions.select(*rest, "text")).join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in a shared folder, created empty if it isn't there."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def update(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scans what the ledger at path lacks, appends it there in one committed job, and returns the versions' findings. A
    run that fails before the commit leaves the ledger as it was; the next one scans those blobs again."""
    spark = versions.sparkSession
    scan(versions, open_ledger(spark, path), rules).write.mode("append").parquet(path)
    return findings(versions, open_ledger(spark, path), rules)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the base kinds' counts, base_sha256 and spans of findings."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(written(of(*BASE)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
