"""The hash-chained audit log."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("occurred_at", "action", "entity_type", "entity_id", "payload")


def entry_hash(prev: Column, *fields: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, *fields).cast("binary"), 256)


def append(entries: DataFrame, prev: str = "") -> DataFrame:
    """Chains entries in seq order. Each hash needs the one before, so the batch goes through one ordered task in a
    stream; only the current hash is held."""

    def run(batches):
        last = prev
        for b in batches:
            out = []
            for row in b[list(FIELDS)].itertuples(index=False):
                h = hashlib.sha256("|".join([last, *(str(x) for x in row)]).encode()).hexdigest()
                out.append((last, h))
                last = h
            b["prev_hash"], b["entry_hash"] = [x for x, _ in out], [x for _, x in out]
            yield b

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    return entries.repartition(1).sortWithinPartitions("seq").mapInPandas(run, schema + ", prev_hash string, entry_hash string")


def verify(log: DataFrame, chain: str | None = None) -> DataFrame:
    """seq and what is wrong: 'hash' where the stored hash isn't that of the row, 'link' where prev_hash isn't the
    hash before. Checking needs only each row and its neighbour."""
    w = Window.partitionBy(*([chain] if chain else [])).orderBy("seq")
    bad_hash = F.col("entry_hash") != entry_hash(F.col("prev_hash"), *[F.col(f).cast("string") for f in FIELDS])
    bad_link = F.col("prev_hash") != F.coalesce(F.lag("entry_hash").over(w), F.col("prev_hash"))
    return log.select("seq", F.when(bad_hash, "hash").when(bad_link, "link").alias("fault")).filter("fault is not null")


def latency_histogram(df: DataFrame, ms: str, edges: tuple[float, ...] = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500)) -> DataFrame:
    """bucket (the first edge not below the value; -1 beyond all), n."""
    b = None
    for e in edges:
        b = F.when(F.col(ms) <= e, float(e)) if b is None else b.when(F.col(ms) <= e, float(e))
    return df.groupBy(b.otherwise(-1.0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
