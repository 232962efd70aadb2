"""Frozen feature snapshots with fingerprints, and a keyed store that is changed by staged writes and a manifest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprinted(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows with fingerprint: the SHA-256 of the columns' names and values in the order of the names; NULL is a value of
    its own, and lengths keep neighbours apart."""
    part = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")))
    return rows.withColumn("fingerprint", F.sha2(F.concat_ws(";", *[part(c) for c in sorted(columns or rows.columns)]).cast("binary"), 256))


def freeze(features: DataFrame, keys: list[str], at: str, as_of: datetime) -> DataFrame:
    """What was known at a time: of each key the last row not after it (of equal times that of the greatest fingerprint),
    with its fingerprint. Combined before the shuffle, so a key of very many rows is one row there."""
    known = fingerprinted(features.filter(F.col(at) <= F.lit(as_of).cast("timestamp_ntz")))
    last = known.groupBy(*keys).agg(F.max_by(F.struct(*known.columns), F.struct(at, "fingerprint")).alias("x"))
    return last.select("x.*")


def dataset_fingerprint(frozen: DataFrame) -> DataFrame:
    """(n_rows, digest) of a snapshot: a sum over the rows' fingerprints that no order changes."""
    mark = F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("bigint")
    return frozen.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(mark), F.lit(0)).alias("digest"))


def differences(frozen: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of a later freeze against an earlier one: added, removed or changed; none if it still holds."""
    a = frozen.select(*keys, F.col("fingerprint").alias("_a"))
    b = now.select(*keys, F.col("fingerprint").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return a.join(b, keys, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, change.alias("change"))


class Store:
    """Rows by key in a shared folder: data/batch=../part=.. and manifest/version=...

    A change rewrites the parts that it touches under a new batch and then writes the next manifest, which says the
    batch of every part. Readers follow the greatest manifest. A run that dies before the manifest leaves unread
    files; one writer at a time. parts is fixed when the store is made and bounds the manifest."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, newest: str, parts: int = 64):
        self.spark, self.path, self.schema, self.key, self.newest, self.parts = spark, path, schema, key, newest, parts
        spark.createDataFrame([], "part int, batch string, version int").write.mode("ignore").partitionBy("version").parquet(f"{path}/manifest")
        spark.createDataFrame([], f"{schema}, batch string, part int").write.mode("ignore").partitionBy("batch", "part").parquet(f"{path}/data")

    def manifest(self) -> tuple[int, dict[int, str]]:
        """The version and the batch of each part: at most `parts` rows."""
        m = self.spark.read.schema("part int, batch string, version int").parquet(f"{self.path}/manifest")
        version = m.agg(F.max("version")).first()[0] or 0
        return version, {r["part"]: r["batch"] for r in m.filter(F.col("version") == version).collect()}

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The rows that the manifest holds (of some parts); partition pruning leaves other batches unread."""
        live = {p: b for p, b in self.manifest()[1].items() if parts is None or p in parts}
        data = self.spark.read.schema(f"{self.schema}, batch string, part int").parquet(f"{self.path}/data")
        on = F.lit(False)
        for p, b in live.items():
            on |= (F.col("part") == p) & (F.col("batch") == b)
        return data.filter(on).drop("batch", "part")

    def upsert(self, rows: DataFrame) -> int:
        """Puts rows in by key; of several with one key, stored or new, that of the greatest `newest` stays (then that of
        the greatest fingerprint). The same rows again change nothing. Returns the manifest's version."""
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        stored = self.read()
        new = rows.select(*stored.columns)
        last = lambda d: fingerprinted(d).groupBy(self.key).agg(F.max_by(F.struct(*d.columns), F.struct(self.newest, "fingerprint")).alias("x")).select("x.*")
        fresh = fingerprinted(last(new)).join(fingerprinted(stored).select("fingerprint"), "fingerprint", "left_anti").drop("fingerprint").withColumn("part", part)
        touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # at most `parts`
        version, live = self.manifest()
        if not touched:
            return version
        batch = f"{version + 1:08d}"
        merged = last(self.read(touched).unionByName(fresh.drop("part"))).withColumn("part", part)
        # Only this batch's folders are replaced, so a run that is tried again after a failure leaves no rows twice.
        merged.withColumn("batch", F.lit(batch)).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(f"{self.path}/data")
        entries = [(p, b, version + 1) for p, b in (live | dict.fromkeys(touched, batch)).items()]
        self.spark.createDataFrame(entries, "part int, batch string, version int").coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.path}/manifest")
        return version + 1
