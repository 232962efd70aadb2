"""Sinks: registry, findings and report exports, content-addressed artifacts, the evidence package layout."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by ';', maps as key=count pairs in key order, for CSV; NULL stays an empty cell."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), ";").alias(f.name))
        elif kind == "map":
            out.append(F.array_join(F.transform(F.array_sort(F.map_entries(f.name)), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"].cast("string"))), ";").alias(f.name))
        elif kind == "struct":
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def stix_notes(claims: DataFrame, key: str, text: str) -> DataFrame:
    """One STIX 2.1 note for each claim as a JSON line; ids are UUIDs of version 5, built from SHA-1."""
    h = F.sha1(F.concat(F.lit(NAMESPACE.bytes), F.col(key).cast("string").cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    v5: Column = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    return claims.select(F.to_json(F.struct(F.lit("note").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("note--"), v5).alias("id"), F.col(text).alias("content"))).alias("value"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def corrupted(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored artifacts that are missing or whose bytes have another hash."""
    return stored.join(found.select("path", F.col("sha256").alias("now")), "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("path", "sha256", "now")


def write_packages(evidence: DataFrame, path: str, at: str = "collected_at") -> None:
    """year / month / case partitions."""
    evidence.withColumns({"year": F.year(at), "month": F.month(at)}).write.partitionBy("year", "month", "case_id").parquet(path)
