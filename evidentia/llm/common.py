"""Helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the six ASCII controls 09-0D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: ASCII letters, digits and everything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: what the cluster names, else (single machine) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="evidentia-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared scratch folder and reads it back: lineage ends there, and any
    lost executor's work is re-read rather than recomputed."""
    small_batches(df.sparkSession)
    path = f"{scratch_root(df.sparkSession)}/evidentia-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def held_out(key: Column, n: int, remainder: int) -> Column:
    """Whether a row belongs to the held-out fold. A null key is never held out."""
    return F.coalesce(crc_mod(key, n) == remainder, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, per_class: dict[int, int], fold: int = 5) -> tuple[DataFrame, dict[int, float]]:
    """A bounded training sample and the weight of a row of each class.

    Takes at most per_class[c] documents of class c, those with the smallest hash of doc_id, from rows outside
    the held-out fold (crc32 mod fold == 0). A doc_id with several labels takes the largest. Returns
    (doc_id, text, ..., y) rows and, for each class, labelled documents / sampled documents, which restores the
    true class frequencies."""
    # Only doc_id and the target are kept: other columns of labels may clash with those of documents.
    known = labels.select("doc_id", F.col(target).cast("int").alias("y")).dropna().filter(~held_out(F.col("doc_id"), fold, 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.filter(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in per_class.items() if totals.get(c)]
    weights = {c: max(1.0, totals[c] / per_class[c]) for c in per_class if totals.get(c)}
    if not parts:
        return documents.select("doc_id", "text").withColumn("y", F.lit(0)).limit(0), {}
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    # At most sum(per_class) ids of 12 bytes: the broadcast has a fixed bound.
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), weights


#: What a Python worker holds of a table at once: rows, and bytes where texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts are large rows: the default of 10,000 rows to a batch would be most of a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_text(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """mapInArrow over the named columns only. fn takes a RecordBatch and returns a RecordBatch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


#: Hashes that are broadcast at most (8 bytes each, some 24 in the executors' tables).
LISTED = 2_000_000


def listed(found: DataFrame, column: str) -> DataFrame | None:
    """The hashes in a column of found (a written table) as _listed, to be broadcast; None if there are more than
    LISTED, and callers shuffle instead. Results are the same."""
    return F.broadcast(found.select(F.col(column).alias("_listed")).distinct()) if found.count() <= LISTED else None
