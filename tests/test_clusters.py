"""Clusters against all pairs of candidates, as they are defined."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.functions.scores import hamming
from evidentia.operators import dedup


def defined(f, least_jaccard, most_bits):
    n = f.filter("hash is not null").dropDuplicates(["hash"])
    keys = n.withColumn("key", F.explode(F.concat(X.lsh_bands(F.col("minhash")), X.simhash_chunks(F.col("simhash")))))
    a, b = keys.alias("a"), keys.alias("b")
    near = (X.signature_jaccard(F.col("a.minhash"), F.col("b.minhash")) >= least_jaccard) | (hamming(F.col("a.simhash"), F.col("b.simhash")) <= most_bits)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.hash") < F.col("b.hash"))).filter(near).select("a.hash", "b.hash").distinct().collect()
    root = {r.hash: r.hash for r in n.select("hash").collect()}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        u, v = sorted((of(u), of(v)))
        root[v] = u
    return {r.doc_id: of(r.hash) for r in f.filter("hash is not null").select("doc_id", "hash").collect()}, len(pairs)


@pytest.mark.parametrize(("jaccard", "bits", "chunk"), [(0.8, 3, 512), (0.8, 3, 3), (0.5, 2, 4), (0.95, 1, 512)])
def test_clusters_are_those_of_all_candidates(spark, monkeypatch, jaccard, bits, chunk):
    monkeypatch.setattr(dedup, "CHUNK", chunk)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    near = d.filter("doc_id % 10 = 0").select((F.col("doc_id") * 100 + 100_000).alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"), "text")
    near = near.select((F.col("doc_id") + F.col("k")).alias("doc_id"), F.concat("text", F.repeat(F.concat(F.lit(" tail"), "k"), F.col("k"))).alias("text"))
    d = d.union(near).union(spark.createDataFrame([(-1, None), (-2, ""), (-3, " ")], "doc_id bigint, text string"))
    want, n = defined(dedup.fingerprinted(d).cache(), jaccard, bits)
    got = {r.doc_id: (r.representative, r.size) for r in dedup.cluster(d, jaccard, bits).collect()}
    sizes = {x: list(want.values()).count(x) for x in want.values()}
    assert n > 100 and got == {k: (x, sizes[x]) for k, x in want.items()}


def test_common_chunks_make_no_pairs(spark):
    """Fingerprints that share a chunk of 16 bits and nothing else used to meet pair by pair."""
    d = spark.range(4000).select(F.xxhash64("id").bitwiseAND(~0xFFFF).alias("first_bits"), "id").select(F.col("first_bits").alias("simhash"), F.col("id").cast("string").alias("hash"))
    met = dedup.dealt(d.select(F.explode(dedup.blocks_of(F.col("simhash"), 3)).alias("key"), "hash", "simhash"))
    assert met.count() < 40_000
