"""Merkle manifest of a dataset: a tree for each group, built level by level in windows, and a tree over their roots.

A level's window is partitioned by group and parent index; its ordered full-frame collect_list holds the digests of
one run of nodes, which is both the parent's preimage and every node's siblings. Only the first row of each node puts
its digest into the list, so parents are deduplicated before the next level looks at them.

Rows are taken in blocks of consecutive leaves (arity ^ depth of them): a block's rows lie in one partition, sorted
once, and all windows of its levels follow without another shuffle. Of a block only its topmost digest goes on, one
row for very many, so a tree of n leaves takes log n / depth rounds, and proofs go down the same way: a block's rows
meet one row with what is above it. No group, however large, is ever in one task, and nothing but a greatest count
reaches the driver.

Defined results: leaves of a group ascend by doc_id, null first, then by leaf digest; rows that repeat are leaves of
their own; a null group is a group like others and comes first; a null value is "-"; texts of any length are hashed
whole; an empty table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import crc_mod, materialize

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ARITY, DEPTH = 2, 10


def encoded(value: Column) -> Column:
    """A value of a leaf: its length in bytes, a colon and itself, or a dash for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def group_key(value: Column) -> Column:
    """A string that is never null; keys order as the values do, bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """(group, ...) rows with at, their place within the group from 0 in that order, and n, the group's size.

    Rows are dealt by ranges of (group, order) and written; a place is the number of the group's rows in the ranges
    before plus the row number within its own, so a group of any size is spread."""
    ties = F.monotonically_increasing_id()
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.withColumn("_tie", ties).repartitionByRange(ranges, "group", *order, "_tie").withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt.drop("_tie"), "ranges")
    own = Window.partitionBy("group")
    counts = dealt.groupBy("group", "_range").agg(F.count(F.lit(1)).alias("_rows"))  # a group has as many rows as ranges
    counts = counts.select("group", "_range", F.coalesce(F.sum("_rows").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_rows").over(own).alias("n"))
    number = F.row_number().over(Window.partitionBy("group", "_range").orderBy(*order))
    return materialize(dealt.withColumn("_number", number).join(counts, ["group", "_range"]).withColumn("at", F.col("_before") + F.col("_number") - 1).drop("_range", "_number", "_before"), "positions")


def climb(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """(group, at, n, digest, ...) rows with block, steps and top.

    steps: for each of the depth levels above a node that its group has, the joined digests of its siblings before and
    after it. top: on each block's first row, the digest of the node that the block has become."""
    span = arity**depth
    d = nodes.withColumn("block", F.floor(F.col("at") / span)).repartition("group", "block").withColumn("_node0", F.col("digest"))
    # Parent indices, top first: the same order serves every level's window, so rows are sorted once.
    parents = [f"_parent{k}" for k in range(depth, 0, -1)]
    d = d.withColumns({f"_parent{k}": F.floor(F.col("at") / arity**k) for k in range(1, depth + 1)})
    for k in range(depth):
        width = arity**k
        above = parents[: depth - k]  # the last of them is this level's parent index; it fixes those before it
        w = Window.partitionBy("group", "block", *above).orderBy(*parents[depth - k :], "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = d.withColumn(f"_run{k}", F.collect_list(F.when(F.col("at") % width == 0, F.col(f"_node{k}"))).over(w))
        # A group of one node has no more levels: its node stays.
        d = d.withColumn(f"_node{k + 1}", F.when(F.col("n") <= width, F.col(f"_node{k}")).when(F.col("at") % (width * arity) == 0, F.sha2(F.array_join(f"_run{k}", ""), 256)))

    def step(k: int) -> Column:
        place = (F.floor(F.col("at") / arity**k) % arity).cast("int")
        run = F.col(f"_run{k}")
        return F.when(F.col("n") > arity**k, F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("before"), F.array_join(F.slice(run, place + 2, F.lit(arity)), "").alias("after")))

    return d.withColumn("steps", F.array_compact(F.array(*[step(k) for k in range(depth)]))).withColumn("top", F.col(f"_node{depth}")).select(*nodes.columns, "block", "steps", "top")


def ascend(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> list[DataFrame]:
    """The nodes themselves, then those of every depth-th level above them, up to one node for each group."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > 1:
        tops = climb(levels[-1].select("group", "at", "n", "digest"), arity, depth).filter(F.col("at") % arity**depth == 0)
        levels.append(materialize(tops.select("group", F.col("block").alias("at"), F.ceil(F.col("n") / arity**depth).alias("n"), F.col("top").alias("digest")), "level"))
    return levels


def descend(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """The lowest level's rows with steps up to the root, and the other columns of tops: (group, steps, ...), one row for
    each group with what lies above its last node."""
    more = [c for c in tops.columns if c not in ("group", "steps")]
    if len(levels) == 1:
        return levels[0].join(tops, "group")
    above = levels[-1].select("group", F.col("at").alias("block")).join(tops, "group").withColumnRenamed("steps", "_above")
    for k in range(len(levels) - 2, -1, -1):
        own = climb(levels[k], arity, depth).drop("top").join(above, ["group", "block"])
        own = own.withColumn("steps", F.concat("steps", "_above")).drop("_above")
        if k:
            above = materialize(own.select("group", F.col("at").alias("block"), F.col("steps").alias("_above"), *more), "above")
    return own.drop("block")


def prove(leaves: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """(group, doc_id, digest, ...) rows with at, n, steps (siblings up to the root), subroot and root."""
    levels = ascend(positions(leaves, ["doc_id", "digest"]), arity, depth)
    subroots = levels[-1].select(F.lit("").alias("group"), F.col("group").alias("key"), "digest")
    forest = ascend(positions(subroots, ["key"]), arity, depth)
    none = F.array().cast("array<struct<before:string,after:string>>")
    root = forest[-1].select("group", F.col("digest").alias("root"), none.alias("steps"))
    tops = descend(forest, root, arity, depth).select(F.col("key").alias("group"), F.col("digest").alias("subroot"), "root", "steps")
    return descend(levels, materialize(tops, "subroots"), arity, depth)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda node, s: digest_of(s["before"], node, s["after"]))


def leaves_of(documents: DataFrame, group: str = "lang") -> DataFrame:
    """(group, doc_id, digest, tampered) of each row. tampered: the digest with n_chars one greater, where 7 divides
    the crc32 of doc_id and n_chars isn't null; else null."""
    leaf = digest_of(*[encoded(F.col(c)) for c in FIELDS])
    changed = digest_of(*[encoded(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS])
    hit = (crc_mod(F.col("doc_id"), 7) == 0) & F.col("n_chars").isNotNull()
    return documents.select(group_key(F.col(group)).alias("group"), "doc_id", leaf.alias("digest"), F.when(hit, changed).alias("tampered"))


def verify(documents: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """Per document its leaf, subroot, root, the digest of its proof, the root folded from the (tampered) leaf, and
    whether that is the root."""
    d = prove(materialize(leaves_of(documents), "leaves"), arity, depth)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    d = d.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("steps")).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))
