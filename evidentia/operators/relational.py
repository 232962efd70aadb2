"""Relational building blocks of the registry, case and dashboard views."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.dedup import checkpointed


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given; true without any."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def contains_ci(column: str, term: str) -> Column:
    """Case-insensitive substring, the term taken literally."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def within(column: str, since: datetime | None = None, until: datetime | None = None) -> Column:
    """Inclusive time window, either side open."""
    c = F.col(column)
    return all_of(c >= F.lit(since).cast("timestamp_ntz") if since else None, c <= F.lit(until).cast("timestamp_ntz") if until else None)


def at_least(column: str, floor: float) -> Column:
    """Assessed and not below the floor: NULL is no score."""
    return F.col(column).isNotNull() & (F.col(column) >= floor)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order, which should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def zero_filled(counts: DataFrame, vocabulary: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Every declared value, with 0 where nothing was counted. The vocabulary is a declared list, and small."""
    return vocabulary.join(counts, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0)).cast("bigint"))


def month_velocity(df: DataFrame, column: str, until: datetime, months: int) -> DataFrame:
    """month, n, delta: counts of the months up to until, zero-filled; the first delta is NULL. The calendar has as
    many rows as months are asked for."""
    spark = df.sparkSession
    last = until.strftime("%Y-%m-01")
    calendar = spark.sql(f"select explode(sequence(add_months(date'{last}', {-months}), date'{last}', interval 1 month)) month")
    low, high = calendar.agg(F.min("month"), F.add_months(F.max("month"), 1)).first()
    counts = df.filter((F.col(column) >= F.lit(low).cast("timestamp_ntz")) & (F.col(column) < F.lit(high).cast("timestamp_ntz"))).groupBy(F.trunc(F.col(column).cast("date"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("month")  # months + 1 rows
    return zero_filled(counts, calendar, ["month"]).withColumn("delta", F.col("n") - F.lag("n").over(w))


def week_start(column: str) -> Column:
    """Monday 00:00 of the week, as a date."""
    return F.trunc(F.col(column).cast("date"), "week")


def merge_edges(edges: DataFrame, symmetric: Column) -> DataFrame:
    """Edges of one key become one: window union, greatest confidence, evidence in the order first seen. The endpoints
    of a symmetric edge are folded."""
    a, b = F.col("source"), F.col("target")
    folded = edges.filter("source <> target").select("rel_type", F.when(symmetric, F.least(a, b)).otherwise(a).alias("source"), F.when(symmetric, F.greatest(a, b)).otherwise(b).alias("target"), "first_seen", "last_seen", "confidence", "evidence_id")
    return folded.groupBy("rel_type", "source", "target").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("confidence").alias("confidence"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("first_seen", "evidence_id"))), lambda x: x["evidence_id"])).alias("evidence_ids"),
    )


def missing_keys(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to ingest: duplicates inside the batch and rows already stored (NULL equals NULL) are skipped."""
    n = new.dropDuplicates(list(keys))
    match = reduce(lambda a, b: a & b, [n[k].eqNullSafe(stored[k]) for k in keys])
    return n.join(stored.select(*keys), match, "left_anti")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of every broken rule; a rule that is NULL is broken."""
    broken = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


#: Pairs that a cell of overlap_join tries on average if there are cores for more cells of a bucket, such cells for each
#: core, and windows that a cell holds: beyond these, more cells would only be more copies of the rows.
PAIRS_A_CELL, CELLS_A_CORE, WINDOWS_HELD = 20_000_000, 16, 1_000_000


def overlap_join(left: DataFrame, right: DataFrame, bucket_days: int = 7) -> DataFrame:
    """Pairs of (id, start, end) rows whose closed windows meet. Either the left window starts in the right one, or the
    right one later in the left one, so starts are joined with windows in the bucket of days where the start lies: a pair
    is tried in one bucket for each case.

    A bucket's starts are dealt into rows and its windows into columns of a grid, as many as keep a cell small: few
    buckets may hold almost all windows."""
    at = lambda c: F.floor(F.unix_date(c.cast("date")) / bucket_days).cast("int")
    named = lambda d, p: checkpointed(d.filter("start <= end").select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "start", "end")]), "windows")
    l, r = named(left, "l"), named(right, "r")

    def starts_in(a: DataFrame, x: str, b: DataFrame, y: str, later: bool) -> DataFrame:
        starts = a.withColumn("_bucket", at(F.col(f"{x}_start")))
        windows = b.withColumn("_bucket", F.explode(F.sequence(at(F.col(f"{y}_start")), at(F.col(f"{y}_end")))))
        count = lambda d, n: d.groupBy("_bucket").agg(F.count(F.lit(1)).alias(n))
        cores = left.sparkSession.sparkContext.defaultParallelism
        cells = F.greatest(F.ceil(F.col("b") / WINDOWS_HELD), F.least(F.ceil(F.col("a") * F.col("b") / PAIRS_A_CELL), F.lit(CELLS_A_CORE * cores)))
        of = count(starts, "a").join(count(windows, "b"), "_bucket").withColumn("across", F.least(cells, F.greatest(F.lit(1), F.round(F.sqrt(cells * F.col("a") / F.col("b"))))).cast("int"))
        # A row a bucket.
        of = checkpointed(of.select("_bucket", "across", F.ceil(cells / F.col("across")).cast("int").alias("down")), "grid")
        n = of.agg(F.sum(F.col("across") * F.col("down"))).first()[0] or 1
        block = lambda p, c: F.pmod(F.xxhash64(f"{p}_id", f"{p}_start", f"{p}_end"), F.col(c)).cast("int")
        dealt = lambda d, first, last, step: d.join(of, "_bucket").select(*d.columns, F.explode(F.sequence(first, last, step)).alias("_cell")).repartition(2 * n, "_bucket", "_cell")
        row, column, down = block(x, "across"), block(y, "down"), F.col("down")
        pairs = dealt(starts, row * down, (row + 1) * down - 1, F.lit(1)).join(dealt(windows, column, column + (F.col("across") - 1) * down, down).hint("shuffle_hash"), ["_bucket", "_cell"])
        start, since = F.col(f"{x}_start"), F.col(f"{y}_start")
        return pairs.filter((start > since if later else start >= since) & (start <= F.col(f"{y}_end"))).select(*[f"{p}_{c}" for p in "lr" for c in ("id", "start", "end")])

    return starts_in(l, "l", r, "r", False).unionByName(starts_in(r, "r", l, "l", True))


def against(rows: DataFrame, asked: DataFrame, size: int = 500) -> DataFrame:
    """Every row beside every asked row (a struct q). Asked rows come in blocks of about size, so that rows are read
    once for each block and Spark may broadcast the blocks or spread them."""
    n = max(1, math.ceil(asked.count() / size))
    blocks = asked.groupBy(F.pmod(F.xxhash64(*asked.columns), F.lit(n)).alias("_block")).agg(F.collect_list(F.struct(*asked.columns)).alias("_asked"))
    return rows.crossJoin(blocks.select("_asked")).select(*rows.columns, F.explode("_asked").alias("q"))
