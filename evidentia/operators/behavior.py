"""Behaviour profiles of subjects, and how alike two are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scores as S
from evidentia.operators import blocks


def gaps(events: DataFrame) -> DataFrame:
    """Adds gap: seconds since the subject's previous event."""
    w = Window.partitionBy("subject_id").orderBy("observed_at", "event_id")
    return events.withColumn("gap", S.seconds(F.col("observed_at")) - S.seconds(F.lag("observed_at").over(w)))


def burstiness(g: DataFrame) -> DataFrame:
    """(sigma - mean) / (sigma + mean) of the gaps, from -1 to 1; 0 below two gaps."""
    a = g.groupBy("subject_id").agg(F.count("gap").alias("k"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mean"))
    value = F.when((F.col("k") < 2) | (F.col("sd") + F.col("mean") == 0), 0.0).otherwise((F.col("sd") - F.col("mean")) / (F.col("sd") + F.col("mean")))
    return a.select("subject_id", value.alias("burstiness"))


def profile(events: DataFrame) -> DataFrame:
    """One row for each subject: hour and weekday histograms (shares), kinds, rate a day, burstiness, from one
    aggregation and the gaps."""
    hour = [F.avg((F.hour("observed_at") == h).cast("double")) for h in range(24)]
    day = [F.avg((F.weekday("observed_at") == d).cast("double")) for d in range(7)]
    span = F.greatest(F.lit(1.0), (S.seconds(F.max("observed_at")) - S.seconds(F.min("observed_at"))) / 86400)
    p = events.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.array(*hour).alias("hours"), F.array(*day).alias("days"), (F.count(F.lit(1)) / span).alias("rate"), F.count_distinct(F.col("observed_at").cast("date")).alias("active_days"))
    return p.join(burstiness(gaps(events)), "subject_id")


def jensen_shannon(a: Column, b: Column) -> Column:
    """Base 2, of two arrays of equal length, each made to sum to one; 0 for two zero arrays, 1 for one."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    sa, sb = total(a), total(b)
    terms = F.zip_with(a, b, lambda x, y: part(x / sa, (x / sa + y / sb) / 2) / 2 + part(y / sb, (x / sa + y / sb) / 2) / 2)
    return F.when((sa == 0) & (sb == 0), 0.0).when((sa == 0) | (sb == 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total(terms))))


def shares_of_hours(t):
    """What divergences needs of a block of profiles (hours): known ones, shares that sum to one, totals, entropies."""
    known, m, _ = blocks.vectors(t["hours"].combine_chunks())
    total = m.sum(1)
    p = np.divide(m, total[:, None], out=np.zeros_like(m), where=total[:, None] != 0)
    return known, p, total, (p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(1)


def divergences(a, b) -> np.ndarray:
    """jensen_shannon of every pair: the entropy of the mean less the mean entropy, hour by hour."""
    (p, sp, ep), (q, sq, eq) = a, b
    out = (ep[:, None] + eq) / 2
    for h in range(p.shape[1]):
        m = (p[:, h, None] + q[:, h]) / 2
        out -= m * np.log2(m, out=np.zeros_like(m), where=m > 0)
    out = np.clip(out, 0.0, 1.0)
    x, y = (sp == 0)[:, None], sq == 0
    out[x | y] = 1.0
    out[x & y] = 0.0
    return out


def chi_square(a: Column, b: Column) -> Column:
    return F.sqrt(0.5 * F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v))


#: Weights of the compared channels.
WEIGHTS = {"hours": 1.5, "days": 1.0, "rate": 1.0, "burstiness": 1.0}


def compare(l: str = "l", r: str = "r") -> Column:  # noqa: E741
    """The weighted likeness of two joined profiles, aliased l and r."""
    c = lambda side, name: F.col(f"{side}.{name}")
    parts = {"hours": S.cosine(c(l, "hours"), c(r, "hours")), "days": S.cosine(c(l, "days"), c(r, "days")), "rate": S.scalar_similarity(c(l, "rate"), c(r, "rate")), "burstiness": S.scalar_similarity(c(l, "burstiness"), c(r, "burstiness"))}
    return F.round(sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0)) / sum(WEIGHTS.values()), 6)


def refusals(p: DataFrame, min_events: int = 8, min_days: int = 3) -> DataFrame:
    """subject_id and why a subject isn't scored; NULL where it is."""
    return p.select("subject_id", F.when(F.col("n") < min_events, "too few events").when(F.col("active_days") < min_days, "too few days").alias("reason"))
