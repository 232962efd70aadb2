"""Activity series, change points and state changes of subjects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def activity_series(events: DataFrame, bucket: str = "day") -> DataFrame:
    """subject_id, bucket, n: counts of each subject between its first and last bucket, gaps as 0."""
    c = events.groupBy("subject_id", F.date_trunc(bucket, "observed_at").cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    span = c.groupBy("subject_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = span.select("subject_id", F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {bucket}"))).alias("bucket"))
    return grid.join(c, ["subject_id", "bucket"], "left").select("subject_id", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def ks_by_rows(sample: DataFrame, value: str, side: str, key: str) -> DataFrame:
    """key, ks: the greatest distance of the two sides' distribution functions; ties count at once."""
    c = sample.groupBy(key, value).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    w = Window.partitionBy(key).orderBy(value)
    t = Window.partitionBy(key)
    run = c.select(key, (F.sum("a").over(w) / F.sum("a").over(t)).alias("fa"), (F.sum("b").over(w) / F.sum("b").over(t)).alias("fb"))
    return run.groupBy(key).agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("ks"))


def best_cuts(series: DataFrame, min_size: int = 3) -> DataFrame:
    """subject_id, cut, gain: the cut of the greatest mean-shift gain nl*nr/(nl+nr)*(difference of means)^2, the first
    of equals, from prefix sums."""
    w = Window.partitionBy("subject_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = Window.partitionBy("subject_id")
    p = series.select("subject_id", "bucket", F.sum("n").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("k"), F.sum("n").over(t).alias("all"), F.count(F.lit(1)).over(t).alias("len"))
    r = F.col("len") - F.col("k")
    gain = F.col("k") * r / F.col("len") * F.pow(F.col("s") / F.col("k") - (F.col("all") - F.col("s")) / r, 2)
    ok = p.filter((F.col("k") >= min_size) & (r >= min_size)).withColumn("gain", gain)
    return ok.groupBy("subject_id").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("k")).alias("k"))).alias("x")).select("subject_id", (-F.col("x.k")).alias("cut"), F.col("x.gain").alias("gain"))


def cusum(values: Column, drift: float = 1.0, threshold: float = 5.0, reference: Column | None = None) -> Column:
    """The places (from 0) of alarms in an ordered array: sums of deviations above and below the reference (the mean
    unless given), less the drift; an alarm beyond the threshold, tested upwards first, resets both."""
    mean = reference if reference is not None else F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)

    def step(s, x):
        d = x["v"] - x["m"]
        up, down = F.greatest(F.lit(0.0), s["up"] + d - drift), F.greatest(F.lit(0.0), s["down"] - d - drift)
        hit = (up > threshold) | (down > threshold)
        return F.struct(F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(down).alias("down"), F.when(hit, F.concat(s["at"], F.array(x["i"]))).otherwise(s["at"]).alias("at"))

    # The mean is bound once, outside the scan.
    items = F.element_at(F.transform(F.array(mean), lambda m: F.transform(values, lambda v, i: F.struct(v.cast("double").alias("v"), m.cast("double").alias("m"), i.cast("int").alias("i")))), 1)
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(items, start, step, lambda s: s["at"])


def series_array(series: DataFrame) -> DataFrame:
    return series.groupBy("subject_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"].cast("double")).alias("values"))


def segments_of(values: np.ndarray, min_size: int = 3, min_gain: float = 1.0) -> list[int]:
    """Cuts of binary segmentation by mean-shift gain, ascending, from prefix sums."""
    total = np.r_[0.0, np.cumsum(values)]
    cuts, todo = [], [(0, len(values))]
    while todo:
        lo, hi = todo.pop()
        k = np.arange(lo + min_size, hi - min_size + 1)
        if not len(k):
            continue
        left, right = k - lo, hi - k
        gain = left * right / (hi - lo) * ((total[k] - total[lo]) / left - (total[hi] - total[k]) / right) ** 2
        best = int(gain.argmax())
        if gain[best] > min_gain:
            cuts.append(int(k[best]))
            todo += [(lo, int(k[best])), (int(k[best]), hi)]
    return sorted(cuts)


def binary_segmentation(series: DataFrame, min_size: int = 3, min_gain: float = 1.0) -> DataFrame:
    """subject_id, cut of every change of level; a subject's series is one group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bucket")
        cuts = segments_of(g["n"].to_numpy(float), min_size, min_gain)
        return pd.DataFrame({"subject_id": [g["subject_id"].iloc[0]] * len(cuts), "cut": cuts})

    return series.groupBy("subject_id").applyInPandas(run, f"subject_id {series.schema['subject_id'].dataType.simpleString()}, cut long")


def confirmed_changes(values: list, persist: int = 2) -> list[tuple[int, object, object]]:
    """(place, before, after) of changes that the next values confirm: persist equal values in all. The comparison is
    with the last confirmed value, so a flap moves nothing."""
    out, held = [], values[0] if values else None
    for i in range(1, len(values)):
        if values[i] != held and i + persist <= len(values) and all(v == values[i] for v in values[i : i + persist]):
            out.append((i, held, values[i]))
            held = values[i]
    return out


def state_changes(events: DataFrame, persist: int = 2) -> DataFrame:
    """subject_id, event_id, before, after of every confirmed change of value."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("subject_id", "event_id")}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["observed_at", "event_id"])
        found = confirmed_changes(g["value"].tolist(), persist)
        return pd.DataFrame([(g["subject_id"].iloc[0], g["event_id"].iloc[i], a, b) for i, a, b in found], columns=["subject_id", "event_id", "before", "after"])

    return events.select("subject_id", "event_id", "observed_at", "value").groupBy("subject_id").applyInPandas(run, f"subject_id {kinds['subject_id']}, event_id {kinds['event_id']}, before string, after string")


def migrations(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Of each change, the share of the subject's later events that are still at the destination."""
    e = events.select("subject_id", F.col("event_id").alias("e"), F.col("observed_at").alias("t"), "value")
    c = changes.join(e.select("subject_id", F.col("e").alias("event_id"), F.col("t").alias("changed_at")), ["subject_id", "event_id"])
    j = c.join(e, "subject_id").filter(F.col("t") > F.col("changed_at"))
    return j.groupBy("subject_id", "event_id", "before", "after").agg(F.round(F.avg((F.col("value") == F.col("after")).cast("double")), 6).alias("confidence"), F.count(F.lit(1)).alias("later"))
