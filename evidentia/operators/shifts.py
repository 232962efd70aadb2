"""Change reports over streams: activity shifts, confirmed state changes, regimes, and refusals of what is too short.

A stream is (case_id, subject_id, channel, event_id, observed_at, value): channel `activity` is counted in buckets, any
other channel is a track of states. Every report has a second output of refusals, one row for each stream that is too
short for its detector, so that "not analysed" never looks like "not changed".

Activity is counted by bucket before anything else, so a stream of any number of events is as long as its span of
time. States are followed over ranges of time: each range reduces its events to runs of equal values and drops those
that can't confirm anything, and only these pieces of a subject meet, so one busy subject is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.dedup import checkpointed

KEYS = ["case_id", "subject_id", "channel"]
#: The least gain of a cut by KS distance and by mean shift in reports, and the detector's own defaults.
SERVICE_MIN_GAIN = {"ks": 0.6, "binary_segmentation": 100.0}
DETECTOR_MIN_GAIN = {"ks": 0.3, "binary_segmentation": 1.0}
DRIFT, THRESHOLD, MIN_SIZE, MIN_PERSIST, DAY = 1.0, 5.0, 3, 2, 86_400
FOUND = "array<struct<at:int,score:double,up:boolean,distance:double>>"


def least_buckets(min_size: int) -> int:
    """Buckets below which no activity shift is claimed."""
    return max(2 * min_size, 4)


def least_events(min_persist: int) -> int:
    """Events below which no state change can be confirmed."""
    return min_persist + 2


# Detectors: of an array of counts, the places and scores of its changes. Counts are compared as integers, scaled by the
# series' length, and divided last: equal gains are equal numbers, and a sum at the threshold doesn't exceed it.


def ks_gains(v: np.ndarray) -> np.ndarray:
    """The two-sample KS distance of v[:k] and v[k:] for k = 1 .. len - 1."""
    below = np.cumsum(v[:, None] <= np.unique(v)[None, :], axis=0)
    k = np.arange(1, len(v))
    return np.abs(below[:-1] * len(v) - below[-1] * k[:, None]).max(axis=1) / (k * (len(v) - k))


def mean_shift_gains(v: np.ndarray) -> np.ndarray:
    """k (n - k) / n times the squared difference of the means of v[:k] and v[k:], for k = 1 .. len - 1."""
    k, left = np.arange(1, len(v)), np.cumsum(v)[:-1]
    apart = left * len(v) - v.sum() * k
    return apart * apart / (len(v) * k * (len(v) - k))


def cusum_alarms(v: np.ndarray, drift: float, threshold: float) -> list[tuple[int, float]]:
    """(place, signed score) of two-sided CUSUM alarms against the mean; an alarm resets both sums."""
    up = down = 0.0
    out = []
    n, drift, threshold = len(v), drift * len(v), threshold * len(v)
    for i, x in enumerate((v * n - v.sum()).tolist()):
        up, down = max(0.0, up + x - drift), max(0.0, down - x - drift)
        if up > threshold or down > threshold:
            out.append((i, (up if up > threshold else -down) / n))
            up = down = 0.0
    return out


def cuts(v: np.ndarray, gains, min_size: int, min_gain: float) -> list[tuple[int, float]]:
    """(place, gain) of binary segmentation: the first of the best cuts while its gain exceeds min_gain."""
    out, todo = [], [(0, len(v))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 * min_size:
            continue
        g = gains(v[lo:hi])[min_size - 1 : hi - lo - min_size]
        best = int(g.argmax())
        if g[best] > min_gain:
            cut = lo + min_size + best
            out.append((cut, float(g[best])))
            todo += [(lo, cut), (cut, hi)]
    return sorted(out)


def detections(v: np.ndarray, method: str, min_size: int, min_gain: float | None, drift: float, threshold: float) -> list[dict]:
    """Changes of one series: place of the right side's first value, score, direction and the KS distance of the sides."""
    if method == "cusum":
        found = [(i, abs(s), s > 0) for i, s in cusum_alarms(v, drift, threshold)]
    else:
        floor = DETECTOR_MIN_GAIN[method] if min_gain is None else min_gain
        found = [(i, g, bool(v[i:].mean() > v[:i].mean())) for i, g in cuts(v, ks_gains if method == "ks" else mean_shift_gains, min_size, floor)]
    distance = ks_gains(v) if found else None
    return [{"at": i, "score": s, "up": up, "distance": float(distance[i - 1]) if i else None} for i, s, up in found]


def detector(method: str = "cusum", min_size: int = MIN_SIZE, min_gain: float | None = None, drift: float = DRIFT, threshold: float = THRESHOLD):
    """The detector as a function of a column of counts."""
    if method not in ("cusum", "ks", "binary_segmentation"):
        raise ValueError(f"unknown method {method}")

    @F.pandas_udf(FOUND)
    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda v: detections(np.asarray(v, float), method, min_size, min_gain, drift, threshold))

    return found


# Series


def bucketed(streams: DataFrame, bucket: int = DAY) -> DataFrame:
    """(case_id, subject_id, channel, events, first_at, last_at, points) of activity streams; points: (at, n, first_at,
    last_at) of every epoch-aligned bucket between the first and the last, silent ones with n = 0."""
    number = F.floor(F.unix_seconds(F.col("observed_at").cast("timestamp")) / bucket)
    counts = streams.filter("channel = 'activity'").groupBy(*KEYS, number.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("lo"), F.max("observed_at").alias("hi"))
    silent = counts.groupBy(*KEYS).agg(F.min("b").alias("from_b"), F.max("b").alias("to_b")).select(*KEYS, F.explode(F.sequence("from_b", "to_b")).alias("b"), F.lit(0).cast("bigint").alias("n"), *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("lo", "hi")])
    filled = counts.select(*KEYS, "b", "n", "lo", "hi").unionByName(silent).groupBy(*KEYS, "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    at = F.timestamp_seconds(F.col("b") * bucket).cast("timestamp_ntz")
    point = F.struct(at.alias("at"), "n", F.col("lo").alias("first_at"), F.col("hi").alias("last_at"))
    # As many points as buckets, however many events.
    return filled.groupBy(*KEYS).agg(F.sum("n").alias("events"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"), F.array_sort(F.collect_list(point)).alias("points"))


def _sum(points: Column) -> Column:
    return F.aggregate(points, F.lit(0).cast("bigint"), lambda a, p: a + p["n"])


def _window(points: Column) -> Column:
    """What lies on one side of a change."""
    return F.struct(
        F.array_min(F.transform(points, lambda p: p["first_at"])).alias("from_at"), F.array_max(F.transform(points, lambda p: p["last_at"])).alias("to_at"), _sum(points).alias("events"), F.size(points).alias("buckets"),
        F.round(_sum(points) / F.size(points), 6).alias("mean"),
    )


def activity_shifts(series: DataFrame, method: str = "cusum", bucket: int = DAY, min_size: int = MIN_SIZE, min_gain: float | None = None, drift: float = DRIFT, threshold: float = THRESHOLD) -> DataFrame:
    """One row a change of a series of bucketed(): changed_at (the bucket's start), score, direction, the KS distance of
    the two sides, and before and after (times, events, buckets, mean). Series of too few buckets have none: see refusals."""
    find = detector(method, min_size, min_gain, drift, threshold)
    long = series.filter(F.size("points") >= least_buckets(min_size))
    d = long.withColumn("d", F.explode(find(F.transform("points", lambda p: p["n"].cast("double")))))
    at = F.col("d.at")
    side = lambda first, n: F.when(n > 0, _window(F.slice("points", first, n)))
    return d.select(
        *KEYS, F.lit(method).alias("detector"), F.element_at("points", at + 1)["at"].alias("changed_at"), F.round("d.score", 6).alias("score"), F.when(F.col("d.up"), "increase").otherwise("decrease").alias("direction"),
        F.round("d.distance", 6).alias("distance"), side(F.lit(1), at).alias("before"), side(at + 1, F.size("points") - at).alias("after"),
    )


def citations(shifts: DataFrame, streams: DataFrame, bucket: int = DAY) -> DataFrame:
    """(..., changed_at, event_id) of the events in the bucket of each activity shift: the events behind the claim."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("observed_at").cast("timestamp")) / bucket) * bucket).cast("timestamp_ntz")
    events = streams.filter("channel = 'activity'").select(*KEYS, start.alias("changed_at"), "event_id")
    return events.join(shifts.select(*KEYS, "changed_at").distinct(), [*KEYS, "changed_at"])


# States


def state_runs(streams: DataFrame, min_persist: int = MIN_PERSIST) -> DataFrame:
    """(case_id, subject_id, channel, run, value, n, since, last_at, support) of the runs of equal values that matter:
    each track's first one and those of more than min_persist events, in order. support: their first min_persist + 1
    event ids."""
    order, need = ["observed_at", "event_id"], min_persist + 1
    ranges = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = streams.filter("channel <> 'activity'").select(*KEYS, *order, "value").repartitionByRange(ranges, *KEYS, *order)
    d = checkpointed(d.withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*KEYS, "_range")
    start = F.coalesce(~F.col("value").eqNullSafe(F.lag("value").over(own.orderBy(*order))) | (F.row_number().over(own.orderBy(*order)) == 1), F.lit(True))
    d = d.withColumn("_start", start).withColumn("_run", F.sum(F.col("_start").cast("int")).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS, "_range", "_run").orderBy(*order)))
    seen = F.struct("observed_at", "event_id")
    pieces = d.groupBy(*KEYS, "_range", "_run").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("since"), F.max("observed_at").alias("last_at"), F.array_sort(F.collect_list(F.when(F.col("_k") <= need, seen))).alias("head"))
    pieces = pieces.withColumn("_last", F.col("_run") == F.max("_run").over(own))
    # A short run inside a range confirms nothing; at its edges it may go on in the next range.
    pieces = pieces.filter((F.col("_run") == 1) | F.col("_last") | (F.col("n") >= need))
    track = Window.partitionBy(*KEYS).orderBy("_range", "_run")
    goes_on = (F.col("_run") == 1) & F.lag("_last").over(track) & F.col("value").eqNullSafe(F.lag("value").over(track))
    pieces = pieces.withColumn("run", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(track.rowsBetween(Window.unboundedPreceding, 0)))
    heads = F.slice(F.array_sort(F.flatten(F.collect_list("head"))), 1, need)
    runs = pieces.groupBy(*KEYS, "run").agg(F.first("value").alias("value"), F.sum("n").alias("n"), F.min("since").alias("since"), F.max("last_at").alias("last_at"), F.transform(heads, lambda s: s["event_id"]).alias("support"))
    return runs.filter((F.col("run") == 1) | (F.col("n") >= need))


def state_changes(streams: DataFrame, min_persist: int = MIN_PERSIST) -> DataFrame:
    """One row for each change of a track that the next min_persist events confirm: changed_at, from_value, to_value
    and the ids of the change and its confirmations. The comparison is with the last confirmed state, so a flap moves
    nothing, and a change at the end without enough events after it is none."""
    w = Window.partitionBy(*KEYS).orderBy("run")
    runs = state_runs(streams, min_persist).withColumn("from_value", F.lag("value").over(w)).filter(F.col("run") > 1)
    return runs.filter(~F.col("value").eqNullSafe(F.col("from_value"))).select(*KEYS, F.col("since").alias("changed_at"), "from_value", F.col("value").alias("to_value"), F.col("support").alias("event_ids"))


def presence(streams: DataFrame, min_persist: int = MIN_PERSIST) -> DataFrame:
    """The intervals of a track between its confirmed changes: value, since, until (the next change; NULL: still)."""
    w = Window.partitionBy(*KEYS).orderBy("run")
    runs = state_runs(streams, min_persist).withColumn("_before", F.lag("value").over(w))
    starts = runs.filter((F.col("run") == 1) | ~F.col("value").eqNullSafe(F.col("_before")))
    return starts.select(*KEYS, "value", "since", F.lead("since").over(w).alias("until"))


# Reports


def refusals(streams: DataFrame, series: DataFrame, min_persist: int = MIN_PERSIST, min_size: int = MIN_SIZE) -> DataFrame:
    """(case_id, subject_id, channel, observed, required, unit, reason) of streams that are too short for their detector."""
    states = streams.filter("channel <> 'activity'").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("observed"))
    short = states.select(*KEYS, "observed", F.lit(least_events(min_persist)).alias("required"), F.lit("events").alias("unit"), F.lit("a confirmed change needs one event before it, itself and its confirmations").alias("reason"))
    quiet = series.select(*KEYS, F.size("points").cast("bigint").alias("observed"), F.lit(least_buckets(min_size)).alias("required"), F.lit("buckets").alias("unit"), F.lit("two sides of that few buckets give a number, not a change").alias("reason"))
    return short.unionByName(quiet).filter(F.col("observed") < F.col("required"))


def case_shifts(streams: DataFrame, method: str = "binary_segmentation", bucket: int = DAY, min_persist: int = MIN_PERSIST, min_size: int = MIN_SIZE, min_gain: float | None = None, drift: float = DRIFT, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, shifts, refusals). report: one row a case with its streams, observations, window, numbers of shifts and
    refusals, and basis: `changes`, `no change`, `partly analysed` (changes or none, with refusals) or `too short`."""
    series = checkpointed(bucketed(streams, bucket), "series")
    floor = SERVICE_MIN_GAIN.get(method) if min_gain is None else min_gain
    active = activity_shifts(series, method, bucket, min_size, floor, drift, threshold).select(*KEYS, "detector", "changed_at", "score", "direction", F.lit(None).cast("string").alias("from_value"), F.lit(None).cast("string").alias("to_value"))
    states = state_changes(streams, min_persist).select(*KEYS, F.lit("state_change").alias("detector"), "changed_at", F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("direction"), "from_value", "to_value")
    shifts = checkpointed(active.unionByName(states), "shifts")
    refused = checkpointed(refusals(streams, series, min_persist, min_size), "refusals")
    each = streams.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("lo"), F.max("observed_at").alias("hi"))
    cases = each.groupBy("case_id").agg(F.count(F.lit(1)).alias("streams"), F.sum("n").alias("observations"), F.min("lo").alias("window_start"), F.max("hi").alias("window_end"))
    number = lambda d, name: d.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    report = cases.join(number(shifts, "shifts"), "case_id", "left").join(number(refused, "refusals"), "case_id", "left").fillna(0, ["shifts", "refusals"])
    basis = F.when((F.col("refusals") > 0) & (F.col("refusals") == F.col("streams")), "too short").when(F.col("refusals") > 0, "partly analysed").when(F.col("shifts") > 0, "changes").otherwise("no change")
    return report.withColumn("basis", basis), shifts, refused


def regimes(series: DataFrame, method: str = "binary_segmentation", min_size: int = MIN_SIZE, min_gain: float | None = None) -> DataFrame:
    """The stretches that the cuts divide each long enough series into: index, first and last bucket, buckets, mean,
    peak, total, and the gain of the cut that begins it (NULL for the first)."""
    floor = SERVICE_MIN_GAIN[method] if min_gain is None else min_gain
    find = detector(method, min_size, floor)
    d = series.filter(F.size("points") >= 2 * min_size).withColumn("d", find(F.transform("points", lambda p: p["n"].cast("double"))))
    first = F.struct(F.lit(0).alias("at"), F.lit(None).cast("double").alias("gain"))
    edges = F.concat(F.array(first), F.transform("d", lambda x: F.struct(x["at"].alias("at"), F.round(x["score"], 6).alias("gain"))))
    d = d.select(*KEYS, "points", edges.alias("edges")).select(*KEYS, "points", "edges", F.posexplode("edges").alias("index", "edge"))
    until = F.coalesce(F.get("edges", F.col("index") + 1)["at"], F.size("points"))
    d = d.select(*KEYS, "index", F.col("edge.gain").alias("gain"), F.slice("points", F.col("edge.at") + 1, until - F.col("edge.at")).alias("p"))
    return d.select(
        *KEYS, "index", "gain", F.get("p", F.lit(0))["at"].alias("first_bucket"), F.element_at("p", -1)["at"].alias("last_bucket"), F.size("p").alias("buckets"), F.round(_sum(F.col("p")) / F.size("p"), 6).alias("mean"),
        F.array_max(F.transform("p", lambda x: x["n"])).alias("peak"), _sum(F.col("p")).alias("total"),
    )


def behaviour(series: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Of each activity series: buckets, observations, window, mean, standard deviation, peak, silent buckets, and
    whether it is long enough to analyse."""
    n, mean = F.size("points"), F.col("events") / F.size("points")
    squares = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["n"] * p["n"])
    return series.select(
        *KEYS, n.alias("buckets"), F.col("events").alias("observations"), "first_at", "last_at", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean)), 6).alias("standard_deviation"),
        F.array_max(F.transform("points", lambda p: p["n"])).alias("peak"), F.size(F.filter("points", lambda p: p["n"] == 0)).alias("silent_buckets"), (n >= least_buckets(min_size)).alias("analysable"),
    )
