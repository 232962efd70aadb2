import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from evidentia.operators import shifts

SCHEMA = "case_id long, subject_id string, channel string, event_id string, observed_at timestamp_ntz, value string"
DAY0 = datetime(2024, 1, 1, 9)


def track(values, subject="a", channel="marketplace"):
    return [(1, subject, channel, f"{subject}{i:05d}", DAY0 + timedelta(hours=i), v) for i, v in enumerate(values)]


def activity(counts, subject="a"):
    return [(1, subject, "activity", f"{subject}-{d}-{i}", DAY0 + timedelta(days=d, minutes=i), "post") for d, n in enumerate(counts) for i in range(n)]


def brute_states(values, persist):
    out, held = [], values[0]
    for i in range(1, len(values)):
        after = values[i + 1 : i + 1 + persist]
        if values[i] != held and len(after) == persist and all(v == values[i] for v in after):
            out.append((i, held, values[i]))
            held = values[i]
    return out


def brute_ks(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})


def brute_mean(a, b):
    return len(a) * len(b) / (len(a) + len(b)) * (sum(a) / len(a) - sum(b) / len(b)) ** 2


def brute_cuts(values, gain, size, floor):
    out, todo = [], [list(range(len(values)))]
    while todo:
        at = todo.pop()
        best, cut = floor, None
        for k in range(size, len(at) - size + 1):
            g = gain([values[i] for i in at[:k]], [values[i] for i in at[k:]])
            if (g := round(g, 12)) > best:
                best, cut = g, k
        if cut is not None:
            out.append((at[cut], best))
            todo += [at[:cut], at[cut:]]
    return sorted(out)


def test_states_of_many_tracks(spark):
    """Against the rule event by event, with tracks that are dealt over several ranges."""
    rng = random.Random(2)
    tracks = {f"t{k}": [v for _ in range(rng.randint(1, 12)) for v in [rng.choice("abc")] * rng.choice([1, 1, 2, 3, 6])] for k in range(25)}
    tracks |= {"flap": list("aabaa"), "stay": list("aabbb"), "end": list("aab"), "one": ["a"], "long": ["a"] * 400 + ["b"] * 400 + ["a", "b"] * 200}
    d = spark.createDataFrame([r for s, v in tracks.items() for r in track(v, s)], SCHEMA)
    for persist in (0, 1, 2):
        got = sorted((r.subject_id, r.changed_at, r.from_value, r.to_value, tuple(r.event_ids)) for r in shifts.state_changes(d, persist).collect())
        want = sorted((s, DAY0 + timedelta(hours=i), a, b, tuple(f"{s}{j:05d}" for j in range(i, i + persist + 1))) for s, v in tracks.items() for i, a, b in brute_states(v, persist))
        assert got == want
    stays = {(r.subject_id, r.value): (r.since, r.until) for r in shifts.presence(d).collect()}
    assert stays["stay", "a"] == (DAY0, DAY0 + timedelta(hours=2)) and stays["flap", "a"] == (DAY0, None) and ("flap", "b") not in stays


def test_detectors():
    rng = random.Random(4)
    for _ in range(120):
        v = [rng.choice([0, 1, 2, 5]) for _ in range(rng.randint(6, 40))]
        a = np.array(v, float)
        for gain, gains, floor in ((brute_ks, shifts.ks_gains, 0.3), (brute_mean, shifts.mean_shift_gains, 1.0)):
            got, want = shifts.cuts(a, gains, 3, floor), brute_cuts(v, gain, 3, floor)
            assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([g for _, g in got], [g for _, g in want])
    assert [i for i, s in shifts.cusum_alarms(np.array([1.0] * 10 + [9.0] * 10), 1.0, 5.0) if s > 0][0] == 11
    assert shifts.cusum_alarms(np.array([3.0] * 20), 1.0, 5.0) == []


@pytest.mark.parametrize("method", ["cusum", "ks", "binary_segmentation"])
def test_activity_shift_is_found_with_its_sides(spark, method):
    d = spark.createDataFrame(activity([1] * 10 + [0, 0] + [9] * 10) + activity([2] * 20, "flat") + activity([1, 8], "short"), SCHEMA)
    series = shifts.bucketed(d)
    rows = shifts.activity_shifts(series, method).collect()
    assert {r.subject_id for r in rows} == {"a"}
    up = min((r for r in rows if r.direction == "increase"), key=lambda r: r.changed_at)
    assert datetime(2024, 1, 10) <= up.changed_at <= datetime(2024, 1, 14) and up.before.mean < up.after.mean and up.before.events + up.after.events == 100
    assert 0 < up.distance <= 1
    assert shifts.citations(shifts.activity_shifts(series, method).filter("direction = 'increase'"), d).filter("subject_id <> 'a'").count() == 0
    refused = shifts.refusals(d, series).collect()
    assert [(r.subject_id, r.observed, r.required, r.unit) for r in refused] == [("short", 2, 6, "buckets")]


def test_reports(spark):
    d = spark.createDataFrame(activity([1] * 10 + [20] * 10) + track(list("aabbb")) + track(list("ab"), "b") + [(2, "c", "marketplace", "x", DAY0, "v")], SCHEMA)
    report, found, refused = shifts.case_shifts(d)
    by = {r.case_id: r for r in report.collect()}
    assert (by[1].streams, by[1].shifts, by[1].refusals, by[1].basis) == (3, 2, 1, "partly analysed") and (by[2].shifts, by[2].basis) == (0, "too short")
    assert {r.detector for r in found.collect()} == {"binary_segmentation", "state_change"} and refused.count() == 2
    parts = shifts.regimes(shifts.bucketed(d)).orderBy("index").collect()
    assert [(p["index"], p.buckets, p.mean, p.peak, p.total) for p in parts] == [(0, 10, 1.0, 1, 10), (1, 10, 20.0, 20, 200)] and parts[0].gain is None and parts[1].gain > 100
    b = shifts.behaviour(shifts.bucketed(spark.createDataFrame(activity([2, 0, 0, 4]), SCHEMA))).first()
    assert (b.buckets, b.observations, b.silent_buckets, b.peak, b.mean, b.analysable) == (4, 6, 2, 4, 1.5, False)


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert shifts.case_shifts(d)[0].collect() == [] and shifts.state_changes(d).collect() == []


def test_unknown_method():
    with pytest.raises(ValueError):
        shifts.detector("guess")


def test_registered_detector(spark):
    from evidentia.operators import extension

    extension.register(spark, "peaks", lambda v: [(i, x) for i, x in enumerate(v) if x == v.max()])
    spark.createDataFrame([("b", 2, 5.0, "x"), ("a", 3, 1.0, "x"), ("a", 1, 7.0, "x"), ("a", 2, 7.0, "x"), (None, 1, 0.0, "x")], "subject_id string, at int, n double, more string").createOrReplaceTempView("points_of_test")
    got = spark.sql("select * from peaks(table(points_of_test))").collect()
    assert {tuple(r) for r in got} == {("a", 0, 1, 7.0), ("a", 1, 2, 7.0), ("b", 0, 2, 5.0), (None, 0, 1, 0.0)}
    with pytest.raises(Exception, match="lacks n"):
        spark.sql("select * from peaks(table(select subject_id, at from points_of_test))").collect()
    with pytest.raises(ValueError):
        extension.register(spark, "no name", len)
