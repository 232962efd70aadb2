from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidentia.operators import store
from evidentia.sources import collect

SEEN = "candidate_id string, ref string, payload binary"


class Site(collect.Collector):
    name, version, per_minute = "site", "1", 0
    tries: dict = {}

    def discover(self, spark, scope):
        return spark.createDataFrame([(str(i), None, f"page {i}".encode()) for i in range(scope["n"])], SEEN)

    def collect(self, candidate_id, ref, payload):
        k = int(candidate_id)
        if k == 1:
            raise collect.Rejected("no")
        if k == 2:
            raise collect.TimedOut("slow")
        if k == 3:
            raise OSError("down")
        if k == 4 and not Site.tries.setdefault(4, 0):
            Site.tries[4] = 1
            raise collect.TimedOut("once")
        return payload

    def normalize(self, raw):
        if raw == b"page 5":
            raise ValueError("broken")
        return [] if raw == b"page 6" else [(raw.decode(), {"k": "v"}), ("more", {})]


class Closed(collect.Collector):
    name = "closed"

    def discover(self, spark, scope):
        raise collect.Rejected("not mine")


def test_run_isolates_failures_and_resumes(spark):
    seen, outcomes, settled = collect.run(spark, [Site(), Closed()], {"n": 10})
    o = {r.collector: r for r in outcomes.collect()}
    assert (o["site"].candidates, o["site"].observations, o["site"].empty, o["site"].errors, o["site"].refused) == (10, 10, 1, 4, None)
    assert o["closed"].refused == "not mine" and o["closed"].candidates == 0
    assert {r.candidate_id: r.attempts for r in seen.filter("candidate_id = '4'").collect()} == {"4": 2}
    assert settled.count() == 9  # the one that timed out is tried again
    again, outcomes, after = collect.run(spark, [Site()], {"n": 12}, settled)
    assert {r.candidate_id for r in again.collect()} == {"10", "11"} and outcomes.first().candidates == 3 and after.count() == 11
    with pytest.raises(ValueError):
        collect.run(spark, [], {})


def test_rate_limiter():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    r = collect.RateLimiter(2, lambda: now[0], sleep)
    for _ in range(5):
        r.acquire()
        now[0] += 1
    assert slept == [58.0, 58.0] and now[0] == 121.0
    collect.RateLimiter(0, lambda: now[0], sleep).acquire()


def test_freeze_and_differences(spark):
    rows = [("a", datetime(2024, 1, 1), 1), ("a", datetime(2024, 1, 3), 2), ("a", datetime(2024, 1, 9), 3), ("b", datetime(2024, 1, 9), 1), ("c", datetime(2024, 1, 2), None)]
    d = spark.createDataFrame(rows, "k string, at timestamp_ntz, v int")
    then = store.freeze(d, ["k"], "at", datetime(2024, 1, 5))
    assert {(r.k, r.v) for r in then.collect()} == {("a", 2), ("c", None)}
    one = lambda x: tuple(store.dataset_fingerprint(x).first())
    assert one(then) == one(store.freeze(d.repartition(5), ["k"], "at", datetime(2024, 1, 5)))
    assert store.differences(then, then, ["k"]).count() == 0
    later = store.freeze(d.filter("k <> 'c'"), ["k"], "at", datetime(2024, 1, 9))
    assert {(r.k, r.change) for r in store.differences(then, later, ["k"]).collect()} == {("a", "changed"), ("b", "added"), ("c", "removed")}


def test_store_upserts_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "assessments"), "assessment_id bigint, score double, recorded int", "assessment_id", "recorded", 8)
    rows = lambda *r: spark.createDataFrame(list(r), "assessment_id bigint, score double, recorded int")
    assert s.read().count() == 0
    assert s.upsert(rows(*[(i, i / 10, 1) for i in range(40)])) == 1 and s.read().count() == 40
    assert s.upsert(rows(*[(i, i / 10, 1) for i in range(40)])) == 1  # the same again: nothing to do
    assert s.upsert(rows((3, 0.9, 2), (3, 0.8, 3), (99, 0.5, 1), (5, 0.0, 0))) == 2
    got = {r.assessment_id: r.score for r in s.read().collect()}
    assert len(got) == 41 and got[3] == 0.8 and got[99] == 0.5 and got[5] == 0.5
    # A batch without a manifest is not there.
    spark.createDataFrame([(7, 7.0, 9, "00000009", 0)], "assessment_id bigint, score double, recorded int, batch string, part int").write.mode("append").partitionBy("batch", "part").parquet(f"{s.path}/data")
    assert {r.assessment_id: r.score for r in s.read().collect()} == got
    again = store.Store(spark, s.path, s.schema, "assessment_id", "recorded", 8)
    assert again.read().filter(F.col("assessment_id") == 3).first().score == 0.8
