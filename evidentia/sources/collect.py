"""Collectors and their orchestration as Spark jobs: candidates are rows, failures are rows, and a run can be resumed.

A collector tells candidates from a scope, fetches one, and normalises what it fetched. Candidates are spread over
tasks; each is tried on its own, so one that fails costs only itself. What a run has settled is kept by collector,
version and candidate, and the next run leaves it out."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.dedup import checkpointed


class Rejected(Exception):
    """Out of scope, or refused; not tried again."""


class TimedOut(Exception):
    """Tried again, up to the attempts allowed."""


class Collector:
    """name and version go into every row; a limit of 0 a minute means none. Subclasses travel to the tasks."""

    name = "collector"
    version = "0.0.0"
    per_minute = 60

    def discover(self, spark: SparkSession, scope: dict) -> DataFrame:
        """(candidate_id string, ref string, payload binary) of what matches the scope; payload may be null. Raises
        Rejected for a scope that isn't this collector's."""
        raise NotImplementedError

    def collect(self, candidate_id: str, ref: str | None, payload: bytes | None) -> bytes:
        """The candidate's raw bytes."""
        raise NotImplementedError

    def normalize(self, raw: bytes) -> Sequence[tuple[str, dict[str, str]]]:
        """(text, metadata) of every observation in it."""
        raise NotImplementedError


class RateLimiter:
    """A sliding window of a minute: acquire waits until fewer than the limit were let through in the last 60 seconds."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.limit, self.clock, self.sleep = int(per_minute), clock, sleep
        self.passed: deque[float] = deque()

    def acquire(self) -> None:
        if self.limit <= 0:
            return
        now = self.clock()
        while self.passed and now - self.passed[0] >= 60:
            self.passed.popleft()
        if len(self.passed) >= self.limit:
            self.sleep(60 - (now - self.passed[0]))
            self.passed.popleft()
            now = self.clock()
        self.passed.append(now)


ROWS = "collector string, version string, candidate_id string, place int, text string, metadata map<string,string>, attempts int, error string"


def attempt(c: Collector, limiter: RateLimiter, attempts: int, candidate: tuple) -> list[tuple]:
    """The rows of one candidate: its observations, or one with the error that ended it."""
    row = lambda place, text, meta, n, error: (c.name, c.version, candidate[0], place, text, meta, n, error)
    for n in range(1, attempts + 1):
        try:
            limiter.acquire()
            raw = c.collect(*candidate)
            break
        except TimedOut as e:
            if n == attempts:
                return [row(None, None, None, n, f"timeout: {e}")]
        except Rejected as e:
            return [row(None, None, None, n, f"rejected: {e}")]
        except Exception as e:  # any other fault is this candidate's alone
            return [row(None, None, None, n, f"{type(e).__name__}: {e}")]
    try:
        return [row(k, text, meta, n, None) for k, (text, meta) in enumerate(c.normalize(raw))] or [row(-1, None, None, n, None)]
    except Exception as e:
        return [row(None, None, None, n, f"normalize {type(e).__name__}: {e}")]


def run(spark: SparkSession, collectors: Sequence[Collector], scope: dict, settled: DataFrame | None = None, attempts: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, outcomes, settled). outcomes: one row a collector with candidates, observations, empty, errors and
    refused (the scope's refusal). settled: (collector, version, candidate_id) with those of before; candidates that
    timed out aren't among them, so the next run tries them again.

    A limit of so many fetches a minute is shared: a collector gets no more tasks than that, each with its part."""
    if not collectors:
        raise ValueError("no collectors")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, refused = None, []
    for c in collectors:
        try:
            found = c.discover(spark, scope).select("candidate_id", "ref", "payload")
        except Rejected as e:
            refused.append((c.name, c.version, str(e)))
            continue
        if settled is not None:
            own = settled.filter((F.col("collector") == c.name) & (F.col("version") == c.version)).select("candidate_id")
            found = found.join(own, "candidate_id", "left_anti")
        tasks = min(ranges, c.per_minute) if c.per_minute > 0 else ranges
        share = c.per_minute / tasks if c.per_minute > 0 else 0

        def fetch(batches: Iterator[pd.DataFrame], c=c, share=share) -> Iterator[pd.DataFrame]:
            limiter = RateLimiter(share)
            for b in batches:
                out = [r for x in b.itertuples(index=False) for r in attempt(c, limiter, attempts, (x.candidate_id, x.ref, x.payload))]
                yield pd.DataFrame(out, columns=[f.split()[0] for f in ROWS.split(", ")]).astype({"place": "Int32"})

        got = found.repartition(tasks, "candidate_id").mapInPandas(fetch, ROWS)
        rows = got if rows is None else rows.unionByName(got)
    # Written once: counts, observations and the record of what is settled must tell of the same fetches.
    rows = checkpointed(rows if rows is not None else spark.createDataFrame([], ROWS), "collected")
    counts = rows.groupBy("collector", "version").agg(F.count_distinct("candidate_id").alias("candidates"), F.count_if(F.col("place") >= 0).alias("observations"), F.count_if(F.col("place") == -1).alias("empty"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    names = spark.createDataFrame([(c.name, c.version) for c in collectors], "collector string, version string")
    why = spark.createDataFrame(refused, "collector string, version string, refused string")
    outcomes = names.join(counts, ["collector", "version"], "left").fillna(0).join(why, ["collector", "version"], "left")
    now = rows.filter(F.col("error").isNull() | ~F.col("error").startswith("timeout")).select("collector", "version", "candidate_id").distinct()
    done = now if settled is None else settled.select("collector", "version", "candidate_id").unionByName(now).distinct()
    return rows.filter("place >= 0").drop("error", "place"), outcomes, done
