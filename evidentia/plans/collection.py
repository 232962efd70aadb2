"""Collection runs and frozen features over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import store
from evidentia.plans.registry import query
from evidentia.sources import collect
from evidentia.sources.tables import observations, table


class PageCollector(collect.Collector):
    """Stored pages as a site: every tenth is refused, every eleventh never answers; a page's words are its observation."""

    name, version, per_minute = "pages", "1.0.0", 0

    def discover(self, spark: SparkSession, scope: dict) -> DataFrame:
        return table(spark, scope["folder"], "pages").select(F.col("page_id").cast("string").alias("candidate_id"), F.col("url").alias("ref"), F.col("html").cast("binary").alias("payload"))

    def collect(self, candidate_id: str, ref: str | None, payload: bytes | None) -> bytes:
        if int(candidate_id) % 10 == 3:
            raise collect.Rejected("out of scope")
        if int(candidate_id) % 11 == 5:
            raise collect.TimedOut("no answer")
        return payload or b""

    def normalize(self, raw: bytes) -> list[tuple[str, dict[str, str]]]:
        return [(raw.decode(), {"bytes": str(len(raw))})]


class ClosedCollector(collect.Collector):
    name, version = "closed", "1.0.0"

    def discover(self, spark: SparkSession, scope: dict) -> DataFrame:
        raise collect.Rejected("scope is not covered")


@query("with p as (select count(*) n, count(*) filter (where page_id % 10 = 3 or page_id % 11 = 5) bad from pages) select 'pages' collector, n candidates, n - bad observations, cast(0 as bigint) as empty, bad errors, cast(null as varchar) refused from p union all select 'closed', 0, 0, 0, 0, 'scope is not covered'")
def collection_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return collect.run(spark, [PageCollector(), ClosedCollector()], {"folder": sf})[1].drop("version")


@query("with e as (select *, row_number() over (partition by user_id order by ts desc) k, sha256('event_id=' || strlen(event_id::varchar) || ':' || event_id || ';event_type=' || strlen(event_type) || ':' || event_type || ';micros=' || strlen(epoch_us(ts)::varchar) || ':' || epoch_us(ts) || ';subject_id=' || strlen(user_id::varchar) || ':' || user_id) f from events where ts <= timestamp '2024-01-15 12:00:00') select user_id subject_id, event_id, event_type, f fingerprint from e where k = 1")
def frozen_features(spark: SparkSession, sf: str) -> DataFrame:
    """Each subject's last event as it was known at a time."""
    e = observations(spark, sf).select("subject_id", "event_id", F.col("value").alias("event_type"), "observed_at", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("micros"))
    frozen = store.freeze(e, ["subject_id"], "observed_at", datetime(2024, 1, 15, 12))
    return store.fingerprinted(frozen.select("subject_id", "event_id", "event_type", "micros")).drop("micros")
