"""Change reports over the driver tables: subjects' events and the cases' evidence as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import extension, shifts
from evidentia.plans.registry import query
from evidentia.sources.tables import evidence, observations


def streams(spark: SparkSession, sf: str) -> DataFrame:
    """A subject's events as its activity and, by their types, as its track of states; a case's evidence as activity."""
    e = observations(spark, sf).select((F.col("subject_id") % 50).alias("case_id"), F.concat(F.lit("s"), "subject_id").alias("subject_id"), F.col("event_id").cast("string").alias("event_id"), "observed_at", "value")
    ledger = evidence(spark, sf).select("case_id", F.concat(F.lit("case"), "case_id").alias("subject_id"), F.col("evidence_id").alias("event_id"), F.col("collected_at").alias("observed_at"), F.col("kind").alias("value"))
    columns = ["case_id", "subject_id", "channel", "event_id", "observed_at", "value"]
    return e.unionByName(ledger).withColumn("channel", F.lit("activity")).select(*columns).unionByName(e.withColumn("channel", F.lit("marketplace")).select(*columns))


STREAMS = """e as (select user_id % 50 case_id, 's' || user_id subject_id, cast(event_id as varchar) event_id, ts observed_at, event_type v from events),
a as (select case_id, subject_id, observed_at from e union all select l_orderkey % 50, 'case' || (l_orderkey % 50), l_shipdate from lineitem),
c as (select case_id, subject_id, date_trunc('day', observed_at) b, count(*) n, min(observed_at) lo, max(observed_at) hi from a group by all),
g as (select case_id, subject_id, unnest(generate_series(min(b), max(b), interval 1 day)) b from c group by 1, 2),
s as (select g.case_id, g.subject_id, cast(g.b as timestamp) b, coalesce(n, 0) n, lo, hi, row_number() over w i, avg(coalesce(n, 0)) over (partition by g.case_id, g.subject_id) m, count(*) over (partition by g.case_id, g.subject_id) len from g left join c on c.case_id = g.case_id and c.subject_id = g.subject_id and c.b = g.b window w as (partition by g.case_id, g.subject_id order by g.b))"""

#: Sums and limits times the length of the series, so that all of them are integers.
CUSUM = """u as (select case_id, subject_id, i, len, cast(n * len - sum(n) over (partition by case_id, subject_id) as bigint) x from s),
r as (select case_id, subject_id, cast(0 as bigint) i, cast(0 as bigint) up, cast(0 as bigint) down, 0.0::double hit from u where i = 1
 union all select case_id, subject_id, i, case when up > 5 * len or down > 5 * len then 0 else up end, case when up > 5 * len or down > 5 * len then 0 else down end, case when up > 5 * len then up / len when down > 5 * len then -down / len else 0 end
  from (select u.case_id, u.subject_id, u.i, u.len, greatest(0, r.up + x - len) up, greatest(0, r.down - x - len) down from r join u on u.case_id = r.case_id and u.subject_id = r.subject_id and u.i = r.i + 1)),
hits as (select r.case_id, r.subject_id, r.i, r.hit from r join (select distinct case_id, subject_id from s where len >= 6) using (case_id, subject_id) where hit <> 0)"""

#: The state held so far, from event to event: a change needs the same value twice more.
HELD = """k as (select *, row_number() over w i, lead(v) over w v1, lead(v, 2) over w v2 from e window w as (partition by case_id, subject_id order by observed_at, event_id)),
h as (select case_id, subject_id, i, v held, cast(null as varchar) bef, false hit, observed_at from k where i = 1 union all
select k.case_id, k.subject_id, k.i, case when k.v <> h.held and k.v1 = k.v and k.v2 = k.v then k.v else h.held end, h.held, coalesce(k.v <> h.held and k.v1 = k.v and k.v2 = k.v, false), k.observed_at from h join k on k.case_id = h.case_id and k.subject_id = h.subject_id and k.i = h.i + 1)"""


@query(f"""with recursive {STREAMS}, {CUSUM},
x as (select h.case_id, h.subject_id, h.i pos, h.hit, s.* exclude (case_id, subject_id) from hits h join s on s.case_id = h.case_id and s.subject_id = h.subject_id),
f as (select x.case_id, x.subject_id, x.pos, y.n v, count(*) filter (where x.n <= y.n and x.i < x.pos) bl, count(*) filter (where x.i < x.pos) nl, count(*) filter (where x.n <= y.n and x.i >= x.pos) br, count(*) filter (where x.i >= x.pos) nr from x join (select distinct case_id, subject_id, pos, n from x) y on y.case_id = x.case_id and y.subject_id = x.subject_id and y.pos = x.pos group by all),
dist as (select case_id, subject_id, pos, max(abs(bl * nr - br * nl) / nullif(nl * nr, 0)) d from f group by all)
select case_id, subject_id, max(b) filter (where i = pos) changed_at, round(abs(max(hit)), 6) score, case when max(hit) > 0 then 'increase' else 'decrease' end direction, round(max(d), 6) distance, cast(sum(n) filter (where i < pos) as bigint) events_before, cast(sum(n) filter (where i >= pos) as bigint) events_after, round(avg(n) filter (where i < pos), 6) mean_before, round(avg(n) filter (where i >= pos), 6) mean_after, max(hi) filter (where i < pos) last_before, min(lo) filter (where i >= pos) first_after
from x join dist using (case_id, subject_id, pos) group by case_id, subject_id, pos""")
def activity_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """CUSUM alarms of every activity stream with what lies on both sides."""
    d = shifts.activity_shifts(shifts.bucketed(streams(spark, sf)))
    side = lambda a, f, n: F.col(f"{a}.{f}").alias(n)
    return d.select("case_id", "subject_id", "changed_at", "score", "direction", "distance", side("before", "events", "events_before"), side("after", "events", "events_after"), side("before", "mean", "mean_before"), side("after", "mean", "mean_after"), side("before", "to_at", "last_before"), side("after", "from_at", "first_after"))


@query(f"""with recursive {STREAMS}, {CUSUM}, {HELD},
z as (select case_id, subject_id, 'activity' channel, min(lo) lo, max(hi) hi, sum(n) n, max(len) < 6 short from s group by 1, 2 union all select case_id, subject_id, 'marketplace', min(observed_at), max(observed_at), count(*), count(*) < 4 from e group by 1, 2),
t as (select case_id, count(*) n from (select case_id from hits union all select case_id from h where hit) group by 1),
q as (select case_id, count(*) streams, cast(sum(n) as bigint) observations, min(lo) window_start, max(hi) window_end, count(*) filter (where short) refusals from z group by 1)
select q.*, coalesce(t.n, 0) shifts, case when refusals > 0 and refusals = streams then 'too short' when refusals > 0 then 'partly analysed' when coalesce(t.n, 0) > 0 then 'changes' else 'no change' end basis from q left join t using (case_id)""")
def case_shift_report(spark: SparkSession, sf: str) -> DataFrame:
    return shifts.case_shifts(streams(spark, sf), "cusum")[0]


@query(f"""with {STREAMS} select case_id, subject_id, 'activity' channel, len observed, 58 required from s group by all having len < 58 union all select case_id, subject_id, 'marketplace', count(*), 62 from e group by 1, 2 having count(*) < 62""")
def shift_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Streams too short for 60 confirmations, or for two sides of 29 days."""
    s = streams(spark, sf)
    return shifts.refusals(s, shifts.bucketed(s), 60, 29).select(*shifts.KEYS, "observed", "required")


@query(f"""with recursive {STREAMS}, p as (select *, cast(sum(n) over (partition by case_id, subject_id order by i) as bigint) t from s union all select distinct case_id, subject_id, null, 0, null, null, 0, m, len, 0 from s),
seg as (select case_id, subject_id, 0::bigint lo, len hi, null::double gain from s where i = 1 and len >= 6 union all
 select case_id, subject_id, u.lo, u.hi, u.gain from (select case_id, subject_id, unnest([{{'lo': lo, 'hi': -b.k, 'gain': null}}, {{'lo': -b.k, 'hi': hi, 'gain': b.g}}]) u from
  (select seg.case_id, seg.subject_id, seg.lo, seg.hi, max({{'g': (((c.t - x.t) * (seg.hi - seg.lo) - (y.t - x.t) * (c.i - seg.lo)) * 1e0::double) * ((c.t - x.t) * (seg.hi - seg.lo) - (y.t - x.t) * (c.i - seg.lo)) / ((seg.hi - seg.lo) * (c.i - seg.lo) * (seg.hi - c.i)), 'k': -c.i}}) b from seg join p x on x.case_id = seg.case_id and x.subject_id = seg.subject_id and x.i = seg.lo join p y on y.case_id = seg.case_id and y.subject_id = seg.subject_id and y.i = seg.hi join p c on c.case_id = seg.case_id and c.subject_id = seg.subject_id and c.i between seg.lo + 3 and seg.hi - 3 group by all) where b.g > 2.0)),
cut as (select case_id, subject_id, lo, max(gain) gain from seg group by all),
d as (select *, row_number() over w - 1 idx, coalesce(lead(lo) over w, (select max(len) from s where s.case_id = cut.case_id and s.subject_id = cut.subject_id)) up from cut window w as (partition by case_id, subject_id order by lo))
select d.case_id, d.subject_id, cast(idx as int) as index, round(max(gain), 6) gain, min(b) first_bucket, max(b) last_bucket, cast(count(*) as int) buckets, round(avg(n), 6) mean, max(n) peak, cast(sum(n) as bigint) total from d join s on s.case_id = d.case_id and s.subject_id = d.subject_id and s.i > d.lo and s.i <= d.up group by d.case_id, d.subject_id, idx""")
def activity_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Binary segmentation by mean shift with a gain above 2."""
    return shifts.regimes(shifts.bucketed(streams(spark, sf)), min_gain=2.0).drop("channel")


@query(f"with recursive {STREAMS}, {HELD} select case_id, subject_id, observed_at changed_at, bef from_value, held to_value from h where hit")
def actor_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of state that two more events confirm."""
    return shifts.state_changes(streams(spark, sf)).select("case_id", "subject_id", "changed_at", "from_value", "to_value")


@query(f"with recursive {STREAMS}, {HELD} select case_id, subject_id, held as value, observed_at since, lead(observed_at) over (partition by case_id, subject_id order by i) until from h where hit or i = 1")
def actor_presence(spark: SparkSession, sf: str) -> DataFrame:
    return shifts.presence(streams(spark, sf)).drop("channel")


@query(f"with {STREAMS} select case_id, subject_id, cast(len as int) buckets, cast(sum(n) as bigint) observations, min(lo) first_at, max(hi) last_at, round(max(m), 6) mean, round(stddev_pop(n), 6) standard_deviation, max(n) peak, cast(count(*) filter (where n = 0) as int) silent_buckets, len >= 6 analysable from s group by case_id, subject_id, len")
def behaviour_series(spark: SparkSession, sf: str) -> DataFrame:
    return shifts.behaviour(shifts.bucketed(streams(spark, sf))).drop("channel")


@query(f"with recursive {STREAMS}, {CUSUM} select hits.subject_id, hits.i - 1 place, s.b as at, round(hits.hit, 6) score from hits join s on s.case_id = hits.case_id and s.subject_id = hits.subject_id and s.i = hits.i")
def registered_detector(spark: SparkSession, sf: str) -> DataFrame:
    """CUSUM as a table function of SQL over all activity series."""
    extension.register(spark, "cusum_of", lambda v: shifts.cusum_alarms(v, shifts.DRIFT, shifts.THRESHOLD) if len(v) >= shifts.least_buckets(shifts.MIN_SIZE) else [])
    points = shifts.bucketed(streams(spark, sf)).select("subject_id", F.explode("points").alias("p")).select("subject_id", "p.at", "p.n")
    points.createOrReplaceTempView("activity_points")
    return spark.sql("select subject_id, place, at, round(score, 6) score from cusum_of(table(activity_points))")
