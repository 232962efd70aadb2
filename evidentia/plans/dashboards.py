"""Console views over the stored tables, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import dashboards as D
from evidentia.plans.registry import query
from evidentia.plans.relational import ACTORS, CONSOLE, CONSOLE_SLA, EVIDENCE, NOW, console_cases, hypothesis_links
from evidentia.sources.tables import actors, cases, evidence, observations, table

#: An assessment for each order of an assessed actor: a map of two signals.
ASSESS = f"(select o_orderkey % 50 case_id, o_orderkey assessment_id, confidence, confidence style, round((o_orderkey % 97) / 97.0, 4) timing from orders join {ACTORS} a on a.actor_id = o_custkey)"


def _assessments(spark: SparkSession, sf: str) -> DataFrame:
    o = cases(spark, sf).join(actors(spark, sf).select("actor_id", "confidence"), "actor_id")
    timing = F.round((F.col("case_id") % 97) / F.lit(97.0), 4)
    return o.select((F.col("case_id") % 50).alias("case_id"), F.col("case_id").alias("assessment_id"), "confidence", F.create_map(F.lit("style"), "confidence", F.lit("timing"), timing).alias("signals"))


#: An assessment for each order: calibrated if its actor is assessed; up to three signals, named in any case.
ASSESSED = f"""(select o_orderkey % 50 case_id, o_orderkey assessment_id, confidence calibrated, round((o_orderkey % 89) / 89.0, 4) raw, o_orderdate created_at, confidence behavioral, round((o_orderkey % 97) / 97.0, 4) temporal, case when o_orderkey % 2 = 0 then round((o_orderkey % 83) / 83.0, 4) end financial,
 cast(o_orderkey % 5 as bigint) pro, cast(case when o_orderkey % 7 = 0 then 2 when o_orderkey % 11 = 0 then 1 else 0 end as bigint) con from orders join {ACTORS} a on a.actor_id = o_custkey)"""


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    o = cases(spark, sf).join(actors(spark, sf).select("actor_id", "confidence"), "actor_id")
    k = F.col("case_id")
    part = lambda n: F.round((k % n) / F.lit(float(n)), 4)
    signals = F.map_filter(F.create_map(F.lit("Behavioral"), F.col("confidence"), F.lit("temporal"), part(97), F.lit("FINANCIAL"), F.when(k % 2 == 0, part(83))), lambda n, v: v.isNotNull())
    ids = lambda n: F.transform(F.array_repeat(F.lit("e"), n), lambda x, i: F.concat(x, i.cast("string")))
    con = F.when(k % 7 == 0, ids(F.lit(2))).when(k % 11 == 0, ids(F.lit(1)))
    return o.select((k % 50).alias("case_id"), k.alias("assessment_id"), F.col("confidence").alias("calibrated"), part(89).alias("raw"), F.col("opened_at").alias("created_at"), signals.alias("signals"), ids((k % 5).cast("int")).alias("supporting"), con.alias("contradicting"))


@query(f"""with c as (select *, {CONSOLE_SLA} sla from {CONSOLE}) select count(*) total_investigations, count(*) filter (where status in ('open', 'active')) active_investigations, count(*) filter (where priority = 'critical') critical, count(*) filter (where priority = 'high') high, count(*) filter (where sla in ('breached', 'at_risk')) sla_at_risk, count(*) filter (where assigned_to is null) unassigned,
 (select count(*) from {EVIDENCE} where collected_at >= timestamp '1998-07-25') new_evidence, (select count(*) from {ASSESSED} where con > 0) unresolved_links, (select cast(round_even(avg(least(100, round_even(100.0 * n / 60000, 0))), 0) as bigint) from (select count(*) n from lineitem group by l_returnflag)) pressure_index from c""")
def command_posture(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence(spark, sf)
    pressure = e.groupBy("kind").agg(F.least(F.lit(100.0), F.bround(100.0 * F.count(F.lit(1)) / 60000, 0)).alias("score"))
    return D.command_posture(console_cases(spark, sf), e, assessed(spark, sf), pressure, NOW)


@query(f"with a as (select *, row_number() over (partition by case_id order by calibrated desc nulls last, created_at desc, assessment_id) r from {ASSESSED}) select case_id, assessment_id, round(coalesce(calibrated, raw), 4) confidence, pro supporting_signals, cast(1 + (calibrated is not null)::int + (financial is not null)::int as bigint) modalities, con contradictions, round(greatest(behavioral, temporal, financial), 3) freshness from a join (select distinct case_id % 50 c from {CONSOLE} where status <> 'closed') o on o.c = a.case_id where r = 1")
def attribution_posture(spark: SparkSession, sf: str) -> DataFrame:
    c = console_cases(spark, sf).select((F.col("case_id") % 50).alias("case_id"), "status")
    return D.attribution_posture(assessed(spark, sf), c)


@query(f"""with a as {ASSESSED}, c as (select case_id, least(0.85, sum(con) / count(*) * 0.12) k, avg(behavioral) b, avg(temporal) t, avg(financial) f from a group by 1),
v as (select case_id, k, unnest([{{'m': 'Behavioral', 's': coalesce(b, 0.55)}}, {{'m': 'Infrastructure', 's': 0.55}}, {{'m': 'Financial', 's': coalesce(f, 0.55)}}, {{'m': 'Stylometry', 's': 0.55}}, {{'m': 'Temporal', 's': coalesce(t, 0.55)}}]) u from c)
select case_id, u.m modality, case when u.s >= 0.72 then 'HIGH' when u.s >= 0.48 then 'MEDIUM' else 'LOW' end support, case when k >= 0.72 then 'HIGH' when k >= 0.48 then 'MEDIUM' else 'LOW' end contradict, round(u.s, 3) support_value, round(k, 3) contradict_value, round(least(0.99, u.s + 0.08) * 100, 1) freshness from v""")
def signal_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return D.signal_matrix(assessed(spark, sf))


LINKS = f"(select order_id h, coalesce(case when source_id % 11 <> 0 then 'm' || (source_id % 5) end, 'unattributed') m, kind = 'R' con, source_id % 25 grp from {EVIDENCE})"


@query(f"""with b as (select h, m, count(*) filter (where not con) s, count(*) filter (where con) c from {LINKS} group by 1, 2), t as (select h, cast(sum(s) as bigint) s, cast(sum(c) as bigint) c, count(*) filter (where c = 0) al, count(*) filter (where s = 0) ap, count(*) filter (where s > 0 and c > 0) w from b group by 1), g as (select h, count(distinct grp) n from {LINKS} where not con group by 1)
select o.h hypothesis_id, coalesce(s, 0) supporting_evidence, coalesce(c, 0) contradicting_evidence, coalesce(al, 0) aligned, coalesce(ap, 0) apart, coalesce(w, 0) weak, coalesce(n, 0) independent_source_groups, s is null gap from (select o_orderkey h from orders union all select -p_partkey from part) o left join t on t.h = o.h left join g on g.h = o.h""")
def hypothesis_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses of orders, and, without any evidence, of parts."""
    h = table(spark, sf, "orders").select(F.col("o_orderkey").alias("hypothesis_id")).unionByName(table(spark, sf, "part").select((-F.col("p_partkey")).alias("hypothesis_id")))
    return D.hypothesis_summary(h, hypothesis_links(spark, sf))


@query(f"with e as (select case_id, count(*) evidence, count(distinct source_id) sources, count(distinct coalesce('g' || s_nationkey, 's' || source_id)) as groups from {EVIDENCE} left join supplier on s_suppkey = source_id and s_acctbal >= 0 group by 1) select e.*, round(m, 4) calibrated from e left join (select case_id, max(confidence) m from {ASSESS} group by 1) a using (case_id)")
def case_metrics(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("group_id"))
    return D.case_metrics(evidence(spark, sf), groups, _assessments(spark, sf))


RELATED = "(select distinct l_suppkey source, (l_suppkey * 7 + l_linenumber) % 100 + 1 target from lineitem)"


@query(f"with r as {RELATED}, ends as (select source id from r union all select target from r where target <> source) select s_suppkey id, count(ends.id) relations from supplier left join ends on ends.id = s_suppkey group by 1")
def finding_relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 100 + 1).alias("target")).distinct()
    return D.relation_counts(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), r)


@query("""with b as (select round(l_discount * 10, 4) ce, round(l_tax * 12.5, 4) co, round(l_quantity / 50, 4) ht, round(l_linenumber / 7, 4) tl from lineitem),
d as (select array_to_string(list_transform(list_sort(list_filter([case when ce >= 0.8 then {'s': -ce, 'k': 0, 'c': 'certificate'} end, case when co >= 0.7 then {'s': -co, 'k': 1, 'c': 'content'} end, case when ht >= 0.9 then {'s': -ht, 'k': 2, 'c': 'http'} end, case when tl >= 0.95 then {'s': -tl, 'k': 3, 'c': 'tls'} end], lambda x: x is not null)), lambda x: x.c), ',') decisive from b)
select decisive, decisive <> '' and not contains(decisive, ',') single_channel, count(*) n from d group by all""")
def decisive_channel_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Which channels decide, strongest first, and how often only one does."""
    score = lambda c, x: (F.lit(c), F.round(x, 4))
    m = F.create_map(*score("certificate", F.col("l_discount") * 10), *score("content", F.col("l_tax") * 12.5), *score("http", F.col("l_quantity") / 50), *score("tls", F.col("l_linenumber") / 7))
    d = table(spark, sf, "lineitem").select(D.decisive_channels(m, {"certificate": 0.8, "content": 0.7, "http": 0.9, "tls": 0.95, "technology": 0.95}).alias("d"))
    return d.groupBy(F.array_join("d", ",").alias("decisive"), (F.size("d") == 1).alias("single_channel")).agg(F.count(F.lit(1)).alias("n"))


@query("""with l as (select 'c' || o_custkey source, 's' || l_suppkey target, case when l_returnflag = 'R' then 'returned' else 'traded' end kind, round(max(l_quantity) / 50, 4) confidence, min(l_shipdate) first_seen, max(l_shipdate) last_seen from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3 having round(max(l_quantity) / 50, 4) >= 0.5 and case when l_returnflag = 'R' then 'returned' else 'traded' end = 'traded'),
b as (select source actor, target other, * exclude (source, target) from l union all select target, source, * exclude (source, target) from l) select actor, other, kind, confidence, last_seen, cast(k as bigint) as rank from (select *, row_number() over (partition by actor order by last_seen desc nulls last, first_seen desc nulls last, other, kind) k from b) where k <= 3""")
def actor_links(spark: SparkSession, sf: str) -> DataFrame:
    """The three newest trades of every actor, from either end."""
    j = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "returned").otherwise("traded")
    ship = F.col("l_shipdate").cast("timestamp_ntz")
    links = j.groupBy(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), kind.alias("kind")).agg(F.round(F.max("l_quantity") / 50, 4).alias("confidence"), F.min(ship).alias("first_seen"), F.max(ship).alias("last_seen"))
    return D.links_of(links.withColumn("recorded", F.lit(True)), 0.5, "traded", True, 3)


@query("with a as (select user_id subject, 'seen' channel, cast(ts as timestamp) happened, event_type what from events where event_type in ('click', 'view') union all select o_custkey, 'order', cast(o_orderdate as timestamp), o_orderstatus from orders), f as (select user_id subject, 'order' channel, cast(ts as timestamp) happened, event_type what from events where event_type = 'purchase') select channel, what, count(*) n, count(distinct subject) subjects from (select * from a union all select * from f where not exists (select 1 from a where a.subject = f.subject and a.channel = f.channel)) group by 1, 2")
def case_streams(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    pick = lambda d, channel: d.select(F.col("subject_id").alias("subject"), F.lit(channel).alias("channel"), F.col("observed_at").alias("at"), F.col("value").alias("what"))
    orders = cases(spark, sf).select(F.col("actor_id").alias("subject"), F.lit("order").alias("channel"), F.col("opened_at").alias("at"), F.col("status").alias("what"))
    s = D.merged_streams([pick(o.filter(F.col("value").isin("click", "view")), "seen"), orders], pick(o.filter("value = 'purchase'"), "order"))
    return s.groupBy("channel", "what").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"))


@query("with recursive p as (select s_suppkey source_id, cast(s_suppkey as varchar) path from supplier where s_suppkey % 5 = 0 union all select s.s_suppkey, p.path || '>' || s.s_suppkey from supplier s join p on s.s_suppkey = p.source_id + 1 where s.s_suppkey % 5 <> 0) select source_id, path from p")
def lineage_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k.alias("source_id"), F.when(k % 5 != 0, k - 1).alias("copied_from"))
    return D.lineage_path(s).select("source_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("with s as (select s_suppkey source_id, s_suppkey - s_suppkey % 5 root, s_suppkey % 5 depth from supplier) select root, count(*) members, max(depth) depth from s group by 1")
def lineage_members(spark: SparkSession, sf: str) -> DataFrame:
    from evidentia.operators.dedup import lineage_roots

    k = F.col("s_suppkey")
    return D.lineage_members(lineage_roots(table(spark, sf, "supplier").select(k.alias("source_id"), F.when(k % 5 != 0, k - 1).alias("copied_from"))))


@query("with t as (select role, lag(role) over w other, turn, lag(turn) over w before from conversations window w as (partition by conv_id order by turn)) select least(role, other) l, greatest(role, other) r, count(*) n, cast(least(min(turn), min(before)) as bigint) first_at, cast(greatest(max(turn), max(before)) as bigint) last_at from t where role <> other group by 1, 2")
def interaction_graph(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turn = F.col("turn").cast("bigint")
    return D.interactions(table(spark, sf, "conversations").select(F.col("role").alias("author"), F.lag("role").over(w).alias("other"), turn.alias("at"), F.lag(turn).over(w).alias("other_at")))


@query("select user_id, count(*) filter (where len(k) > 0) contradicted, cast(coalesce(sum(len(k)), 0) as bigint) contradictions from (select user_id, list_filter(['click:' || (event_id % 3), 'x'], lambda x: event_type = 'click' and event_id % 2 = 0) k from events) group by 1")
def contradiction_totals(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0), F.array(F.concat(F.lit("click:"), (F.col("event_id") % 3).cast("string")), F.lit("x")))
    return table(spark, sf, "events").withColumn("k", ids).groupBy("user_id").agg(F.count_if(D.non_empty(F.col("k"))).alias("contradicted"), D.array_total(F.col("k")).alias("contradictions"))
