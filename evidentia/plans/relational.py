"""Registry, case, ledger and dashboard queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators import relational as R
from evidentia.plans.registry import query
from evidentia.sources.tables import actors, cases, evidence, observations, table

NOW = datetime(1998, 8, 1)
#: Actors and confidences as SQL. The balance is rounded as a decimal: 2885.50 is 0.2886, which a double just below the middle makes 0.2885.
ACTORS = "(select c_custkey actor_id, c_name handle, c_mktsegment category, c_nationkey source_id, case when c_acctbal >= 0 then cast(cast(cast(c_acctbal as decimal(18, 6)) * 0.0001 as decimal(18, 4)) as double) end confidence from customer)"
EVIDENCE = "(select concat(l_orderkey, '-', l_linenumber) evidence_id, l_orderkey % 50 case_id, l_suppkey source_id, l_orderkey order_id, l_shipdate collected_at, round(1 - l_discount, 2) reliability, cast(l_quantity as bigint) quantity, l_returnflag kind from lineitem)"
CASES = "(select o_orderkey case_id, o_custkey actor_id, lower(substr(o_orderpriority, 3, 20)) priority, o_orderstatus status, o_orderdate opened_at, o_orderdate + interval 2 day sla_due_at, o_totalprice amount from orders)"


@query(f"select a.actor_id, a.handle, n_name source_name, a.confidence, coalesce(i.n, 0) identifiers from {ACTORS} a left join nation on source_id = n_nationkey left join (select o_custkey, count(*) n from orders group by 1) i on i.o_custkey = a.actor_id order by a.confidence desc nulls last, a.actor_id limit 50 offset 10")
def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("actor_id")).agg(F.count(F.lit(1)).alias("identifiers"))
    a = actors(spark, sf).join(table(spark, sf, "nation"), F.col("source_id") == F.col("n_nationkey"), "left").join(ids, "actor_id", "left")
    return a.orderBy(F.desc_nulls_last("confidence"), "actor_id").offset(10).limit(50).select("actor_id", "handle", F.col("n_name").alias("source_name"), "confidence", F.coalesce("identifiers", F.lit(0)).alias("identifiers"))


@query(f"select actor_id, handle, confidence from {ACTORS} where (lower(handle) like '%12%' or actor_id in (select o_custkey from orders where lower(o_orderpriority) like '%urgent%' and o_orderstatus = 'F')) and category = 'BUILDING' and confidence is not null and confidence >= 0.2")
def registry_filter_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    hit = table(spark, sf, "orders").filter(R.contains_ci("o_orderpriority", "urgent") & (F.col("o_orderstatus") == "F")).select(F.col("o_custkey").alias("id"), F.lit(True).alias("hit")).distinct()
    a = actors(spark, sf).filter(R.all_of(F.col("category") == "BUILDING", R.at_least("confidence", 0.2))).join(hit, F.col("actor_id") == F.col("id"), "left")
    return a.filter(R.contains_ci("handle", "12") | F.coalesce("hit", F.lit(False))).select("actor_id", "handle", "confidence")


@query(f"select actor_id, confidence, row_number() over (partition by category order by confidence asc nulls last, actor_id) place from {ACTORS}")
def registry_sort_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("category").orderBy(F.asc_nulls_last("confidence"), "actor_id")
    return actors(spark, sf).select("actor_id", "confidence", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"select status, priority, count(*) n from {CASES} group by 1, 2")
def status_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))


@query(f"select v.status, p.priority, count(c.case_id) n from (values ('F'), ('O'), ('P'), ('X')) v(status) cross join (values ('urgent'), ('high'), ('medium'), ('low'), ('none')) p(priority) left join {CASES} c on c.status = v.status and c.priority = p.priority group by 1, 2")
def zero_filled_counts(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = spark.createDataFrame([(s, p) for s in "FOPX" for p in ("urgent", "high", "medium", "low", "none")], "status string, priority string")
    return R.zero_filled(cases(spark, sf).groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n")), vocabulary, ["status", "priority"])


@query(f"select source_id, count(distinct case_id) cases, count(distinct order_id) orders from {EVIDENCE} group by 1")
def distinct_count_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).groupBy("source_id").agg(F.count_distinct("case_id").alias("cases"), F.count_distinct("order_id").alias("orders"))


@query(f"select case_id, cast(sum(case when kind = 'R' then quantity else 0 end) as bigint) returned, count(*) filter (where reliability >= 0.95) reliable from {EVIDENCE} group by 1")
def conditional_sum(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).groupBy("case_id").agg(F.sum(F.when(F.col("kind") == "R", F.col("quantity")).otherwise(0)).alias("returned"), F.count_if(F.col("reliability") >= 0.95).alias("reliable"))


@query("with cal as (select cast(unnest(generate_series(date '1997-07-01', date '1998-08-01', interval 1 month)) as date) as month), c as (select cast(date_trunc('month', l_shipdate) as date) as month, count(*) n from lineitem group by 1), z as (select cal.month, coalesce(n, 0) n from cal left join c using (month)) select month, n, n - lag(n) over (order by month) delta from z")
def monthly_velocity_delta(spark: SparkSession, sf: str) -> DataFrame:
    return R.month_velocity(evidence(spark, sf), "collected_at", NOW, 13)


@query("with w as (select user_id, cast(date_trunc('week', ts) as date) wk, count(*) n from events group by 1, 2), hi as (select max(wk) m from w), cal as (select cast(unnest(generate_series(cast(m - interval 77 day as date), m, interval 7 day)) as date) wk from hi), u as (select distinct user_id from w where wk in (select wk from cal)), z as (select u.user_id, cal.wk, coalesce(n, 0) n from u cross join cal left join w on w.user_id = u.user_id and w.wk = cal.wk) select user_id, string_agg(n, ',' order by wk) series from z group by 1")
def weekly_series_array(spark: SparkSession, sf: str) -> DataFrame:
    w = observations(spark, sf).groupBy("subject_id", R.week_start("observed_at").alias("wk")).agg(F.count(F.lit(1)).alias("n"))
    last = w.agg(F.max("wk")).first()[0]
    # Twelve places for each subject with a sighting in them; a map lookup fills the gaps, so no calendar join.
    recent = w.filter((F.col("wk") <= F.lit(last)) & (F.col("wk") >= F.date_sub(F.lit(last), 77))).withColumn("k", (F.datediff("wk", F.date_sub(F.lit(last), 77)) / 7).cast("int"))
    m = recent.groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return m.select(F.col("subject_id").alias("user_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("string")), ",").alias("series"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def latest_per_key_row_number(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_per_key(observations(spark, sf), ["subject_id"], [F.desc("observed_at"), F.desc("event_id")]).select(F.col("subject_id").alias("user_id"), "event_id", F.col("value").alias("event_type"))


@query(f"select category, actor_id, confidence from (select *, row_number() over (partition by category order by confidence desc nulls last, actor_id) r from {ACTORS}) where r = 1")
def lead_row_first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_per_key(actors(spark, sf), ["category"], [F.desc_nulls_last("confidence"), F.asc("actor_id")]).select("category", "actor_id", "confidence")


@query("select o.o_orderkey case_id, n1.n_name actor_nation, n2.n_name source_nation, count(*) n from orders o join customer on o_custkey = c_custkey join nation n1 on c_nationkey = n1.n_nationkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation n2 on s_nationkey = n2.n_nationkey where o_orderpriority = '1-URGENT' and n1.n_name <> n2.n_name group by 1, 2, 3")
def double_self_alias_join(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = o.join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(n.alias("a"), F.col("c_nationkey") == F.col("a.n_nationkey")).join(n.alias("b"), F.col("s_nationkey") == F.col("b.n_nationkey")).filter("a.n_name <> b.n_name")
    return j.groupBy(F.col("o_orderkey").alias("case_id"), F.col("a.n_name").alias("actor_nation"), F.col("b.n_name").alias("source_nation")).agg(F.count(F.lit(1)).alias("n"))


@query("select distinct user_id, event_type, cast(ts as date) as \"day\" from events where hour(ts) >= 12 except select user_id, event_type, cast(ts as date) from events where hour(ts) < 12")
def anti_join_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """What came in the afternoon, against what was stored in the morning of the day."""
    e, keys = table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"]
    return R.missing_keys(e.filter(F.hour("ts") >= 12).select(*keys), e.filter(F.hour("ts") < 12).select(*keys), keys)


@query(f"select count(*) n, min(actor_id) lowest from {ACTORS} where actor_id in (select o_custkey from orders where o_totalprice > 200000)")
def semi_join_in(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").filter("o_totalprice > 200000")
    return actors(spark, sf).join(big, F.col("actor_id") == F.col("o_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"), F.min("actor_id").alias("lowest"))


@query("with hits as (select 'case' kind, o_orderkey id from orders where o_orderpriority like '%HIGH%' union all select 'actor', c_custkey from customer where lower(c_mktsegment) like '%auto%' union all select 'source', s_suppkey from supplier where lower(s_name) like '%1%' union all select 'event', event_id from events where lower(props) like '%9%') select kind, id, cast(r as bigint) as rank from (select *, row_number() over (partition by kind order by id) r from hits) where r <= 5")
def per_kind_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Global search: a limit for each kind of result."""
    pick = lambda t, kind, column, term, key: table(spark, sf, t).filter(R.contains_ci(column, term)).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    hits = pick("orders", "case", "o_orderpriority", "HIGH", "o_orderkey").unionByName(pick("customer", "actor", "c_mktsegment", "auto", "c_custkey")).unionByName(pick("supplier", "source", "s_name", "1", "s_suppkey")).unionByName(pick("events", "event", "props", "9", "event_id"))
    return R.top_per_key(hits, ["kind"], [F.asc("id")], 5).select("kind", "id", F.col("rank").cast("bigint").alias("rank"))


@query("select happened, feed, id from (select o_orderdate as happened, 'audit' feed, o_orderkey id from orders union all select l_shipdate, 'evidence', l_orderkey * 10 + l_linenumber from lineitem) order by happened desc, feed, id desc limit 40")
def union_feeds_topk(spark: SparkSession, sf: str) -> DataFrame:
    audit = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("happened"), F.lit("audit").alias("feed"), F.col("o_orderkey").alias("id"))
    ev = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("timestamp_ntz").alias("happened"), F.lit("evidence").alias("feed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return audit.unionByName(ev).orderBy(F.desc("happened"), "feed", F.desc("id")).limit(40)


SLA = "case when sla_due_at is null then 'none' when sla_due_at < timestamp '1998-08-01' then 'breached' when sla_due_at <= timestamp '1998-08-01' + interval 12 hour then 'at_risk' else 'ok' end"


@query(f"select case_id, {SLA} sla from {CASES} where opened_at >= timestamp '1998-07-01'")
def sla_state_case(spark: SparkSession, sf: str) -> DataFrame:
    from evidentia.functions.scores import sla_state

    return cases(spark, sf).filter(R.within("opened_at", datetime(1998, 7, 1))).select("case_id", sla_state(F.col("sla_due_at"), NOW).alias("sla"))


#: Cases as the console sees them: open, active or closed, with a severity, and one in ten without an analyst.
CONSOLE = """(select case_id, actor_id, case status when 'F' then 'closed' when 'O' then 'open' else 'active' end status, case priority when 'urgent' then 'critical' else priority end priority,
 case when amount >= 300000 then 'critical' when amount >= 200000 then 'high' when amount >= 100000 then 'medium' when amount >= 30000 then 'low' else 'informational' end severity, sla_due_at due, case when actor_id % 10 <> 0 then actor_id end assigned_to from """ + CASES + ")"
CONSOLE_SLA = "case when status = 'closed' or due is null then 'none' when due < timestamp '1998-08-01' then 'breached' when due <= timestamp '1998-08-01' + interval 12 hour then 'at_risk' else 'ok' end"


def console_cases(spark: SparkSession, sf: str) -> DataFrame:
    from evidentia.functions.scores import sla_state

    c = cases(spark, sf)
    severity = F.when(F.col("amount") >= 300000, "critical").when(F.col("amount") >= 200000, "high").when(F.col("amount") >= 100000, "medium").when(F.col("amount") >= 30000, "low").otherwise("informational")
    status = F.when(F.col("status") == "F", "closed").when(F.col("status") == "O", "open").otherwise("active")
    c = c.select("case_id", "actor_id", status.alias("status"), F.when(F.col("priority") == "urgent", "critical").otherwise(F.col("priority")).alias("priority"), severity.alias("severity"), F.col("sla_due_at").alias("due"), F.when(F.col("actor_id") % 10 != 0, F.col("actor_id")).alias("assigned_to"))
    return c.withColumn("sla_state", F.when(F.col("status") == "closed", "none").otherwise(sla_state(F.col("due"), NOW)))


@query(f"""with own as (select order_id case_id, count(*) filter (where kind = 'R') contradictions from {EVIDENCE} group by 1), ledger as (select case_id, count(*) links, count(*) filter (where collected_at >= timestamp '1998-08-01' - interval 7 day) recent from {EVIDENCE} group by 1),
q as (select c.*, {CONSOLE_SLA} sla, coalesce(contradictions, 0) k, coalesce(links, 0) links, coalesce(recent, 0) recent from {CONSOLE} c left join own on own.case_id = c.case_id left join ledger on ledger.case_id = c.case_id % 50),
r as (select case_id, case when status = 'closed' then [{{'w': 0, 'label': 'Case closed'}}] else list_sort(list_filter([
 {{'w': -case priority when 'critical' then 46 when 'high' then 34 when 'medium' then 20 when 'low' then 10 else 12 end, 'label': case priority when 'not specified' then 'Not Specified' else upper(priority[1]) || priority[2:] end || ' priority'}},
 {{'w': -case severity when 'critical' then 26 when 'high' then 19 when 'medium' then 11 when 'low' then 5 else 0 end, 'label': upper(severity[1]) || severity[2:] || ' severity'}},
 case sla when 'breached' then {{'w': -18, 'label': 'SLA breached'}} when 'at_risk' then {{'w': -9, 'label': 'SLA due in ' || greatest(1, datediff('second', timestamp '1998-08-01', due) // 3600) || 'h'}} end,
 case when k > 0 then {{'w': -cast(least(12, 4 * k) as int), 'label': k || ' unresolved contradiction' || case when k > 1 then 's' else '' end}} end, case when recent // 25 > 0 then {{'w': -cast(least(12, recent // 25) as int), 'label': recent || ' evidence in 7 days'}} end,
 case when links // 150 > 0 then {{'w': -cast(least(8, links // 150) as int), 'label': links || ' relationships resolved'}} end, case when assigned_to is null then {{'w': -6, 'label': 'No analyst assigned'}} end], lambda x: x is not null)) end reasons from q)
select case_id, cast(least(100, -list_sum(list_transform(reasons, lambda x: x.w))) as int) score, reasons[1].label as reason, array_to_string(list_transform(reasons, lambda x: x.label || ' ' || -x.w), '; ') reasons from r""")
def queue_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every case's score with the reasons behind it; evidence and links are those of the case's ledger."""
    from evidentia.functions.scores import queue_points, queue_reasons

    e = evidence(spark, sf)
    own = e.groupBy(F.col("order_id").alias("case_id")).agg(F.count_if(F.col("kind") == "R").alias("contradictions"))
    week = F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 7 days")
    ledger = e.groupBy(F.col("case_id").alias("bucket")).agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("collected_at") >= week).alias("recent"))
    c = console_cases(spark, sf).join(own, "case_id", "left").join(ledger, F.col("case_id") % 50 == F.col("bucket"), "left").fillna(0, ["contradictions", "links", "recent"])
    hours = F.expr(f"timestampdiff(second, timestamp_ntz'{NOW}', due)") / 3600
    r = queue_reasons(F.col("priority"), F.col("severity"), F.col("sla_state"), hours, F.col("contradictions"), F.col("recent"), F.col("links"), F.col("assigned_to").isNull(), F.col("status"))
    c = c.select("case_id", r.alias("r"))
    return c.select("case_id", queue_points(F.col("r")).alias("score"), F.get("r", F.lit(0))["label"].alias("reason"), F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["label"], x["weight"].cast("string"))), "; ").alias("reasons"))


@query("select name, n, cast(least(100, round(100.0 * n / ceiling)) as bigint) level from (select 'cases' name, count(*) n, 15000 ceiling from orders where o_orderstatus <> 'F' union all select 'evidence', count(*), 60000 from lineitem union all select 'returned', count(*), 20000 from lineitem where l_returnflag = 'R' union all select 'actors', count(*), 1500 from customer union all select 'events', count(*), 9000 from events)")
def pressure_indicators(spark: SparkSession, sf: str) -> DataFrame:
    from evidentia.functions.scores import scaled

    one = lambda t, name, ceiling, where="true": table(spark, sf, t).filter(where).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", scaled(F.col("n"), ceiling).alias("level"))
    parts = [one("orders", "cases", 15000, "o_orderstatus <> 'F'"), one("lineitem", "evidence", 60000), one("lineitem", "returned", 20000, "l_returnflag = 'R'"), one("customer", "actors", 1500), one("events", "events", 9000)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"select v.band, count(e.evidence_id) n, count(distinct e.source_id) sources, cast(coalesce(sum(quantity), 0) as bigint) records from (values ('high'), ('medium'), ('low'), ('none')) v(band) left join (select *, case when reliability >= 0.97 then 'high' when reliability >= 0.93 then 'medium' when reliability >= 0 then 'low' end band from {EVIDENCE}) e on e.band = v.band group by 1")
def banded_reliability(spark: SparkSession, sf: str) -> DataFrame:
    from evidentia.functions.scores import band

    e = evidence(spark, sf).withColumn("band", band(F.col("reliability"), {"high": 0.97, "medium": 0.93, "low": 0.0}))
    counts = e.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("sources"), F.sum("quantity").alias("records"))
    vocabulary = spark.createDataFrame([(b,) for b in ("high", "medium", "low", "none")], "band string")
    return vocabulary.join(counts, "band", "left").fillna(0, ["n", "sources", "records"])


@query("select user_id, string_agg(concat(event_type, '=', n), ';' order by event_type) kinds from (select user_id, event_type, count(*) n from events group by 1, 2) group by 1")
def nested_kind_map(spark: SparkSession, sf: str) -> DataFrame:
    """kind=count pairs; the map itself stays available before the last projection."""
    m = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("kinds"))
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";").alias("kinds"))


@query(f"select order_id hypothesis_id, coalesce(case when source_id % 11 <> 0 then 'm' || (source_id % 5) end, 'unattributed') modality, count(*) filter (where kind <> 'R') supporting, count(*) filter (where kind = 'R') contradicting, count(*) filter (where kind <> 'R') - count(*) filter (where kind = 'R') net, case when bool_and(kind <> 'R') then 'aligned' when bool_and(kind = 'R') then 'apart' else 'weak' end bucket from {EVIDENCE} group by 1, 2")
def hypothesis_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """A hypothesis for each order: its lines support it, returned ones contradict."""
    from evidentia.operators.dashboards import hypothesis_comparison

    return hypothesis_comparison(hypothesis_links(spark, sf))


def hypothesis_links(spark: SparkSession, sf: str) -> DataFrame:
    modality = F.when(F.col("source_id") % 11 != 0, F.concat(F.lit("m"), (F.col("source_id") % 5).cast("string")))
    return evidence(spark, sf).select(F.col("order_id").alias("hypothesis_id"), modality.alias("modality"), F.when(F.col("kind") == "R", "contradicting").otherwise("supporting").alias("role"), (F.col("source_id") % 25).alias("independence_group"))


@query(f"select s.s_suppkey source_id, case when max(collected_at) is null or max(collected_at) < timestamp '1998-08-01' - interval 7 day then true else false end stale from supplier s left join {EVIDENCE} e on e.source_id = s.s_suppkey group by 1")
def staleness_predicate(spark: SparkSession, sf: str) -> DataFrame:
    last = evidence(spark, sf).groupBy("source_id").agg(F.max("collected_at").alias("last"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id")).join(last, "source_id", "left")
    return s.select("source_id", (F.col("last").isNull() | (F.col("last") < F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 7 days"))).alias("stale"))


@query("select lane, count(*) n from (select case event_type when 'click' then 'interaction' when 'view' then 'interaction' when 'purchase' then 'value' else 'event' end lane from events) group by 1")
def action_lane_map(spark: SparkSession, sf: str) -> DataFrame:
    lanes = {"click": "interaction", "view": "interaction", "purchase": "value"}
    m = F.create_map(*[F.lit(x) for kv in lanes.items() for x in kv])
    return table(spark, sf, "events").groupBy(F.coalesce(F.try_element_at(m, "event_type"), F.lit("event")).alias("lane")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id from events where lower(props) like '%\"k\": 6%'")
def json_text_like(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter(R.contains_ci("props", '"k": 6')).select("event_id")


@query("select event_type, count(*) n, count(try_cast(json_extract_string(props, '$.k') as int)) with_k, cast(coalesce(sum(try_cast(json_extract_string(props, '$.k') as int)), 0) as bigint) total from events group by 1")
def json_field_reads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("with_k"), F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias("total"))


@query("select id, rule from (select l_orderkey * 10 + l_linenumber id, unnest(['discount', 'late', 'quantity']) as rule, unnest([l_discount between 0 and 0.05, l_shipdate <= timestamp '1998-11-01', l_quantity <= 49]) ok from lineitem) where not ok")
def structural_violations(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return R.violations(line, "id", {"discount": F.col("l_discount").between(0, 0.05), "late": F.col("l_shipdate") <= F.lit("1998-11-01").cast("timestamp_ntz"), "quantity": F.col("l_quantity") <= 49})


@query("with k as (select o_custkey, o_orderpriority, min(o_orderkey) id from orders where o_totalprice > 150000 group by 1, 2) select id, o_custkey from k order by id limit 30")
def dedupe_then_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The cap is on distinct results, so the page is full whenever there are enough."""
    o = table(spark, sf, "orders").filter("o_totalprice > 150000")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("id")).orderBy("id").limit(30).select("id", "o_custkey")


WINDOWS = "(select l_suppkey id, min(l_shipdate) as start, min(l_shipdate) + interval 40 day as \"end\" from lineitem where l_returnflag = '{}' group by 1)"


@query(f"select l.id l_id, r.id r_id from {WINDOWS.format('A')} l join {WINDOWS.format('N')} r on greatest(l.start, r.start) <= least(l.\"end\", r.\"end\")")
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    side = lambda flag: line.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("id")).agg(F.min("l_shipdate").cast("timestamp_ntz").alias("start")).withColumn("end", F.col("start") + F.expr("interval 40 days"))
    return R.overlap_join(side("A"), side("N")).select("l_id", "r_id")


@query(f"with g as (select case_id, coalesce('n' || s_nationkey, 'ungrouped:' || source_id) grp, count(*) n from {EVIDENCE} left join supplier on s_suppkey = source_id and s_acctbal >= 0 group by 1, 2) select case_id, grp dominant, n size from (select *, row_number() over (partition by case_id order by n desc, grp) r from g) where r = 1")
def dominant_group(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("n"), "s_nationkey").alias("g"))
    g = evidence(spark, sf).groupBy("case_id", "source_id").agg(F.count(F.lit(1)).alias("n")).join(s, "source_id", "left").groupBy("case_id", F.coalesce("g", F.concat(F.lit("ungrouped:"), "source_id")).alias("dominant")).agg(F.sum("n").alias("size"))
    return R.first_per_key(g, ["case_id"], [F.desc("size"), F.asc("dominant")])


@query(f"select n_name, round(avg(confidence), 4) mean_confidence, count(confidence) assessed from nation left join {ACTORS} on source_id = n_nationkey group by 1")
def mean_or_null(spark: SparkSession, sf: str) -> DataFrame:
    a = actors(spark, sf)
    return table(spark, sf, "nation").join(a, F.col("source_id") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count("confidence").alias("assessed"))


@query("select event_type, round(avg(k), 4) mean_k from (select event_type, try_cast(json_extract_string(props, '$.k') as double) k from events) where k is not null group by 1")
def map_key_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The mean for each key of a map column."""
    m = table(spark, sf, "events").select(F.create_map("event_type", F.get_json_object("props", "$.k").try_cast("double")).alias("signals"))
    return m.select(F.explode("signals").alias("event_type", "v")).filter("v is not null").groupBy(F.lower("event_type").alias("event_type")).agg(F.round(F.avg("v"), 4).alias("mean_k"))


@query(f"select c.case_id, coalesce(e.n, 0) evidence, e.earliest, e.latest, coalesce(e.groups, 0) as groups, a.confidence from {CASES} c left join (select order_id, count(*) n, min(collected_at) earliest, max(collected_at) latest, count(distinct source_id % 7) as groups from {EVIDENCE} group by 1) e on e.order_id = c.case_id left join {ACTORS} a on a.actor_id = c.actor_id where c.status = 'O'")
def case_rollup(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence(spark, sf).groupBy(F.col("order_id").alias("case_id")).agg(F.count(F.lit(1)).alias("evidence"), F.min("collected_at").alias("earliest"), F.max("collected_at").alias("latest"), F.count_distinct(F.col("source_id") % 7).alias("groups"))
    c = cases(spark, sf).filter("status = 'O'").join(e, "case_id", "left").join(actors(spark, sf).select("actor_id", "confidence"), "actor_id", "left")
    return c.select("case_id", F.coalesce("evidence", F.lit(0)).alias("evidence"), "earliest", "latest", F.coalesce("groups", F.lit(0)).alias("groups"), "confidence")


@query("select s_suppkey source_id, n_name, coalesce(jobs, 0) jobs, cast(coalesce(records, 0) as bigint) records, case when last is null then 'never' when last < timestamp '1998-08-01' - interval 7 day then 'stale' else 'healthy' end freshness from supplier join nation on s_nationkey = n_nationkey left join (select l_suppkey, count(distinct l_orderkey) jobs, sum(cast(l_quantity as bigint)) records, max(l_shipdate) as last from lineitem where l_shipdate <= timestamp '1998-08-01' group by 1) x on x.l_suppkey = s_suppkey")
def source_register(spark: SparkSession, sf: str) -> DataFrame:
    x = evidence(spark, sf).filter(R.within("collected_at", until=NOW)).groupBy("source_id").agg(F.count_distinct("order_id").alias("jobs"), F.sum("quantity").alias("records"), F.max("collected_at").alias("last"))
    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "source_id").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(x, "source_id", "left")
    fresh = F.when(F.col("last").isNull(), "never").when(F.col("last") < F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 7 days"), "stale").otherwise("healthy")
    return s.select("source_id", "n_name", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("records", F.lit(0)).alias("records"), fresh.alias("freshness"))


@query("select n_name, count(*) n, count(*) filter (where o_orderstatus = 'O') open, cast(sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as bigint) urgent from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def team_load(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
