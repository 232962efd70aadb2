"""Aggregate views of an analyst console: posture, signal matrix, comparison, metrics, lists and lineage."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.relational import all_of, first_per_key

# Fixed values of the signal matrix: a default support, the contradictions' step and bound, the freshness, the bands.
DEFAULT_SUPPORT = 0.55
CONTRADICT_STEP, CONTRADICT_MOST = 0.12, 0.85
FRESH_STEP, FRESH_MOST = 0.08, 0.99
HIGH, MEDIUM = 0.72, 0.48
MODALITIES = ("behavioral", "infrastructure", "financial", "stylometry", "temporal")
#: Cases in these states are done.
TERMINAL = ("closed", "archived")
#: Channels of an infrastructure finding in the order of ties; temporal never decides.
CHANNELS = ("certificate", "content", "http", "tls", "technology")


def band(value: Column) -> Column:
    return F.when(value >= HIGH, "HIGH").when(value >= MEDIUM, "MEDIUM").otherwise("LOW")


def non_empty(array: Column) -> Column:
    """Whether the array has an element; NULL and empty have none."""
    return F.coalesce(F.size(array) > 0, F.lit(False))


def array_total(array: Column) -> Column:
    """The elements of all arrays of a group together, 0 for none (an aggregate)."""
    return F.coalesce(F.sum(F.size(F.coalesce(array, F.array().cast("array<string>")))), F.lit(0)).cast("bigint")


def command_posture(cases: DataFrame, evidence: DataFrame, assessments: DataFrame, pressure: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """The headline figures, one row. cases: (status, priority, sla_state, assigned_to); evidence: (collected_at);
    assessments: (contradicting), an array; pressure: (score). At risk counts breached deadlines as well."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    counts = cases.agg(
        F.count(F.lit(1)).alias("total_investigations"), F.count_if(F.col("status").isin("open", "active")).alias("active_investigations"), F.count_if(F.col("priority") == "critical").alias("critical"), F.count_if(F.col("priority") == "high").alias("high"),
        F.count_if(F.col("sla_state").isin("breached", "at_risk")).alias("sla_at_risk"), F.count_if(F.col("assigned_to").isNull()).alias("unassigned"),
    )
    fresh = evidence.agg(F.count_if(F.col("collected_at") >= since).alias("new_evidence"))
    unresolved = assessments.agg(F.count_if(non_empty(F.col("contradicting"))).alias("unresolved_links"))
    index = pressure.agg(F.coalesce(F.bround(F.avg("score"), 0), F.lit(0.0)).cast("bigint").alias("pressure_index"))
    return counts.crossJoin(F.broadcast(fresh)).crossJoin(F.broadcast(unresolved)).crossJoin(F.broadcast(index))  # one row each


def attribution_posture(assessments: DataFrame, cases: DataFrame) -> DataFrame:
    """The leading assessment of each case that isn't done: greatest calibrated confidence (none comes last), then the
    newest, then the smallest id. A case without an assessment is left out. Its confidence is the calibrated one, else
    the raw score; freshness is the strongest signal, else the calibrated confidence, else 0.

    assessments: (case_id, assessment_id, calibrated, raw, created_at, signals, supporting, contradicting)."""
    lead = first_per_key(assessments, ["case_id"], [F.desc_nulls_last("calibrated"), F.desc("created_at"), F.asc("assessment_id")])
    open_cases = cases.filter(~F.col("status").isin(*TERMINAL)).select("case_id").distinct()
    none = F.array().cast("array<string>")
    return lead.join(open_cases, "case_id").select(
        "case_id", "assessment_id", F.round(F.coalesce("calibrated", "raw"), 4).alias("confidence"), F.size(F.coalesce("supporting", none)).cast("bigint").alias("supporting_signals"), F.coalesce(F.size("signals"), F.lit(0)).cast("bigint").alias("modalities"),
        F.size(F.coalesce("contradicting", none)).cast("bigint").alias("contradictions"), F.round(F.coalesce(F.array_max(F.map_values("signals")), "calibrated", F.lit(0.0)), 3).alias("freshness"),
    )


def signal_matrix(assessments: DataFrame, modalities: Sequence[str] = MODALITIES) -> DataFrame:
    """Every modality of each case that has an assessment: the mean of its signals over all of them (a default without
    one), all the case's contradictions per assessment, bounded, and so alike for every modality, their bands, and the
    freshness of 100.

    assessments: (case_id, signals, contradicting); signals' names count in any case."""
    n = F.sum(F.size(F.coalesce("contradicting", F.array().cast("array<string>")))) / F.count(F.lit(1))
    cases = assessments.groupBy("case_id").agg(F.least(F.lit(CONTRADICT_MOST), n * CONTRADICT_STEP).alias("against"))
    each = assessments.select("case_id", F.explode("signals").alias("name", "value")).groupBy("case_id", F.lower("name").alias("modality")).agg(F.avg("value").alias("mean"))
    grid = cases.withColumn("modality", F.explode(F.array(*map(F.lit, modalities))))
    support = F.coalesce("mean", F.lit(DEFAULT_SUPPORT))
    return grid.join(each, ["case_id", "modality"], "left").select(
        "case_id", F.initcap("modality").alias("modality"), band(support).alias("support"), band(F.col("against")).alias("contradict"), F.round(support, 3).alias("support_value"), F.round("against", 3).alias("contradict_value"),
        F.round(F.least(F.lit(FRESH_MOST), support + FRESH_STEP) * 100, 1).alias("freshness"),
    )


def hypothesis_comparison(links: DataFrame) -> DataFrame:
    """One row a hypothesis and modality: supporting and contradicting links, their difference, and bucket: aligned with
    supporting links only, apart with contradicting ones only, weak with both. Any role but `supporting` contradicts;
    no modality is `unattributed`. links: (hypothesis_id, modality, role, ...)."""
    own = F.col("role") == "supporting"
    g = links.groupBy("hypothesis_id", F.coalesce("modality", F.lit("unattributed")).alias("modality")).agg(F.count_if(own).alias("supporting"), F.count_if(~F.coalesce(own, F.lit(False))).alias("contradicting"))
    bucket = F.when(F.col("contradicting") == 0, "aligned").when(F.col("supporting") == 0, "apart").otherwise("weak")
    return g.withColumn("net", F.col("supporting") - F.col("contradicting")).withColumn("bucket", bucket)


def hypothesis_summary(hypotheses: DataFrame, links: DataFrame) -> DataFrame:
    """Of each hypothesis: supporting and contradicting evidence, independent source groups (of supporting links), the
    modalities of each bucket, and gap, whether no evidence has been linked at all."""
    parts = hypothesis_comparison(links).groupBy("hypothesis_id").agg(F.sum("supporting").alias("supporting_evidence"), F.sum("contradicting").alias("contradicting_evidence"), *[F.count_if(F.col("bucket") == b).alias(b) for b in ("aligned", "apart", "weak")])
    groups = links.filter("role = 'supporting'").groupBy("hypothesis_id").agg(F.count_distinct("independence_group").alias("independent_source_groups"))
    out = hypotheses.select("hypothesis_id").join(parts, "hypothesis_id", "left").join(groups, "hypothesis_id", "left")
    gap = F.col("supporting_evidence").isNull()
    return out.withColumn("gap", gap).fillna(0, ["supporting_evidence", "contradicting_evidence", "aligned", "apart", "weak", "independent_source_groups"])


def case_metrics(evidence: DataFrame, groups: DataFrame, assessments: DataFrame) -> DataFrame:
    """For each case: evidence, distinct sources and independence groups (a source without one counts for itself), and
    the greatest calibrated confidence. Counted by source first, so a hot case is small before it is joined."""
    by_source = evidence.groupBy("case_id", "source_id").agg(F.count(F.lit(1)).alias("n")).join(groups, "source_id", "left")
    own = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("s"), F.col("source_id").cast("string")))
    g = by_source.groupBy("case_id").agg(F.sum("n").alias("evidence"), F.count(F.lit(1)).alias("sources"), F.count_distinct(own).alias("groups"))
    return g.join(assessments.groupBy("case_id").agg(F.round(F.max("confidence"), 4).alias("calibrated")), "case_id", "left")


def relation_counts(items: DataFrame, relations: DataFrame, key: str = "id") -> DataFrame:
    """items with relations: how often each is an end of a relation (source, target); one with itself counts once."""
    ends = relations.select(F.explode(F.array_distinct(F.array("source", "target"))).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("relations"))
    return items.join(ends, key, "left").withColumn("relations", F.coalesce("relations", F.lit(0)).cast("bigint"))


def decisive_channels(breakdown: Column, thresholds: dict[str, float]) -> Column:
    """The channels of a map whose score reaches their threshold, strongest first, ties in the thresholds' order."""
    hit = [F.when(F.try_element_at(breakdown, F.lit(c)) >= t, F.struct((-F.try_element_at(breakdown, F.lit(c))).alias("s"), F.lit(k).alias("k"), F.lit(c).alias("c"))) for k, (c, t) in enumerate(thresholds.items())]
    return F.transform(F.array_sort(F.array_compact(F.array(*hit))), lambda x: x["c"])


def links_of(links: DataFrame, min_confidence: float | None = None, kind: str | None = None, recorded: bool | None = None, limit: int = 200) -> DataFrame:
    """actor, other, kind, confidence, last_seen, rank: an actor's links with the newest activity first (unknown times last,
    then first_seen, then the ids), each seen from both ends. The conditions are optional; limit is a page's length.

    links: (source, target, kind, recorded, confidence, first_seen, last_seen)."""
    keep = all_of(F.col("confidence") >= min_confidence if min_confidence is not None else None, F.col("kind") == kind if kind else None, F.col("recorded") == recorded if recorded is not None else None)
    seen = links.filter(keep)
    rest = ["kind", "confidence", "first_seen", "last_seen"]
    both = seen.select(F.col("source").alias("actor"), F.col("target").alias("other"), *rest).unionByName(seen.filter("source <> target").select(F.col("target").alias("actor"), F.col("source").alias("other"), *rest))
    w = Window.partitionBy("actor").orderBy(F.desc_nulls_last("last_seen"), F.desc_nulls_last("first_seen"), "other", "kind")
    return both.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit).drop("first_seen")


def merged_streams(first: Sequence[DataFrame], fallback: DataFrame) -> DataFrame:
    """Events (subject, channel, at, what) of several sources; those of the fallback only where no other source has the
    subject and channel."""
    out = first[0]
    for s in first[1:]:
        out = out.unionByName(s)
    known = out.select("subject", "channel").distinct()
    return out.unionByName(fallback.join(known, ["subject", "channel"], "left_anti").select(*out.columns))


def lineage_members(roots: DataFrame) -> DataFrame:
    """root, members, depth of (source_id, root, depth): how many sources go back to each root, and how far at most."""
    return roots.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max("depth").alias("depth"))


def lineage_path(sources: DataFrame, max_depth: int = 64) -> DataFrame:
    """source_id, path (from the root to the source) of (source_id, copied_from), by joining doubled path pieces; a
    parent that isn't registered is its own root, a cycle raises."""
    from evidentia.operators.dedup import checkpointed

    up = F.col("copied_from")
    state = sources.select("source_id", up.alias("up"), F.array("source_id").alias("path"))
    done = 1
    while state.filter("up is not null").limit(1).count():
        if done > max_depth:
            raise ValueError("the lineage has a cycle")
        above = state.select(F.col("source_id").alias("k"), F.col("up").alias("far"), F.col("path").alias("more"))
        joined = state.join(above, F.col("up") == F.col("k"), "left")
        missing = F.when(F.col("up").isNotNull(), F.array("up"))  # an unregistered parent
        state = checkpointed(joined.select("source_id", "far", F.concat(F.coalesce("more", missing, F.array().cast(state.schema["path"].dataType)), "path").alias("path")).withColumnRenamed("far", "up"), "path")
        done *= 2
    return state.select("source_id", "path")


def interactions(replies: DataFrame) -> DataFrame:
    """l, r, n, first_at, last_at of replies and mentions between different aliases, either way: (author, other, at,
    other_at), both posts' times count."""
    pair = replies.filter("author <> other").select(F.least("author", "other").alias("l"), F.greatest("author", "other").alias("r"), "at", "other_at")
    return pair.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("at"), F.min("other_at")).alias("first_at"), F.greatest(F.max("at"), F.max("other_at")).alias("last_at"))
