"""Scalar scores, bands and similarity measures as Column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.ln(q / (1 - q))


def band(x: Column, floors: dict[str, float]) -> Column:
    """The first name whose floor is reached; NULL below all and for NULL."""
    out = None
    for name, floor in floors.items():
        out = F.when(x >= floor, name) if out is None else out.when(x >= floor, name)
    return out


def scaled(n: Column, ceiling: float) -> Column:
    """n against a ceiling as 0..100."""
    return F.least(F.lit(100), F.round(100.0 * n / ceiling)).cast("bigint")


def sla_state(due: Column, now: datetime, warn_hours: int = 12) -> Column:
    t = F.lit(now).cast("timestamp_ntz")
    return F.when(due.isNull(), "none").when(due < t, "breached").when(due <= t + F.expr(f"interval {warn_hours} hours"), "at_risk").otherwise("ok")


#: Points of a case queue's parts, and how many items make a point of evidence and links.
PRIORITY_POINTS = {"urgent": 46, "critical": 46, "high": 34, "medium": 20, "low": 10}
SEVERITY_POINTS = {"critical": 26, "high": 19, "medium": 11, "low": 5, "informational": 0}
SLA_POINTS = {"breached": 18, "at_risk": 9}
PER_EVIDENCE, PER_LINK, UNASSIGNED_POINTS = 25, 150, 6


def points(x: Column, table: dict[str, int], default: int) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out.otherwise(default)


def queue_reasons(priority: Column, severity: Column, sla: Column, hours_left: Column, contradictions: Column, recent: Column, links: Column, unassigned: Column, status: Column) -> Column:
    """Why a case stands where it does in the queue: (weight, label), heaviest first, then by label; a done case has one
    reason of weight 0. recent: evidence of the last days; hours_left: to the deadline, for cases at risk."""
    part = lambda ok, weight, label: F.when(ok, F.struct((-weight).cast("int").alias("w"), label.alias("label")))
    text = lambda *p: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in p])
    yes, by_evidence, by_links = F.lit(True), F.least(F.lit(12), F.floor(recent / PER_EVIDENCE)), F.least(F.lit(8), F.floor(links / PER_LINK))
    reasons = F.array_compact(F.array(
        part(yes, points(priority, PRIORITY_POINTS, 12), text(F.initcap(priority), " priority")), part(yes, points(severity, SEVERITY_POINTS, 5), text(F.initcap(severity), " severity")),
        part(sla == "breached", F.lit(SLA_POINTS["breached"]), F.lit("SLA breached")), part(sla == "at_risk", F.lit(SLA_POINTS["at_risk"]), text("SLA due in ", F.greatest(F.lit(1), F.floor(hours_left)), "h")),
        part(contradictions > 0, F.least(F.lit(12), 4 * contradictions), text(contradictions, " unresolved contradiction", F.when(contradictions > 1, "s").otherwise(""))),
        part(by_evidence > 0, by_evidence, text(recent, " evidence in 7 days")), part(by_links > 0, by_links, text(links, " relationships resolved")), part(unassigned, F.lit(UNASSIGNED_POINTS), F.lit("No analyst assigned")),
    ))
    done = status.isin("closed", "archived")
    return F.when(done, F.array(F.struct(F.lit(0).alias("weight"), text("Case ", status).alias("label")))).otherwise(F.transform(F.array_sort(reasons), lambda x: F.struct((-x["w"]).alias("weight"), x["label"].alias("label"))))


def queue_points(reasons: Column) -> Column:
    """A case's place in the queue: its reasons' weights, at most 100."""
    return F.least(F.lit(100), F.aggregate(reasons, F.lit(0), lambda a, x: a + x["weight"]))


def ratio_similarity(a: Column, b: Column) -> Column:
    """min / max; 0 if either is not positive."""
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def scalar_similarity(a: Column, b: Column) -> Column:
    """1 - |a - b| / (|a| + |b|); 1 when both are 0."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(1 - F.abs(a - b) / (F.abs(a) + F.abs(b)))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def cosine(a: Column, b: Column) -> Column:
    """Of two dense arrays; 0 for a zero vector or different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / 1_000_000.0


def active_at(first: Column, last: Column, t: Column) -> Column:
    """The closed window holds t."""
    return (first <= t) & (last >= t)


def overlaps(first: Column, last: Column, since: Column | None, until: Column | None) -> Column:
    """The window meets [since, until], whose ends may be open."""
    out = F.lit(True)
    if since is not None:
        out &= last >= since
    return out & (first <= until) if until is not None else out


def window_iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Intersection over union of two windows; 1 for two equal points."""
    inter = F.greatest(F.lit(0.0), seconds(F.least(a2, b2)) - seconds(F.greatest(a1, b1)))
    union = seconds(F.greatest(a2, b2)) - seconds(F.least(a1, b1))
    return F.when(union == 0, 1.0).otherwise(inter / union)


def shorter_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Intersection over the shorter window: a point inside counts 1, touching ends 0."""
    lo, hi = F.greatest(a1, b1), F.least(a2, b2)
    short = F.least(seconds(a2) - seconds(a1), seconds(b2) - seconds(b1))
    return F.when(lo > hi, 0.0).when(short == 0, 1.0).otherwise(F.greatest(F.lit(0.0), seconds(hi) - seconds(lo)) / short)


def harmonic_discount(n: Column) -> Column:
    return 1.0 / n


def log_discount(n: Column) -> Column:
    return 1 / (1 + F.ln(n.cast("double")))


def square_discount(n: Column) -> Column:
    """A group of n contributes 1/n in total."""
    return 1.0 / (n * n)


def null_mean(*xs: Column) -> Column:
    """The mean of what is not NULL; NULL without any."""
    known = F.filter(F.array(*xs), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
