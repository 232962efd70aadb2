"""Deterministic retrieval: intents, evidence packs, citation checks."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ordered keyword rules; the first that matches names the tool.
RULES = [("compare", r"\b(compare|versus|vs)\b"), ("timeline", r"\b(when|timeline|changed?|shift)\b"), ("graph", r"\b(connected|linked|path|neighbou?rs?)\b"), ("assessment", r"\b(confidence|assessment|hypothes[ie]s)\b"), ("actor", r"\b(actor|who|persona)\b"), ("search", r"")]
UNITS = {"hour": 3600, "day": 86400, "week": 604800}


def intent(question: str) -> str:
    return next(name for name, rule in RULES if re.search(rule, question.lower()))


def window(question: str, now: datetime, cap_days: int = 90) -> tuple[datetime, datetime] | None:
    """"last 24 hours" and the like as (since, until); capped."""
    m = re.search(r"\b(?:last|past)\s+(\d+)\s+(hour|day|week)s?\b", question.lower())
    if not m:
        return None
    return now - timedelta(seconds=min(int(m[1]) * UNITS[m[2]], cap_days * 86400)), now


def merge_packs(items: DataFrame) -> DataFrame:
    """One row for each item_id, from the first tool that gave it."""
    return items.groupBy("item_id").agg(F.min(F.struct("tool_order", "place", "body")).alias("x")).select("item_id", F.col("x.tool_order").alias("tool_order"), F.col("x.body").alias("body"))


def check_citations(claims: DataFrame, pack: DataFrame) -> DataFrame:
    """claim_id, status: supported (all citations are in the pack), unsupported (none is, or none given), or partial;
    dropped: the citations that aren't."""
    c = claims.select("claim_id", F.explode_outer(F.array_distinct("citations")).alias("item_id")).join(pack.select("item_id", F.lit(True).alias("known")).distinct(), "item_id", "left")
    g = c.groupBy("claim_id").agg(F.count("item_id").alias("n"), F.count("known").alias("k"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("item_id")))).alias("dropped"))
    return g.select("claim_id", F.when((F.col("n") > 0) & (F.col("n") == F.col("k")), "supported").when(F.col("k") == 0, "unsupported").otherwise("partial").alias("status"), "dropped")
