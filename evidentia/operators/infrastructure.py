"""Infrastructure observations: typed parsing, channel similarities, candidate rule and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scores as S
from evidentia.functions.text import signature_jaccard

SCHEMA = "observation_id string, subject string, tls struct<version:string,cipher_suite:string,alpn:array<string>,ja3:string>, http struct<status_code:int,server:string,content_type:string,headers:map<string,string>>, certificate struct<fingerprint_sha256:string,subject:string,issuer:string,serial_number:string,sans:array<string>,spki_sha256:string>, technologies array<string>, body string, observed_range struct<start:timestamp,end:timestamp>"
#: Channel weights, renormalised over the channels both sides have, and the strong channels' cutoffs in
#: the order in which they decide.
WEIGHTS = {"certificate": 0.30, "content": 0.25, "technology": 0.15, "http": 0.15, "tls": 0.10, "temporal": 0.05}
STRONG = {"certificate": 0.9, "content": 0.8, "http": 0.9}
OVERALL = 0.6

#: Rows of all groups together for each block that a group's pairs are dealt into, on either side.
SUPPLIERS_A_BLOCK = 5_000


def parse(raw: DataFrame, column: str = "payload") -> DataFrame:
    """The typed record and, for a payload without identity, subject or window, what is missing."""
    p = raw.withColumn("o", F.from_json(column, SCHEMA))
    missing = F.filter(F.array(*[F.when(F.col(f"o.{f}").isNull(), F.lit(f)) for f in ("observation_id", "subject", "observed_range")]), lambda x: x.isNotNull())
    return p.withColumn("missing", missing)


def equal(a: Column, b: Column) -> Column:
    """1 or 0 where both are known, else NULL."""
    return (a == b).cast("double")


def certificate(l: str, r: str) -> Column:  # noqa: E741
    f = lambda s, n: F.col(f"{s}.certificate.{n}")
    rest = S.null_mean(equal(f(l, "subject"), f(r, "subject")), equal(f(l, "issuer"), f(r, "issuer")), F.when(f(l, "sans").isNotNull() & f(r, "sans").isNotNull(), S.jaccard(f(l, "sans"), f(r, "sans"))))
    return F.when(f(l, "fingerprint_sha256") == f(r, "fingerprint_sha256"), 1.0).when(f(l, "spki_sha256") == f(r, "spki_sha256"), 0.9).otherwise(rest)


def tls(l: str, r: str) -> Column:  # noqa: E741
    return S.null_mean(*[equal(F.col(f"{l}.tls.{n}"), F.col(f"{r}.tls.{n}")) for n in ("version", "cipher_suite", "ja3")])


def http(l: str, r: str) -> Column:  # noqa: E741
    keys = lambda s: F.map_keys(F.col(f"{s}.http.headers"))
    return S.null_mean(*[equal(F.col(f"{l}.http.{n}"), F.col(f"{r}.http.{n}")) for n in ("status_code", "server", "content_type")], F.when(keys(l).isNotNull() & keys(r).isNotNull(), S.jaccard(keys(l), keys(r))))


def technology(l: str, r: str) -> Column:  # noqa: E741
    a, b = F.col(f"{l}.technologies"), F.col(f"{r}.technologies")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), S.jaccard(a, b))


def content(l: str, r: str) -> Column:  # noqa: E741
    bits = 1 - S.hamming(F.col(f"{l}.simhash"), F.col(f"{r}.simhash")) / 64
    return 0.5 * bits + 0.5 * signature_jaccard(F.col(f"{l}.minhash"), F.col(f"{r}.minhash"))


def temporal(l: str, r: str) -> Column:  # noqa: E741
    f = lambda s, n: F.col(f"{s}.observed_range.{n}")
    return S.shorter_overlap(f(l, "start"), f(l, "end"), f(r, "start"), f(r, "end"))


def overall(channels: dict[str, Column]) -> Column:
    """The weighted mean of the known channels; NULL without any."""
    weight = sum((F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, c in channels.items()), F.lit(0.0))
    total = sum((F.coalesce(WEIGHTS[k] * c, F.lit(0.0)) for k, c in channels.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def decide(pairs: DataFrame) -> DataFrame:
    """Of pairs with a column for each channel: those with overlapping windows, an overall score of OVERALL and a
    strong channel, the first of STRONG."""
    channels = {k: F.col(k) for k in WEIGHTS}
    strong = F.coalesce(*[F.when(F.col(k) >= cut, F.lit(k)) for k, cut in STRONG.items()])
    return pairs.withColumn("overall", overall(channels)).withColumn("strongest", strong).filter("temporal > 0 and strongest is not null").filter(F.col("overall") >= OVERALL)


def correlate(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate pairs of observations that share a blocking key (a certificate, a server, a content bucket: an array
    of strings in each of the named columns)."""
    block = lambda d, s: d.select(F.struct(*d.columns).alias(s), F.explode(F.array_distinct(F.concat(*[F.coalesce(F.col(k), F.array().cast("array<string>")) for k in keys]))).alias("key"))
    p = block(left, "l").join(block(right, "r"), "key").filter("l.observation_id < r.observation_id").withColumn("pair", F.concat_ws("|", "l.observation_id", "r.observation_id")).dropDuplicates(["pair"])
    return decide(p.select("l", "r", certificate("l", "r").alias("certificate"), content("l", "r").alias("content"), technology("l", "r").alias("technology"), http("l", "r").alias("http"), tls("l", "r").alias("tls"), temporal("l", "r").alias("temporal")))


def changes(observations: DataFrame, fields: list[str]) -> DataFrame:
    """subject, field, before, after, changed_after, changed_by: each tracked field against the same subject's
    previous observation, where both are known and differ."""
    w = Window.partitionBy("subject").orderBy("start", "end", "observation_id")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lag(f).over(w).alias("before"), F.col(f).alias("after")) for f in fields])
    d = observations.select("subject", F.lag("end").over(w).alias("changed_after"), F.col("start").alias("changed_by"), rows.alias("rows"))
    return d.select("subject", "changed_after", "changed_by", F.inline("rows")).filter("before <> after")
