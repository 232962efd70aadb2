"""Graph import, case graphs and names over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import graph_build, ner
from evidentia.plans.registry import query
from evidentia.sources.tables import table

ONTOLOGY = graph_build.Ontology({"actor": "ACTOR", "wallet": "WALLET"}, (("transacts_with", "ACTOR", "WALLET", False), ("associated_with", "*", "*", True)))
#: Customers are actors, suppliers wallets if their balance isn't negative (else of a type without a label); every line is
#: a relationship: returned ones are associations, those from the supplier's side, and seventh lines have an unknown type.
ENTITIES = "(select 'c' || c_custkey id, 'actor' t, 'ACTOR' label from customer union all select 's' || s_suppkey, case when s_acctbal >= 0 then 'wallet' else 'account' end, case when s_acctbal >= 0 then 'WALLET' end from supplier)"
RELATIONS = """(select l_orderkey || '-' || l_linenumber rid, case when l_linenumber = 7 then 'mentions' when l_returnflag = 'R' then 'associated_with' else 'transacts_with' end t, case when l_returnflag = 'R' then 's' || l_suppkey else 'c' || o_custkey end a, case when l_returnflag = 'R' then 'c' || o_custkey else 's' || l_suppkey end b,
 o_orderdate lo, l_shipdate hi, 1 - l_discount c from lineitem join orders on o_orderkey = l_orderkey)"""
CHECKED = f"(select r.*, x.label la, y.label lb, case when r.t = 'mentions' then 'unknown_type' when x.label is null then 'no_source' when y.label is null then 'no_target' when lo > hi then 'reversed_window' end reason from {RELATIONS} r left join {ENTITIES} x on x.id = a left join {ENTITIES} y on y.id = b)"


def imported(spark: SparkSession, sf: str) -> graph_build.Import:
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    entity = lambda d, i, t, name: d.select(i.alias("entity_id"), t.alias("entity_type"), F.col(name).alias("surface_form"), F.lower(name).alias("normalized_form"), F.lit(1.0).alias("confidence"))
    entities = entity(c, F.concat(F.lit("c"), "c_custkey"), F.lit("actor"), "c_name").unionByName(entity(s, F.concat(F.lit("s"), "s_suppkey"), F.when(F.col("s_acctbal") >= 0, "wallet").otherwise("account"), "s_name"))
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    back, actor, wallet = F.col("l_returnflag") == "R", F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey")
    kind = F.when(F.col("l_linenumber") == 7, "mentions").when(back, "associated_with").otherwise("transacts_with")
    relations = j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("relationship_id"), kind.alias("rel_type"), F.when(back, wallet).otherwise(actor).alias("source"), F.when(back, actor).otherwise(wallet).alias("target"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("first_seen"), F.col("l_shipdate").cast("timestamp_ntz").alias("last_seen"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("evidence_id"),
    )
    return graph_build.bulk_import(entities, relations, ONTOLOGY)


@query(f"select t rel_type, case when t = 'associated_with' then least(a, b) else a end source, case when t = 'associated_with' then greatest(a, b) else b end target, min(lo) first_seen, max(hi) last_seen, round(max(c), 6) confidence, count(*) as rows, count(distinct split_part(rid, '-', 1)) citations from {CHECKED} where reason is null group by 1, 2, 3")
def graph_import_edges(spark: SparkSession, sf: str) -> DataFrame:
    return imported(spark, sf).edges.drop("edge_key").withColumn("confidence", F.round("confidence", 6))


@query(f"select 'entity' kind, 'no_label' reason, count(*) n from {ENTITIES} where label is null union all select 'relationship', reason, count(*) from {CHECKED} where reason is not null group by 2")
def graph_import_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return imported(spark, sf).quarantine.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


CASE_ENTITIES = "(select distinct case_id, id, t from (select o_orderkey % 50 case_id, 'c' || o_custkey id, 'actor' t from orders union all select l_orderkey % 50, 's' || l_suppkey, 'wallet' from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal >= 0))"
CASE_EDGES = "(select l_orderkey % 50 case_id, 'c' || o_custkey a, 's' || l_suppkey b, case when l_returnflag = 'R' then 'returned' else 'paid' end t, count(*) n from lineitem join orders on o_orderkey = l_orderkey group by all)"


def case_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    known = table(spark, sf, "supplier").filter("s_acctbal >= 0")
    people = orders.select((F.col("o_orderkey") % 50).alias("case_id"), F.concat(F.lit("c"), "o_custkey").alias("entity_id"), F.lit("actor").alias("type"))
    wallets = line.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select((F.col("l_orderkey") % 50).alias("case_id"), F.concat(F.lit("s"), "l_suppkey").alias("entity_id"), F.lit("wallet").alias("type"))
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "returned").otherwise("paid")
    edges = j.groupBy((F.col("l_orderkey") % 50).alias("case_id"), F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), kind.alias("type")).agg(F.count(F.lit(1)).alias("evidence"))
    return people.unionByName(wallets).distinct(), edges


@query(f"with e as {CASE_ENTITIES}, g as (select r.* from {CASE_EDGES} r join e x on x.case_id = r.case_id and x.id = a join e y on y.case_id = r.case_id and y.id = b), d as (select case_id, unnest([a, b]) id, n from g) select e.case_id, e.id entity_id, e.t as type, count(d.id) degree, cast(coalesce(sum(n), 0) as bigint) evidence from e left join d on d.case_id = e.case_id and d.id = e.id group by all")
def case_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph_build.case_graph(*case_parts(spark, sf))[0]


@query(f"with e as {CASE_ENTITIES}, g as (select r.* from {CASE_EDGES} r join e x on x.case_id = r.case_id and x.id = a join e y on y.case_id = r.case_id and y.id = b where r.t = 'paid') select case_id, 'node' kind, t as type, count(*) n from e group by all union all select case_id, 'edge', t, count(*) from g group by all")
def case_graph_types(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by type, with payments as the only edges."""
    return graph_build.type_counts(graph_build.case_graph(*case_parts(spark, sf), edge_types=["paid"]))


TOKENS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_-]+')"


@query(f"with g as (select distinct name from (select unnest({TOKENS.format('text')}) name from benchmark) where regexp_matches(name, '^[a-z]{{9,}}$')), t as (select doc_id, unnest({TOKENS.format('text')}) value from documents) select doc_id, value, count(*) n from t join g on g.name = t.value group by 1, 2")
def gazetteer_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document names one of the long words of the benchmark."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(low, F.lit("[a-z0-9_-]+"), F.lit(0))).alias("name"), F.lit("word").alias("kind")).filter(F.col("name").rlike("^[a-z]{9,}$")).distinct()
    return ner.recognise(table(spark, sf, "documents"), names, resolve=False).filter("cue = 'gazetteer'").groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))
