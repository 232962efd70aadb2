"""Pair features, infrastructure, style, containment, encoders and assistant queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import scores as S
from evidentia.functions import text as X
from evidentia.operators import assistant, blocks, encoders, flows, fusion, infrastructure, relational, resolution, stylometry
from evidentia.operators.resolution import group_split
from evidentia.plans.registry import query
from evidentia.sources import exports
from evidentia.sources.tables import edges, evidence, observations, table
from evidentia.sources.tables import flows as flow_rows

FLOWS = "(select distinct o_orderkey tx_id, 'c' || o_custkey a, 's' || l_suppkey b, o_totalprice amount, o_orderdate ts from orders join lineitem on l_orderkey = o_orderkey)"


@query(f"""with p as (select 'c' || a.c_custkey l, 'c' || b.c_custkey r from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_custkey <> b.c_custkey where a.c_custkey % 20 = 0), n as (select distinct a w, b o from {FLOWS}), t as (select distinct a w, tx_id from {FLOWS}),
d as (select w, count(*) d from n group by 1), f as (select w, count(*) f from t group by 1), o as (select p.l, p.r, count(*) k from p join n x on x.w = p.l join n y on y.w = p.r and y.o = x.o group by 1, 2)
select p.l, p.r, round(case when a.d is null or b.d is null then 0 else least(a.d, b.d) / greatest(a.d, b.d) end, 6) degree_ratio, round(case when fa.f is null or fb.f is null then 0 else least(fa.f, fb.f) / greatest(fa.f, fb.f) end, 6) frequency_ratio, round(case when a.d is null or b.d is null then 0 else coalesce(k, 0) / (a.d + b.d - coalesce(k, 0)) end, 6) counterparty_jaccard, 0.0::double co_occurrence
from p left join d a on a.w = p.l left join d b on b.w = p.r left join f fa on fa.w = p.l left join f fb on fb.w = p.r left join o on o.l = p.l and o.r = p.r""")
def wallet_pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth wallet against all others of its nation."""
    owner = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("wallet"), F.col("c_nationkey").alias("cluster_id"))
    return flows.pairs_within(flow_rows(spark, sf), owner, "cast(substr(wallet, 2) as bigint) % 20 = 0", ("degree_ratio", "frequency_ratio", "counterparty_jaccard", "co_occurrence"), 6)


@query("with h as (select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) subject, page_id, regexp_extract(html, '<html[^>]*lang=\"(\\w+)\"', 1) lang from pages), c as (select subject, page_id, lag(lang) over w before, lang as after from h window w as (partition by subject order by page_id)) select subject, page_id, before, after from c where before <> after")
def historical_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as observations of their hosts, in page order; the tracked field is the document's language."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("observation_id"), X.url_host(F.col("url")).alias("subject"), F.col("page_id").alias("start"), F.col("page_id").alias("end"), F.regexp_extract("html", r'<html[^>]*lang="(\w+)"', 1).alias("lang"))
    return infrastructure.changes(p, ["lang"]).select("subject", F.col("changed_by").alias("page_id"), "before", "after")


@query("with s as (select s_suppkey id, s_nationkey n, s_acctbal >= 0 p, s_acctbal b from supplier), k as (select a.id l, b.id r, case when abs(a.b - b.b) < 50 then 0.95 else 0.4 end cert, case when a.p = b.p then 0.9 else 0.2 end content, case when a.b > 5000 then null else 0.7 end tech from s a join s b on a.n = b.n and a.id < b.id) select l, r, round((0.3 * cert + 0.25 * content + coalesce(0.15 * tech, 0) + 0.05) / (0.6 + case when tech is null then 0 else 0.15 end), 6) overall, case when cert >= 0.9 then 'certificate' when content >= 0.8 then 'content' end strongest from k where (cert >= 0.9 or content >= 0.8) and (0.3 * cert + 0.25 * content + coalesce(0.15 * tech, 0) + 0.05) / (0.6 + case when tech is null then 0 else 0.15 end) >= 0.6")
def infra_candidates(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"), "s_acctbal")
    # A nation's pairs are dealt over the cells of a grid: blocks of its suppliers by blocks of its suppliers.
    k = 1 + s.count() // infrastructure.SUPPLIERS_A_BLOCK
    block, every = F.pmod(F.xxhash64("id"), F.lit(k)), F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))
    a, b = s.withColumn("i", block).withColumn("j", every).repartition(8 * k, "n", "i", "j").alias("a"), s.withColumn("j", block).withColumn("i", every).alias("b")
    p = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.id") < F.col("b.id")))
    none = F.lit(None).cast("double")
    p = p.select(
        F.col("a.id").alias("l"), F.col("b.id").alias("r"), F.when(F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal")) < 50, 0.95).otherwise(0.4).alias("certificate"), F.when((F.col("a.s_acctbal") >= 0) == (F.col("b.s_acctbal") >= 0), 0.9).otherwise(0.2).alias("content"),
        F.when(F.col("a.s_acctbal") > 5000, none).otherwise(0.7).alias("technology"), none.alias("http"), none.alias("tls"), F.lit(1.0).alias("temporal"),
    )
    return infrastructure.decide(p).select("l", "r", F.round("overall", 6).alias("overall"), "strongest")


@query("with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+') w from documents), t as (select doc_id, len(w) n, len(list_distinct(w)) k from w) select doc_id, cast(n as bigint) n_words, round(case when n > 0 then k / n else 0 end, 6) type_token from t")
def style_type_token(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").select("doc_id", stylometry.features("text").alias("f"))
    return m.select("doc_id", F.get("f", F.lit(1)).cast("bigint").alias("n_words"), F.round(F.get("f", F.lit(7)), 6).alias("type_token"))


@query()
def style_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth benchmark item against all items."""
    m = table(spark, sf, "benchmark").select("item_id", stylometry.features("text").alias("f"), stylometry.hashed_vector("text").alias("v"))
    both = relational.against(m, m.filter("item_id % 20 = 0"))
    return both.select(F.col("q.item_id").alias("asked"), "item_id", F.round(stylometry.agreement(F.col("f"), F.col("q.f")), 6).alias("agreement"), F.round(S.cosine(F.col("v"), F.col("q.v")), 6).alias("cosine"))


@query("""with w as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+') w from benchmark), s as (select distinct item_id, array_to_string(w[i:i + 4], ' ') g from (select item_id, w, unnest(range(1, len(w) - 3)) i from w where len(w) >= 5)), n as (select item_id, count(*) n from s group by 1),
d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+') w from documents), e as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5))
select doc_id, item_id, round(count(*) / any_value(n), 6) containment from e join s using (g) join n using (item_id) group by 1, 2""")
def benchmark_containment(spark: SparkSession, sf: str) -> DataFrame:
    """The share of an item's five-word shingles that a document holds, where it holds any."""
    shingled = lambda t, k: table(spark, sf, t).select(k, X.tokens(F.col("text")).alias("w")).filter("size(w) >= 5").select(k, F.explode(F.array_distinct(F.transform(X.word_shingles(F.col("w"), 5), lambda x: F.xxhash64(x)))).alias("g"))
    s = shingled("benchmark", "item_id")
    n = s.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    k = shingled("documents", "doc_id").join(s, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("k"))
    return k.join(n, "item_id").select("doc_id", "item_id", F.round(F.col("k") / F.col("n"), 6).alias("containment"))


@query("with e as (select vec_id, cast(embedding as double[]) v from embeddings), q as (select vec_id asked, v q from e where vec_id % 20 = 0) select asked, vec_id, round(1 / (1 + exp(-2 * list_cosine_similarity(v, q))), 6) score from e cross join q")
def pair_score_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth vector against all vectors."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return blocks.beside(e, F.col("vec_id") % 20 == 0, "vec_id", blocks.embeddings, encoders.pair_scores, 6, itself=True).withColumnsRenamed({"l": "asked", "r": "vec_id"})


@query("select c_custkey actor_id, case when cast(('0x' || substr(sha256('26151|' || c_nationkey), 1, 8)) as bigint) / 4294967296 < 0.65 then 'train' else 'test' end part from customer")
def group_split_hash(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("actor_id"), "c_nationkey")
    return group_split(c, "c_nationkey").select("actor_id", "part")


@query("with s as (select s_suppkey id, s_nationkey n, round(s_acctbal, -3) b, lower(s_name) h from supplier) select a.id l, b.id r, round(0.15 * (1 - levenshtein(a.h, b.h) / greatest(length(a.h), length(b.h))) + 0.85 * (0.2 * (a.n = b.n)::int + 0.6 * (a.b = b.b)::int), 3) score from s a join s b on a.id <> b.id and a.id % 20 = 0")
def candidate_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth supplier against all others: names, nation as time zone, balance class as wallet."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"), F.round("s_acctbal", -3).alias("b"), F.lower("s_name").alias("h"))
    return blocks.beside(s, F.col("id") % 20 == 0, "id", resolution.aliases, resolution.alias_scores, 3)


@query(f"with e as (select distinct tx_id, least(a, b) s, greatest(a, b) t, ts from {FLOWS}) select s source, t target, min(ts) first_seen, max(ts) last_seen, count(distinct tx_id) evidence from e group by 1, 2")
def edge_merge_union(spark: SparkSession, sf: str) -> DataFrame:
    e = flow_rows(spark, sf).select(F.lit("PAYS").alias("rel_type"), F.col("input").alias("source"), F.col("output").alias("target"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.lit(1.0).alias("confidence"), F.col("tx_id").alias("evidence_id"))
    return relational.merge_edges(e, F.lit(True)).select("source", "target", "first_seen", "last_seen", F.size("evidence_ids").cast("bigint").alias("evidence"))


@query("select l_orderkey % 50 case_id, count(*) n, round(avg(k), 6) mean_discount from (select l_orderkey, 1.0 / count(*) over (partition by l_suppkey, l_orderkey % 50) k from lineitem) group by 1")
def redundancy_discounts(spark: SparkSession, sf: str) -> DataFrame:
    """1/n for each source of a case: the sizes are summed before the cases are."""
    g = evidence(spark, sf).groupBy("case_id", "source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("n") * S.harmonic_discount(F.col("n")))
    return g.groupBy("case_id").agg(F.sum("n").alias("n"), F.round(F.sum("w") / F.sum("n"), 6).alias("mean_discount"))


@query("with p as (select conv_id, turn, text from conversations), c as (select conv_id, count(*) n, count(*) filter (where turn % 2 = 0) k from p group by 1) select conv_id claim_id, case when n = k then 'supported' when k = 0 then 'unsupported' else 'partial' end status, cast(n - k as bigint) dropped from c")
def citation_validation(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation cites its turns; the pack holds the even ones."""
    c = table(spark, sf, "conversations").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("item_id"), "turn")
    claims = c.groupBy(F.col("conv_id").alias("claim_id")).agg(F.collect_list("item_id").alias("citations"))
    out = assistant.check_citations(claims, c.filter("turn % 2 = 0"))
    return out.select("claim_id", "status", F.size("dropped").cast("bigint").alias("dropped"))


@query("with n as (select count(*) n from customer), p as (select o_custkey l, o_custkey * 7 % n r from orders cross join n), q as (select o_custkey l, o_custkey * 11 % n r from orders cross join n), a as (select distinct least(l, r) l, greatest(l, r) r from p where l <> r), b as (select distinct least(l, r) l, greatest(l, r) r from q where l <> r), j as (select count(*) filter (where a.l is not null and b.l is not null) tp, count(*) filter (where b.l is null) fp, count(*) filter (where a.l is null) fn from a full join b on a.l = b.l and a.r = b.r) select tp, fp, fn, n * (n - 1) // 2 - tp - fp - fn tn from j cross join n")
def pair_confusion(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").count()
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("l"))
    return fusion.pair_confusion(o.withColumn("r", F.col("l") * 7 % n), o.withColumn("r", F.col("l") * 11 % n), n)


@query("select user_id, string_agg(topic || '=' || n, ';' order by topic) topics from (select user_id, case when props like '%1%' then 'one' when props like '%2%' then 'two' else 'general' end topic, count(*) n from events group by 1, 2) group by 1")
def topic_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """The first vocabulary term that the text holds, else general; exported as key=count pairs."""
    topic = F.when(F.contains("props", F.lit("1")), "one").when(F.contains("props", F.lit("2")), "two").otherwise("general")
    m = observations(spark, sf).groupBy("subject_id", topic.alias("topic")).agg(F.count(F.lit(1)).alias("n")).groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("topics"))
    return exports.flat(m).withColumnRenamed("subject_id", "user_id")


@query()
def encoder_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Relational encoding of nations and regions: four features a node."""
    n = table(spark, sf, "nation")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.array(F.length("n_name") / 10, F.col("n_regionkey") / 4.0, F.lit(1.0), F.lit(0.0)).alias("x")).unionByName(table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.array(F.length("r_name") / 10, F.col("r_regionkey") / 4.0, F.lit(0.0), F.lit(1.0)).alias("x")))
    e = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in").alias("rel"), F.lit(0.0).alias("day"))
    out = encoders.relational(nodes, e, 4, 8, ["in"])
    return out.select("node_id", F.round(F.get("h", F.lit(0)), 6).alias("h0"), F.size("h").alias("width"))


@query("select o_orderkey claim, count(*) sources, string_agg(distinct 's' || l_suppkey, ';' order by 's' || l_suppkey) evidence from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P' group by 1")
def case_report_claims(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = o.groupBy(F.col("o_orderkey").alias("claim")).agg(F.count(F.lit(1)).alias("sources"), F.array_sort(F.collect_set(F.concat(F.lit("s"), "l_suppkey"))).alias("evidence"))
    return exports.flat(g)


@query("select 'c' || o_custkey source, count(distinct 's' || l_suppkey) suppliers from orders join lineitem on l_orderkey = o_orderkey group by 1 order by 2 desc, 1 limit 20")
def actor_graph_topk(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("suppliers")).orderBy(F.desc("suppliers"), "source").limit(20)
