"""Search, text and duplicate queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.functions.scores import dice, jaccard, levenshtein_similarity
from evidentia.operators import blocks
from evidentia.operators import search as S
from evidentia.plans.registry import query
from evidentia.sources.tables import table

TERMS = ["the", "reed", "que"]
#: Words of a document in SQL.
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]+')"
BM25 = f"""with d as (select doc_id, {WORDS} w from documents), t as (select unnest(['the', 'reed', 'que']) term), n as (select count(*) docs, avg(len(w)) mean from d),
c as (select doc_id, len(w) length, term, len(list_filter(w, lambda x: x = term)) tf from d cross join t), df as (select term, count(*) filter (where tf > 0) df from c group by 1),
s as (select doc_id, sum(case when tf > 0 then ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) else 0 end) lexical, count(*) filter (where tf > 0) hits from c join df using (term) cross join n group by 1)
"""


@query(BM25 + "select doc_id, round(lexical, 4) score from s where hits >= 1")
def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    return S.bm25(table(spark, sf, "documents"), TERMS).select("doc_id", F.round("lexical", 4).alias("score"))


@query(BM25 + "select doc_id, round(lexical, 4) score from s where hits = 3 order by lexical desc, doc_id limit 10")
def bm25_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(table(spark, sf, "documents"), S.SearchQuery("the reed que", "exact", limit=10)).select("doc_id", F.round("score", 4).alias("score"))


@query(f"select doc_id from documents where concat(' ', array_to_string({WORDS}, ' '), ' ') like '% of the %'")
def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(table(spark, sf, "documents"), S.SearchQuery("of the", "phrase", limit=None)).select("doc_id")


@query(BM25.replace("['the', 'reed', 'que']", "['thing', 'reed']") + f""", g as (select doc_id, list_distinct({WORDS}) w from documents where lang = 'en'), p as (select doc_id, w, list_distinct(flatten(list_transform(w, lambda x: list_transform(range(1, length(x) + 3), lambda i: substr('##' || x || '##', i, 3))))) t from g),
q as (select ['thing', 'reed'] qw, list_distinct(flatten(list_transform(['thing', 'reed'], lambda x: list_transform(range(1, length(x) + 3), lambda i: substr('##' || x || '##', i, 3))))) qt),
f as (select p.doc_id, lexical, case when len(t) + len(qt) = 0 then 0 else 0.5 * 2 * len(list_intersect(t, qt)) / (len(t) + len(qt)) end + 0.5 * len(list_intersect(w, qw)) / len(list_distinct(list_concat(w, qw))) sem from p cross join q join s using (doc_id)),
m as (select max(lexical) top from f) select doc_id, round(0.7 * case when top > 0 then lexical / top else 0 end + 0.3 * sem, 4) score from f cross join m where lexical > 0 or sem > 0""")
def hybrid_score(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(table(spark, sf, "documents"), S.SearchQuery("thing reed", hybrid=True, limit=None), condition=F.col("lang") == "en").select("doc_id", F.round("score", 4).alias("score"))


@query("select doc_id, 0.0 as score, (select count(*) from documents where lang = 'fr' and source in ('src1', 'src2')) total from documents where lang = 'fr' and source in ('src1', 'src2') order by doc_id limit 25")
def filter_only_browse(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(table(spark, sf, "documents"), S.SearchQuery(limit=25), condition=(F.col("lang") == "fr") & F.col("source").isin("src1", "src2")).select("doc_id", "score", "total")


@query(f"with t as (select doc_id, unnest({WORDS}) token from documents) select token, count(*) cf, count(distinct doc_id) df from t group by 1 having count(distinct doc_id) >= 5")
def postings_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.postings(table(spark, sf, "documents"), ["text"]).groupBy("token").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")).filter("df >= 5")


@query(f"""with t as (select item_id, unnest({WORDS}) term from benchmark), c as (select item_id, term, count(*) tf from t group by 1, 2), v as (select term, count(*) df, count(*) over () from c group by 1 having count(*) >= 2), n as (select count(*) n from benchmark),
w as (select item_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) w from c join v using (term) cross join n), u as (select item_id, term, w / sqrt(sum(w * w) over (partition by item_id)) w from w)
select a.item_id l, b.item_id r, round(sum(a.w * b.w), 5) cosine from u a join u b on a.term = b.term and a.item_id < b.item_id group by 1, 2""")
def tfidf_cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of benchmark items that share a term: each item's vector is sparse and unit, so the join adds up cosines."""
    from evidentia.operators.resolution import sparse_cosine_pairs, tfidf

    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return sparse_cosine_pairs(tfidf(b, X.tokens(F.col("text")), min_df=2)).select(F.col("l"), F.col("r"), F.round("cosine", 5).alias("cosine"))


@query("with d as (select vec_id, label, embedding from embeddings where vec_id % 20 = 0), p as (select a.vec_id l, b.vec_id r, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) c from d a join embeddings b on a.vec_id <> b.vec_id) select l, r, cast(k as bigint) as rank from (select l, r, row_number() over (partition by l order by round(c, 9) desc, r) k from p) where k <= 5")
def embedding_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """For every twentieth vector, the five nearest of all others."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return blocks.beside(e, F.col("vec_id") % 20 == 0, "vec_id", blocks.embeddings, blocks.cosines, 9, most=5).select("l", "r", "rank")


@query("select min(doc_id) representative, count(*) n, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) hash from documents group by 3 having count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    norm = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    return table(spark, sf, "documents").groupBy(X.content_hash(norm).alias("hash")).agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""with w as (select item_id, regexp_split_to_array(lower(trim(text)), '\\s+') w from benchmark), s as (select distinct item_id, array_to_string(w[i:i+1], ' ') g from (select item_id, w, unnest(range(1, greatest(2, len(w)))) i from w)), n as (select item_id, count(*) n from s group by 1)
select a.item_id l, b.item_id r, round(count(*) / (x.n + y.n - count(*)), 6) jaccard from s a join s b on a.g = b.g and a.item_id < b.item_id join n x on x.item_id = a.item_id join n y on y.item_id = b.item_id group by 1, 2, x.n, y.n""")
def shingle_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split(F.lower(F.trim("text")), r"\s+")
    s = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(X.word_shingles(w, 2))).alias("g"))
    n = s.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = s.alias("a").join(s.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.item_id") < F.col("b.item_id"))).groupBy(F.col("a.item_id").alias("l"), F.col("b.item_id").alias("r")).agg(F.count(F.lit(1)).alias("k"))
    sizes = pairs.join(n.select(F.col("item_id").alias("l"), F.col("n").alias("x")), "l").join(n.select(F.col("item_id").alias("r"), F.col("n").alias("y")), "r")
    return sizes.select("l", "r", F.round(F.col("k") / (F.col("x") + F.col("y") - F.col("k")), 6).alias("jaccard"))


@query("with g as (select n_name, list_distinct(list_transform(range(1, length(n_name) + 3), lambda i: substr('##' || lower(n_name) || '##', i, 3))) t from nation) select a.n_name l, b.n_name r, round(2 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)), 6) dice, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) edit, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) jaccard from g a join g b on a.n_name < b.n_name")
def ngram_dice(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_name", X.padded_trigrams(F.array(F.lower("n_name"))).alias("t"))
    a, b = n.alias("a"), F.broadcast(n).alias("b")  # 25 nations
    p = a.join(b, F.col("a.n_name") < F.col("b.n_name"))
    return p.select(F.col("a.n_name").alias("l"), F.col("b.n_name").alias("r"), F.round(dice(F.col("a.t"), F.col("b.t")), 6).alias("dice"), F.round(levenshtein_similarity(F.col("a.n_name"), F.col("b.n_name")), 6).alias("edit"), F.round(jaccard(F.col("a.t"), F.col("b.t")), 6).alias("jaccard"))


@query("select conv_id, turn, concat_ws(',', case when regexp_matches(text, '(?i)ignore (?:all |any )?(?:previous|prior|above) (?:instructions|directions)') then 'ignore' end, case when regexp_matches(text, '(?i)\\byou are (?:now|a|an)\\b') then 'role' end, case when regexp_matches(text, '(?i)(?:system|developer) (?:prompt|message)') then 'prompt' end) flags from conversations")
def injection_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.injection_flags(F.col("text")), ",").alias("flags"))


@query("select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) host, regexp_replace(url, '#.*$', '') url from pages")
def url_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.url_host(F.col("url")).alias("host"), X.url(F.col("url")).alias("url"))


@query("select regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') as domain, count(*) n from pages group by 1")
def domain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(X.domain(X.url_host(F.col("url"))).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query()
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.canonical_text("html").alias("text"))


@query()
def duplicate_clusters(spark: SparkSession, sf: str) -> DataFrame:
    from evidentia.operators.dedup import cluster

    return cluster(table(spark, sf, "documents").select("doc_id", "text"))


@query()
def extracted_entities(spark: SparkSession, sf: str) -> DataFrame:
    from evidentia.operators.extraction import extract

    return extract(table(spark, sf, "documents").select("doc_id", "text"))
