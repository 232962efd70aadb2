"""Hand-computed cases and invariants of the operators."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import scores as S
from evidentia.functions import text as X
from evidentia.operators import assistant, audit, dashboards, dedup, encoders, extraction, flows, fusion, graph, infrastructure, relational, search, stylometry, timeline
from evidentia.sources import exports, synthetic
from evidentia.streaming import activity

T0 = datetime(2024, 1, 1)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def events(spark, values, subject=1, step=3600):
    rows = [(i, subject, T0 + timedelta(seconds=i * step), v, 1.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "event_id long, subject_id long, observed_at timestamp_ntz, value string, magnitude double")


def test_flaps_move_nothing():
    assert timeline.confirmed_changes(list("aabaa")) == []
    assert timeline.confirmed_changes(list("aabbb")) == [(2, "a", "b")]
    assert timeline.confirmed_changes(list("abaabb")) == [(4, "a", "b")]


def test_state_changes_and_migration(spark):
    e = events(spark, list("aabbab"))
    c = timeline.state_changes(e)
    assert [(r.event_id, r.before, r.after) for r in c.collect()] == [(2, "a", "b")]
    assert timeline.migrations(e, c).first().confidence == pytest.approx(2 / 3, abs=1e-6)


def test_cusum(spark):
    v = [0.0] * 10 + [9.0] * 4
    mean = sum(v) / len(v)
    up = down = 0.0
    want = []
    for i, x in enumerate(v):
        up, down = max(0.0, up + x - mean - 1), max(0.0, down - (x - mean) - 1)
        if up > 5 or down > 5:
            want.append(i)
            up = down = 0.0
    assert one(spark, timeline.cusum(F.array(*map(F.lit, v))).alias("c")).c == want
    assert one(spark, timeline.cusum(F.array(*map(F.lit, v)), reference=F.lit(0.0)).alias("c")).c == [10, 11, 12, 13]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=0, max_size=30))
def test_segments_are_ordered_and_spaced(values):
    cuts = timeline.segments_of(np.array(values, float), 3, 1.0)
    assert cuts == sorted(set(cuts)) and all(b - a >= 3 for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True)) or not cuts


def test_segmentation(spark):
    assert timeline.segments_of(np.array([0.0] * 6 + [5.0] * 6)) == [6]
    s = spark.createDataFrame([(1, T0 + timedelta(days=i), 0 if i < 6 else 5) for i in range(12)], "subject_id long, bucket timestamp_ntz, n long")
    assert [r.cut for r in timeline.binary_segmentation(s).collect()] == [6]
    assert timeline.best_cuts(s).first().cut == 6


def test_similarities(spark):
    t = lambda d: F.lit(T0 + timedelta(days=d)).cast("timestamp_ntz")
    r = one(
        spark, S.window_iou(t(0), t(0), t(0), t(0)).alias("iou_point"), S.window_iou(t(0), t(4), t(2), t(6)).alias("iou"), S.shorter_overlap(t(0), t(4), t(2), t(3)).alias("inside"), S.shorter_overlap(t(0), t(4), t(4), t(8)).alias("touch"), S.shorter_overlap(t(0), t(4), t(2), t(2)).alias("point"),
        S.ratio_similarity(F.lit(2.0), F.lit(4.0)).alias("ratio"), S.scalar_similarity(F.lit(0.0), F.lit(0.0)).alias("zero"), S.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("none"), S.hamming(F.lit(7), F.lit(1)).alias("bits"), S.null_mean(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.5)).alias("mean"),
        S.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("cos"),
    )
    assert (r.iou_point, r.inside, r.touch, r.point, r.ratio, r.zero, r.none, r.bits, r.mean, r.cos) == (1.0, 1.0, 0.0, 1.0, 0.5, 1.0, 1.0, 2, 0.75, 0.0)
    assert r.iou == pytest.approx(1 / 3)


def test_text_forms(spark):
    assert X.canonical("<p>A&amp;B</p><script>x</script>  ﬁne​ ") == "A&B fine"
    r = one(spark, X.url(F.lit("WWW.Example.com/Path#x")).alias("u"), X.url(F.lit("HTTPS://Ex.com/A.")).alias("v"), X.domain(F.lit("www.Ex.com.")).alias("d"), X.resolution_handle(F.lit("@@Dark  Fox-1_")).alias("h"), X.char_ngrams(F.lit("abcd")).alias("g"), X.word_shingles(F.array(F.lit("a"), F.lit("b"))).alias("s"), X.padded_trigrams(F.array(F.lit("ab"))).alias("p"))
    assert (r.u, r.v, r.d, r.h, r.g, r.s) == ("http://www.example.com/Path", "https://ex.com/A", "ex.com", "dark_fox_1", ["abc", "bcd"], ["a b"])
    assert r.p == ["##a", "#ab", "ab#", "b##"]
    assert X.simhash_of("") == 0 and X.minhash_of("") == [0] * 64 and X.simhash_of("Same text") == X.simhash_of("same TEXT")


def test_checksums_and_spans():
    assert extraction.base58_ok("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa") and not extraction.base58_ok("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb")
    assert extraction.bech32_ok("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4") and not extraction.bech32_ok("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5")
    text = "é mail Bob@Example.com or @dark_fox, see http://Ex.com/a. vendor nightowl at Silk Market, report.pdf"
    got = [(k, text[lo:hi], v) for k, lo, hi, v, _ in extraction.spans(text)]
    assert ("email", "Bob@Example.com", "bob@example.com") in got and ("handle", "@dark_fox", "dark_fox") in got and ("alias", "nightowl", "nightowl") in got
    assert ("url", "http://Ex.com/a", "http://Ex.com/a") in got and ("marketplace", "Silk Market", "silk market") in got and not any("report" in v for _, _, v in got)


def test_search_modes(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "fox red"), (3, "blue owl"), (4, None)], "doc_id long, text string")
    ids = lambda q: [r.doc_id for r in search.search(docs, q).collect()]
    assert set(ids(search.SearchQuery("red owl"))) == {1, 2, 3}
    assert ids(search.SearchQuery("fox red", "exact"))[0] == 2 and set(ids(search.SearchQuery("fox red", "exact"))) == {1, 2}
    assert ids(search.SearchQuery("red fox", "phrase")) == [1]
    hybrid = search.search(docs, search.SearchQuery("red fox", hybrid=True)).collect()
    assert all(0 <= r.score <= 1 for r in hybrid) and hybrid[0].doc_id in (1, 2)
    assert ids(search.SearchQuery("")) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        search.SearchQuery("!!")


def test_search_fields(spark):
    docs = spark.createDataFrame([(1, "Red fox", "seen at dawn", ["e1"]), (2, "dawn", "a red fox", ["e2"]), (3, None, None, None), (4, "owl", "fox den red", ["e1"])], "doc_id long, title string, body string, entity_ids array<string>")
    weights = {"title": 3.0, "body": 1.0}
    rows = {r.doc_id: r for r in search.search(docs, search.SearchQuery("red fox", "exact", weights=weights)).collect()}
    assert set(rows) == {1, 2, 4} and rows[1].matched_fields == ["title"] and rows[4].matched_fields == ["body"]
    assert rows[1].score - search.EXACT_BONUS > rows[2].score and rows[2].matched_terms == ["red", "fox"] and rows[2].total == 3
    phrase = {r.doc_id: r.matched_fields for r in search.search(docs, search.SearchQuery("red fox", "phrase", weights=weights)).collect()}
    assert phrase == {1: ["title"], 2: ["body"]}
    kept = search.search(docs, search.SearchQuery("fox", weights=weights), condition=search.passes(entity_ids=["e1"])).collect()
    assert [r.doc_id for r in kept] == [1, 4]
    assert search.search(docs.limit(0), search.SearchQuery("fox", hybrid=True, weights=weights)).collect() == []
    emoji = search.search(spark.createDataFrame([(1, "\U00020000\U00020001 word")], "doc_id long, text string"), search.SearchQuery("word", hybrid=True)).first()
    assert emoji.score == pytest.approx(0.7 + 0.3 * (0.5 * 2 * 6 / (10 + 6) + 0.5 / 2))


def test_graph(spark):
    rows = [("a", "b", 1), ("b", "c", 2), ("a", "d", 3), ("d", "c", 1), ("x", "y", 5)]
    e = spark.createDataFrame([(s, t, T0, T0 + timedelta(days=n), n) for s, t, n in rows], "source string, target string, first_seen timestamp_ntz, last_seen timestamp_ntz, evidence_id long")
    n = graph.neighbourhood(e, "a", 2)
    assert {(r.node, r.hop) for r in n.collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert graph.incident_edges(e, n, 2).count() == 4
    path = graph.evidence_path(e, "a", "c")
    assert [p["target"] for p in path] == ["d", "c"] and graph.evidence_path(e, "a", "a") == [] and graph.evidence_path(e, "a", "y") is None
    assert [r.other for r in graph.common_neighbours(e, "b", "d").orderBy("other").collect()] == ["a", "c"]
    assert graph.active(e, at=T0 + timedelta(days=4)).count() == 1


def test_lineage(spark):
    s = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99)], "source_id long, copied_from long")
    assert {(r.source_id, r.root, r.depth) for r in dedup.lineage_roots(s).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 99, 1)}
    with pytest.raises(ValueError):
        dedup.lineage_roots(spark.createDataFrame([(1, 2), (2, 1)], "source_id long, copied_from long"), 8)


def test_duplicate_clusters(spark):
    base = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, base), (2, base.upper()), (3, base + " tail"), (4, "something else entirely here"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.cluster_id, r["size"]) for r in dedup.cluster(docs).collect()}
    assert got[1] == got[2] == got[3] and got[1][1] == 3 and got[4][0] != got[1][0]


def test_audit_chain(spark):
    e = spark.createDataFrame([(i, f"t{i}", "act", "case", str(i), "{}") for i in range(6)], "seq long, occurred_at string, action string, entity_type string, entity_id string, payload string")
    log = audit.append(e)
    rows = log.orderBy("seq").collect()
    assert rows[0].entry_hash == hashlib.sha256(b"|t0|act|case|0|{}").hexdigest()
    assert audit.verify(log).collect() == []
    bad = log.withColumn("payload", F.when(F.col("seq") == 3, "{1}").otherwise(F.col("payload")))
    assert [(r.seq, r.fault) for r in audit.verify(bad).collect()] == [(3, "hash")]


def test_calibration(spark):
    s, y = np.array([0.1, 0.4, 0.35, 0.8]), np.array([0, 0, 1, 1])
    edges, values = fusion.isotonic(s, y)
    assert values.tolist() == sorted(values.tolist()) and values[-1] == 1.0
    assert one(spark, fusion.step_lookup(F.lit(0.9), edges, values).alias("v")).v == 1.0
    a, b = fusion.platt(s, y)
    assert a > 0 and np.isfinite(b)
    d = spark.createDataFrame([(0, 0.9, 1), (1, 0.8, 0), (2, 0.7, 0), (3, 0.6, 1)], "id int, score double, label int")
    assert fusion.best_f1(d).first().threshold == 0.9 and fusion.average_precision(d).first()[0] == pytest.approx(0.75) and fusion.roc_auc(d).first()[0] == pytest.approx(0.5)


def test_flow_conserves_amount(spark):
    f = spark.createDataFrame([("t", i, o, 100.0, T0) for i in "ab" for o in "cd"], "tx_id string, input string, output string, amount double, ts timestamp_ntz")
    assert flows.aggregated(f).agg(F.sum("total")).first()[0] == pytest.approx(100.0)
    g = synthetic.wallet_graph(spark, 20, 60)
    pairs = spark.createDataFrame([("w001", "w002"), ("w003", "w999")], "l string, r string")
    rows = flows.pair_features(g, pairs, spark.createDataFrame([("w001", 1), ("w002", 1)], "wallet string, cluster_id long")).collect()
    assert all(0 <= r[c] <= 1 for r in rows for c in r.asDict() if c not in "lr")


def test_infrastructure(spark):
    raw = spark.createDataFrame([('{"observation_id":"o1","subject":"s"}',), ("{bad",)], "payload string")
    assert [r.missing for r in infrastructure.parse(raw).collect()] == [["observed_range"], ["observation_id", "subject", "observed_range"]]
    p = spark.createDataFrame([(1.0, 0.9, None, None, None, 1.0), (0.5, 0.5, 0.5, 0.5, 0.5, 1.0)], "certificate double, content double, technology double, http double, tls double, temporal double")
    assert [r.strongest for r in infrastructure.decide(p).collect()] == ["certificate"]


def test_infrastructure_correlation(spark):
    body = "('v1' version, 'c' cipher_suite)"
    assert body
    one_row = "select '{0}' observation_id, named_struct('version','1','cipher_suite','c','ja3','j') tls, named_struct('status_code',200,'server','s','content_type','t','headers',map('a','b')) http, named_struct('fingerprint_sha256','{1}','subject','x','issuer','i','sans',array('a'),'spki_sha256','k') certificate, array('php') technologies, 5L simhash, array(1L,2L) minhash, named_struct('start',timestamp'2024-01-01','end',timestamp'2024-01-03') observed_range, array('fp:{1}') block"
    d = spark.sql(one_row.format("o1", "f") + " union all " + one_row.format("o2", "f") + " union all " + one_row.format("o3", "g"))
    got = infrastructure.correlate(d, d, ["block"]).collect()
    assert [(r.l.observation_id, r.r.observation_id, r.strongest) for r in got] == [("o1", "o2", "certificate")] and got[0].overall == pytest.approx(1.0)


def test_style_and_encoders(spark):
    assert stylometry.measures("") == [0.0] * 14 and stylometry.measures("A b. B!")[1:3] == [3.0, 2.0]
    v = np.array(stylometry.hashed("the fox"))
    assert np.linalg.norm(v) == pytest.approx(1.0)
    assert stylometry.transform("A, b!", "punctuation") == "A b" and stylometry.transform("aB", "case") == "Ab"
    assert stylometry.transform("you are", "slang") == "u r" and len(stylometry.transform("a b c d", "shorten").split()) == 1
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "node_id string, x array<double>")
    e = spark.createDataFrame([("a", "b", "r", 0.0)], "src string, dst string, rel string, day double")
    h = {r.node_id: r.h for r in encoders.relational(nodes, e, 2, 4, ["r"]).collect()}
    w = lambda n: encoders.projection(n, 2, 4)
    assert np.allclose(h["b"], np.tanh(np.array([0, 1]) @ w("self") + np.array([1, 0]) @ w("r")))
    assert {r.node_id for r in encoders.attention(nodes, e, 2, 4).collect()} == {"a", "b"}


def test_assistant():
    assert assistant.intent("Compare a and b") == "compare" and assistant.intent("anything") == "search"
    since, until = assistant.window("events of the last 24 hours", T0)
    assert until - since == timedelta(hours=24) and assistant.window("now", T0) is None


def test_exports(spark, tmp_path):
    d = spark.sql("select 1 id, map('b', 2, 'a', 1) kinds, array('x', 'y') tags, cast(null as double) score")
    assert exports.flat(d).first().asDict() == {"id": 1, "kinds": "a=1;b=2", "tags": "x;y", "score": None}
    exports.write_csv(d, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().kinds == "a=1;b=2"
    import json
    import uuid

    note = json.loads(exports.stix_notes(spark.sql("select 'k' id, 'text' t"), "id", "t").first().value)
    assert note["id"] == f"note--{uuid.uuid5(exports.NAMESPACE, 'k')}"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    found = exports.artifacts(spark, str(tmp_path / "f"))
    assert found.first().sha256 == hashlib.sha256(b"abc").hexdigest() and exports.corrupted(found, found).count() == 0


def test_ingest_nulls_match(spark):
    new = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "sha string, seen int")
    old = spark.createDataFrame([("a", None)], "sha string, seen int")
    assert [tuple(r) for r in relational.missing_keys(new, old, ["sha", "seen"]).collect()] == [("b", 1)]


def test_streams_agree_with_batch(spark, tmp_path):
    values = list("aabbabbbcca")
    e = events(spark, values)
    src = tmp_path / "in"
    for k in range(3):
        e.filter(F.col("event_id").between(k * 4, k * 4 + 3)).coalesce(1).write.mode("append").parquet(str(src))
    schema = e.withColumn("observed_at", F.col("observed_at").cast("timestamp")).schema
    e.withColumn("observed_at", F.col("observed_at").cast("timestamp")).orderBy("event_id").coalesce(1).write.mode("overwrite").parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    for name, df, mode in (("states", activity.confirmed_states(stream), "append"), ("days", activity.tumbling(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    want = [(r.event_id, r.before, r.after) for r in timeline.state_changes(e).collect()]
    assert sorted((r.event_id, r.before, r.after) for r in spark.sql("select * from states").collect()) == sorted(want) and want
    assert [r.n for r in spark.sql("select * from days").collect()] == [r.n for r in timeline.activity_series(e).collect()]


def test_dashboard_edges(spark):
    paths = {r.source_id: r.path for r in dashboards.lineage_path(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 9)], "source_id long, copied_from long")).collect()}
    assert paths == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4], 5: [9, 5]}
    with pytest.raises(ValueError):
        dashboards.lineage_path(spark.createDataFrame([(1, 2), (2, 1)], "source_id long, copied_from long"))
    r = dashboards.relation_counts(spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1, 2), (1, 1)], "source long, target long"))
    assert {x.id: x.relations for x in r.collect()} == {1: 2, 2: 1, 3: 0}
    schema = "case_id long, assessment_id long, calibrated double, raw double, created_at int, signals map<string,double>, supporting array<string>, contradicting array<string>"
    assessments = spark.createDataFrame([(1, 7, None, 0.4, 1, {"a": 0.2}, ["x"], ["y", "z"]), (1, 9, None, 0.9, 2, {}, None, None), (3, 5, 0.5, 0.1, 1, None, [], []), (4, 1, 0.7, 0.1, 1, None, [], [])], schema)
    g = dashboards.attribution_posture(assessments, spark.createDataFrame([(1, "open"), (2, "open"), (3, "active"), (4, "closed")], "case_id long, status string"))
    assert {x.case_id: (x.assessment_id, x.confidence, x.modalities, x.contradictions, x.freshness) for x in g.collect()} == {1: (9, 0.9, 0, 0, 0.0), 3: (5, 0.5, 0, 0, 0.5)}
    m = {(x.case_id, x.modality): (x.support_value, x.contradict_value, x.support) for x in dashboards.signal_matrix(assessments, ["a", "b"]).collect()}
    assert m[1, "A"] == (0.2, 0.12, "LOW") and m[1, "B"] == (0.55, 0.12, "MEDIUM") and m[3, "A"] == (0.55, 0.0, "MEDIUM")
    links = spark.createDataFrame([("h", "m", "supporting", 1), ("h", "m", "supporting", 2), ("h", "n", "contradicting", 1), ("h", None, "supporting", 1), ("h", None, "other", 1)], "hypothesis_id string, modality string, role string, independence_group int")
    assert {x.modality: (x.bucket, x.net) for x in dashboards.hypothesis_comparison(links).collect()} == {"m": ("aligned", 2), "n": ("apart", -1), "unattributed": ("weak", 0)}
    s = {x.hypothesis_id: x for x in dashboards.hypothesis_summary(spark.createDataFrame([("h",), ("i",)], "hypothesis_id string"), links).collect()}
    assert s["h"].independent_source_groups == 2 and not s["h"].gap and s["i"].gap
    empty = spark.createDataFrame([], "k array<string>").agg(dashboards.array_total(dashboards.F.col("k")).alias("n")).first()
    assert empty.n == 0


def test_eth_checksum(spark):
    assert extraction.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    good = "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"  # published with the standard
    broken = good.replace("aAe", "aae")
    docs = [(1, f"pay {good} now"), (2, f"pay {broken} now"), (3, f"pay {good.lower()}"), (4, "nothing here. At all"), (5, None), (6, "ask vendor\u00a0nightowl"), (7, "@_fox hi"), (8, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.type, r.value, r.confidence) for r in extraction.extract(df).collect()}
    assert {(1, "wallet", good.lower(), 0.95), (3, "wallet", good.lower(), 0.8)} <= got and not any(g[0] in (2, 4, 5, 8) for g in got)
    assert got == {(i, s[0], s[3], s[4]) for i, t in docs if t for s in extraction.spans(t)}


def test_running_sums(spark):
    rows = [(i, (i * 7 % 13) / 13, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame([(i, s, int(y)) for i, s, y in rows], "id long, score double, label int")
    got = {r.id: (r.k, r.hits) for r in fusion.running_sums(df, [fusion.F.desc("score"), fusion.F.asc("id")], {"k": fusion.F.lit(1), "hits": fusion.F.col("label")}).collect()}
    hits = 0
    for k, (i, _, y) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        hits += y
        assert got[i] == (k, hits)
    assert fusion.running_sums(df.limit(0), [fusion.F.asc("id")], {"k": fusion.F.lit(1)}).count() == 0
