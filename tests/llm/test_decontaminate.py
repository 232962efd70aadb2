from collections import Counter

from evidentia.llm import decontaminate as dec
from tests.llm.fixtures import awkward, frame

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def digest(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def items(spark, sf):
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()]
    rows += [(900, "one"), (901, "One TWO"), (902, None), (903, ""), (904, "!!"), (905, "a a a a a a a a a a a a"), (900, "one"), (None, "the same line")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def documents(spark, sf, rows):
    texts = [t for _, t in rows if t]
    more = [(500, "x " + texts[0].upper() + " y", None, None, 0, None, None), (501, " ".join(texts[1].split()[3:15]), None, None, 0, None, None), (502, "a " * 30, None, None, 0, None, None), (503, texts[2] + " " + texts[2], None, None, 0, None, None)]
    return awkward() + more + [(1000 + r.doc_id, r.text, None, None, 0, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]


def test_matches_brute_force(spark, sf):
    rows, bench = items(spark, sf)
    docs = documents(spark, sf, rows)
    want = Counter(dec.brute_force([(r[0], r[1]) for r in docs], rows))
    got = digest(dec.contamination(frame(spark, docs), bench))
    assert got == want and sum(k[-1] for k in got) >= 5


def test_full_filters_give_the_same(spark, sf, monkeypatch):
    """Filters that let most words pass only cost."""
    rows, bench = items(spark, sf)
    docs = frame(spark, documents(spark, sf, rows))
    whole = digest(dec.contamination(docs, bench))
    monkeypatch.setattr(dec, "FILTER_BITS", 1 << 6)
    monkeypatch.setattr(dec, "REMEMBERED", 3)
    assert digest(dec.contamination(docs, bench)) == whole


def test_filter(spark):
    words = [f"w{k}é" for k in range(300)]
    passes = dec.word_filter(spark.createDataFrame([(w,) for w in words], "word string"))
    assert all(passes(w.encode()) for w in words) and sum(passes(f"x{k}".encode()) for k in range(3000)) < 10


def test_a_long_text_and_clashing_columns(spark):
    bench = spark.createDataFrame([("a", " ".join(f"item{k}" for k in range(14)))], "item_id string, text string")
    rows = [(1, "filler words " * 200_000 + " ".join(f"ITEM{k}" for k in range(2, 13)), "x", 5, "y"), (2, "filler " * 5, "z", 6, None), (2, "filler " * 5, "z", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit string, k long, win string")
    got = {r.doc_id: r for r in dec.contamination(docs, bench).collect()}
    assert (got[1].n_hit, got[1].n_words, got[1].n_items) == (11, 400_011, 1) and not got[2].contaminated
    kept = dec.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == rows[1:]


def test_empty_tables(spark, sf):
    rows, bench = items(spark, sf)
    assert dec.contamination(frame(spark, []), bench).collect() == []
    assert not any(r.contaminated for r in dec.contamination(frame(spark), bench.limit(0)).collect())
