import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import decontaminate, simhash, substrings
from evidentia.llm.common import table
from tests.llm.fixtures import awkward, frame
from tests.llm.test_simhash import brute_fingerprint, brute_roots


def rows_of(df):
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect()]


def test_stages_against_brute_force(spark, sf):
    """Each stage's effect on real and awkward rows; every stage but the last keeps the columns of documents."""
    docs = table(spark, sf, "documents")
    columns = docs.columns
    docs = docs.unionByName(frame(spark, [(5000 + r[0] if r[0] is not None else None, *r[1:]) for r in awkward()]).select(*columns))
    before = rows_of(docs)
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == columns
    toxic = {r.doc_id for r in table(spark, sf, "labels").filter("toxic = 1").collect()}
    kept = rows_of(clean)
    assert not Counter(kept) - Counter(before)
    gone = {r[0] for r in before} - {r[0] for r in kept}
    assert len(gone & toxic) >= len(gone) / 2
    one = rows_of(simhash.keep_one(docs))
    order = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
    roots = brute_roots([brute_fingerprint(r[1]) for r in order])
    assert sorted((r[0] for r in one), key=str) == sorted((order[k][0] for k in set(roots)), key=str)
    cut = {(r[0], r[4]): r for r in rows_of(substrings.rewrite(docs.dropDuplicates(["doc_id"]), 300))}
    assert len(cut) > 200 and all(r[1] is None or r[4] is None or len(r[1]) == r[4] for r in cut.values() if r[0] is not None and r[0] < 5000)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    hit = Counter(d[0] for d in decontaminate.brute_force([(r[0], r[1]) for r in before], items) if not d[-1])
    assert Counter(r[0] for r in rows_of(corpus_pipeline.drop_contaminated(spark, docs, sf))) == hit


def test_whole_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert 100 < len(got) <= 200 and len({r.doc_id for r in got}) == len(got)
    assert all(r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("with_ids", [True])
def test_tokens_match_the_library(spark, with_ids):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    from evidentia.llm import bpe

    rows = awkward() + [(900, "a<|endoftext|>b  \n\n c", None, None, 0, None, None), (901, "a" * 3000, None, None, 0, None, None)]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.tokenize(frame(spark, rows), path, with_ids).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), tuple(ids)] += 1
    assert got == want


def test_clashing_and_empty(spark, sf):
    """Stages keep columns whose names the operators use themselves, and take empty tables."""
    rows = [(i, f"text {i} " + "word " * 90, f"x{i}", i, "k", "s", "d") for i in range(3)] + [(9, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, th long, key string, spans string, data string")
    for stage in (simhash.keep_one, lambda d: substrings.rewrite(d, 300), lambda d: corpus_pipeline.drop_contaminated(spark, d, sf), lambda d: corpus_pipeline.drop_toxic(spark, d, sf)):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {(r.doc_id, r.id, r.th) for r in out.collect()} <= {(r[0], r[2], r[3]) for r in rows}
        assert stage(docs.limit(0)).collect() == []


def test_rules_and_tokens_on_empty(spark):
    from evidentia.llm import bpe, rules
    from tests.llm.fixtures import labels

    assert rules.quality_rules(frame(spark, []), labels(spark)).collect() == []
    assert bpe.tokenize(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
