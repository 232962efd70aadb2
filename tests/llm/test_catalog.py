from evidentia.llm import catalog
from tests.compare import connect, difference


def test_oracles(spark, sf):
    con = connect(sf)
    for name, sql in catalog.oracle_sql().items():
        assert difference(con, sql, catalog.queries()[name](spark, sf)) == "", name


def test_schemas(spark, sf):
    want = {
        "op1_quality": ["doc_id", "held_out", "score", "predicted"], "op2_language": ["doc_id", "held_out", "lang_pred", "score"], "op3_pages": ["page_id", "url", "text", "n_chars"], "op4_simhash": ["doc_id", "fingerprint", "component_id"],
        "op5_substrings": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op6_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op8_license": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"], "op9_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op11_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op12_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        "op13_periods": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    }
    assert set(want) == set(catalog.queries())
    for name, columns in want.items():
        if name in ("op9_bpe", "op8_license", "op6_decontaminate", "op11_secrets", "op12_manifest", "op13_periods"):
            assert catalog.queries()[name](spark, sf).columns == columns
