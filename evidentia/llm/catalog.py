"""The thin driver queries of the training-text operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import bpe, decontaminate, language, license, manifest, pages, periods, quality, rules, secrets, simhash, substrings, toxicity
from evidentia.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), 400, keep_first=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.findings(versions, secrets.scan(versions)))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(table(spark, sf_dir, "documents"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.detect(table(spark, sf_dir, "documents"))


#: Words, A-Z lower-cased, in DuckDB.
WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""with iw as (select item_id, {WORDS.format('text')} w from benchmark where text is not null and item_id is not null),
g as (select distinct item_id, least(10, len(w)) k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') s from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from iw where len(w) > 0)),
d as (select doc_id, {WORDS.format('text')} w from documents),
p as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d cross join (select distinct k from g) where len(w) >= k)),
h as (select p.doc_id, p.i, p.k, g.item_id from p join g on p.k = g.k and p.s = g.s),
n as (select doc_id, count(distinct x) n_hit from (select doc_id, unnest(range(i, i + k)) x from h) group by 1),
t as (select doc_id, count(*) n_items, string_agg(v, ',' order by v) items from (select distinct doc_id, cast(item_id as varchar) v from h) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join n using (doc_id) left join t using (doc_id)"""


def op8_sql() -> str:
    """Base phrases by position; template labels by trying every block and every window of every text."""
    rows = [(label, i, len(t.split()), sorted(set(t.split())), must.split()) for label, ts in license.TEMPLATES.items() for i, (t, must) in enumerate(ts)]
    templates = ", ".join(f"('{label}', {i}, {n}, {ws}, {must})" for label, i, n, ws, must in rows)
    phrases = " union all ".join(f"select doc_id, i - 1 as place, '{label}' lab from u where " + " and ".join(f"w[i{f' + {k}' if k else ''}] = '{x}'" for k, x in enumerate(p.split())) for p, label in license.PHRASES.items())
    return rf"""with d as (select doc_id, text, {WORDS.format('text')} w from documents), u as (select doc_id, w, unnest(range(1, len(w) + 1)) i from d where contains(lower(text), 'license') or contains(lower(text), 'reserved') or contains(lower(text), 'cc')),
b as (select doc_id, place, lab from ({phrases})),
t(lab, tid, n, ws, must) as (values {templates}),
c as (select d.*, t.* from d join t on len(list_intersect(d.w, must)) = len(must) and len(list_intersect(d.w, ws)) >= ceil(0.8 * len(ws) - 1e-9)),
k as (select doc_id, -i place, lab, ws, must, list_distinct({WORDS.format('block')}) w from (select doc_id, lab, ws, must, unnest(bs) block, unnest(range(1, len(bs) + 1)) i from (select *, string_split(regexp_replace(text, '([.!?;])[ 	]+', '' || chr(10), 'g'), chr(10)) bs from c))),
v as (select doc_id, lab, ws, must, i, w[i:i + n - 1] w from (select *, unnest(range(1, len(w) + 1)) i from c)),
f as (select doc_id, place, must[1] anchor, lab, len(list_intersect(w, ws)) o, len(ws) n from k where len(list_intersect(w, must)) = len(must) and len(list_intersect(w, ws)) >= ceil(0.8 * len(ws) - 1e-9)
 union all select doc_id, i + j - 1, must[1], lab, len(list_intersect(w, ws)), len(ws) from (select *, unnest(range(1, len(w) + 1)) j from v where len(list_intersect(w, must)) = len(must) and len(list_intersect(w, ws)) >= ceil(0.8 * len(ws) - 1e-9)) where w[j] = must[1]),
m as (select doc_id, lab, max(o / n) c from (select *, max(o) over (partition by doc_id, place, anchor) best from f) where o = best group by 1, 2),
a as (select doc_id, count(*) n_base, min(place) first_word, max(place) last_word from b group by 1),
l as (select doc_id, string_agg(distinct lab, ',' order by lab) labels, max(c) c from (select doc_id, lab, 1.0 c from b union all select doc_id, lab, c from m) group by 1),
o as (select doc_id, string_agg(distinct lab, ',' order by lab) labels from b group by 1)
select d.doc_id, cast(len(d.w) as bigint) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(o.labels, '') base_labels, coalesce(l.labels, '') labels, case when n_base > 0 then 1.0::double else coalesce(l.c, 0)::double end score from d left join a using (doc_id) left join l on l.doc_id = d.doc_id left join o on o.doc_id = d.doc_id"""


def op11_sql() -> str:
    """Each kind's matches are placed by the lengths of what lies between them."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = {
        "assign": (rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24), "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), "github": ("gh[pousr]_[A-Za-z0-9]+", 0, 40),
        "slack": ("xox[abprs]-[A-Za-z0-9-]+", 0, 24), "google": ("AIza[A-Za-z0-9_-]+", 0, 39), "url": (r"://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", 0, 0),
    }
    found = " union all ".join(f"select rid, '{kind}' kind, {k} ord, string_split_regex(t, '{p}') gaps, regexp_extract_all(t, '{p}') hits, regexp_extract_all(t, '{p}', {g}) own, {least} least from d" for k, (kind, (p, g, least)) in enumerate(kinds.items()))
    return f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
m as ({found}),
u as (select *, unnest(range(1, len(hits) + 1)) i from m),
s as (select rid, kind, ord, cast(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) a, length(hits[i]) n from u where length(own[i]) >= least),
g as (select rid, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, ord) filter (ord < 3) base, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, ord) spans from s group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join g using (rid)"""


def op12_sql(levels: int = 24, tops: int = 8) -> str:
    """A common table for each level, and one for each step of the proofs: groups of up to 2^levels leaves, and 2^tops of them."""
    field = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"
    leaf = lambda n: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"
    up = lambda name, k: f"{name}{k + 1} as (select g, i // 2 i, case when n > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end h, (n + 1) // 2 n from {name}{k} group by g, i // 2, n)"
    step = lambda out, name, k: f"{out}{k + 1} as (select p.* exclude (f, pr), case when p.n > (1::bigint << {k}) then sha256(case when (p.i >> {k}) & 1 = 1 then coalesce(s.h, '') || f else f || coalesce(s.h, '') end) else f end f, pr || coalesce(s.h, '') pr from {out}{k} p left join {name}{k} s on s.g = p.g and s.i = xor(p.i >> {k}, 1))"
    parts = [
        f"d as (select doc_id, coalesce('=' || lang, '') g, {leaf('n_chars')} leaf, case when {crc} % 7 = 0 and n_chars is not null then {leaf('n_chars + 1')} end bad from documents)",
        "l0 as (select g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 i, leaf h, count(*) over (partition by g) n, doc_id, bad from d)",
        *[up("l", k) for k in range(levels)], f"r0 as (select '' g, row_number() over (order by g) - 1 i, h, count(*) over () n, g lang from l{levels})", *[up("r", k) for k in range(tops)],
        "p0 as (select doc_id, g, i, n, h leaf, coalesce(bad, h) f, '' pr from l0)", *[step("p", "l", k) for k in range(levels)],
        f"q0 as (select p.doc_id, p.leaf, r.h subroot, '' g, r.i, r.n, p.f, p.pr from p{levels} p join r0 r on r.lang = p.g)", *[step("q", "r", k) for k in range(tops)],
    ]
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, h as root, sha256(pr) proof_sha256, f folded_root, f = h verified from q{tops} cross join (select h from r{tops})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_language, op3_pages, op4_simhash, op5_substrings, op6_decontaminate, op7_toxicity, op8_license, op9_bpe, op10_quality_rules, op11_secrets, op12_manifest, op13_periods)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": OP6, "op8_license": op8_sql(), "op11_secrets": op11_sql(), "op12_manifest": op12_sql()}
