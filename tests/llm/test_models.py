"""The learned operators: held-out accuracy on real rows, and defined results on awkward ones."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import language, pages, quality, rules, toxicity
from evidentia.llm.common import table
from tests.llm.fixtures import awkward, frame, labels

SF = "/root/testdata/sf0.01"


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("module", "target", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.75)])
def test_held_out_auc(spark, module, target, least):
    got = {r.doc_id: r for r in module.classify(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    known = [(got[r.doc_id].score, r[target]) for r in table(spark, SF, "labels").collect() if got[r.doc_id].held_out]
    assert auc(known) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows(spark, module):
    rows = awkward()
    for known in ([], [(1, 1, 0, "x"), (3, 0, 1, "x"), (4, 1, 0, "x"), (9, 0, 1, "x"), (11, 1, 1, None), (None, 0, 0, None)], [(1, 1, 1, None)]):
        got = module.classify(frame(spark, rows), labels(spark, known)).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert all(0 <= r.score <= 1 for r in got)
    assert module.classify(frame(spark, []), labels(spark)).collect() == []


def test_language(spark):
    docs = table(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_awkward(spark):
    got = {(r.doc_id, r.lang_pred) for r in language.identify(frame(spark)).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (15, "und")} <= got and len({l for _, l in got}) > 1
    assert {r.lang_pred for r in language.identify(frame(spark).drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert language.identify(frame(spark, [])).collect() == []


def test_rules_against_brute_force(spark, sf):
    rows = awkward() + [(1000 + r.doc_id, r.text, None, None, 0, None, None) for r in table(spark, sf, "documents").collect()]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.quality_rules(frame(spark, rows), labels(spark)).collect())
    word, want = re.compile(r"[^\x20\x09-\x0D]+"), Counter()
    for r in rows:
        t = r[1] or ""
        w = word.findall(t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if word.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert got == want


def test_learned_rules(spark):
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in rules.quality_rules(docs, known).collect()}
    held = [(got[r.doc_id], r.quality) for r in known.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    bad = [r for r, y in held if y == 0]
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)
    good = [r for r, y in held if y == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>x</style></head><body class="home"><header><a href=/>Site</a></header><div class="cookie-notice">We use cookies</div>
<div id=box7><a href=/1>One</a> <a href=/2>Two</a></div><article><header><h1>Head &amp; line {n}</h1></header><p>First  para{n}<br>more<p>Second <b>bold<p>Third</b> &eacute;
<script>if (a < b) x("</p>")</script><div class="ad">Buy</div><form><p>Name</p></form></article><section class="comments"><p>Nice</p></section><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_page_text():
    root = pages.parse(PAGE.format(n=1))
    nodes = pages.measure(root, "h")
    assert pages.text_of(root, nodes, {}) == "Head & line 1\n\nFirst para1 more\n\nSecond bold\n\nThird é"


def test_templates_by_host(spark):
    bare = "<body><div class=x1><a href=/a>Alpha</a> <a href=/b>Beta</a></div><div><p>Text {n} of its own</p></div><div class=zz>All of it {h}</div></body>"
    rows = [(i, f"http://h.example/{i}", bare.format(n=i, h="here")) for i in range(8)] + [(20, "http://other.example/", bare.format(n=1, h="here")), (21, None, None), (22, "x", ""), (22, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect())
    want = Counter((i, f"Text {i} of its own", 15 + len(str(i)) - 0) for i in range(8))
    assert {k[:2] for k in want} <= {k[:2] for k in got} and got[22, "", 0] == 2 and got[21, "", 0] == 1
    assert (20, "Alpha Beta\n\nText 1 of its own\n\nAll of it here", 45) in got
    assert Counter((r.page_id, r.text, r.n_chars) for r in pages.extract(df, 0).collect()) == got
    assert pages.extract(df.limit(0)).collect() == []


def test_long_runs_of_digits_and_signs():
    """Masked tokens are found in time that grows with the text's length, whatever their length."""
    import time

    from evidentia.llm import toxicity

    lexicon = toxicity.Lexicon.of(["idiot"])
    began = time.time()
    for text in ("0" * 1_000_000 + "!", "-" * 1_000_000, "a1" * 300_000, "x" * 1_000_000 + " id1ot", "*" * 500_000 + "a"):
        toxicity.features(text, lexicon)
    assert time.time() - began < 15
    at = toxicity.NAMES.index("masked_hits")
    assert [toxicity.features(t, lexicon)[at] for t in ("you id1ot", "1d1ot", "id*ot", "x" * 90 + " 1diot!", "a\t1diot\tb", "id10t1")] == [1, 1, 1, 1, 1, 0]


def test_letters_of_every_plane_and_many_languages(spark):
    from evidentia.llm import language

    assert language.trigrams("\U00030001\U00030002") is not None and language.trigrams("1 2") is None
    rows = [(4 * k, "".join(chr(0x4E00 + 7 * k + i % 5) for i in range(30)), f"l{k:03}", None, 0, None, None) for k in range(500)]
    got = language.identify(frame(spark, rows)).collect()
    assert len({r.lang_pred for r in got}) > 256


def test_interactions_equal_the_sum_over_pairs():
    """The linear-time identity against explicit pairs."""
    rng = np.random.default_rng(1)
    fm = quality.FactorisationMachine(9, 4)
    x, fm.v, fm.w = rng.random(9), rng.random((9, 4)), rng.random(9)
    pairs = sum(x[i] * x[j] * (fm.v[i] @ fm.v[j]) for i in range(9) for j in range(i))
    assert np.isclose(fm.raw(np.array([0]), np.arange(9), x)[0][0], fm.w @ x + pairs)


SITE = """<body><div class=top><a href=/>Home</a> <a href=/x>News</a> <b>{shop}</b></div><div class=main><div class=lead><p>Story {n} begins.</p><p>It goes on with {n} more.</p></div>
<ul class="menu"><li>Soup {n}</li><li>Bread {n}</li></ul><p>A <a class="related" href=#>link {n}</a> and a <span class="share price">price {n}</span>.</p></div>
<div class=low><p>All of this site is made by {shop}.</p><p>Call us.</p></div><div class="comments"><p>Reader {n} says no.</p></div></body>"""


def test_templates_decide_without_an_article(spark, monkeypatch):
    """Twenty pages a host and no article: what recurs goes, what differs stays, and only by counting."""
    rows = [(100 * h + n, f"https://shop{h}.example/p/{n}", SITE.format(shop=f"Shop {h}", n=1000 * h + n), "x") for h in range(3) for n in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = {r[0]: "\n\n".join(f"Story {k} begins.|It goes on with {k} more.|Soup {k}|Bread {k}|A link {k} and a price {k}.".split("|")) for r in rows for k in [1000 * (r[0] // 100) + r[0] % 100]}
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == want
    assert {r.page_id: r.text for r in pages.extract(df.repartition(7)).collect()} == want
    alone = df.filter("page_id = 5")
    assert "Home News Shop 0" in pages.extract(alone).collect()[0].text


def test_without_counting_templates_stay(spark, monkeypatch):
    """The names and tags alone leave the site's own boxes in the text: only the counts take them out."""
    rows = [(n, f"https://shop0.example/p/{n}", SITE.format(shop="Shop 0", n=n)) for n in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    counted = {r.page_id: r.text for r in pages.extract(df).collect()}
    monkeypatch.setattr(pages, "templates", lambda p: spark.createDataFrame([], "hash long, level int"))
    for r in pages.extract(df).collect():
        assert r.text.startswith("Home News Shop 0") and "Call us." in r.text
        assert "Home" not in counted[r.page_id] and "Call us." not in counted[r.page_id]


SHARED = "<p>This passage is syndicated and stands on many pages of the host, never with the same words around it.</p>"


def test_syndicated_passages_stay(spark):
    """A passage on a third of a host's pages stays among fresh prose, with an article or without; a promotion box of
    the same number of pages goes; copies of one story under different menus keep it."""
    box = "<div class=promo><p>Subscribe to our weekly letter today.</p></div>"
    rows, want = [], {}
    for tag in ("article", "div"):
        host = f"{tag}.example"
        for n in range(60):
            hit = n % 3 == 0
            body = f"<{tag} class=story><h1>{'The news' if hit else f'Title {n}'}</h1><p>Own text {n} begins here and is long enough to count.</p>{SHARED if hit else ''}<p>It ends with {n}.</p></{tag}>"
            rows.append((len(rows), f"http://{host}/{n}", f"<body><div class=nav1><a href=/>Start</a></div>{body}{box if hit else ''}</body>"))
            lines = ["The news" if hit else f"Title {n}", f"Own text {n} begins here and is long enough to count.", *([SHARED[3:-4]] if hit else []), f"It ends with {n}."]
            want[rows[-1][0]] = "\n\n".join(lines)
    for n in range(60):
        story = "<div><p>The same story, word for word.</p><p>In two paragraphs.</p></div>" if n < 15 else f"<div><p>Story number {n}.</p></div>"
        rows.append((len(rows), f"http://copies.example/{n}", f"<body><ul class=m{n}><li><a href=/{n}>To {n}</a></li></ul>{story}</body>"))
        want[rows[-1][0]] = f"To {n}\n\n" + ("The same story, word for word.\n\nIn two paragraphs." if n < 15 else f"Story number {n}.")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == want
    assert {r.page_id: r.text for r in pages.extract(df, 0).collect()} == want


def test_names_are_whole_and_comments_of_any_tag_go():
    def text(html: str) -> str:
        nodes = pages.measure(root := pages.parse(html), "h")
        return pages.text_of(root, nodes, {})

    assert text('<article><div class="notice">Take notice.</div><div class="photo ad hoc">A photo.</div><p>Body</p></article>') == "Take notice.\n\nA photo.\n\nBody"
    assert text('<body><div class="notice">We moved.</div><div class="ad sponsored">Buy</div><div id="comments"><p>Nice</p></div><p>Body</p></body>') == "Body"
    assert text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>") == "If x=2 holds"
    assert text('<article><p>Body</p></article><article class="comment odd" id="comment-7"><p>Reader</p></article>') == "Body"
    assert text('<article class="post commentary"><p>Body</p><article class="comment-body"><p>Reader</p></article></article>') == "Body"


def test_renamed_articles_give_the_same_text(spark):
    """On the given pages nothing hangs on the article tag: renamed, the counts and rules give the same text."""
    from pyspark.sql import functions as F

    given = table(spark, SF, "pages")
    renamed = given.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    rows = lambda df: {r.page_id: r.text for r in pages.extract(df).collect()}
    assert rows(renamed) == rows(given)


def test_broken_pages_in_linear_time():
    import time

    for piece in ("<a ", '<a t="', "<a 'x>' ", "<title>", "<b><p>", "</", "<!", "<a t=\"'>", "<div><b>", "&amp;<", "<svg><a"):
        began = time.time()
        html = "<p>start</p>" + piece * (1_000_000 // len(piece))
        nodes = pages.measure(root := pages.parse(html), "h")
        assert pages.text_of(root, nodes, {}).startswith("start")
        assert time.time() - began < 20, piece


def test_tags():
    got = [(html[a:b], name, closing) for html in ["x<a href='>'>y</a><!-- <b> --><br/>< p><i", "<p class=\"a>b"] for a, b, name, _, closing in pages.tags(html)]
    assert got == [("<a href='>'>", "a", False), ("</a>", "a", True), ("<!-- <b> -->", "", False), ("<br/>", "br", False), ('<p class="a>', "p", False)]
