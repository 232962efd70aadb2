import itertools
import random
import time

from evidentia.operators import extraction, ner


def test_grammar_and_roles():
    t = "Acme Market and the black market; ALPHA  forum, mynetwork community. Traded on the forum"
    assert [(s[0], t[s[1] : s[2]], s[3]) for s in ner.by_grammar(t)] == [("marketplace", "Acme Market", "acme market"), ("forum", "ALPHA  forum", "alpha forum"), ("forum", "mynetwork community", "mynetwork community")]
    t = "vendor ghostbroker, Vendor: shipped, mod  night.owl. seller the x; administrator @ a1 subvendor no; owner z"
    assert [(s[3], s[5], t[s[1] : s[2]]) for s in ner.by_role(t)] == [("ghostbroker", "vendor", "ghostbroker"), ("night.owl", "mod", "night.owl."), ("a1", "administrator", "a1")]


def test_gazetteer_whole_words_only():
    a = ner.automaton({"chat_delta": "channel", "market_beta": "marketplace", "new york": "place", "york": "town"})
    t = "Chat_Delta xchat_delta chat_delta-2 É market_beta. New York"
    assert [(s[0], t[s[1] : s[2]]) for s in ner.by_name(t, a)] == [("channel", "Chat_Delta"), ("marketplace", "market_beta"), ("place", "New York"), ("town", "York")]


def test_best_set_of_overlaps():
    rng = random.Random(1)
    for _ in range(300):
        spans = []
        for _ in range(rng.randint(0, 8)):
            lo = rng.randint(0, 20)
            spans.append(("t", lo, lo + rng.randint(1, 8), str(rng.randint(0, 3)), rng.choice([0.65, 0.7, 0.9]), "c"))
        weight = lambda ss: sum(s[4] * (s[2] - s[1]) for s in ss)
        free = lambda ss: all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(ss, 2))
        got = ner.chosen(spans)
        best = max((weight(c) for n in range(len(set(spans)) + 1) for c in itertools.combinations(set(spans), n) if free(c)), default=0)
        assert free(got) and abs(weight(got) - best) < 1e-9


def test_both_ways_agree(spark):
    texts = [None, "", "Acme Market vendor acme chat_delta", "new york forum New  York new york", "x" * 50_000 + " chat_delta", "vendor chat_delta sold"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    g = spark.createDataFrame([("Chat_Delta", "channel"), ("new york", "place"), ("acme", "firm"), ("acme", "brand"), ("?", "none"), (None, "none")], "name string, kind string")
    for resolve in (True, False):
        small = sorted(map(tuple, ner.recognise(d, g, resolve).collect()))
        assert small and small == sorted(map(tuple, ner.recognise(d, g, resolve, most=0).collect()))
    assert not any(r.type == "alias" and r.value == "acme" for r in ner.recognise(d, g).collect())
    assert ner.recognise(d.limit(0), g).collect() == [] and ner.recognise(d, g.limit(0)).filter("cue = 'gazetteer'").count() == 0


def test_hosts():
    assert extraction.host_like("shop.coin") and extraction.host_like("a.b.ru") and not extraction.host_like("report.pdf") and not extraction.host_like("x.onion")
    assert not extraction.host_like("a.zzz") and extraction.host_like("a.zzz", "https://") and extraction.host_like("a.zzz", " www.")


def test_percent_encoded_text_is_linear():
    began = time.time()
    extraction.spans("https://x.com/?q=" + "%41%42" * 170_000)
    extraction.spans("%41" * 350_000)
    assert time.time() - began < 4
