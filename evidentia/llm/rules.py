"""Quality rules: native text statistics and a learned decision list.

Statistics are Spark expressions over whole texts. A learner on the driver takes the statistics of a bounded
labelled sample, grows conjunctions of thresholds by sequential covering (FOIL gain on a growing part), prunes them
(on a held-back part), and emits the ordered list as one Spark conditional expression. No Python runs on executors.

Defined results: a null text counts as empty and has no words; an empty labelled sample gives an empty list, so
only the base rule decides; rows that repeat get equal results; of thresholds of equal gain the first one tried counts
(ties), and sampled rows are put in order first; texts of any length are measured whole; an empty table gives an empty
result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import SPACE, labelled_sample

#: Statistics that the learner may test: shares of the words or characters, and distinct words over the root of all,
#: which unlike their share hardly depends on the length.
FEATURES = ["symbol_share", "upper_share", "bang_share", "bar_share", "echo_share", "repeat_share", "dup_line_share", "richness", "mean_word", "log_words"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array's lambda binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a width-word window that occurs at least twice in the array of words.

    Windows are compared by the 64-bit hash of their words. Most texts have no equal windows, which a hash set
    finds; only the others sort their windows and measure what the repeated ones cover."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        # Each start covers up to the next start, or a whole window.
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1) - p, F.lit(width)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        return F.when(F.size(w) < width, F.lit(0).cast("bigint")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h))))

    return of(words)


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, the base statistics and the learner's features of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.filter(F.split(text, rf"[{SPACE}]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    d = documents.select("doc_id", text.alias("text")).withColumns({"words": split, "lines": lines})
    n = F.size("words").cast("bigint")
    d = d.select(
        "doc_id",
        n.alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(f"[{SPACE}]"))).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit("!")).alias("n_bang"),
        F.regexp_count("text", F.lit(r"\|")).alias("n_bar"),
        let(F.transform("words", lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(F.array_distinct(h)).alias("types"), F.size(F.filter(h, lambda x, k: (k > 0) & (F.get(h, k - 1) == x))).alias("echo"))).alias("t"),
    )
    share = lambda a, b: F.coalesce(F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_bang", "n_words").alias("bang_share"),
        share("n_bar", "n_words").alias("bar_share"), share("t.echo", "n_words").alias("echo_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), F.coalesce(F.col("t.types") / F.sqrt(F.nullif(F.col("n_words").cast("double"), F.lit(0.0))), F.lit(0.0)).alias("richness"), share("word_chars", "n_words").alias("mean_word"),
        F.log1p(F.col("n_words").cast("double")).alias("log_words"),
    )


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.cut if self.above else row[self.feature] < self.cut

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.above else F.col(self.feature) < self.cut


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests; documents that meet all are rejected."""

    tests: tuple[Test, ...]
    precision: float
    support: int

    def holds(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.tests)

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out &= t.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'>=' if t.above else '<'} {t.cut:.4g}" for t in self.tests) + f" -> reject ({self.precision:.3f} of {self.support})"


def _cuts(rows: list[dict], feature: str, most: int = 48) -> list[float]:
    """Midpoints between neighbouring values, at most so many, spread over the ranks."""
    values = sorted({r[feature] for r in rows})
    mids = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return mids[:: max(1, len(mids) // most)]


def _grow(rows: list[dict], max_tests: int) -> list[Test]:
    """Adds the test of the greatest FOIL gain until no good document is covered."""
    tests: list[Test] = []
    while len(tests) < max_tests:
        bad = sum(r["y"] == 0 for r in rows)
        if bad == len(rows) or not bad:
            break
        base, best = math.log2(bad / len(rows)), (1e-9, None, rows)
        for f in FEATURES:
            for cut in _cuts(rows, f):
                for above in (True, False):
                    t = Test(f, above, cut)
                    kept = [r for r in rows if t.holds(r)]
                    p = sum(r["y"] == 0 for r in kept)
                    if p and (gain := p * (math.log2(p / len(kept)) - base)) > best[0]:
                        best = (gain, t, kept)
        if best[1] is None:
            break
        tests.append(best[1])
        rows = best[2]
    return tests


def _prune(tests: list[Test], rows: list[dict]) -> list[Test]:
    """Drops tests from the end while (bad - good) / covered on the held-back rows doesn't fall."""

    def worth(ts: list[Test]) -> float:
        got = [r["y"] for r in rows if all(t.holds(r) for t in ts)]
        return sum(1 if y == 0 else -1 for y in got) / len(got) if got else -1.0

    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def learn_rules(rows: list[dict], max_rules: int = 12, max_tests: int = 4, least_precision: float = 0.87, least_support: int = 4, seed: int = 42) -> list[Rule]:
    """Sequential covering over rows of FEATURES and y (0: reject)."""
    rows = sorted(rows, key=lambda r: tuple(r[f] for f in FEATURES))
    random.Random(seed).shuffle(rows)
    rules: list[Rule] = []
    while len(rules) < max_rules and sum(r["y"] == 0 for r in rows) >= least_support:
        grow, back = rows[: 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]
        tests = _grow(grow, max_tests)
        if not tests:
            break
        tests = _prune(tests, back)
        got = [r["y"] for r in rows if all(t.holds(r) for t in tests)]
        bad = sum(y == 0 for y in got)
        # Laplace's estimate, so that a few rows don't make a rule.
        if bad < least_support or (bad + 1) / (len(got) + 2) < least_precision:
            break
        rules.append(Rule(tuple(tests), bad / len(got), len(got)))
        rows = [r for r in rows if not rules[-1].holds(r)]
    return rules


def verdict(rules: list[Rule], default: bool = True) -> Column:
    """The decision list as one conditional expression: the first rule that holds rejects."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def quality_rules(documents: DataFrame, labels: DataFrame, max_bad: int = 500, max_good: int = 1000) -> DataFrame:
    """The base statistics of every document, base_failed, and kept: the learned list's verdict.

    max_bad, max_good: the bounds of the labelled sample whose statistics the driver gathers."""
    sample, _ = labelled_sample(documents, labels, "quality", {0: max_bad, 1: max_good})
    known = sample.select("doc_id", "y").groupBy("doc_id").agg(F.first("y").alias("y"))
    stats = statistics(sample.select("doc_id", "text")).join(F.broadcast(known), "doc_id").select(*FEATURES, "y")
    rules = learn_rules([r.asDict() for r in stats.limit(2 * (max_bad + max_good)).collect()])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(documents).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
