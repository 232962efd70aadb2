"""Numbers that lie exactly on a limit or between two decimals: query and SQL must agree there too."""

import random
from fractions import Fraction

import numpy as np
import pytest

from evidentia.operators import shifts
from evidentia.plans import catalog
from evidentia.plans.relational import ACTORS
from tests.compare import connect, difference

SF = "/root/testdata/sf0.1"


def brute_alarms(v):
    up = down = Fraction(0)
    out = []
    for i, x in enumerate(v):
        d = x - Fraction(sum(v), len(v))
        up, down = max(Fraction(0), up + d - 1), max(Fraction(0), down - d - 1)
        if up > 5 or down > 5:
            out.append((i, float(up if up > 5 else -down)))
            up = down = Fraction(0)
    return out


def test_sums_at_the_threshold():
    rng = random.Random(15)
    for _ in range(3000):
        v = [rng.choice([0, 1, 2, 3, 8]) for _ in range(rng.randint(6, 40))]
        assert shifts.cusum_alarms(np.array(v, float), 1.0, 5.0) == brute_alarms(v)


def test_gains_are_rounded_once():
    rng = random.Random(14)
    for _ in range(200):
        v = [rng.randint(0, 9) for _ in range(rng.randint(6, 60))]
        n = len(v)
        ks = [(Fraction(sum(v[:k]), k), Fraction(sum(v[k:]), n - k), k) for k in range(1, n)]
        assert shifts.mean_shift_gains(np.array(v, float)).tolist() == [float(Fraction(k * (n - k), n) * (a - b) ** 2) for a, b, k in ks]


@pytest.mark.parametrize("name", ["registry_sort_nulls_last", "activity_regimes", "registered_detector"])
def test_oracle(spark, name):
    assert difference(connect(SF), catalog.oracle_sql()[name], catalog.queries()[name](spark, SF)) == ""


def test_confidence_in_the_middle(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create table customer as select i c_custkey, 'n' c_name, 'm' c_mktsegment, 0 c_nationkey, i + 0.5::double c_acctbal from range(9999) t(i)")
    assert con.sql(f"select count(*) from {ACTORS} where confidence <> (actor_id + 1) / 10000").fetchall() == [(0,)]
