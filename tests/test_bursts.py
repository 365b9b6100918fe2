"""Burst states against the enumeration of all state sequences."""

import itertools
import math
import random

import pytest

from scriptorium.operators import trends

SCHEMA = "k string, y int, key long, period string, hits int"


def brute(hits, totals, factor, rise):
    """The least cost over all sequences, and the cost of a given one."""
    p0 = sum(hits) / sum(totals)
    p1 = min(factor * p0, (1 + p0) / 2)
    up = rise * math.log(len(totals))

    def cost(states):
        out, last = 0.0, 0
        for s, r, d in zip(states, hits, totals):
            p = (p0, p1)[s]
            out += -(r * math.log(p) + (d - r) * math.log(1 - p)) + (up if s > last else 0)
            last = s
        return out

    return min(cost(s) for s in itertools.product((0, 1), repeat=len(totals))), cost


@pytest.mark.parametrize("factor,rise", [(2.0, 1.0), (1.5, 0.3), (3.0, 0.0)])
def test_states_are_the_cheapest_sequence(spark, factor, rise):
    r = random.Random(5)
    rows = [(None, 2000 + y, 1, "x", 2) for y in range(9) for _ in range(3)] + [("a", None, 1, "x", 2)] * 4
    for k, rate in (("a", 4), ("b", 9), ("c", 2), ("d", 1)):
        for y in range(9):
            rows += [(k, 2000 + y, 1, "x", 2)] * (r.randrange(rate * (4 if r.random() < 0.3 else 1)) + y % 2)
    got = trends.burst_states(spark.createDataFrame(rows, SCHEMA), "k", "y", factor, rise).collect()
    assert {x.key for x in got} == {"a", "b", "c", "d"} and len(got) == 36
    for k in "abcd":
        mine = sorted((x for x in got if x.key == k), key=lambda x: x.period)
        hits, totals, states = [x.hits for x in mine], [x.total for x in mine], [x.state for x in mine]
        assert hits == [sum(a == k and b == x.period for a, b, *_ in rows) for x in mine]
        best, cost = brute(hits, totals, factor, rise)
        assert math.isclose(cost(states), best, rel_tol=1e-9)


def test_a_planted_burst_is_one_run(spark):
    rows = [(f"s{n % 20}", y, 1, "x", 2) for y in range(1990, 2010) for n in range(200)]
    rows += [("t", y, 1, "x", 2) for y in range(1990, 2010) for _ in range(60 if 1998 <= y <= 2001 else 10)]
    got = trends.bursts(trends.burst_states(spark.createDataFrame(rows, SCHEMA), "k", "y")).collect()
    assert [(x.key, x.first_period, x.last_period, x.periods, x.hits) for x in got] == [("t", 1998, 2001, 4, 240)]


def test_empty_tables_and_keys_that_all_records_have(spark):
    assert trends.bursts(trends.burst_states(spark.createDataFrame([], SCHEMA), "k", "y")).collect() == []
    one = spark.createDataFrame([("a", 2000, 1, "x", 2), ("a", 2001, 1, "x", 2)], SCHEMA)
    assert trends.burst_states(one, "k", "y").collect() == []
    assert trends.burst_states(spark.createDataFrame([("a", None, 1, "x", 2)], SCHEMA), "k", "y").collect() == []
