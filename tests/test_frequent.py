"""Frequency sketches: true counts lie within the bounds, however the sketches were merged."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from certloom.operators import frequent

HOUR, DAY = 3600, 86400
SCHEMA = "period_start long, facet int, value string, n long"


@pytest.fixture(scope="module")
def counts(spark):
    rnd = random.Random(3)
    rows = []
    for hour in range(60):
        for facet in (0, 3):
            some = {f"v{min(int(rnd.paretovariate(0.6)), 400)}" for _ in range(rnd.choice([0, 1, 5, 60]))}
            rows += [(hour * HOUR, facet, v, rnd.choice([1, 1, 2, 7, 50])) for v in sorted(some)]
    return spark.createDataFrame(rows + [(0, 0, None, 9), (0, 0, "gone", 0)], SCHEMA)


def true_counts(counts, step=None):
    totals = {}
    for r in counts.collect():
        if r["value"] is not None and r["n"]:
            start = r["period_start"] // step * step if step else 0
            totals.setdefault((start, r["facet"]), Counter())[r["value"]] += r["n"]
    return totals


def check(sketches, true, width):
    rows = sketches.collect()
    assert {(r["period_start"], r["facet"]) for r in rows} == set(true) and len(rows) == len(true)
    for r in rows:
        exact = true[r["period_start"], r["facet"]]
        listed = {e["value"]: e for e in r["entries"]}
        assert r["total"] == sum(exact.values()) and len(listed) == len(r["entries"]) == min(width, len(listed))
        for value, n in exact.items():
            if value in listed:
                assert listed[value]["low"] <= n <= listed[value]["high"]
            else:
                assert n <= r["slack"]


@pytest.mark.parametrize("width", [1, 4, 30])
def test_bounds_hold_over_two_merges(counts, width):
    hourly = frequent.sketch(counts, width)
    check(hourly, true_counts(counts, HOUR), width)
    daily = frequent.merge(hourly, DAY, width)
    check(daily, true_counts(counts, DAY), width)
    check(frequent.merge(daily, width=width), true_counts(counts), width)


def test_wide_sketches_are_exact(counts):
    whole = frequent.merge(frequent.sketch(counts, 1000))
    true = true_counts(counts)
    for facet in (0, 3):
        got = [(r["value"], r["low"], r["high"]) for r in frequent.top(whole, 10).filter(F.col("facet") == facet).orderBy("rank").collect()]
        want = sorted(true[0, facet].items(), key=lambda x: (-x[1], x[0]))[:10]
        assert got == [(v, n, n) for v, n in want]


def test_sure_values_are_among_the_first(counts):
    merged = frequent.merge(frequent.sketch(counts, 12), width=12)
    true, sure = true_counts(counts), 0
    for r in frequent.top(merged, 5).filter("sure").collect():
        exact = true[0, r["facet"]]
        assert sum(n > exact[r["value"]] for n in exact.values()) < 5
        sure += 1
    assert sure


def test_a_value_below_every_list_is_not_lost(spark):
    """Second in every hour, first of the day: lists of one entry cannot show it, but the slack says so."""
    rows = [(h * HOUR, 0, v, n) for h in range(24) for v, n in ((f"h{h}", 10), ("steady", 9))]
    merged = frequent.merge(frequent.sketch(spark.createDataFrame(rows, SCHEMA), 1), width=1)
    r = merged.first()
    assert r["slack"] >= 9 * 24 and not frequent.top(merged, 1).first()["sure"]
    wider = frequent.top(frequent.merge(frequent.sketch(spark.createDataFrame(rows, SCHEMA), 2)), 1).first()
    assert (wider["value"], wider["low"], wider["high"], wider["sure"]) == ("steady", 216, 216, True)


def test_empty_and_ranges(spark, counts):
    none = spark.createDataFrame([], SCHEMA)
    assert frequent.merge(frequent.sketch(none)).count() == 0 and frequent.top(frequent.sketch(none)).count() == 0
    chosen = frequent.in_range(frequent.sketch(counts), 5 * HOUR, 7 * HOUR).select("period_start").distinct().collect()
    assert {r[0] for r in chosen} <= {5 * HOUR, 6 * HOUR}
