import pytest
from pyspark.sql import functions as F

from certloom import schemas
from certloom.operators import periods, rates, summaries
from certloom.sources.suffixes import seed_rules

HOUR, DAY = 3600, 86400


@pytest.fixture
def rows(certs):
    return certs.frame(
        {"seen_at": 10, "domains": ["a.x.com", "*.x.com", "com", "1.2.3.4"], "issuer_org": "A"},
        {"seen_at": 20, "domains": ["y.org"], "issuer_org": "B"},
        {"seen_at": 30, "domains": ["b.y.org"], "issuer_org": None},
        {"seen_at": HOUR, "domains": ["*.z.net", "*.x.com"], "issuer_org": "B"},
        {"seen_at": DAY + 5, "domains": ["q.net"], "issuer_org": None},
    )


def test_hourly_stats(spark, rows):
    got = {r["period_start"]: r for r in periods.hourly_stats(rows, seed_rules(spark), 99).collect()}
    assert sorted(got) == [0, HOUR, DAY]
    first = got[0]
    assert (first["period_end"], first["total_certificates"], first["computed_at"]) == (HOUR, 3, 99)
    assert (first["unique_domains"], first["unique_issuers"], first["wildcard_count"]) == (2, 2, 1)
    assert first["avg_san_count"] == 2.0
    assert [tuple(e) for e in first["top_domains"]] == [("x.com", 2), ("y.org", 2)]
    assert [tuple(e) for e in first["top_issuers"]] == [("A", 1), ("B", 1)]
    assert got[DAY]["top_issuers"] == [] and got[DAY]["unique_issuers"] == 0


def test_daily_stats(spark, rows):
    got = {r["period_start"]: r for r in periods.daily_stats(rows, seed_rules(spark), 99).collect()}
    assert (got[0]["total_certificates"], got[0]["peak_hourly_rate"], got[0]["wildcard_count"]) == (4, 3, 2)
    assert [tuple(e) for e in got[0]["top_domains"]] == [("x.com", 3), ("y.org", 2), ("z.net", 1)]
    assert got[DAY]["peak_hourly_rate"] == 1


def test_stats_columns_match_the_table(spark, rows):
    hourly = periods.hourly_stats(rows, seed_rules(spark), 1)
    daily = periods.daily_stats(rows, seed_rules(spark), 1)
    assert hourly.columns == schemas.HOURLY_STATS.fieldNames()
    assert daily.columns == schemas.DAILY_STATS.fieldNames()
    assert [f.dataType.simpleString() for f in daily.schema] == [f.dataType.simpleString() for f in schemas.DAILY_STATS]


def test_top_list_is_cut_and_ties_are_fixed(spark, certs):
    rows = certs.frame(*[{"seen_at": 1, "domains": [f"n{i}.com"], "issuer_org": f"I{i:03}"} for i in range(150)])
    (row,) = periods.hourly_stats(rows, seed_rules(spark), 1).collect()
    assert (len(row["top_issuers"]), len(row["top_domains"])) == (100, 100)
    assert (row["unique_issuers"], row["unique_domains"]) == (150, 150)
    assert row["top_issuers"][0]["value"] == "I000" and row["top_issuers"][99]["value"] == "I099"


def test_empty_table(spark, certs):
    empty = certs.frame({}).filter(F.lit(False))
    assert periods.daily_stats(empty, seed_rules(spark), 1).count() == 0
    assert tuple(periods.table_stats(empty).first()) == (0, 0, None, None)


def test_backfill_fills_only_holes(spark, rows):
    existing = spark.createDataFrame([(0,)], "period_start bigint")
    rules = seed_rules(spark)
    got = periods.backfill(rows, existing, 100, 2 * DAY + 1, HOUR, rules, 1).collect()
    assert {r["period_start"] for r in got} == {HOUR, DAY}
    forced = periods.backfill(rows, existing, 0, 2 * DAY, HOUR, rules, 1, force=True).collect()
    assert {r["period_start"] for r in forced} == {0, HOUR, DAY}
    missing = periods.missing_periods(existing, 0, 3 * HOUR + 1, HOUR).collect()
    assert {r["period_start"] for r in missing} == {HOUR, 2 * HOUR}
    assert periods.default_range(rows, 2 * DAY + 7) == (0, 2 * DAY)


def test_latest_completed(spark, rows):
    none = spark.createDataFrame([], "period_start bigint")
    rules = seed_rules(spark)
    (row,) = periods.latest_completed(rows, none, 2 * HOUR + 5, HOUR, rules, 1).collect()
    assert row["period_start"] == HOUR
    there = spark.createDataFrame([(HOUR,)], "period_start bigint")
    assert periods.latest_completed(rows, there, 2 * HOUR + 5, HOUR, rules, 1).count() == 0


def test_range_summary(spark, rows):
    daily = periods.daily_stats(rows, seed_rules(spark), 1)
    week = summaries.in_range(daily, daily, "7d", 2 * DAY)
    assert tuple(summaries.range_summary(week).first()) == (5, 2, 4, 2)
    merged = summaries.merge_top_lists(week, "top_domains").orderBy("rank").collect()
    assert [tuple(r) for r in merged] == [(1, "x.com", 3), (2, "y.org", 2), (3, "q.net", 1), (4, "z.net", 1)]
    assert summaries.mean_of_period_averages(week).first()["mean_avg_san_count"] == 1.5
    bars = summaries.volume_series(daily).collect()
    assert [(r["period_start"], r["width"]) for r in bars] == [(0, 100.0), (DAY, 25.0)]


def test_volume_of_tiny_periods_and_of_nothing(spark):
    df = spark.createDataFrame([(0, 1000), (1, 1)], "period_start bigint, total_certificates bigint")
    assert [r["width"] for r in summaries.volume_series(df).collect()] == [100.0, 4.0]
    zero = df.select("period_start", F.lit(0).cast("bigint").alias("total_certificates"))
    assert [r["width"] for r in summaries.volume_series(zero.filter("period_start = 0")).collect()] == [4.0]


def test_sketches_merge(spark, rows):
    day = periods.approx_counts(periods.merge_approx(periods.approx_stats(rows, HOUR, seed_rules(spark)), DAY)).orderBy("period_start")
    assert [tuple(r) for r in day.collect()] == [(0, 2, 3), (DAY, 0, 1)]  # x.com, y.org, z.net; q.net


RATES = [([(0, 100)], 10_000, 10.0), ([(0, 50), (61_000, 20)], 66_000, 0.3), ([(0, 100)], 500, 0.0), ([], 5000, 0.0)]


@pytest.mark.parametrize("batches,now,expected", RATES)
def test_rate_at(spark, batches, now, expected):
    df = spark.createDataFrame(batches, "at_ms bigint, n bigint")
    assert rates.rate_at(df, now, 0).first()["rate"] == expected


def test_rolling_rate_crosses_minutes(spark):
    df = spark.createDataFrame([(59_000, 30), (59_000, 30), (61_000, 6), (118_999, 1), (119_001, 5)], "at_ms bigint, n bigint")
    got = rates.rolling_rate(df, 0).orderBy("at_ms").collect()
    assert [(r["at_ms"], r["total"]) for r in got] == [(59_000, 60), (61_000, 66), (118_999, 67), (119_001, 12)]
    assert got[3]["rate"] == 0.2


def test_ingest_counts(certs):
    batch = certs.frame({"fingerprint": "a"}, {"fingerprint": "a"}, {"fingerprint": "b"}, {"fingerprint": "c", "issuer_org": "no"})
    target = certs.frame({"fingerprint": "b"})
    row = rates.ingest_counts(batch, F.col("issuer_org") != "no", target).first()
    assert tuple(row) == (4, 1, 1, 2, 1)


def test_stored_statistics_are_filled_once(spark, rows, tmp_path):
    from certloom.operators import jobs, tables

    path, rules = str(tmp_path / "hourly"), seed_rules(spark)

    def stored():
        return {r["period_start"]: r["computed_at"] for r in tables.read_periods(spark, path).collect()}

    jobs.update_latest(spark, rows, path, HOUR, rules, 2 * HOUR + 5)
    assert stored() == {HOUR: 2 * HOUR + 5}
    jobs.update_stats(spark, rows, path, HOUR, rules, 2 * DAY + 5)
    assert stored() == {0: 2 * DAY + 5, HOUR: 2 * HOUR + 5, DAY: 2 * DAY + 5}
    jobs.update_stats(spark, rows, path, HOUR, rules, 3 * DAY, start=0, end=HOUR, force=True)
    assert stored() == {0: 3 * DAY, HOUR: 2 * HOUR + 5, DAY: 2 * DAY + 5}


def test_null_names_lose_no_certificate(spark, rows):
    nulled = rows.withColumn("domains", F.when(F.col("seen_at") % 20 != 10, F.col("domains")))
    whole = periods.period_basics(nulled, DAY).agg(F.sum("total_certificates")).first()[0]
    daily = periods.daily_stats(nulled, seed_rules(spark), 99).collect()
    assert sum(r["total_certificates"] for r in daily) == whole == 5
