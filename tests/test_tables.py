from datetime import date

import pytest
from pyspark.sql import functions as F

from certloom import schemas, session
from certloom.operators import key_runs, tables
from certloom.operators.periods import seen_between

DAY = 86400


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def fingerprints(df):
    return sorted(r["fingerprint"] for r in df.select("fingerprint").collect())


def test_first_of_equal_rows_is_inserted(spark, certs, path):
    batch = certs.frame({"fingerprint": "a", "serial_number": "1"}, {"fingerprint": "a", "serial_number": "2"}, {"fingerprint": "b"})
    assert tables.append_new(spark, path, batch) == 2
    assert tables.append_new(spark, path, batch) == 0
    assert tables.append_new(spark, path, certs.frame({"fingerprint": "b"}, {"fingerprint": "c"})) == 1
    stored = tables.read_certificates(spark, path)
    assert fingerprints(stored) == ["a", "b", "c"]
    assert stored.filter("fingerprint = 'a'").first()["serial_number"] == "1"
    assert stored.schema.fieldNames() == schemas.CERTIFICATE_COLUMNS


@pytest.mark.parametrize("small", [True, False])
def test_a_batch_beyond_the_broadcast_bound(certs, monkeypatch, small):
    monkeypatch.setattr(tables, "small_enough", lambda *args: small)
    target, batch = certs.frame({"fingerprint": "a"}), certs.frame({"fingerprint": "a"}, {"fingerprint": "b"})
    assert fingerprints(tables.insert_new(target, batch)) == ["b"]


def test_the_first_arrival_stays(certs):
    batch = certs.frame(
        {"fingerprint": "a", "seen_at": 9, "cert_index": 1, "log_url": "m"},
        {"fingerprint": "a", "seen_at": 5, "cert_index": None, "log_url": "z"},
        {"fingerprint": "a", "seen_at": 5, "cert_index": 8, "log_url": "m"},
        {"fingerprint": "a", "seen_at": 5, "cert_index": 4, "log_url": "z"},
    )
    (row,) = tables.insert_new(certs.frame({}), batch).collect()
    assert (row["seen_at"], row["log_url"], row["cert_index"]) == (5, "m", 8)


@pytest.mark.parametrize("step", ["write_run", "_write_days", "delete_path"])
@pytest.mark.parametrize("tag", [None, "run-0"])
def test_a_broken_insert_is_repeated_without_loss(spark, certs, path, monkeypatch, step, tag):
    tables.append_new(spark, path, certs.frame({"fingerprint": "old"}))
    batch = certs.frame({"fingerprint": "old"}, {"fingerprint": "a"}, {"fingerprint": "b"})
    real = getattr(tables, step)

    def broken(*args, **options):
        if step == "delete_path" and "_open" not in args[1]:
            return real(*args, **options)
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(tables, step, broken)
        with pytest.raises(OSError):
            tables.append_new(spark, path, batch, tag=tag)
    # Named batches count what they had inserted; others find it there.
    landed = step == "delete_path" and tag is None
    assert tables.append_new(spark, path, batch, tag=tag) == (0 if landed else 2)
    assert fingerprints(tables.read_certificates(spark, path)) == ["a", "b", "old"]
    assert tables.append_new(spark, path, batch) == 0
    assert fingerprints(tables.read_certificates(spark, path)) == ["a", "b", "old"]


def test_a_named_batch_repeated_after_its_end_counts_again(spark, certs, path):
    batch = certs.frame({"fingerprint": "a"}, {"fingerprint": "b"})
    assert [tables.append_new(spark, path, batch, tag="run-3") for _ in range(3)] == [2, 2, 2]
    assert fingerprints(tables.read_certificates(spark, path)) == ["a", "b"]


def test_runs_stay_few_and_only_hits_are_opened(spark, certs, path, monkeypatch):
    """The files that an insert opens follow the logarithm of the inserts, not their number."""
    monkeypatch.setattr(key_runs, "WIDTH", 3)
    opened, real = [], key_runs.read_keys
    monkeypatch.setattr(tables, "read_keys", lambda spark, root, places: (opened.append(len(places)), real(spark, root, places))[1])
    batches = [certs.frame(*[{"fingerprint": f"f{k}-{i}"} for i in range(3)]) for k in range(24)]
    most = 0
    for batch in batches:
        assert tables.append_new(spark, path, batch) == 3
        most = max(most, len(key_runs.list_runs(spark, f"{path}/_keys")))
    # A key that no filter lets pass opens nothing; 24 batches leave two runs of each tier at most.
    assert most <= 6 and sum(opened) <= 2
    opened.clear()
    assert tables.append_new(spark, path, batches[0].unionByName(batches[23])) == 0 and 1 <= sum(opened) <= 3
    assert tables.read_certificates(spark, path).count() == 72


def test_filters_pass_what_a_run_holds(spark, certs, path, monkeypatch):
    monkeypatch.setattr(key_runs, "PART_KEYS", 64)
    keys = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("fingerprint"), F.lit("t").alias("batch"), F.col("id").alias("seen_at"))
    run = key_runs.write_run(spark, path, keys, 500)
    assert (run.parts, key_runs.list_runs(spark, path)) == (8, [run])
    assert len(key_runs.may_hold(spark, path, [run], keys.select("fingerprint"))) == 8
    (place,) = key_runs.may_hold(spark, path, [run], keys.filter("seen_at = 77").select("fingerprint"))
    part = key_runs.read_keys(spark, path, [place])
    assert part.filter("seen_at = 77").count() == 1 and part.count() < 200
    assert key_runs.read_keys(spark, path, key_runs.all_parts([run])).count() == 500
    absent = [spark.createDataFrame([(f"no{k}",)], "fingerprint string") for k in range(20)]
    assert sum(len(key_runs.may_hold(spark, path, [run], a)) for a in absent) <= 2
    key_runs.raise_floor(spark, path, 400)
    assert key_runs.read_keys(spark, path, key_runs.all_parts(key_runs.list_runs(spark, path))).count() == 100


def test_a_mark_is_settled_once(spark, certs, path, monkeypatch):
    """The next insert drops the keys that a broken one left without certificates, also those of another batch."""
    tables.append_new(spark, path, certs.frame({"fingerprint": "old"}))
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_write_days", lambda *args: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tables.append_new(spark, path, certs.frame({"fingerprint": "a"}, {"fingerprint": "b"}), tag="x")
    assert tables.folder_names(spark, f"{path}/_open")
    assert tables.append_new(spark, path, certs.frame({"fingerprint": "a"}), tag="y") == 1
    assert tables.folder_names(spark, f"{path}/_open") == []
    assert fingerprints(tables.read_certificates(spark, path)) == ["a", "old"]


def test_keys_follow_the_table(spark, certs, path):
    """A table without keys gets them at its first insert; rows removed by retention may come again."""
    now = 200 * DAY
    rows = certs.frame({"fingerprint": "old", "seen_at": 100 * DAY}, {"fingerprint": "new", "seen_at": now - DAY})
    tables.rewrite_daily(rows, path)
    assert tables.append_new(spark, path, rows) == 0
    assert tables.enforce_retention(spark, path, 90, now) == 1
    assert tables.append_new(spark, path, rows) == 1
    assert tables.append_new(spark, path, rows) == 0


def test_jobs_leave_nothing_behind(spark, certs, tmp_path, monkeypatch):
    path, shared = str(tmp_path / "table"), tmp_path / "shared"
    monkeypatch.setattr(session, "scratch_dir", lambda spark, label: str(shared / label))
    tables.append_new(spark, path, certs.frame({}, {"seen_at": DAY}))
    tables.compact_days(spark, path, date(1970, 1, 1), date(2030, 1, 1))
    tables.enforce_retention(spark, path, 5, 10 * DAY)
    tables.save_periods(spark, str(tmp_path / "hours"), spark.createDataFrame([stats_row(0, 1)], schemas.HOURLY_STATS))
    assert list(shared.iterdir()) == []
    assert {n for n in tables.folder_names(spark, path) if n.startswith("_")} <= {"_keys", "_open", "_SUCCESS"}


def test_compaction_keeps_a_heavy_day_in_order(spark, certs, path):
    tables.rewrite_daily(certs.frame(*[{"seen_at": i % 500} for i in range(2000)]), path, partitions=4)
    with_small_files = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in with_small_files.items():
        spark.conf.set(key, value)
    try:
        tables.compact_days(spark, path, date(1970, 1, 1), date(1970, 1, 2))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = tables.read_certificates(spark, path).groupBy(F.input_file_name()).agg(F.min("seen_at"), F.max("seen_at"))
    bounds = sorted(tuple(r)[1:] for r in files.collect())
    assert len(bounds) > 1
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_metadata_is_written_and_read(spark, path):
    for rows in ([("k", "old", 1), ("j", "x", 1)], [("k", "new", 3)]):
        tables.save_metadata(spark, path, spark.createDataFrame(rows, schemas.METADATA))
    assert {r["key"]: r["value"] for r in tables.read_metadata(spark, path).collect()} == {"k": "new", "j": "x"}


def test_copy_is_idempotent(spark, certs, path):
    source = certs.frame(*[{"seen_at": DAY * i} for i in range(7)])
    ranges = [(0, 3 * DAY), (3 * DAY, 6 * DAY), (6 * DAY, 9 * DAY)]
    assert tables.copy_table(spark, source, path, 7, ranges) == 7
    assert tables.copy_table(spark, source, path, 7) == 0
    assert {r["created_at"] for r in tables.read_certificates(spark, path).collect()} == {7}


def test_copy_resumes(spark, certs, path):
    source = certs.frame(*[{"seen_at": DAY * i} for i in range(5)])
    tables.copy_table(spark, source.filter(seen_between(before=2 * DAY)), path, 7)
    assert tables.copy_table(spark, source, path, 7) == 3


def test_retention(spark, certs, path):
    now = 200 * DAY
    rows = [{"seen_at": now - d * DAY + s} for d, s in ((100, 0), (91, 5), (90, -1), (90, 0), (90, 5), (1, 0))]
    tables.rewrite_daily(certs.frame(*rows), path)
    assert tables.enforce_retention(spark, path, 90, now) == 3
    left = tables.read_certificates(spark, path)
    assert sorted(r["seen_at"] for r in left.collect()) == [now - 90 * DAY, now - 90 * DAY + 5, now - DAY]
    assert tables.enforce_retention(spark, path, 90, now) == 0
    assert len(tables.day_partitions(spark, path)) == 2


def test_retention_cuts_through_a_day_and_may_empty_it(spark, certs, path):
    now = 200 * DAY + 5000
    tables.rewrite_daily(certs.frame({"seen_at": 110 * DAY + 4999}, {"seen_at": 150 * DAY}), path)
    assert tables.enforce_retention(spark, path, 90, now) == 1
    assert tables.day_partitions(spark, path) == [date(1970, 5, 31)]


def test_compact_keeps_the_last_insert(spark, certs, path):
    rows = certs.frame(
        {"fingerprint": "a", "seen_at": 5, "created_at": 1},
        {"fingerprint": "a", "seen_at": 5, "created_at": 9},
        {"fingerprint": "a", "seen_at": DAY + 5, "created_at": 2},
    )
    assert sorted(r["created_at"] for r in tables.compact(rows).collect()) == [2, 9]
    assert [r["created_at"] for r in tables.compact(rows, keys=("fingerprint",)).collect()] == [9]
    tables.rewrite_daily(rows, path)
    tables.compact_days(spark, path, date(1970, 1, 1), date(1970, 1, 2))
    assert sorted(r["created_at"] for r in tables.read_certificates(spark, path).collect()) == [2, 9]


def test_rewrite_splits_a_heavy_day_in_order(spark, certs, path):
    tables.rewrite_daily(certs.frame(*[{"seen_at": i % 500} for i in range(2000)]), path, partitions=4)
    files = tables.read_certificates(spark, path).groupBy(F.input_file_name()).agg(F.min("seen_at"), F.max("seen_at"))
    bounds = sorted(tuple(r)[1:] for r in files.collect())
    assert len(bounds) > 1
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_last_write_wins(spark):
    rows = [("k", "old", 1), ("k", "new", 3), ("k", "mid", 2), ("j", "x", 1)]
    df = spark.createDataFrame(rows, schemas.METADATA)
    assert {r["key"]: r["value"] for r in tables.latest_by_key(df, ["key"], "updated_at").collect()} == {"k": "new", "j": "x"}


def stats_row(start, total):
    return (start, start + 3600, total, 1, 1, 0, 1.5, [("a.com", total)], [], 1)


def test_periods_are_replaced(spark, path):
    def frame(*rows):
        return spark.createDataFrame(list(rows), schemas.HOURLY_STATS)

    tables.save_periods(spark, path, frame(stats_row(0, 1), stats_row(3600, 2), stats_row(DAY, 3)))
    tables.save_periods(spark, path, frame(stats_row(3600, 20), stats_row(7200, 4)))
    got = {r["period_start"]: r["total_certificates"] for r in tables.read_periods(spark, path).collect()}
    assert got == {0: 1, 3600: 20, 7200: 4, DAY: 3}
    rows = tables.read_stats(tables.read_periods(spark, path), 3600, DAY).collect()
    assert [r["period_start"] for r in rows] == [3600, 7200]
    assert rows[0]["top_domains"][0]["value"] == "a.com"


def test_union_keeps_rows_of_the_first(certs):
    a = certs.frame({"fingerprint": "x", "serial_number": "a"})
    b = certs.frame({"fingerprint": "x", "serial_number": "b"}, {"fingerprint": "y"})
    got = {r["fingerprint"]: r["serial_number"] for r in tables.dedupe_union(a, b).collect()}
    assert got["x"] == "a" and set(got) == {"x", "y"}


def test_empty_inputs_insert_nothing(spark, certs, path):
    empty = spark.createDataFrame([], schemas.CERTIFICATE)
    assert tables.append_new(spark, path, empty) == 0
    assert tables.copy_table(spark, empty, path, 7) == 0
    assert tables.append_new(spark, path, certs.frame({})) == 1
    assert tables.append_new(spark, path, certs.frame({}).filter("false")) == 0


def test_filter_blocks_are_grouped_by_one_number(spark):
    keys = spark.range(5000).selectExpr("md5(cast(id AS string)) AS fingerprint").union(spark.sql("SELECT CAST(NULL AS string)"))
    parts, blocks = 4, 3
    made = key_runs.filter_bits(keys, parts, blocks)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Sort [number#" in plan and "ASC NULLS FIRST, " not in plan
    part, block = key_runs._part(parts), key_runs._block(blocks)
    each = keys.select(part.alias("part"), block.alias("block"), F.explode(key_runs._positions()).alias("p")).distinct()
    want = {}
    for r in each.collect():
        want.setdefault((r["part"], r["block"]), set()).add(r["p"])
    got = {(r["part"], r["block"]): {8 * i + k for i, x in enumerate(r["bits"]) for k in range(8) if x >> k & 1} for r in made.collect()}
    assert got == want and len(got) == 12
