import pytest
from pyspark.sql import functions as F

from certloom.operators import periods, stored_counts, tables
from certloom.sources.suffixes import seed_rules

HOUR, DAY = 3600, 86400


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def plain(spark, path, step):
    """The statistics that a scan of the certificates gives."""
    return sorted(periods.stats_for(tables.read_certificates(spark, path), step, seed_rules(spark), 5).collect())


def check(spark, path):
    for step in (HOUR, DAY):
        assert sorted(stored_counts.period_stats(spark, path, step, 5).collect()) == plain(spark, path, step)


def batch(certs, key, times):
    own = [{"fingerprint": f"{key}{i}", "seen_at": t, "domains": [f"w{i}.{key}.com", f"*.{key}.org"], "issuer_org": None if i % 3 else key} for i, t in enumerate(times)]
    return certs.frame(*own, {"fingerprint": key, "seen_at": times[0], "domains": None, "issuer_org": key})


def test_inserts_late_rows_and_deletions(spark, certs, path):
    first = batch(certs, "a", [50 * DAY + 7, 50 * DAY + HOUR, 51 * DAY])
    tables.append_new(spark, path, first)
    stored_counts.build(spark, path, seed_rules(spark))
    check(spark, path)
    assert tables.append_new(spark, path, first) == 0
    tables.append_new(spark, path, batch(certs, "b", [51 * DAY + 9, 52 * DAY]))
    tables.append_new(spark, path, batch(certs, "late", [50 * DAY + 8, 50 * DAY + 2 * HOUR + 1]))
    check(spark, path)
    # The limit lies within an hour.
    assert tables.enforce_retention(spark, path, 2, 52 * DAY + 8) == 2
    check(spark, path)
    assert tables.enforce_retention(spark, path, 1, 52 * DAY + 8) == 5
    check(spark, path)
    # What retention took may come again, below its limit too.
    assert tables.append_new(spark, path, first) == 4
    check(spark, path)
    chosen = stored_counts.period_stats(spark, path, HOUR, 5, 51 * DAY, 52 * DAY)
    assert sorted(chosen.collect()) == [r for r in plain(spark, path, HOUR) if 51 * DAY <= r["period_start"] < 52 * DAY]


def test_compaction_takes_counts_away(spark, certs, path):
    rows = batch(certs, "a", [50 * DAY, 50 * DAY + HOUR])
    tables.rewrite_daily(rows.unionByName(rows), path)
    stored_counts.build(spark, path, seed_rules(spark))
    day = rows.select("seen_date").first()[0]
    for _ in range(2):
        tables.compact_days(spark, path, day, day.replace(day=day.day + 1))
        check(spark, path)
    assert tables.read_certificates(spark, path).count() == 3


def test_changes_stay_few(spark, certs, path, monkeypatch):
    monkeypatch.setattr(stored_counts, "WIDTH", 2)
    tables.append_new(spark, path, batch(certs, "a", [50 * DAY]))
    stored_counts.build(spark, path, seed_rules(spark))
    for k in range(7):
        tables.append_new(spark, path, batch(certs, f"k{k}", [50 * DAY + k * HOUR]))
        changes = stored_counts.list_changes(spark, path)
        assert len(changes) <= 3
        assert [c.first for c in changes] == [1] + [c.last + 1 for c in changes[:-1]]
    names = tables.folder_names(spark, f"{path}/{stored_counts.FOLDER}")
    assert len([n for n in names if n.startswith("change-")]) == len(changes)
    check(spark, path)


def test_parts_left_by_a_broken_join_do_not_count_twice(spark, certs, path, monkeypatch):
    monkeypatch.setattr(stored_counts, "WIDTH", 2)
    tables.append_new(spark, path, batch(certs, "a", [50 * DAY]))
    stored_counts.build(spark, path, seed_rules(spark))
    with monkeypatch.context() as patch:
        patch.setattr(stored_counts, "delete_path", lambda spark, p: None)
        tables.append_new(spark, path, batch(certs, "b", [50 * DAY]))
    names = tables.folder_names(spark, f"{path}/{stored_counts.FOLDER}")
    assert len([n for n in names if n.startswith("change-")]) == 3
    check(spark, path)
    tables.append_new(spark, path, batch(certs, "c", [50 * DAY]))
    check(spark, path)


@pytest.mark.parametrize("step", ["_write_days", "join_tiers"])
def test_counts_of_a_broken_insert_are_settled(spark, certs, path, monkeypatch, step):
    tables.append_new(spark, path, batch(certs, "a", [50 * DAY]))
    stored_counts.build(spark, path, seed_rules(spark))
    broken = batch(certs, "b", [50 * DAY + 1, 51 * DAY])
    with monkeypatch.context() as patch:
        patch.setattr(tables, step, lambda *args: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tables.append_new(spark, path, broken)
    tables.append_new(spark, path, batch(certs, "c", [50 * DAY + 2]))
    check(spark, path)
    tables.append_new(spark, path, broken)
    check(spark, path)


def test_sums_read_no_certificate(spark, certs, path):
    tables.append_new(spark, path, batch(certs, "a", [50 * DAY, 53 * DAY]))
    stored_counts.build(spark, path, seed_rules(spark))
    files = stored_counts.period_stats(spark, path, DAY, 5, 53 * DAY, 54 * DAY).inputFiles()
    assert files and all(f"/{stored_counts.FOLDER}/" in f for f in files)


def test_an_empty_table(spark, certs, path):
    rows = certs.frame({"seen_at": 5}).filter(F.lit(False))
    rows.write.parquet(path)
    stored_counts.build(spark, path, seed_rules(spark))
    assert stored_counts.period_stats(spark, path, DAY, 5).count() == 0
