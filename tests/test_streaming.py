import json

import pytest
from pyspark.sql import functions as F

from certloom.operators import periods, search, tables
from certloom.operators.searches import parse_searches
from certloom.plans import derived
from certloom.streaming import ingest
from tests.test_messages import message


def write_file(folder, name, *messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(m) + "\n" for m in messages) + "{broken\n")


def with_print(fingerprint, **leaf):
    return message(fingerprint=fingerprint, **leaf)


def run(spark, tmp_path, **options):
    ingest.ingest_stream(
        ingest.read_message_files(spark, str(tmp_path / "in"), 1),
        str(tmp_path / "table"),
        str(tmp_path / "counters"),
        str(tmp_path / options.pop("checkpoint", "checkpoint")),
        now=5,
        once=True,
        **options,
    ).awaitTermination()
    return {r["fingerprint"] for r in tables.read_certificates(spark, str(tmp_path / "table")).collect()}


def test_ingest_continues_and_replays(spark, tmp_path):
    source = tmp_path / "in"
    write_file(source, "1.txt", with_print("AA:01"), with_print("AA:01"), {"message_type": "heartbeat"})
    write_file(source, "2.txt", with_print("AA:02"), with_print("AA:01"), with_print("BB", all_domains=["other.org"]))
    kept = {"globs": ["*example.com"]}
    assert run(spark, tmp_path, **kept) == {"aa01", "aa02"}
    totals = ingest.read_counters(spark, str(tmp_path / "counters")).first()
    assert totals.asDict() == {"received": 5, "filtered": 1, "inserted": 2, "duplicate": 2, "batches": 2}
    # New data only, from the checkpoint.
    write_file(source, "3.txt", with_print("AA:03"))
    assert run(spark, tmp_path, **kept) == {"aa01", "aa02", "aa03"}
    assert ingest.read_counters(spark, str(tmp_path / "counters")).first()["received"] == 6
    # Everything again, as after a lost checkpoint.
    assert run(spark, tmp_path, checkpoint="other", **kept) == {"aa01", "aa02", "aa03"}
    assert tables.read_certificates(spark, str(tmp_path / "table")).count() == 3
    # The counters of the first run stay beside those of the second.
    totals = ingest.read_counters(spark, str(tmp_path / "counters")).first()
    assert totals.asDict() == {"received": 12, "filtered": 2, "inserted": 3, "duplicate": 7, "batches": 6}


def test_a_batch_that_failed_behind_its_insert_counts_its_rows(spark, tmp_path, monkeypatch):
    write_file(tmp_path / "in", "1.txt", with_print("AA:01"), with_print("AA:02"), with_print("AA:01"))
    real = tables.append_new

    def failing(*args, **options):
        real(*args, **options)
        raise OSError("lost before the counters")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "append_new", failing)
        with pytest.raises(Exception):
            run(spark, tmp_path)
    assert run(spark, tmp_path) == {"aa01", "aa02"}
    totals = ingest.read_counters(spark, str(tmp_path / "counters")).first()
    assert totals.asDict() == {"received": 3, "filtered": 0, "inserted": 2, "duplicate": 1, "batches": 1}


@pytest.fixture
def cert_files(spark, certs, tmp_path):
    rows = certs.frame(
        *[{"seen_at": 1000 * i, "domains": [f"n{i}.com", "*.x.com"][: 1 + i % 2], "issuer_org": f"I{i % 3}"} for i in range(40)]
    )
    path = str(tmp_path / "certs")
    rows.orderBy("seen_at").coalesce(1).write.option("maxRecordsPerFile", 10).parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows, stream


def test_feed_holds_the_newest_over_all_batches(spark, cert_files, tmp_path):
    rows, stream = cert_files
    ingest.live_feed(stream, str(tmp_path / "feed"), str(tmp_path / "cp"), once=True).awaitTermination()
    feed = ingest.read_feed(spark, str(tmp_path / "feed"))
    assert sorted(feed.collect()) == sorted(search.recent(rows, 25).collect())


def test_feed_goes_on_with_a_new_checkpoint(spark, certs, tmp_path):
    feed = str(tmp_path / "feed")
    old, new = certs.frame(*[{"seen_at": i} for i in range(40)]), certs.frame(*[{"seen_at": 35 + i} for i in range(10)])
    for name, rows in (("1", old), ("2", new), ("3", new)):
        path = str(tmp_path / name)
        rows.coalesce(1).write.option("maxRecordsPerFile", 10).parquet(path)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        ingest.live_feed(stream, feed, str(tmp_path / f"cp{name}"), once=True).awaitTermination()
    shown = ingest.read_feed(spark, feed)
    assert sorted(shown.collect()) == sorted(search.recent(old.unionByName(new), 25).collect())
    assert len(tables.folder_names(spark, feed)) == 2


def test_rates_equal_the_batch(spark, certs, tmp_path):
    rows = certs.frame(*[{"seen_at": s} for s in [0, 1, 5, 5, 9, 58, 60, 61, 119, 300, 301, 500, 900]])
    rows.coalesce(1).write.parquet(str(tmp_path / "certs"))
    rates = ingest.rolling_insert_rate(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "certs")), "10 seconds")
    ingest.to_table(rates, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r["window_end"]: r["total"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    seen = [r["seen_at"] for r in rows.collect()]
    ends = {s - s % 5 + 60 - 5 * k for s in seen for k in range(12)}
    assert got == {e: sum(e - 60 <= s < e for s in seen) for e in ends if e <= 890}


def test_closed_hours_equal_the_batch(spark, cert_files, tmp_path):
    rows, stream = cert_files
    hours = ingest.tumbling_stats(stream, "1 hour", "0 seconds")
    ingest.to_table(hours, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(
        "period_start", "total_certificates", "total_domain_count", F.col("approx_issuers").alias("unique_issuers"), "wildcard_count"
    )
    closed = periods.period_basics(rows, 3600).filter("period_start + 3600 <= 39000")
    assert sorted(got.collect()) == sorted(closed.collect())


def test_dedupe_within_the_watermark(spark, certs, tmp_path):
    rows = certs.frame(*[{"fingerprint": f"f{i % 5}", "seen_at": i} for i in range(30)])
    path = str(tmp_path / "certs")
    rows.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ingest.to_table(
        ingest.dedupe_stream(stream, "1 hour").select("fingerprint"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True
    ).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"f{i}" for i in range(5)]


def test_alerts_equal_the_batch(spark, cert_files, tmp_path):
    rows, stream = cert_files
    searches = spark.createDataFrame([(1, "n7"), (2, "issuer:I1 -x.com"), (3, '"n3.com" OR domain:n4.com')], "search_id int, text string")
    parsed = parse_searches(searches)
    ingest.search_alerts(stream, parsed, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    ingest.search_alerts(stream, parsed, str(tmp_path / "out"), str(tmp_path / "cp2"), once=True).awaitTermination()
    got = ingest.read_alerts(spark, str(tmp_path / "out"))
    from certloom.operators.searches import match_searches

    assert sorted(got.collect()) == sorted(match_searches(rows, parsed).collect())


def test_searches_change_between_batches(spark, cert_files, tmp_path, monkeypatch):
    """A search that is added counts from the next batch on, one that is removed until it goes; others stay anchored."""
    rows, stream = cert_files
    path, anchored = str(tmp_path / "searches"), []
    ingest.save_searches(spark, path, spark.createDataFrame([(1, "issuer:I1"), (2, "x.com")], "search_id int, text string"))
    real_match, real_parse, calls = ingest.match_index, ingest.parse_searches, []

    def match(batch, index):
        found = real_match(batch, index)
        calls.append(batch.count())
        if len(calls) == 2:
            # Search 2 goes, 3 comes, 1 stays as it is.
            ingest.save_searches(spark, path, spark.createDataFrame([(1, "issuer:I1"), (3, "com")], "search_id int, text string"))
        return found

    monkeypatch.setattr(ingest, "match_index", match)
    monkeypatch.setattr(ingest, "parse_searches", lambda df: (anchored.append(sorted(r["search_id"] for r in df.collect())), real_parse(df))[1])
    ingest.search_alerts(stream, ingest.StoredSearches(path), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {(r["search_id"], r["fingerprint"]) for r in ingest.read_alerts(spark, str(tmp_path / "out")).collect()}
    early, late = rows.orderBy("seen_at").limit(20).collect(), rows.orderBy(F.col("seen_at").desc()).limit(20).collect()
    want = {(1, r["fingerprint"]) for r in early + late if r["issuer_org"] == "I1"}
    want |= {(2, r["fingerprint"]) for r in early if "*.x.com" in r["domains"]} | {(3, r["fingerprint"]) for r in late}
    assert got == want and anchored == [[1, 2], [3]] and len(calls) == 4


def test_ingest_by_a_table_of_patterns(spark, tmp_path):
    source = tmp_path / "in"
    write_file(source, "1.txt", with_print("AA:01"), with_print("AA:02", all_domains=["other.org"]), with_print("AA:01"))
    write_file(source, "2.txt", with_print("AA:03", all_domains=["deep.other.net"]))
    patterns = spark.createDataFrame([("domain", "*EXAMPLE.com"), ("domain", "*.net"), ("domain", None)], "kind string, pattern string")
    assert run(spark, tmp_path, patterns=patterns) == {"aa01", "aa03"}
    totals = ingest.read_counters(spark, str(tmp_path / "counters")).first()
    assert totals.asDict() == {"received": 4, "filtered": 1, "inserted": 2, "duplicate": 1, "batches": 2}
    with pytest.raises(ValueError):
        run(spark, tmp_path, checkpoint="other", patterns=patterns, globs=["*"])


def test_unique_domains_of_closed_hours(spark, cert_files, tmp_path):
    from certloom.sources.suffixes import seed_rules

    rows, stream = cert_files
    rules = seed_rules(spark)
    hours = ingest.tumbling_stats(stream, "1 hour", "0 seconds", rules)
    ingest.to_table(hours, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r["period_start"]: tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    basics = {r["period_start"]: r for r in periods.period_basics(rows, 3600).collect()}
    domains = {r["period_start"]: r["unique_domains"] for r in periods.unique_domains(rows, 3600, rules).collect()}
    assert got == {p: (b["total_certificates"], b["total_domain_count"], b["wildcard_count"], b["unique_issuers"], domains[p]) for p, b in basics.items() if p + 3600 <= 39000}


def test_messages_are_dealt_into_bounded_files(spark, tmp_path):
    """Shares of equal files, so that no task writes or reads a whole share."""
    n = 1000
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 5}').alias("props"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    out = tmp_path / "messages"
    files = derived.message_files(spark, str(tmp_path), str(out), 3, per_file=50)
    sizes = [len(f.read_text().splitlines()) for f in out.glob("part-*.txt")]
    assert files == 7 and len(sizes) == 3 * files
    assert sum(sizes) == n and max(sizes) <= 50
