import glob
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from certloom.functions.predicates import SearchSpec, Term
from certloom.operators import postings, search, tables
from certloom.operators.key_sets import key_set

DAY = 86400


@pytest.fixture(scope="module")
def rows(spark):
    from tests.conftest import Certs

    made = []
    for i in range(60):
        names = [f"node{i % 7}.lake{i % 5}.example", f"*.ridge{i % 4}.test"][: 1 + i % 2] if i % 9 else None
        made.append({"seen_at": (100 + i % 6) * DAY + 1439 * i, "domains": names, "domain_count": 1, "issuer_org": f"Birch {i % 3}" if i % 4 else None, "subject_cn": None if i % 2 else f"cn-{i}"})
    return Certs(spark).frame(*made).cache()


def united(df):
    """The bitmaps as {(day, trigram): bits}."""
    whole = df.groupBy("seen_date", "gram").agg(F.hex(F.bitmap_or_agg("bits")).alias("bits"))
    return {(r["seen_date"], r["gram"]): r["bits"].rstrip("0") for r in whole.collect()}


SPECS = [
    SearchSpec([[Term("lake3")]]),
    SearchSpec([[Term("NODE1"), Term("birch 2", "issuer", negate=True)]]),
    SearchSpec([[Term("ridge1.test", "domain")], [Term("cn-10", "cn")]]),
    SearchSpec([[Term("Birch 1", "issuer", exact=True), Term("lake2")]], after=101 * DAY, before=105 * DAY),
    SearchSpec([[Term("no such text")]]),
    SearchSpec([[Term("k3")], [Term("lake1")]]),
]


@pytest.fixture(scope="module")
def path(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings") / "table")
    tables.rewrite_daily(rows.filter("cert_index % 3 = 0"), path)
    postings.build(spark, path)
    for k in (1, 2):
        tables.append_new(spark, path, rows.filter(F.col("cert_index") % 3 == k))
    return path


@pytest.mark.parametrize("k", range(len(SPECS)))
def test_index_search_equals_the_scan(spark, rows, path, k):
    got = [r["cert_index"] for r in postings.index_search(spark, path, SPECS[k]).collect()]
    want = [r["cert_index"] for r in search.search(rows, SPECS[k]).collect()]
    assert sorted(got) == sorted(want) and (want or k == 4)


def test_the_index_follows_the_table(spark, rows, path, tmp_path):
    """Inserts, compaction and retention leave the index that a rebuilt one would be."""
    def rebuilt(at):
        return united(postings.postings_of(tables.read_certificates(spark, at)))

    assert united(postings.read_postings(spark, path)) == rebuilt(path)
    other = str(tmp_path / "table")
    tables.rewrite_daily(rows.filter("cert_index % 2 = 0"), other)
    postings.build(spark, other)
    tables.append_new(spark, other, rows)
    tables.compact_days(spark, other, date(1970, 4, 12), date(1970, 4, 14))
    compacted = postings.read_postings(spark, other).filter("seen_date = '1970-04-12'")
    assert compacted.count() == compacted.select("gram").distinct().count() > 0
    assert united(postings.read_postings(spark, other)) == rebuilt(other)
    assert tables.enforce_retention(spark, other, 3, 105 * DAY + 40_000) > 0
    assert united(postings.read_postings(spark, other)) == rebuilt(other) != {}


def test_other_days_are_not_opened(spark, certs, tmp_path):
    path = str(tmp_path / "table")
    tables.rewrite_daily(certs.frame(*[{"seen_at": (50 + i) * DAY, "domains": [f"only{i}.example"]} for i in range(5)]), path)
    postings.build(spark, path)
    for file in glob.glob(f"{path}/seen_date=*/*.parquet"):
        if "seen_date=1970-02-22" not in file:
            with open(file, "wb") as broken:
                broken.write(b"no parquet")
    assert [r["seen_at"] for r in postings.index_search(spark, path, SearchSpec([[Term("only2")]])).collect()] == [52 * DAY]
    assert postings.index_search(spark, path, SearchSpec([[Term("only9")]])).count() == 0


def test_ranges_cover_the_blocks():
    rng = random.Random(1)
    days = []
    for d in (10, 11):
        whole = 0
        for _ in range(150):
            whole |= 1 << rng.randrange(postings.BLOCKS)
        days.append((date(1970, 1, 1 + d), whole.to_bytes(postings.BLOCKS // 8, "little")))
    for most in (1000, 20, 1):
        ranges = postings._ranges(days, most)
        assert len(ranges) <= most and ranges == sorted(ranges)
        for day, bits in days:
            for second in range(0, DAY, 7):
                at = (day - date(1970, 1, 1)).days * DAY + second
                block = second * postings.BLOCKS // DAY
                inside = any(a <= at < b for a, b in ranges)
                assert inside or not bits[block // 8] >> block % 8 & 1
                if most == 1000:
                    assert inside == bool(bits[block // 8] >> block % 8 & 1)


def test_key_sets_hold_their_texts(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    held = key_set(keys.filter("id < 2000") if "id" in keys.columns else keys.limit(2000), "key", 2000)
    inside = keys.filter(held.may_hold(F.col("key"))).count()
    assert 2000 <= inside < 2200
    assert keys.limit(2000).filter(~held.may_hold(F.col("key"))).count() == 0
    empty = key_set(keys.limit(0), "key", 0)
    assert keys.filter(empty.may_hold(F.col("key"))).count() == 0


def test_postings_have_the_bits_of_their_blocks(spark, rows):
    """Bit for bit what Spark's bitmap of the blocks gives, first and last block of a day and words with gaps included."""
    from certloom.operators.searches import grams

    ends = rows.limit(2).withColumn("seen_at", F.when(F.col("cert_index") % 2 == 0, 102 * DAY).otherwise(103 * DAY - 1))
    some = rows.unionByName(ends)
    each = some.select(F.to_date(F.timestamp_seconds("seen_at")).alias("seen_date"), postings._block().alias("block"), F.explode(grams(postings._text(), 3)).alias("gram"))
    want = each.groupBy("seen_date", "gram").agg(F.bitmap_construct_agg("block").alias("bits")).select("gram", "bits", "seen_date")
    got = postings.postings_of(some)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_postings_are_added_up_without_sorting_the_trigrams(spark, rows):
    text = postings.postings_of(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "partial_bit_or" in text
