"""What the physical plans must look like to hold at scale."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from certloom.functions.predicates import SearchSpec, Term, seen_between
from certloom.operators import periods, search, searches, tables
from certloom.operators.domains import registrable_domain
from certloom.plans import derived
from certloom.sources.suffixes import seed_rules

SF = "/root/testdata/sf0.001"
JAN_10 = 1704844800


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "certificates")
    tables.rewrite_daily(derived.certs(spark, SF), path)
    return tables.read_certificates(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_search_prunes_days_and_pushes_time(table):
    spec = SearchSpec([[Term("github")]], after=JAN_10, before=JAN_10 + 86400)
    text = plan(search.page(table, spec, 1, 10).select("fingerprint", "seen_at"))
    assert "seen_date#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(seen_at" in text and "TakeOrderedAndProject" in text
    read = text.split("ReadSchema: ")[1]
    assert "log_url" not in read and "cert_link" not in read


def test_cursors_prune_days(table):
    spec = SearchSpec([[Term("github")]])
    for df in (search.page_after(table, spec, f"{JAN_10}:f", 10), search.export_range(table, f"{JAN_10}:f", 10)):
        assert "seen_date#" in plan(df).split("PartitionFilters: [")[1].split("]")[0]


def test_lookup_pushes_the_fingerprint(table):
    text = plan(search.lookup(table, "abc"))
    assert "EqualTo(fingerprint,abc)" in text and "Exchange" not in text


def test_statistics_scan_once_and_reuse_the_counts(spark, table):
    text = final_plan(periods.daily_stats(table, seed_rules(spark), 1))
    assert text.count("FileScan parquet") == 1
    assert "ReusedExchange" in text
    assert text.count("WindowGroupLimit") == 2
    read = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "fingerprint" not in read and "subject_cn" not in read


def test_registrable_domain_moves_no_rows(spark, table):
    names = table.select(F.explode("domains").alias("domain"))
    text = plan(registrable_domain(names, "domain", seed_rules(spark)))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_first_per_key_is_limited_before_the_shuffle(table):
    text = plan(tables.first_per_key(table, ["fingerprint"], [F.col("cert_index").asc()]))
    assert text.count("WindowGroupLimit") == 2
    below = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in below


def test_insert_reads_only_fingerprints_of_the_target(table):
    batch = table.filter(seen_between(JAN_10, JAN_10 + 86400))
    text = plan(tables.insert_new(table, batch))
    assert "ReadSchema: struct<fingerprint:string>" in text
    target = next(line for line in text.splitlines() if "ReadSchema: struct<fingerprint:string>" in line)
    assert "FileScan" in target


def test_saved_searches_scan_once_and_shuffle_only_matches(spark, table):
    index = searches.index_searches(searches.parse_searches(derived.saved_searches(spark, SF)))
    text = plan(searches.match_index(table, index))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    assert "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning(search_id") == 1


def test_a_large_set_of_searches_scans_once(spark, table):
    index = searches.index_searches(searches.parse_searches(derived.saved_searches(spark, SF)))
    text = plan(searches.match_index(table, replace(index, rows=2**40)))
    assert sum("FileScan" in line and "seen_at" in line for line in text.splitlines()) == 1


def test_only_lead_trigrams_carry_their_text(spark, table, monkeypatch):
    """Trigrams are counted without the text; what carries it is dropped within its row unless a text leads with it."""
    made = []
    real = searches.stored
    monkeypatch.setattr(searches, "stored", lambda df, label: (made.append(df), real(df, label))[1])
    texts = spark.createDataFrame([(1, "github"), (2, "u1.net")], "text_id int, text string")
    last = plan(searches.trigram_candidates(table, texts))
    assert all("_text" not in df.columns for df in made)
    assert last.count("Generate explode(filter(array_distinct") == 1


def test_keys_are_dropped_before_they_are_exploded(spark, table):
    """At most a tenth of a row's runs leave it when the searches are narrow."""
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct()
    narrow = users.select(F.col("user_id").alias("search_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".github")).alias("text"))
    index = searches.index_searches(searches.parse_searches(narrow))
    text = F.lower(F.concat_ws("\n", "domains", "issuer_org", "subject_cn")).alias("_text")
    keys = searches._row_keys(index.kinds, {})
    rows = table.select("*", F.lower(F.concat_ws("\n", "domains")).alias("_names"), text)
    every, kept = rows.select(F.sum(F.size(keys)), F.sum(F.size(F.filter(keys, index.keys.may_hold)))).first()
    assert 0 < kept * 10 < every
    assert "Generate explode(filter(" in plan(searches.match_index(table, index))


def test_sketches_are_made_before_the_shuffle(spark, table):
    text = plan(periods.approx_stats(table, periods.HOUR, seed_rules(spark)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_hll_sketch_agg" in text[text.index("Exchange hashpartitioning") :]


def test_a_deep_page_is_not_sorted_for(table):
    spec = SearchSpec([[Term("github")]])
    text = plan(search.page_by_rank(table, spec, 9, 20))
    limits = [int(n) for n in re.findall(r"(?:limit=|GlobalLimit |CollectLimit |LocalLimit )(\d+)", text)]
    assert limits and max(limits) < 8 * 20 and "PartitionFilters: [isnotnull(seen_date" in text


@pytest.mark.parametrize("large", [False, True])
def test_no_products_and_no_python(spark, table, large):
    rules = seed_rules(spark)
    index = searches.index_searches(searches.parse_searches(derived.saved_searches(spark, SF)))
    frames = [
        periods.hourly_stats(table, rules, 1),
        periods.top_domains(table, 3600, rules),
        registrable_domain(table.select(F.explode("domains").alias("d")), "d", rules, via="shuffle" if large else "lookup"),
        searches.match_index(table, index),
        tables.insert_new(table, table),
        tables.copy_rows(table, table),
    ]
    for df in frames:
        text = plan(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "BatchEval"):
            assert bad not in text


@pytest.mark.parametrize("most", [0, 3, 64])
def test_candidates_by_pairs_and_by_single_trigrams_are_the_same(spark, monkeypatch, most):
    """Rows below and above the bound, a text of one trigram, one that no row holds, and trigrams that stand apart."""
    from tests.conftest import Certs

    names = [["u1234.net"], ["u1299.net", "x34.example"], ["u12.org", "a123.b234.c34.net", "34.n.e.t", "4.net"], ["u55.net"], None]
    rows = Certs(spark).frame(*[{"domains": n, "issuer_org": None, "subject_cn": None, "domain_count": 1} for n in names])
    texts = [(1, "u1234.net"), (2, "U55.net"), (3, "net"), (4, "qqq.net"), (5, "12"), (6, "u1299")]
    monkeypatch.setattr(searches, "MOST_LEADS", most)
    got = searches.trigram_candidates(rows, spark.createDataFrame(texts, "text_id int, text string"))
    want = set()
    for r in rows.collect():
        held = {d.lower()[i : i + 3] for d in r["domains"] or [] for i in range(len(d) - 2)}
        want |= {(k, r["fingerprint"]) for k, t in texts if len(t) > 2 and {t.lower()[i : i + 3] for i in range(len(t) - 2)} <= held}
    assert sorted((r["text_id"], r["fingerprint"]) for r in got.collect()) == sorted(want) and len(want) >= 7
