import json

import pytest

from certloom.functions.text import glob_match
from certloom.operators.filters import filter_by_patterns
from certloom.sources.messages import ingest_filter, parse_messages, to_certificates


# The keys are those of the message format.
def message(**leaf):
    certificate = {
        "all_domains": ["shop.example.com", "example.com"],
        "fingerprint": "0D:E1:F2",
        "issuer": {"CN": "Oak Trust R2", "O": "Oak Trust"},
        "subject": {"CN": "shop.example.com"},
        "serial_number": "7f",
        "not_before": 1640995200,
        "not_after": 1672531199,
        **leaf,
    }
    entry = {"leaf_cert": certificate, "cert_index": 31, "cert_link": "https://elm.invalid/31", "seen": 1650000000.7}
    return {"message_type": "certificate_update", "data": {**entry, "source": {"name": "elm", "url": "https://elm.invalid/"}}}


def parse(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    return parse_messages(df, now=123).collect()


def test_valid_message(spark):
    (row,) = parse(spark, json.dumps(message()))
    assert row["fingerprint"] == "0de1f2"
    assert row["domains"] == ["shop.example.com", "example.com"]
    assert (row["issuer_org"], row["issuer_cn"], row["subject_cn"]) == ("Oak Trust", "Oak Trust R2", "shop.example.com")
    assert (row["cert_index"], row["seen_at"]) == (31, 1650000000)


def test_dropped_messages(spark):
    no_leaf = message()
    del no_leaf["data"]["leaf_cert"]
    dropped = [
        json.dumps({"message_type": "heartbeat"}),
        "{\"message_type\": ",
        "",
        "[]",
        json.dumps(no_leaf),
        json.dumps(message(all_domains=[])),
        json.dumps(message(all_domains=["", None])),
        json.dumps(message(fingerprint="")),
        json.dumps({"Message_Type": "certificate_update"}),
    ]
    assert parse(spark, *dropped) == []


def test_empty_names_are_removed(spark):
    (row,) = parse(spark, json.dumps(message(all_domains=["", "left.org", "", "right.net"])))
    assert row["domains"] == ["left.org", "right.net"]


def test_missing_fields_are_null(spark):
    m = message(subject={}, issuer={})
    del m["data"]["source"], m["data"]["cert_link"], m["data"]["cert_index"], m["data"]["seen"]
    del m["data"]["leaf_cert"]["serial_number"]
    (row,) = parse(spark, json.dumps(m))
    empty = ("issuer_org", "issuer_cn", "subject_cn", "log_name", "log_url", "cert_index", "cert_link")
    assert [row[c] for c in empty] == [None] * len(empty)
    assert (row["serial_number"], row["seen_at"]) == ("", 123)


def test_table_form(spark):
    df = spark.createDataFrame([(json.dumps(message()),)], "value string")
    (row,) = to_certificates(parse_messages(df, now=0), 77).collect()
    assert (row["domain_count"], row["created_at"], str(row["seen_date"])) == (2, 77, "2022-04-15")


FILTERS = [
    ([], [], {1, 2}),
    (["bank.net"], [], {1}),
    (["*.BANK.net"], [], set()),
    (["*.pay.org"], [], {2}),
    (["?.PAY.org"], [], {2}),
    (["??.pay.org"], [], set()),
    ([], ["elm"], {1}),
    (["*.pay.org"], ["AND SONS"], {1, 2}),
    (["pay.org"], ["oak"], set()),
]


@pytest.mark.parametrize("globs,issuers,expected", FILTERS)
def test_ingest_filter(certs, globs, issuers, expected):
    df = certs.frame({"domains": ["bank.net"], "issuer_org": "Elm and Sons"}, {"domains": ["a.pay.org"], "issuer_org": None})
    assert {r["cert_index"] for r in ingest_filter(df, globs, issuers).collect()} == expected


@pytest.mark.parametrize("globs,issuers,expected", FILTERS[1:])
def test_a_table_of_patterns_equals_the_list(spark, certs, globs, issuers, expected):
    df = certs.frame({"domains": ["bank.net"], "issuer_org": "Elm and Sons"}, {"domains": ["a.pay.org"], "issuer_org": None})
    rows = [("domain", g) for g in globs] + [("issuer", i) for i in issuers] + [("domain", None), ("other", "*")]
    patterns = spark.createDataFrame(rows, "kind string, pattern string")
    assert {r["cert_index"] for r in filter_by_patterns(df, patterns).collect()} == expected


@pytest.mark.parametrize("glob,expected", [("*", {1, 2, 3}), ("a+b.*", {1}), ("", set()), ("?.[x]", {3}), ("*.*", {1, 3})])
def test_globs_with_few_or_strange_literals(spark, certs, glob, expected):
    df = certs.frame({"domains": ["a+b.com"]}, {"domains": ["aab"]}, {"domains": ["q.[x]"]}, {"domains": []})
    patterns = spark.createDataFrame([("domain", glob)], "kind string, pattern string")
    assert {r["cert_index"] for r in filter_by_patterns(df, patterns).collect()} == expected
    assert {r["cert_index"] for r in ingest_filter(df, [glob]).collect()} == expected


def test_glob_takes_other_signs_literally(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("a+b",), ("(a)\n",), ("(a)",)], "d string")
    got = df.select("d", glob_match(df.d, "a.b", "(?)").alias("hit")).collect()
    assert [r["d"] for r in got if r["hit"]] == ["a.b", "(a)"]


def test_only_runs_of_the_patterns_lengths_are_cut(spark, certs):
    """A length with few keys is tested key by key, also for a line end in a pattern, and the others are not cut at all."""
    from certloom.operators import filters

    df = certs.frame({"domains": ["n7.abcdef.test"]}, {"domains": ["n41.lake.test"], "issuer_org": "Elm"}, {"domains": ["q"], "issuer_org": "oa\nk"})
    rows = [("domain", f"n{i}.*") for i in range(10, 60)] + [("issuer", "ELM"), ("issuer", "a\nk"), ("domain", "*cdef.t*")]
    index = filters.index_patterns(spark.createDataFrame(rows, "kind string, pattern string"))
    assert index.lengths == (3,) and set(index.few) == {"cdef.t"}
    assert {r["cert_index"] for r in filters.match_patterns(df, index).collect()} == {1, 2}
