from dataclasses import replace

import pytest

from certloom.functions.predicates import SearchError, SearchSpec, Term, domain_boundary, match_spec, term_contains
from certloom.operators import search
from certloom.operators.searches import explode_searches, index_searches, match_index, match_searches, parse_one, parse_searches


def hits(df, text):
    return {r["cert_index"] for r in search.search(df, parse_one(df.sparkSession, text)).collect()}


ZONES = ["harbor.dev", "quarry.coop", "tidal.museum"]
LABELS = ["api", "shop", "mx1", "vault"]
ISSUERS = ["Granite Seal GmbH", "Poplar & Sons", None, 'O\'Dell "Trust"']
START, STEP = 1_700_000_000, 50_000


def rows():
    """Certificates by rule, so that each search's result follows from what its text says."""
    made = []
    for i in range(36):
        zone = ZONES[i % 3]
        names = [zone] if i % 5 == 0 else [f"{LABELS[i % 4]}.{zone}"]
        names += [f"*.{zone}"] if i % 7 == 0 else []
        names += [f"p_{i}.{zone}", f"{i}%off.{zone}"] if i % 6 == 1 else []
        made.append({"domains": names, "issuer_org": ISSUERS[i // 4 % 4], "subject_cn": names[-1] if i % 2 else None, "seen_at": START + i * STEP})
    made.append({"domains": ["bigharbor.dev"], "subject_cn": "harbor.dev.invalid", "issuer_org": None, "seen_at": START})
    return [{**r, "cert_index": i, "domain_count": len(r["domains"])} for i, r in enumerate(made)]


@pytest.fixture(scope="module")
def table(spark):
    from tests.conftest import Certs

    return Certs(spark).frame(*rows()).cache()


def fields(r, column=None):
    values = {"domain": r["domains"], "issuer": [r["issuer_org"] or ""], "cn": [r["subject_cn"] or ""]}
    return values[column] if column else [v for own in values.values() for v in own]


def has(text, column=None):
    return lambda r: any(text.lower() in v.lower() for v in fields(r, column))


def under(zone):
    return lambda r: any(d == zone or d.endswith("." + zone) for d in r["domains"])


def is_(text, column=None):
    return lambda r: text in fields(r, column)


def wild(r):
    return any(d.startswith("*.") for d in r["domains"])


def both(*tests):
    return lambda r: all(t(r) for t in tests)


def either(*tests):
    return lambda r: any(t(r) for t in tests)


def but(test):
    return lambda r: not test(r)


SEARCHES = [
    ("vault", has("vault")),
    ("GRANITE seal", both(has("granite"), has("seal"))),
    ("domain:granite", has("granite", "domain")),
    ("issuer:granite", has("granite", "issuer")),
    ("cn:mx1", has("mx1", "cn")),
    ("shop tidal", both(has("shop"), has("tidal"))),
    ("api OR mx1 or nothing-like-it", either(has("api"), has("mx1"))),
    ("domain:harbor.dev", under("harbor.dev")),
    ("domain:HARBOR.dev or domain:tidal.museum", either(under("harbor.dev"), under("tidal.museum"))),
    ("domain:.museum", under(".museum")),
    ("quarry -shop -api", both(has("quarry"), but(has("shop")), but(has("api")))),
    # A prefix counts at the start of a group only, so this leaves out a literal text.
    ("harbor -issuer:poplar", both(has("harbor"), but(has("issuer:poplar")))),
    (f"vault after:{START + 9 * STEP} before:{START + 20 * STEP}", both(has("vault"), lambda r: 9 * STEP <= r["seen_at"] - START < 20 * STEP)),
    ("quarry after:2023-11-20", both(has("quarry"), lambda r: r["seen_at"] >= 1_700_438_400)),
    ("tidal created:2023-11-15..2023-11-18", both(has("tidal"), lambda r: 1_700_006_400 <= r["seen_at"] < 1_700_352_000)),
    ("tidal wildcard:true", both(has("tidal"), wild)),
    ("tidal wildcard:false", both(has("tidal"), but(wild))),
    ("dev domain_count:>=3", both(has("dev"), lambda r: r["domain_count"] >= 3)),
    ("dev domain_count:<2", both(has("dev"), lambda r: r["domain_count"] < 2)),
    ("p_", has("p_")),
    ("%off", has("%off")),
    ('issuer:"Poplar & Sons"', is_("Poplar & Sons", "issuer")),
    ('issuer:"Poplar"', is_("Poplar", "issuer")),
    ("issuer:o'dell", has("o'dell", "issuer")),
    ('"harbor.dev"', is_("harbor.dev")),
    ('cn:"harbor.dev.invalid"', is_("harbor.dev.invalid", "cn")),
]


def expected_of(test):
    return {r["cert_index"] for r in rows() if test(r)}


@pytest.mark.parametrize("text,test", SEARCHES, ids=[t for t, _ in SEARCHES])
def test_search(table, text, test):
    assert hits(table, text) == expected_of(test)


def test_the_searches_tell_apart():
    """Most searches find some rows and leave others."""
    found = [len(expected_of(t)) for _, t in SEARCHES]
    assert sum(0 < n < 37 for n in found) >= 20


@pytest.mark.parametrize("text", ["domain:", "-nolime", "domain_count:>10", "", "foo OR -bar"])
def test_rejected(spark, text):
    with pytest.raises(SearchError):
        parse_one(spark, text)


def test_spec_needs_positive_term():
    for spec in (SearchSpec([]), SearchSpec([[]]), SearchSpec([[Term("x", negate=True)]])):
        with pytest.raises(SearchError):
            match_spec(spec)


PARSED = [
    ("foo bar", [[(None, "foo", False, False), (None, "bar", False, False)]]),
    ("google domain:x", [[(None, "google", False, False), (None, "domain:x", False, False)]]),
    ("domain:paypal login", [[("domain", "paypal", False, False), ("domain", "login", False, False)]]),
    ("- foo --bar z", [[(None, "foo", True, False), (None, "-bar", True, False), (None, "z", False, False)]]),
    ('x "a\\"b" \'c d\' "open y', [[(None, "x", False, False), (None, 'a"b', False, True), (None, "c d", False, True), (None, "open y", False, True)]]),
    ("Finn's go -", [[(None, "Finn's", False, False), (None, "go", False, False)]]),
    ("a or b OR OR c", [[(None, "a", False, False)], [(None, "b", False, False)], [(None, "OR", False, False), (None, "c", False, False)]]),
    ('a "" b', [[(None, "a", False, False), (None, "b", False, False)]]),
    ('"x"y', [[(None, "x", False, True), (None, "y", False, False)]]),
    ("x after:bogus", [[(None, "x", False, False), (None, "after:bogus", False, False)]]),
    ('"abc\\', [[(None, "abc", False, True)]]),
]


def test_parse_terms(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARSED)], "search_id int, text string")
    got = {}
    for r in explode_searches(parse_searches(df)).orderBy("search_id", "grp", "pos").collect():
        groups = got.setdefault(r["search_id"], [])
        if r["grp"] == len(groups):
            groups.append([])
        groups[r["grp"]].append((r["column"], r["text"], r["negate"], r["exact"]))
    assert got == {i: groups for i, (_, groups) in enumerate(PARSED)}


FILTERS = [
    ("x created:2024-01-01..2024-01-05", (1704067200, 1704499200, None, None, None)),
    ("x created:2024-01-01..2024-01-05 after:2024-01-02", (1704153600, 1704499200, None, None, None)),
    ("x after:100 after:200 before:2024-01-01T10:00Z", (200, 1704103200, None, None, None)),
    ("x created:5..9", (5, 9, None, None, None)),
    ("WILDCARD:TRUE x wildcard:false", (None, None, False, None, None)),
    ("x domain_count:>=5 domain_count:<9", (None, None, None, "<", 9)),
    ("x domain_count:=99999999999999999999", (None, None, None, "=", 2**63 - 1)),
    ("x xafter:1 wildcard:trueish", (None, None, None, None, None)),
    ("x", (None, None, None, None, None)),
]


def test_parse_filters(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FILTERS)], "search_id int, text string")
    rows = parse_searches(df).orderBy("search_id").collect()
    assert [tuple(r[c] for c in ("after", "before", "wildcard", "count_op", "count_n")) for r in rows] == [f for _, f in FILTERS]


def test_null_text_is_rejected(spark):
    (row,) = parse_searches(spark.createDataFrame([(1, None)], "search_id int, text string")).collect()
    assert row["reject"]


@pytest.mark.parametrize("large", [{}, {"few": {}}, {"size": 2**40}, {"rows": 2**40}])
def test_all_searches_at_once_equal_each_alone(spark, table, large):
    texts = [t for t, _ in SEARCHES]
    searches = spark.createDataFrame(list(enumerate(texts)), "search_id int, text string")
    index = index_searches(parse_searches(searches))
    index = replace(index, **large)
    numbered = table.select("fingerprint", "cert_index")
    got = match_index(table, index).join(numbered, "fingerprint").collect()
    assert {(r["search_id"], r["cert_index"]) for r in got} == {(i, n) for i, (_, t) in enumerate(SEARCHES) for n in expected_of(t)}


def test_no_valid_search_matches_nothing(spark, table):
    searches = spark.createDataFrame([(1, "-x"), (2, "")], "search_id int, text string")
    assert match_searches(table, parse_searches(searches)).count() == 0


def test_gram_counts_do_not_change_matches(spark, table):
    from certloom.operators.searches import trigram_counts, trigrams

    searches = spark.createDataFrame([(1, "tid"), (2, "quarry -shop"), (3, "cn:api")], "search_id int, text string")
    parsed = parse_searches(searches)
    plain = match_searches(table, parsed).collect()
    weighted = match_searches(table, parsed, trigram_counts(trigrams(table))).collect()
    assert sorted(plain) == sorted(weighted) and plain


def test_case_sensitive_option(table):
    assert table.filter(term_contains("issuer", "granite", case_sensitive=True)).count() == 0
    assert table.filter(domain_boundary("Harbor.dev", case_sensitive=True)).count() == 0
    assert table.filter(match_spec(SearchSpec([[Term("Granite", "issuer")]], case_sensitive=True))).count() == len(expected_of(has("Granite", "issuer")))


def test_pages_by_rank_equal_pages_by_offset(certs):
    """Days and seconds with many rows, the last page, and pages behind it."""
    df = certs.frame(*[{"domains": ["ranked.example"], "seen_at": 86_400 * (i % 3) + i % 4} for i in range(41)], {"domains": ["other.example"]})
    spec = SearchSpec([[Term("ranked")]])
    for limit in (1, 7, 20, 50):
        for number in range(1, 41 // limit + 3):
            ranked, offset = search.page_by_rank(df, spec, number, limit), search.page(df, spec, number, limit)
            assert [r["fingerprint"] for r in ranked.collect()] == [r["fingerprint"] for r in offset.collect()]


def test_pages_by_offset_and_cursor(certs):
    df = certs.frame(*[{"domains": ["leafing.example.com"], "seen_at": 100 + i // 2} for i in range(5)])
    spec = SearchSpec([[Term("leafing")]])
    first = search.fetch_page(df, spec, 1, 2)
    assert (len(first.rows), first.total, first.total_pages) == (2, 5, 3)
    seen, page = [r["fingerprint"] for r in first.rows], first
    for number in (2, 3):
        page = search.fetch_page(df, spec, number, 2, cursor=page.next_cursor, known_total=first.total)
        offset = search.fetch_page(df, spec, number, 2)
        assert [r["fingerprint"] for r in page.rows] == [r["fingerprint"] for r in offset.rows]
        seen += [r["fingerprint"] for r in page.rows]
    assert len(set(seen)) == 5 and page.next_cursor is None


def test_single_page_needs_no_count(certs):
    df = certs.frame({}, {})
    page = search.fetch_page(df, SearchSpec([[Term("example")]]), 1, 2)
    assert (page.total, page.total_pages, page.next_cursor) == (2, 1, None)
    empty = search.fetch_page(df, SearchSpec([[Term("zzz")]]), 1, 2)
    assert (empty.total, empty.total_pages) == (0, 0)


def test_export_in_batches(certs):
    df = certs.frame(*[{"seen_at": 100 + i % 2} for i in range(7)])
    seen, cursor, batches = [], None, 0
    while True:
        batch = search.export_range(df, cursor, 3)
        seen += [r["fingerprint"] for r in batch.collect()]
        batches += 1
        cursor = search.next_cursor(batch, 3)
        if cursor is None:
            break
    assert (len(seen), len(set(seen)), batches) == (7, 7, 3)


def test_lookup_takes_the_last_insert(certs):
    df = certs.frame({"fingerprint": "f", "created_at": 1}, {"fingerprint": "f", "created_at": 5}, {})
    assert [r["created_at"] for r in search.lookup(df, "f").collect()] == [5]
    assert search.lookup(df, "missing").count() == 0
    wanted = df.select("fingerprint").distinct()
    assert search.lookup_many(df, wanted).count() == 2
