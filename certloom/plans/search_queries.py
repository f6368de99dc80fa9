"""Checked queries: search predicates, registrable domains, saved searches."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from certloom.functions import hosts, times
from certloom.functions.predicates import (
    SearchSpec,
    Term,
    domain_boundary,
    domain_count_cmp,
    match_spec,
    not_term,
    seen_between,
    term_contains,
    term_equals,
)
from certloom.operators import periods, postings, search, searches, tables
from certloom.operators.domains import domain_counts, registrable_domain
from certloom.plans import derived
from certloom.plans.ingest_queries import GITHUB, GITHUB_SQL, JAN_10, JAN_15, JAN_20, NEWEST
from certloom.plans.registry import CERTS, FLAT, NULLED, SEEDS, certs_sql, flat, query, registrable_sql
from certloom.session import scratch_dir, stored
from certloom.sources.suffixes import load_rules, seed_rules


def flags(spark, sf, **tests):
    return derived.certs(spark, sf).select("cert_index", *[c.alias(n) for n, c in tests.items()])


def any_name(condition: str) -> str:
    return f"len(list_filter(domains, lambda d: {condition})) > 0"


ORG, CN = "coalesce(issuer_org, '')", "coalesce(subject_cn, '')"


@query("b9_term_contains", CERTS + f""" SELECT cert_index, {any_name("d ILIKE '%u1%'")} AS in_domain,
  {ORG} ILIKE '%view%' AS in_issuer, {CN} ILIKE '%.net%' OR {CN} ILIKE '%click%' AS in_cn,
  {any_name("contains(d, 'ca')")} OR contains(lower({ORG}), 'ca') OR contains(lower({CN}), 'ca') AS anywhere,
  contains({ORG}, 'ca') AS cased, {any_name("contains(d, 'u%')")} AS literal FROM certs""")
def _(spark, sf):
    return flags(
        spark,
        sf,
        in_domain=term_contains("domain", "U1"),
        in_issuer=term_contains("issuer", "VIEW"),
        in_cn=term_contains("cn", ".net") | term_contains("cn", "click"),
        anywhere=term_contains(None, "Ca"),
        cased=term_contains("issuer", "ca", case_sensitive=True),
        literal=term_contains("domain", "u%"),
    )


@query("b10_term_equals", CERTS + f""" SELECT cert_index, list_contains(domains, 'github.io') AS in_domain,
  {ORG} = 'CA view' AS in_issuer, {CN} = 'click.u1.example.com' AS in_cn,
  list_contains(domains, 'u2.github.io') OR {CN} = 'u2.github.io' OR {ORG} = 'u2.github.io' AS anywhere FROM certs""")
def _(spark, sf):
    return flags(
        spark,
        sf,
        in_domain=term_equals("domain", "github.io"),
        in_issuer=term_equals("issuer", "CA view"),
        in_cn=term_equals("cn", "click.u1.example.com"),
        anywhere=term_equals(None, "u2.github.io"),
    )


@query("b11_domain_boundary", CERTS + f""" SELECT cert_index,
  {any_name("d = 'u1.net' OR d LIKE '%.u1.net'")} AS one, {any_name("d = 'github.io' OR d LIKE '%.github.io'")} AS two FROM certs""")
def _(spark, sf):
    return flags(spark, sf, one=domain_boundary("U1.net"), two=domain_boundary("github.io"))


@query("b12_not_term", CERTS + f" SELECT cert_index FROM certs WHERE NOT ({ORG} ILIKE '%view%') AND NOT ({CN} ILIKE '%github%')")
def _(spark, sf):
    c = derived.certs(spark, sf)
    return c.filter(
        not_term(F.contains("issuer_org", F.lit("view"))) & not_term(term_contains("cn", "GitHub"))
    ).select("cert_index")


SPEC = SearchSpec(
    [[Term("github"), Term("u1", negate=True)], [Term("CA view", "issuer", exact=True), Term("co.uk", "domain")]],
    after=JAN_10,
    before=JAN_20,
    count_op=">=",
    count_n=2,
)


def anywhere(t: str) -> str:
    return f"({any_name(f'contains(d, {t})')} OR contains({ORG}, {t}) OR contains({CN}, {t}))"


SPEC_SQL = f"""(({anywhere("'github'")} AND NOT {anywhere("'u1'")})
  OR ({ORG} = 'CA view' AND {any_name("d = 'co.uk' OR d LIKE '%.co.uk'")}))
  AND seen_at >= {JAN_10} AND seen_at < {JAN_20} AND domain_count >= 2"""


@query("b13_match_spec", f"{CERTS} SELECT cert_index FROM certs WHERE {SPEC_SQL}")
def _(spark, sf):
    return derived.certs(spark, sf).filter(match_spec(SPEC)).select("cert_index")


@query("b14_seen_between", f"{CERTS} SELECT cert_index FROM certs WHERE seen_at >= {JAN_10 + 5000} AND seen_at < {JAN_20 + 5000}")
def _(spark, sf):
    return derived.certs(spark, sf).filter(seen_between(JAN_10 + 5000, JAN_20 + 5000)).select("cert_index")


@query("b15_has_wildcard", f"""{CERTS} SELECT cert_index, {any_name("d LIKE '*.%'")} AS wild, NOT {any_name("d LIKE '*.%'")} AS plain FROM certs""")
def _(spark, sf):
    wild = hosts.has_wildcard(F.col("domains"))
    return flags(spark, sf, wild=wild, plain=~wild)


@query("b16_domain_count_cmp", f"""{CERTS} SELECT cert_index, domain_count > 1 AS gt, domain_count >= 2 AS ge, domain_count < 3 AS lt,
  domain_count <= 1 AS le, domain_count = 3 AS eq FROM certs""")
def _(spark, sf):
    return flags(
        spark,
        sf,
        gt=domain_count_cmp(">", 1),
        ge=domain_count_cmp(">=", 2),
        lt=domain_count_cmp("<", 3),
        le=domain_count_cmp("<=", 1),
        eq=domain_count_cmp("=", 3),
    )


@query("b17_parse_time", """WITH s AS (SELECT event_id, epoch_us(ts) // 1000000 AS sec FROM events)
  SELECT event_id, CASE event_id % 7 WHEN 0 THEN sec - sec % 86400 WHEN 1 THEN sec WHEN 2 THEN sec WHEN 3 THEN sec - 7200
    WHEN 4 THEN sec - sec % 60 WHEN 5 THEN NULL ELSE sec END AS seconds FROM s""")
def _(spark, sf):
    c = derived.certs(spark, sf)
    at = F.timestamp_seconds("seen_at")
    forms = [
        F.date_format(at, "yyyy-MM-dd"),
        F.col("seen_at").cast("string"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm"),
        F.concat(F.date_format(at, "yyyy-13-dd"), F.lit("")),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss.500"),
    ]
    value = forms[-1]
    for i, form in enumerate(forms[:-1]):
        value = F.when(F.col("cert_index") % 7 == i, form).otherwise(value)
    return c.select(F.col("cert_index").alias("event_id"), value.alias("t")).select(
        "event_id", times.parse_time(F.col("t")).alias("seconds")
    )


@query("b18_created_range", """WITH s AS (SELECT event_id, user_id % 4 AS n, epoch_us(ts) // 1000000 AS sec FROM events)
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN sec - sec % 86400 ELSE sec END AS after,
    CASE WHEN event_id % 2 = 0 THEN sec - sec % 86400 + (n + 1) * 86400 ELSE sec + n END AS before FROM s""")
def _(spark, sf):
    ev = derived.events(spark, sf).select("event_id", F.col("user_id") % 4, derived._seconds(F.col("ts"))).toDF("event_id", "n", "sec")

    def day(c):
        return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")

    days = F.concat_ws("..", day(F.col("sec")), day(F.col("sec") + F.col("n") * 86400))
    seconds = F.concat_ws("..", F.col("sec").cast("string"), (F.col("sec") + F.col("n")).cast("string"))
    text = F.when(F.col("event_id") % 2 == 0, days).otherwise(seconds)
    return ev.select("event_id", times.created_range(text).alias("r")).select("event_id", "r.after", "r.before")


NAMES = ", names AS (SELECT cert_index, seen_at, unnest(domains) AS d FROM certs)"


@query("b19_registrable_domain", CERTS + NAMES + ", " + registrable_sql("names", "d") + " SELECT d AS domain, registrable FROM reg")
def _(spark, sf):
    names = domain_counts(derived.certs(spark, sf)).select("domain")
    return registrable_domain(names, "domain", seed_rules(spark))


MORE_RULES = [(s, "normal") for s in SEEDS] + [
    ("example.com", "wildcard"),
    ("u1.example.com", "exception"),
    ("net", "wildcard"),
    ("u2.net", "exception"),
]


@query("b19_all_rule_kinds", CERTS + NAMES + ", " + registrable_sql("names", "d", MORE_RULES) + " SELECT d AS domain, registrable FROM reg")
def _(spark, sf):
    rules = load_rules(spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, MORE_RULES)) + " AS t(suffix, kind)"))
    return registrable_domain(domain_counts(derived.certs(spark, sf)).select("domain"), "domain", rules)


@query("b19_by_shuffle", CERTS + NAMES + ", " + registrable_sql("names", "d", MORE_RULES) + " SELECT d AS domain, registrable FROM reg")
def _(spark, sf):
    """The way taken when the rule table is too large to broadcast."""
    rules = load_rules(spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, MORE_RULES)) + " AS t(suffix, kind)"))
    names = domain_counts(derived.certs(spark, sf)).select("domain")
    return registrable_domain(names, "domain", rules, via="shuffle")


HOSTS = "p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS d FROM pages)"


def page_hosts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1).alias("host"))


@query("b19_page_hosts", f"WITH {HOSTS}, " + registrable_sql("p", "d") + " SELECT page_id, d AS host, registrable FROM p JOIN reg USING (d)")
def _(spark, sf):
    return registrable_domain(page_hosts(spark, sf), "host", seed_rules(spark))


@query("b20_ipv4_shape", """WITH t AS (SELECT event_id, user_id || '.' || (event_id % 2000) || '.1.' || CASE WHEN user_id % 2 = 0 THEN '7' ELSE 'x' END AS ip FROM events)
  SELECT event_id, regexp_full_match(ip, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') AS ipv4 FROM t""")
def _(spark, sf):
    last = F.when(F.col("user_id") % 2 == 0, "7").otherwise("x")
    ip = F.concat_ws(".", F.col("user_id").cast("string"), (F.col("event_id") % 2000).cast("string"), F.lit("1"), last)
    return derived.events(spark, sf).select("event_id", hosts.is_ipv4_shape(ip).alias("ipv4"))


@query("b21_split_host", f"WITH {HOSTS} SELECT page_id, array_to_string(string_split(d, '.'), '|') AS labels, len(string_split(d, '.')) AS n FROM p")
def _(spark, sf):
    dotted = F.when(F.col("page_id") % 2 == 0, F.concat("host", F.lit("."))).otherwise(F.col("host"))
    return page_hosts(spark, sf).select("page_id", hosts.split_host(dotted).alias("l")).select(
        "page_id", F.array_join("l", "|").alias("labels"), F.size("l").cast("bigint").alias("n")
    )


# --- Saved searches: expected terms and filters from the parts the texts were made of --------

USERS = "us AS (SELECT DISTINCT user_id AS id, cast(user_id AS varchar) AS u, user_id % 7 AS f FROM events)"
KINDS = "ks AS (SELECT DISTINCT event_type AS t, ascii(event_type) AS a FROM events)"
TERMS = f"""{USERS}, {KINDS}, terms(search_id, grp, pos, col, txt, negate, exact) AS (
  SELECT id, 0, 0, NULL, 'u' || u || '.github', false, false FROM us WHERE f IN (0, 4)
  UNION ALL SELECT id, 0, 1, NULL, 'click', true, false FROM us WHERE f = 0
  UNION ALL SELECT id, 0, 0, 'domain', 'u' || u || '.github.io', false, false FROM us WHERE f = 1
  UNION ALL SELECT id, 0, 0, 'cn', 'u' || u || '.example', false, false FROM us WHERE f = 2
  UNION ALL SELECT id, 0, 0, 'domain', 'u' || u || '.net', false, false FROM us WHERE f = 3
  UNION ALL SELECT id, 1, 0, 'domain', 'u' || u || '.co.uk', false, false FROM us WHERE f = 3
  UNION ALL SELECT id, 0, 0, NULL, 'u' || u || '.github.io', false, true FROM us WHERE f = 5
  UNION ALL SELECT id, 0, 0, NULL, 'u%_' || u, false, false FROM us WHERE f = 6
  UNION ALL SELECT id, 1, 0, 'domain', 'b.u' || u || '.net', false, false FROM us WHERE f = 6
  UNION ALL SELECT id, 1, 1, 'domain', 'error', true, false FROM us WHERE f = 6
  UNION ALL SELECT id, 2, 0, NULL, 'u' || u || '.example', false, false FROM us WHERE f = 6
  UNION ALL SELECT id, 2, 1, NULL, 'CA', true, false FROM us WHERE f = 6
  UNION ALL SELECT -a, 0, 0, NULL, left(t, 2), false, false FROM ks
  UNION ALL SELECT -1000 - a, 0, 0, 'issuer', 'CA ' || t, false, true FROM ks
  UNION ALL SELECT -2000 - a, 0, 0, 'cn', '*', false, false FROM ks
  UNION ALL SELECT -2000 - a, 0, 1, 'cn', t, false, false FROM ks),
filters(search_id, after, before, wildcard, count_op, count_n) AS (
  SELECT id, CASE f WHEN 3 THEN 1704844800 WHEN 4 THEN 1704412800 END, CASE f WHEN 4 THEN 1704672000 WHEN 5 THEN 1705708800 END,
    CASE WHEN f = 5 THEN false END, CASE WHEN f = 2 THEN '=' END, CASE WHEN f = 2 THEN 1 END FROM us
  UNION ALL SELECT -a, NULL, NULL, NULL, NULL, NULL FROM ks
  UNION ALL SELECT -1000 - a, NULL, NULL, true, '>=', 1 FROM ks
  UNION ALL SELECT -2000 - a, NULL, NULL, NULL, NULL, NULL FROM ks)"""

MATCHES = f"""{TERMS}, tested AS (
  SELECT c.fingerprint, t.search_id, t.grp, t.negate <> CASE
    WHEN exact THEN CASE coalesce(col, '') WHEN 'domain' THEN list_contains(domains, txt) WHEN 'issuer' THEN {ORG} = txt
      WHEN 'cn' THEN {CN} = txt ELSE list_contains(domains, txt) OR {ORG} = txt OR {CN} = txt END
    WHEN col = 'domain' AND contains(txt, '.') THEN contains('|' || lower(array_to_string(domains, '|')) || '|', '|' || lower(txt) || '|')
      OR contains(lower(array_to_string(domains, '|')) || '|', '.' || lower(txt) || '|')
    ELSE CASE coalesce(col, '') WHEN 'domain' THEN contains(lower(array_to_string(domains, '|')), lower(txt))
      WHEN 'issuer' THEN contains(lower({ORG}), lower(txt)) WHEN 'cn' THEN contains(lower({CN}), lower(txt))
      ELSE contains(lower(array_to_string(domains, '|') || '|' || {ORG} || '|' || {CN}), lower(txt)) END END AS ok
  FROM certs c CROSS JOIN terms t),
matches AS (SELECT DISTINCT search_id, fingerprint FROM (
  SELECT search_id, grp, fingerprint FROM tested GROUP BY ALL HAVING bool_and(ok))
  JOIN filters USING (search_id) JOIN certs USING (fingerprint)
  WHERE (after IS NULL OR seen_at >= after) AND (before IS NULL OR seen_at < before)
    AND (wildcard IS NULL OR wildcard = (len(list_filter(domains, lambda d: d LIKE '*.%')) > 0))
    AND (count_op IS NULL OR (count_op = '=' AND domain_count = count_n) OR (count_op = '>=' AND domain_count >= count_n)))"""


def parsed_searches(spark, sf):
    return stored(searches.parse_searches(derived.saved_searches(spark, sf)), "searches")


@query("b27_search_terms", f'WITH {TERMS} SELECT search_id, grp, pos, col AS "column", txt AS text, negate, exact FROM terms')
def _(spark, sf):
    return searches.explode_searches(parsed_searches(spark, sf))


@query("b27_search_filters", f"WITH {TERMS} SELECT * FROM filters")
def _(spark, sf):
    return searches.search_filters(parsed_searches(spark, sf))


@query("b27_search_rejects", """SELECT event_id AS search_id, CASE event_id % 3 WHEN 0 THEN 'no search term'
  ELSE 'a group without a positive term' END AS reason FROM events WHERE event_id % 3 < 2""")
def _(spark, sf):
    """Searches made of filters only, of negated terms only, and a valid one."""
    kind = F.col("event_type")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("domain_count:>"), F.col("user_id").cast("string")))
        .when(F.col("event_id") % 3 == 1, F.concat(kind, F.lit(" or -"), kind))
        .otherwise(kind)
    )
    made = derived.events(spark, sf).select(F.col("event_id").alias("search_id"), text.alias("text"))
    return searches.search_rejects(searches.parse_searches(made))


# --- Joins -----------------------------------------------------------------------------------


@query("c1_anti_join", f"""{CERTS}, known AS (SELECT DISTINCT fingerprint FROM certs WHERE seen_at < {JAN_20})
  SELECT cert_index FROM certs WHERE seen_at >= {JAN_10} AND fingerprint NOT IN (SELECT fingerprint FROM known)""")
def _(spark, sf):
    from certloom.operators.tables import insert_new

    c = derived.certs(spark, sf)
    return insert_new(c.filter(F.col("seen_at") < JAN_20), c.filter(F.col("seen_at") >= JAN_10)).select("cert_index")


@query("c2_semi_join", f"{CERTS} SELECT cert_index FROM certs WHERE {GITHUB_SQL}")
def _(spark, sf):
    """Text hits to rows: the text test is a filter on the scan itself."""
    return search.search(derived.certs(spark, sf), GITHUB).select("cert_index")


@query("c3_exists_in_array", f"""{CERTS} SELECT cert_index, EXISTS (SELECT 1 FROM unnest(domains) t(d) WHERE d LIKE '%.uk') AS some,
  NOT EXISTS (SELECT 1 FROM unnest(domains) t(d) WHERE d LIKE '*.%') AS none FROM certs""")
def _(spark, sf):
    some = F.exists("domains", lambda d: F.endswith(d, F.lit(".uk")))
    return flags(spark, sf, some=some, none=~hosts.has_wildcard(F.col("domains")))


@query("c4_conflict_ignoring_insert", "WITH " + certs_sql(copies=3) + """ SELECT fingerprint, cert_index FROM certs
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seen_at, log_url, cert_index) = 1""")
def _(spark, sf):
    from certloom.operators.tables import insert_new

    c = derived.certs_of(derived.events(spark, sf), copies=3)
    return insert_new(c.limit(0), c).select("fingerprint", "cert_index")


HOLES = "holes AS (SELECT DISTINCT seen_at - seen_at % 3600 AS period_start FROM certs WHERE seen_at // 3600 % 5 <> 0)"


def stats_with_holes(spark, sf):
    """Hourly rows where every fifth hour is missing."""
    c = derived.certs(spark, sf)
    return periods.period_basics(c, periods.HOUR).filter((F.col("period_start") / 3600) % 5 != 0)


@query("c5_missing_periods", f"""{CERTS}, {HOLES} SELECT p AS period_start FROM range({JAN_10}, {JAN_20}, 3600) t(p)
  WHERE p NOT IN (SELECT period_start FROM holes)""")
def _(spark, sf):
    return periods.missing_periods(stats_with_holes(spark, sf), JAN_10, JAN_20, 3600)


@query("c6_match_searches", f"{CERTS}, {MATCHES} SELECT * FROM matches")
def _(spark, sf):
    return searches.match_searches(derived.certs(spark, sf), searches.parse_searches(derived.saved_searches(spark, sf)))


@query("c6_match_counts", f"""{CERTS}, {MATCHES} SELECT search_id, count(fingerprint) AS n FROM filters LEFT JOIN matches USING (search_id) GROUP BY 1""")
def _(spark, sf):
    """Counts of all searches, also of those without a match."""
    parsed = parsed_searches(spark, sf)
    hits = searches.match_searches(derived.certs(spark, sf), parsed).groupBy("search_id").agg(F.count(F.lit(1)).alias("n"))
    return searches.search_filters(parsed).select("search_id").join(hits, "search_id", "left").na.fill(0, ["n"])


@query("c6_null_names", f"{NULLED}, {MATCHES} SELECT * FROM matches")
def _(spark, sf):
    """Certificates without names are found by issuer and subject."""
    return searches.match_searches(derived.nulled_certs(spark, sf), searches.parse_searches(derived.saved_searches(spark, sf)))


@query("c7_suffix_join", CERTS + NAMES + ", " + registrable_sql("names", "d") + """
  SELECT registrable, count(*) AS n FROM names JOIN reg USING (d) GROUP BY 1""")
def _(spark, sf):
    names = domain_counts(derived.certs(spark, sf))
    return registrable_domain(names, "domain", seed_rules(spark)).groupBy("registrable").agg(F.sum("n").alias("n"))


GRAMS = """txts AS (SELECT fingerprint, unnest(list_concat(domains, [coalesce(issuer_org, ''), coalesce(subject_cn, '')])) AS v FROM certs),
grams AS (SELECT DISTINCT fingerprint, lower(v[i:i + 2]) AS gram FROM (SELECT fingerprint, v, unnest(range(1, len(v) - 1)) AS i FROM txts))"""


@query("c8_trigrams", f"{CERTS}, {GRAMS} SELECT gram, count(*) AS n FROM grams GROUP BY 1")
def _(spark, sf):
    return searches.trigram_counts(searches.trigrams(derived.certs(spark, sf)))


@query("c8_trigram_candidates", f"""{CERTS}, {GRAMS}, t AS (SELECT DISTINCT user_id AS text_id, 'u' || user_id || '.net' AS txt FROM events),
  tg AS (SELECT DISTINCT text_id, txt[i:i + 2] AS gram FROM (SELECT *, unnest(range(1, len(txt) - 1)) AS i FROM t)),
  tn AS (SELECT text_id, count(*) AS k FROM tg GROUP BY 1)
  SELECT text_id, fingerprint FROM grams JOIN tg USING (gram) JOIN tn USING (text_id) GROUP BY text_id, fingerprint, k HAVING count(*) = k""")
def _(spark, sf):
    users = derived.events(spark, sf).select(F.col("user_id").alias("text_id")).distinct()
    texts = users.withColumn("text", F.concat(F.lit("u"), F.col("text_id").cast("string"), F.lit(".net")))
    return searches.trigram_candidates(derived.certs(spark, sf), texts)


INDEXED = SearchSpec([[Term("github"), Term("error", "issuer", negate=True)], [Term("click7", "domain")]], after=JAN_10)


@query("c8_index_search", f"""{CERTS} SELECT cert_index, seen_at FROM certs WHERE seen_at >= {JAN_10}
  AND (({GITHUB_SQL}) OR {any_name("contains(d, 'click7')")})""")
def _(spark, sf):
    """A search by stored postings, a part of which came with an insert and a part of which was compacted."""
    path, c = scratch_dir(spark, "indexed"), derived.certs(spark, sf)
    tables.rewrite_daily(c.filter(F.col("seen_at") < JAN_15), path)
    postings.build(spark, path)
    tables.append_new(spark, path, c.filter(F.col("seen_at") >= JAN_10))
    tables.compact_days(spark, path, date(2024, 1, 12), date(2024, 1, 18))
    return postings.index_search(spark, path, INDEXED).select("cert_index", "seen_at")


@query("f2_deep_page", f"{CERTS} SELECT {FLAT} FROM certs WHERE {GITHUB_SQL} {NEWEST} LIMIT 20 OFFSET 140")
def _(spark, sf):
    """Page 8 of 20 rows by rank: no sort of the rows before it."""
    return flat(search.page_by_rank(derived.certs(spark, sf), GITHUB, 8, 20))


@query("g1_union_of_groups", f"{CERTS} SELECT cert_index FROM certs WHERE {any_name("contains(d, 'github')")} OR {ORG} = 'CA view'")
def _(spark, sf):
    spec = SearchSpec([[Term("github", "domain")], [Term("CA view", "issuer", exact=True)]])
    return search.search(derived.certs(spark, sf), spec).select("cert_index")


@query("g2_period_difference", f"""{CERTS}, {HOLES}, every AS (SELECT DISTINCT seen_at - seen_at % 3600 AS period_start FROM certs)
  SELECT period_start FROM every EXCEPT SELECT period_start FROM holes""")
def _(spark, sf):
    c = derived.certs(spark, sf)
    every = c.select(times.hour_bucket(F.col("seen_at")).alias("period_start")).distinct()
    return every.join(stats_with_holes(spark, sf).select("period_start"), "period_start", "left_anti")


@query("d17_match_count", f"{CERTS} SELECT count(*) AS total, cast(ceil(count(*) / 50) AS bigint) AS total_pages FROM certs WHERE {GITHUB_SQL}")
def _(spark, sf):
    return search.match_count(derived.certs(spark, sf), GITHUB, 50)
