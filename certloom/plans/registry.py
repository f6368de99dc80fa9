"""Register of checked queries: a Spark query and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def flat(df: DataFrame) -> DataFrame:
    """Names as one text and the day as text, so that rows compare as plain values."""
    return df.withColumns({"domains": F.array_join("domains", "|"), "seen_date": F.col("seen_date").cast("string")})


# --- SQL of the derived inputs ---------------------------------------------------------------

FLAT = """fingerprint, array_to_string(domains, '|') AS domains, domain_count, issuer_org, issuer_cn, subject_cn,
  not_before, not_after, serial_number, log_name, log_url, cert_index, cert_link, seen_at, created_at,
  cast(seen_date AS varchar) AS seen_date"""


def certs_sql(copies: int = 1, name: str = "certs") -> str:
    key = "event_id" if copies == 1 else f"event_id // {copies}"
    return f"""{name}_k AS (
  SELECT *, cast(json_extract_string(props, '$.k') AS integer) AS k, epoch_us(ts) // 1000000 AS sec,
    cast(user_id AS varchar) AS u FROM events),
{name}_d AS (
  SELECT *, CASE k % 4
    WHEN 0 THEN ['www.u' || u || '.co.uk', '*.u' || u || '.co.uk']
    WHEN 1 THEN [event_type || '.u' || u || '.example.com']
    WHEN 2 THEN ['u' || u || '.github.io', 'a.b.u' || u || '.net', 'github.io']
    ELSE ['*.' || event_type || cast(k AS varchar) || '.org'] END AS domains FROM {name}_k),
{name} AS (
  SELECT md5(cast({key} AS varchar)) AS fingerprint, domains, cast(len(domains) AS integer) AS domain_count,
    CASE WHEN k % 10 <> 0 THEN 'CA ' || event_type END AS issuer_org,
    CASE WHEN k % 10 <> 0 THEN 'CA ' || event_type || ' R' || (k % 3) END AS issuer_cn,
    CASE WHEN k % 7 <> 0 THEN domains[1] END AS subject_cn,
    sec - 3600 * (k % 24) AS not_before, sec - 3600 * (k % 24) + 7776000 AS not_after,
    'SN' || event_id AS serial_number, 'log' || (user_id % 5) AS log_name,
    'https://log' || (user_id % 5) || '.example/' AS log_url, event_id AS cert_index,
    'https://log' || (user_id % 5) || '.example/entry/' || event_id AS cert_link,
    sec AS seen_at, sec + 60 AS created_at, cast(ts AS date) AS seen_date
  FROM {name}_d)"""


CERTS = "WITH " + certs_sql()
# The certificates with no names at all in every third row.
NULLED = "WITH " + certs_sql(name="raw") + """, certs AS (
  SELECT * REPLACE (CASE WHEN cert_index % 3 <> 0 THEN domains ELSE [] END AS domains) FROM raw)"""
COPIED = "WITH " + certs_sql(copies=2)
WILD = "len(list_filter(domains, lambda d: d LIKE '*.%')) > 0"

SEEDS = "com net org io app uk jp au co.uk co.jp com.au github.io herokuapp.com netlify.app".split()


def registrable_sql(source: str, column: str, rules: list[tuple[str, str]] | None = None) -> str:
    """CTE `reg(d, registrable)` for the distinct names of `source.column`."""
    rules = rules or [(s, "normal") for s in SEEDS]
    values = ", ".join(f"('{s}', '{k}')" for s, k in rules)
    label = "[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?"
    return f"""rules(suffix, kind) AS (VALUES {values}),
bare AS (SELECT DISTINCT {column} AS d, regexp_replace(lower(trim({column}, E' \\t\\n\\r\\x0b\\x0c')), '^\\*\\.', '') AS b FROM {source}),
host AS (SELECT d, b, CASE WHEN b LIKE '%.' THEN b[:-2] ELSE b END AS h, string_split(h, '.') AS l FROM bare),
tail AS (SELECT d, l, n, array_to_string(l[len(l) - n + 1:], '.') AS t
  FROM (SELECT d, l, unnest(range(1, len(l) + 1)) AS n FROM host)),
public AS (SELECT d, max(CASE kind WHEN 'exception' THEN n - 1 END) AS e,
    greatest(1, coalesce(max(CASE kind WHEN 'normal' THEN n WHEN 'wildcard' THEN CASE WHEN len(l) > n THEN n + 1 END END), 1)) AS p
  FROM tail LEFT JOIN rules ON t = suffix GROUP BY d),
reg AS (SELECT d, CASE WHEN regexp_full_match(h, '{label}(\\.{label})*') AND len(h) <= 255 AND l[len(l)] <> 'local'
      AND NOT regexp_full_match(b, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') AND len(l) > coalesce(e, p)
    THEN array_to_string(l[len(l) - coalesce(e, p):], '.') END AS registrable
  FROM host JOIN public USING (d))"""
