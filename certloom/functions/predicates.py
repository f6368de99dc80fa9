"""Search predicates as Columns, so that one search is one filter on the certificate scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from certloom.functions.hosts import has_wildcard

DOMAIN, ISSUER, CN = "domain", "issuer", "cn"
FIELDS = {ISSUER: "issuer_org", CN: "subject_cn"}
COUNT_OPERATORS = (">", ">=", "<", "<=", "=")


class SearchError(ValueError):
    """The search has no term, or a group without a positive term."""


@dataclass(frozen=True)
class Term:
    text: str
    column: str | None = None
    negate: bool = False
    exact: bool = False


@dataclass(frozen=True)
class SearchSpec:
    """Groups are joined by OR, terms in a group by AND; the other fields hold for all groups."""

    groups: Sequence[Sequence[Term]]
    after: int | None = None
    before: int | None = None
    wildcard: bool | None = None
    count_op: str | None = None
    count_n: int | None = None
    case_sensitive: bool = field(default=False, kw_only=True)


def _any_domain(test) -> Column:
    return F.coalesce(F.exists(F.col("domains"), lambda d: F.coalesce(test(d), F.lit(False))), F.lit(False))


def _scoped(column: str | None, domain_test, field_test) -> Column:
    if column == DOMAIN:
        return _any_domain(domain_test)
    if column in FIELDS:
        return field_test(F.coalesce(F.col(FIELDS[column]), F.lit("")))
    if column is not None:
        raise ValueError(f"unknown search column {column!r}")
    return reduce(or_, [_scoped(c, domain_test, field_test) for c in (DOMAIN, ISSUER, CN)])


def term_contains(column: str | None, text: str, case_sensitive: bool = False) -> Column:
    """Literal substring in the domains, the issuer, the subject, or any of them."""
    fold = (lambda c: c) if case_sensitive else F.lower
    return _scoped(
        column,
        lambda d: F.contains(fold(d), fold(F.lit(text))),
        lambda c: F.contains(fold(c), fold(F.lit(text))),
    )


def term_equals(column: str | None, text: str) -> Column:
    return _scoped(column, lambda d: d == F.lit(text), lambda c: c == F.lit(text))


def domain_boundary(text: str, case_sensitive: bool = False) -> Column:
    """A domain equal to `text` or below it."""
    fold = (lambda c: c) if case_sensitive else F.lower
    name = fold(F.lit(text))
    return _any_domain(lambda d: (fold(d) == name) | F.endswith(fold(d), F.concat(F.lit("."), name)))


def not_term(p: Column) -> Column:
    return ~F.coalesce(p, F.lit(False))


def term_matches(term: Term, case_sensitive: bool = False) -> Column:
    if term.exact:
        p = term_equals(term.column, term.text)
    elif term.column == DOMAIN and "." in term.text:
        p = domain_boundary(term.text, case_sensitive)
    else:
        p = term_contains(term.column, term.text, case_sensitive)
    return not_term(p) if term.negate else p


def _day(seconds: int) -> date | None:
    day = seconds // 86400
    return date(1970, 1, 1) + timedelta(days=day) if -719162 <= day <= 2932896 else None


def seen_between(after: int | None = None, before: int | None = None) -> Column:
    """`after <= seen_at < before`, with the day bounds that let partitions be skipped."""
    tests = []
    if after is not None:
        tests.append(F.col("seen_at") >= after)
        if _day(after):
            tests.append(F.col("seen_date") >= F.lit(_day(after)))
    if before is not None:
        tests.append(F.col("seen_at") < before)
        if _day(before - 1):
            tests.append(F.col("seen_date") <= F.lit(_day(before - 1)))
    return reduce(and_, tests, F.lit(True)) if tests else F.lit(True)


def domain_count_cmp(op: str, n: int) -> Column:
    c = F.col("domain_count")
    comparisons = {">": c > n, ">=": c >= n, "<": c < n, "<=": c <= n, "=": c == n}
    if op not in comparisons:
        raise ValueError(f"unknown comparison {op!r}")
    return comparisons[op]


def match_spec(spec: SearchSpec) -> Column:
    """The whole search as one Column."""
    if not spec.groups or not all(spec.groups):
        raise SearchError("a search needs at least one search term")
    if not all(any(not t.negate for t in group) for group in spec.groups):
        raise SearchError("each OR group needs at least one positive term")
    matched = reduce(
        or_, [reduce(and_, [term_matches(t, spec.case_sensitive) for t in group]) for group in spec.groups]
    )
    tests = [matched, seen_between(spec.after, spec.before)]
    if spec.wildcard is not None:
        wild = has_wildcard(F.col("domains"))
        tests.append(wild if spec.wildcard else ~wild)
    if spec.count_op is not None:
        tests.append(domain_count_cmp(spec.count_op, spec.count_n))
    return reduce(and_, tests)
