"""Host names: wildcard tests, normal form and name checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that is cut from both ends of a name.
BLANKS = " \t\n\x0b\x0c\r"

IPV4_SHAPE = r"\A[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\z"

# A label has 1 to 63 letters, digits, `-` or `_` and no dash at either end; a name has at most 255 characters.
LABEL = r"[a-z0-9_\x{80}-\x{10FFFF}](?:[a-z0-9_\x{80}-\x{10FFFF}-]{0,61}[a-z0-9_\x{80}-\x{10FFFF}])?"
HOST_FORM = rf"\A{LABEL}(?:\.{LABEL})*\z"


def is_wildcard(c: Column) -> Column:
    return F.startswith(c, F.lit("*."))


def has_wildcard(domains: Column) -> Column:
    """True when any name starts with `*.`."""
    return F.coalesce(F.exists(domains, lambda d: F.coalesce(is_wildcard(d), F.lit(False))), F.lit(False))


def wildcard_sans(domains: Column) -> Column:
    """Number of names that start with `*.`."""
    return F.coalesce(F.size(F.filter(domains, is_wildcard)), F.lit(0))


def is_ipv4_shape(c: Column) -> Column:
    """Four groups of one to three digits; the values are not checked."""
    return c.rlike(IPV4_SHAPE)


def bare_name(c: Column) -> Column:
    """Lower case, no outer white space, no leading `*.`."""
    name = F.btrim(F.lower(c), F.lit(BLANKS))
    return F.when(is_wildcard(name), F.substring(name, 3, 2147483647)).otherwise(name)


def drop_root_dot(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit(".")), F.left(c, F.length(c) - 1)).otherwise(c)


def split_host(c: Column) -> Column:
    """Labels of a host; one trailing dot is tolerated."""
    return F.split(drop_root_dot(c), r"\.")


def is_host_name(c: Column) -> Column:
    return (F.length(c) <= 255) & c.rlike(HOST_FORM)
