import pytest

from certloom.functions import hosts
from certloom.operators.domains import registrable_domain
from certloom.plans.registry import SEEDS
from certloom.sources.suffixes import load_rules, seed_rules

NO_NAMES = ["", None, "*", "*.", "*.*.a.net", "192.0.2.7", "a_b c.net", "-a.net", "a-.net", "a..net", f"{'a' * 64}.net", "printer.local"]


def plain_registrable(name):
    """The longest listed suffix and one label more, by trying every ending; unlisted endings count as one label."""
    host = (name or "").strip().lower().removeprefix("*.").removesuffix(".")
    labels = host.split(".")
    suffix = max((len(s.split(".")) for s in SEEDS if host == s or host.endswith("." + s)), default=1)
    return ".".join(labels[-suffix - 1 :]) if len(labels) > suffix else None


def generated():
    """Every seed suffix and some unlisted ones, alone and below one to three labels, in several spellings."""
    for suffix in [*SEEDS, "lan", "intern.corp", "xn--p1ai"]:
        for depth in range(4):
            name = ".".join([f"l{d}" for d in range(depth)] + [suffix])
            yield from (name, name + ".", name.upper(), f"*.{name}", f" {name}\t")


@pytest.mark.parametrize("via", ["lookup", "shuffle"])
def test_registrable_domain(spark, via):
    cases = [(n, plain_registrable(n)) for n in generated()] + [(n, None) for n in NO_NAMES]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, d string")
    got = registrable_domain(df, "d", seed_rules(spark), via=via).orderBy("i").collect()
    assert [(r["d"], r["registrable"]) for r in got] == cases


@pytest.mark.parametrize("via", ["lookup", "shuffle"])
def test_rule_kinds(spark, via):
    table = spark.createDataFrame(
        [("jp", "normal"), ("kobe.jp", "wildcard"), ("city.kobe.jp", "exception"), ("ck", "wildcard"), ("www.ck", "exception")],
        "suffix string, kind string",
    )
    cases = {
        "a.b.c.kobe.jp": "b.c.kobe.jp",
        "c.kobe.jp": None,
        "kobe.jp": "kobe.jp",
        "city.kobe.jp": "city.kobe.jp",
        "x.city.kobe.jp": "city.kobe.jp",
        "ck": None,
        "foo.ck": None,
        "a.foo.ck": "a.foo.ck",
        "www.ck": "www.ck",
        "a.www.ck": "www.ck",
    }
    df = spark.createDataFrame([(d,) for d in cases], "d string")
    got = registrable_domain(df, "d", load_rules(table), via=via).collect()
    assert {r["d"]: r["registrable"] for r in got} == cases


def test_wildcard_names(spark):
    names = [f"{mark}x.example" for mark in ("*.", "*.y.", "", "y.*.", "*")] + ["*", ""]
    df = spark.createDataFrame([(n,) for n in names], "d string")
    assert [r[0] for r in df.select(hosts.is_wildcard(df.d)).collect()] == [n.startswith("*.") for n in names]


def test_split_host(spark):
    df = spark.createDataFrame([("a.b.com.",), ("com",)], "d string")
    assert [r[0] for r in df.select(hosts.split_host(df.d)).collect()] == [["a", "b", "com"], ["com"]]
