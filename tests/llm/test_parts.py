"""How many files the steps of the near-duplicate stage write: each costs its executor two processes."""

import glob
import os
from urllib.parse import urlparse

import pytest

from certloom.llm import components, decontaminate, simhash
from certloom.session import shared_dir


@pytest.fixture
def wide(spark):
    """Many shuffle partitions that are not joined; gives a count of the files of a label written since."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    folder = urlparse(shared_dir(spark)).path
    listed = lambda label: set(glob.glob(os.path.join(folder, f"{label}-*", "part-*")))
    old = {label: listed(label) for label in ("distinct", "same", "templates", "leaks")}
    yield lambda label: len(listed(label) - old[label])
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_small_link_tables_are_few_parts(spark, wide):
    pairs = spark.range(1, 2001).selectExpr("id AS a", "id - id % 20 AS b")
    found = components.components(pairs, most=2000)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert found.where("root <> node - node % 20").count() == 0
    assert found.count() == 1900  # multiples of 20 are roots
    wide_first = components.components(pairs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wide_first.collect()))


def test_stages_write_small_tables_as_few_files(spark, wide):
    cores = spark.sparkContext.defaultParallelism
    rows = [(k, f"text {k} about {k * 7} things and {k * 13} more of them, {k % 9}") for k in range(600)]
    docs = spark.createDataFrame(rows + [(k + 600, t) for k, t in rows[:300]], "doc_id long, text string")
    assert simhash.keep_first(docs).count() <= 600
    assert 0 < wide("distinct") <= cores and 0 < wide("same") <= cores
    items = spark.createDataFrame([(k, f"a question about {'abcdefghij'[k % 10] * 3} and some {'klmnopqrst'[k // 10] * 4} that nobody asked") for k in range(100)], "item_id long, text string")
    leaked = docs.union(items.selectExpr("item_id + 10000", "text"))
    assert decontaminate.keep_clean(leaked, items).where("doc_id >= 10000").count() == 0
    assert 0 < wide("templates") <= cores and 0 < wide("leaks") <= cores


def test_bounds_grow_with_the_rows(spark):
    from certloom.llm.runtime import FILE_ROWS, gathered

    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 10 * cores)
    assert gathered(many, 1000).rdd.getNumPartitions() == cores
    assert gathered(many, 5 * cores * FILE_ROWS).rdd.getNumPartitions() == 5 * cores
    assert gathered(many, 50 * cores * FILE_ROWS).rdd.getNumPartitions() == 10 * cores
