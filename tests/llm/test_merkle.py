"""The Merkle manifest against a plain one, built node by node, and on awkward tables."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from certloom.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, h string, g int, path string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def climb(hashes, arity):
    """(root, siblings left and right of each leaf, a level at a time)."""
    ways, place = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for way, i in zip(ways, place):
            start = i - i % arity
            way.append(("".join(hashes[start:i]), "".join(hashes[i + 1 : start + arity])))
        hashes = [H(*hashes[k : k + arity]) for k in range(0, len(hashes), arity)]
        place = [i // arity for i in place]
    return hashes[0], ways


def plain(rows, arity=16):
    groups = {}
    for r in rows:
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    trees = []
    for key in sorted(groups):
        own = sorted(groups[key], key=lambda r: (r["doc_id"] is not None, r["doc_id"], leaf(r, r["text"])))
        trees.append((own, *climb([leaf(r, r["text"]) for r in own], arity)))
    root, tops = climb([t[1] for t in trees], arity)
    found = []
    for (own, subroot, ways), top in zip(trees, tops):
        for r, way in zip(own, ways):
            way = way + top
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            at = leaf(r, text)
            for left, right in way:
                at = H(left, at, right)
            found.append((r["doc_id"], leaf(r, r["text"]), subroot, root, H(*[a + b for a, b in way]), at, at == root))
    return found


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_whole_table_equals_a_plain_manifest(spark):
    got = queries.op11_merkle(spark, SF)
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got.columns == COLUMNS and in_order(got.collect()) == in_order(plain(rows))
    assert 0 < got.where("NOT verified").count() < len(rows)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_groups_of_all_sizes(spark, arity):
    """A hot group of several levels, groups of one, null and empty names, names that sort by bytes, null and repeated rows."""
    made = [(i, "hot", "en", i, f"Text {i}") for i in range(300)]
    for k, name in enumerate([None, "", "one", "é", "Z", "z", "\U0001f600", "～", *[f"s{j}" for j in range(20)]]):
        made += [(1000 + 40 * k + i, name, None, None, [None, "", "ABC é", "x" * 70_000][i % 4]) for i in range(1 + k)]
    made += [(5000, "rep", "en", 1, "Same")] * 19 + [(5000, "rep", "en", 1, "Other"), (None, "rep", "en", 1, "No id"), (None, "rep", None, 2, "No id")]
    frame = spark.createDataFrame([(*m, "h", 3, "p") for m in made], SCHEMA).repartition(7)
    rows = [dict(zip(SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), m)) for m in made]
    assert in_order(merkle.manifest(frame, arity=arity).collect()) == in_order(plain(rows, arity))


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(0, None, None, None, None, "", 0, "")], SCHEMA)
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == H("1:0----") and row["verified"]
    assert row["proof_sha256"] == H()
    assert merkle.manifest(one.limit(0)).count() == 0


def test_numbering_does_not_gather_a_group(spark):
    """Places are counted over ranges, however the rows lie; no window is dealt by the group's rows."""
    rows = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 5000).alias("k"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle.numbered(rows, ["k"], "test")
        assert got.where("i <> k OR n <> 5000").count() == 0 and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
