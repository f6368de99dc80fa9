"""The similarity join against all pairs of sets, and its parts against what they promise."""

import random
import re

import numpy as np
import pytest

from certloom.llm import jaccard_join, queries
from certloom.llm.simhash import shingle_set

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, node long, n long, keys string, id long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, 2, "k", 9) for i, t in zip(ids if ids is not None else range(len(texts)), texts)], SCHEMA)


def plain(texts, words=3, percent=90):
    """(set size, least index reachable) of each text, by all pairs."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set() for w in split]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def families(seed, sizes, changes, vocabulary=4000):
    """Texts around originals, with words changed, added and dropped."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    texts = []
    for size in sizes:
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        for n in changes:
            copy = list(base)
            for _ in range(n):
                k = rng.randrange(len(copy))
                kind = rng.randrange(4)
                if kind == 0:
                    copy[k] = word()
                elif kind == 1:
                    copy.insert(k, word())
                elif kind == 2 and len(copy) > 1:
                    del copy[k]
                else:
                    copy.append(word())
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def as_rows(found):
    return [(r["n_shingles"], r["component_id"]) for r in found.orderBy("doc_id").collect()]


def test_whole_table_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    got = queries.op13_jaccard_join(spark, SF)
    want = [(n, ids[k]) for n, k in plain([docs[i] for i in ids])]
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and as_rows(got) == want
    assert any(ids[k] != w[1] for k, w in enumerate(want))


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 3])
def test_families_of_all_sizes_equal_brute_force(spark, monkeypatch, block):
    """Around the boundary between small and large sets, and with lists cut into several blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    sizes = [*range(1, 45), 60, 90, 150, 400]
    texts = [None, "", " \n", *families(4, sizes, (0, 1, 1, 1, 2, 2, 3)), *families(5, [200], [2] * 60 + [4] * 40)]
    want = plain(texts)
    assert as_rows(jaccard_join.similar_sets(frame(spark, texts))) == want
    linked = [n for k, (n, root) in enumerate(want) if root != k]
    assert min(linked) < 12 and max(linked) > 300 and want[0] == (0, 0) and want[1] == (0, 1)


@pytest.mark.parametrize("words,percent", [(5, 80), (1, 60)])
def test_other_shingles_and_thresholds(spark, words, percent):
    texts = families(6, [3, 8, 12, 20, 30, 60], (1, 1, 2, 3, 4), vocabulary=300)
    got = jaccard_join.similar_sets(frame(spark, texts), words=words, percent=percent)
    assert as_rows(got) == plain(texts, words, percent)


def test_repeated_null_ids_and_empty_tables(spark):
    texts = ["a b c d", "a b c d", None, "A  b c\td", "", "x y", "é " * 30_000]
    made = frame(spark, texts, [None, 7, 7, 3, None, None, 1])
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.similar_sets(made).collect())
    assert got == sorted([("None", 2, "3"), ("7", 2, "3"), ("7", 0, "7"), ("3", 2, "3"), ("None", 0, "None"), ("None", 1, "None"), ("1", 1, "1")])
    assert jaccard_join.similar_sets(made.limit(0)).count() == 0


def test_similar_sets_share_a_list():
    rng = np.random.default_rng(1)
    for size in [*range(10, 40), 77, 200, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            for b_size in {-(-9 * size // 10), size, 10 * size // 9}:
                common = int(jaccard_join.least_common(size, b_size))
                if common <= min(size, b_size):
                    b = np.concatenate((a[:common], rng.integers(0, 1 << 63, b_size - common, dtype=np.uint64)))
                    assert np.intersect1d(jaccard_join.list_keys(a), jaccard_join.list_keys(b)).size or np.array_equal(np.sort(a), np.sort(b))


def test_only_equal_sets_need_no_subsets():
    assert [n for n in range(1, 12) if not jaccard_join.subset_sizes(n)] == list(range(1, 9)) and jaccard_join.subset_sizes(10) == [9, 10]


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 400, rng.integers(1, 300), dtype=np.uint64) for _ in range(2))
        a, b = np.unique(a), np.unique(b)
        differ = np.bitwise_count(jaccard_join.parity_sketch(a) ^ jaccard_join.parity_sketch(b)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_a_forest_ties_what_its_edges_tie():
    rng = np.random.default_rng(3)
    for n in (2, 30, 200):
        i, j = rng.integers(0, n, 2 * n), rng.integers(0, n, 2 * n)
        label = rng.integers(0, n, n)
        kept = jaccard_join.spanning_forest(label, i, j)

        def classes(edges):
            root = {x: x for x in range(n)}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for k in edges:
                root[find(int(label[i[k]]))] = find(int(label[j[k]]))
            return {frozenset(y for y in range(n) if find(y) == find(x)) for x in range(n)}

        assert classes(kept) == classes(range(len(i))) and len(kept) < n


def test_the_boundary_is_where_enumeration_stops_being_cheaper(spark):
    """Sets that meet nobody on the lists are not worth enumerating; sets that meet many are."""
    alone = [" ".join(f"{k}x{j}" for j in range(17)) for k in range(40)]
    crowd = [" ".join(f"w{j}" for j in range(16)) + f" z{k}" for k in range(40)]
    found = []
    for texts in (alone, alone + crowd):
        prints = jaccard_join._prints(frame(spark, texts), "doc_id", "text", 3, 90)
        found.append(jaccard_join.boundary(prints.dropDuplicates(["node"])))
    assert found[0] < 15 <= found[1]


def test_shingles_are_those_of_the_contract():
    assert len(shingle_set("A b  c\x0bd A b c", 3)) == 4 and len(shingle_set("One two", 3)) == 1 and len(shingle_set("\x85", 3)) == 1
