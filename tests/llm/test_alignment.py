"""Token alignment against a plain version: byte sets, all pairs of a group, counts over whole documents."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from certloom.llm import alignment, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_a long, pair long, row string"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    with open(path) as file:
        vocab = {i: bytes(letters[c] for c in t) for t, i in json.load(file)["model"]["vocab"].items() if all(c in letters for c in t)}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        a = [(i, vocab[i]) for i in whole.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in model.encode(text)]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    return both


def plain_groups(a, b):
    """[(A ids, B ids)] of a document."""
    ends = []
    for tokens in (a, b):
        at, found = 0, {}
        for i, spelt in tokens:
            at += len(spelt)
            found[at] = i
        ends.append(found)
    groups, own = [], ([], [])
    for at in sorted(set(ends[0]) | set(ends[1])):
        for k in (0, 1):
            if at in ends[k]:
                own[k].append(ends[k][at])
        if at in ends[0] and at in ends[1]:
            groups.append(own)
            own = ([], [])
    return groups


def plain(texts, both):
    groups = [plain_groups(*both(t)) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(p for found in links for p in found)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for g, found in zip(groups, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()),
            sum(n for p, n in found.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in found.items()),
            hashlib.sha256(shown.encode()).hexdigest() if g else "",
        ))
    return rows


def strange(n, seed):
    rnd = random.Random(seed)
    parts = [" ", " ", " word", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "23", ".", ",", "'s", "中文", "😀", "é", "İ", "▁", "<s>", "<|endoftext|>", "<0x0A>", "\x1c", "\x85", "ﬁ", "\r\n", "\x00", "aaaa", "　", "ing", "�"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 7, 7, "x") for k, t in enumerate(texts)], SCHEMA)


def as_rows(found):
    return [tuple(r[c] for c in COLUMNS) for r in found.orderBy("doc_id").collect()]


def test_whole_table_equals_brute_force(spark, libraries):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    got = queries.op12_alignment(spark, SF)
    assert got.columns == ["doc_id", *COLUMNS] and as_rows(got) == plain([docs[i] for i in ids], libraries)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_strange_texts_equal_brute_force(spark, libraries, frequent):
    """Also where few or no pairs are looked up in the tasks."""
    texts = [None, "", "▁", "a▁b", "one two", "one two", " lead", "tail ", "x" * 5000, "中" * 3000, "word another thing again here " * 20_000, *strange(400, 3)]
    want = plain(texts, libraries)
    assert as_rows(alignment.align(frame(spark, texts), frequent=frequent)) == want
    assert want[0] == want[1] == want[2] == want[3] == (0, 0, 0, 0, 0, 0, "") and want[4][0] > 0


def test_groups_as_text_and_other_columns(spark, libraries):
    texts = ["one two\nthree", None, "émigré 中文"]
    shown = [r["groups"] for r in alignment.alignments(frame(spark, texts), with_groups=True).orderBy("id").collect()]
    assert shown == [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups(*libraries(t))) for t in texts]


def test_repeated_null_ids_and_empty_tables(spark):
    rows = [(None, "one two"), (1, "one two"), (1, "three"), (None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in alignment.align(made).collect())
    assert [g[:3] for g in got] == [(False, 1, 1), (False, 1, 2), (True, 0, 0), (True, 0, 2)] and got[1][3] == got[3][3] == 4
    assert alignment.align(made.limit(0)).count() == 0


def test_wide_groups_count_equal_ids_once():
    """A group of many tokens gives the same pairs as its expansion."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 120), rng.integers(0, 7, 90)
    groups = tuple(np.array(x) for x in ([0, 110], [109, 119], [0, 85], [84, 89]))
    keys, links = alignment._linked(groups, a, b, np.array([0, 1]), 10, 100)
    want = Counter((x * 10 + y) for x in a[:110] for y in b[:85]) + Counter(100 + x * 10 + y for x in a[110:] for y in b[85:])
    assert dict(zip(keys.tolist(), links.tolist())) == want and 110 * 85 > alignment._WIDE
