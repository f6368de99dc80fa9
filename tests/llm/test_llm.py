"""Each training-data operator against a plain version of it, and on awkward rows and tables."""

import collections
import hashlib
import itertools
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from certloom.llm import byte_ids, components, decontaminate, language, packing, pages, pii, quality, queries, shards, simhash, syncmers, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string"


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "x") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and long texts, a null and repeated ids, columns named like the operators' own."""
    long = "word another thing again here " * 20_000
    return frame(spark, [None, "", " \n\t", "one two", "one two", long, "é" * 50, "one two", "tail"], [0, 1, 2, 3, 4, 5, 6, 4, None])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# --- op1 ---


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    bits = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(grams))


def plain_components(texts, radius=2):
    """(fingerprint, least id reachable) of each text, by all pairs."""
    prints = {i: plain_print(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (prints[i], find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in plain_components(texts).items()}


def test_one_document_of_each_group_stays(spark, docs, texts):
    want = {i for i, (_, c) in plain_components(texts).items() if c == i}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_rows_with_one_id_are_documents_each(spark):
    """Of equal rows one stays; different texts of one id all stay; rows without id go only for others of their group."""
    made = frame(spark, ["one two three", "four five six", "one two three", "seven eight nine", "seven eight nine", "ten", None, "ten"], [1, 1, 2, 3, 3, None, None, 5])
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in simhash.keep_first(made).collect() if r["text"])
    assert kept == [(False, 1, "four five six"), (False, 1, "one two three"), (False, 3, "seven eight nine"), (False, 5, "ten")]
    assert simhash.keep_first(made.withColumnRenamed("n_chars", "_rank").withColumnRenamed("score", "h")).count() == 5


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_near_pairs_equal_all_pairs(radius):
    rng = np.random.default_rng(radius)
    runs = []
    for size in (2, 3, 64, 65, 200):
        centre = rng.integers(0, 1 << 63, dtype=np.uint64)
        flips = np.uint64(1) << rng.integers(0, 64, (size, 3), dtype=np.uint64)
        runs.append(centre ^ flips[:, 0] ^ flips[:, 1] ^ np.where(rng.random(size) < 0.5, flips[:, 2], np.uint64(0)))
    values, ends = np.concatenate(runs), np.cumsum([len(r) for r in runs])
    starts = ends - [len(r) for r in runs]
    want = {(i, j) for s, e in zip(starts, ends) for i in range(s, e) for j in range(i + 1, e) if int(values[i] ^ values[j]).bit_count() <= radius}
    i, j = simhash.near_pairs(values, starts, ends, radius)
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_a_chain_of_fingerprints_is_one_component(spark):
    values = [0]
    for k in range(40):
        values.append(values[-1] ^ (3 << k))
    made = spark.createDataFrame([(v,) for v in values], "fp long").distinct()
    roots = components.components(simhash.links(made))
    assert {r["root"] for r in roots.collect()} == {min(values)} and roots.count() == len(set(values)) - 1
    assert components.components(simhash.links(made.limit(0))).count() == 0


def test_near_duplicates_on_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r["doc_id"]: r for r in got if r["fingerprint"] == "0" * 16}
    assert {0, 1, 2} <= set(zero) and zero[2]["component_id"] == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 3, 5, 6]
    assert simhash.near_duplicates(none).count() == simhash.keep_first(none).count() == 0


# --- op2 ---


def test_languages_of_held_out_documents(spark, docs):
    got = queries.op2_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(got) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)


def test_ngram_counts_equal_plain_ones():
    found, starts = language.codes(["", "ab", "a", "abc"])
    sizes = np.diff(np.append(starts, found.shape[1]))
    assert sizes.tolist() == [1, 3, 2, 4]
    for row, order in enumerate(language.ORDERS):
        kept = [int((found[row][s : s + n] > 0).sum()) for s, n in zip(starts, sizes)]
        assert kept == [max(0, n - order + 1) for n in (0, 2, 1, 3)]
    assert found[1][starts[1]] == found[1][starts[3]]


def test_languages_equal_a_plain_naive_bayes(spark):
    """Every weight of the model by hand: bucket counts, half a count more, logarithms."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé ñ") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    langs = [rng.choice(["xx", "yy", "zz"]) for _ in texts]
    made = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")

    def buckets(text):
        found, _ = language.codes([text])
        return [b for row in found for b in row.tolist() if b]

    names = sorted(set(langs))
    counts = {n: Counter(b for t, lang in zip(texts, langs) if lang == n for b in buckets(t)) for n in names}
    got = {r["doc_id"]: r for r in language.predict(made, language.train(made)).collect()}
    for k, t in enumerate(texts):
        logs = []
        for n in names:
            total = sum(counts[n].values()) + 0.5 * language.BUCKETS
            logs.append(np.log(langs.count(n) / len(langs)) + sum(np.log((counts[n][b] + 0.5) / total) for b in buckets(t)))
        chances = np.exp(np.array(logs) - max(logs))
        chances /= chances.sum()
        if any(c.isalpha() for c in t):
            assert got[k]["lang_pred"] == names[int(chances.argmax())] and abs(got[k]["score"] - chances.max()) < 1e-3


def test_signs_that_are_no_letters_have_no_language(spark, docs):
    made = frame(spark, ["½ ² 1", "Ⅷ ①", "_ 7", "ª", "Ⅷ x"])
    got = [r["lang_pred"] for r in language.predict(made, language.train(docs)).orderBy("doc_id").collect()]
    assert got[:3] == ["und"] * 3 and "und" not in got[3:]


def test_language_on_odd_rows(spark, odd, none, docs):
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (0, 1, 2)) and got[5]["lang_pred"] != "und"
    kept = language.keep_known(odd, model)
    assert kept.columns == odd.columns and {0, 1, 2}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language.predict(none, model).count() == 0
    assert language.predict(odd, language.train(none)).where("lang_pred <> 'und'").count() == 0


# --- op3 ---


def plain_anchors(text):
    """(units of the window, place) of every anchor, by loops."""
    script = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    units = []
    for run in regex.findall(rf"[{script}]|[^ \t\n\x0b\x0c\r{script}]+", text or ""):
        cut = max(0, len(run) - 32)
        units += [*run[:cut], run[cut:]]

    def pair(x, y):
        first = xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(x.encode(), 42)), 42)
        value = xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(y.encode(), 42)), first)
        return value - (value >> 63 << 64)

    if len(units) < 4:
        return [(tuple(units), 0)] if units else []
    pairs = [pair(x, y) for x, y in zip(units, units[1:])]
    return [(tuple(units[i : i + 4]), i) for i in range(len(units) - 3) if min(pairs[i], pairs[i + 2]) <= pairs[i + 1]]


def plain_likeness(a, b):
    a, b = plain_anchors(a), plain_anchors(b)
    if not a and not b:
        return 1.0
    met = collections.defaultdict(list)
    for side, found in enumerate((a, b)):
        for value, place in found:
            met[value].append((place, side))
    on = collections.defaultdict(list)
    for places in met.values():
        places.sort()
        for (p, s), (q, t) in zip(places, places[1:]):
            if s != t:
                x, y = (p, q) if s == 0 else (q, p)
                on[x - y].append((x, y))
    counted = [xy for own in on.values() if len(own) > 1 or 1 in (len(a), len(b)) for xy in own]
    return (len({x for x, _ in counted}) + len({y for _, y in counted})) / (len(a) + len(b))


def test_edited_texts_and_likeness(spark, texts):
    got = {r["doc_id"]: r for r in queries.op3_syncmers(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i], texts[order[(k + 1) % len(order)]]
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        assert got[i]["n_chars"] == len(own) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_next"] == pytest.approx(plain_likeness(own, after)), i
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(own, edited)), i
        for column, text in (("fingerprint", own), ("edited_fingerprint", edited)):
            assert [int(x.split(":")[1]) for x in got[i][column].split(",") if x] == [place for _, place in plain_anchors(text)]
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.95 * len(got)


def likenesses(spark, pairs):
    made = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    found = made.select("k", syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    return [r[0] for r in found.select("k", syncmers.likeness(F.col("a"), F.col("b")).alias("l")).orderBy("k").select("l").collect()]


def test_likeness_by_position(spark):
    rng = random.Random(5)

    def words(n):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))

    passage, chinese = words(50), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(600))
    long_a, long_b = words(20000).split(), words(20000).split()
    long_a[500:550], long_b[9000:9050] = passage.split(), passage.split()
    base64 = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3000))
    moved = words(30) + " " + passage
    pairs = [
        (" ".join(long_a), " ".join(long_b)),
        (chinese, chinese[:400] + "\u4e01" * 200),
        (chinese, "\u3042" + chinese),
        (base64, "++" + base64[:2000]),
        (passage, moved),
        (passage, passage.replace(passage.split()[20], "edited")),
        (words(40), words(40)),
        ("spam " * 4000, "spam " * 3000),
        ("to be or not " * 40 + passage, passage + " not to be" * 30),
        ("a b", "a b"), ("a b", "a b c"), ("", "a"), (None, ""), ("\U00020000" * 9, "\U00020000" * 7),
    ]
    got = likenesses(spark, pairs)
    assert got == pytest.approx([plain_likeness(a, b) for a, b in pairs])
    assert got[0] > 0.001 and min(got[1], got[3]) > 0.5 and got[2] > 0.98 and got[4] > 0.7 and got[5] > 0.85
    assert got[6] == 0 and got[7] > 0.85 and got[9] == 1 and got[10] == got[11] == 0 and got[12] == 1


def test_anchors_do_not_depend_on_context(spark):
    inner = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    made = frame(spark, [inner, "x y z " + inner + " q r s", inner, "a b", "a b c", "", None])
    lists = [r[0] for r in made.orderBy("doc_id").select(syncmers.anchors(F.col("text"))).collect()]
    a, b, same, two, three, empty, null = ({x >> 32 for x in found} for found in lists)
    assert a and a <= b and lists[0] == lists[2] and len(two) == len(three) == 1 and empty == null == set()


def test_syncmers_on_odd_rows(odd, none, spark):
    got = syncmers.fingerprints(odd)
    assert got.count() == odd.count() and got.where("fingerprint IS NULL OR near_next IS NULL").count() == 0
    after = {r["id"]: r["next"] for r in syncmers.successors(odd, "doc_id").collect()}
    assert after == {6: 5, 5: 4, 4: 3, 3: 2, 2: 1, 1: 0, 0: None, None: 6}
    assert syncmers.fingerprints(none).count() == 0
    assert syncmers.fingerprints(frame(spark, ["only one"])).first()["near_next"] == 1.0


# --- op4 ---

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><nav>menu</nav><div class="post-12">
<h1>Head</h1><p>First <b>bold</b>part &amp; more<p>Second&nbsp;&nbsp;one<br>line</p><script>no("</p>")</script>
<div class="comments"><p>I disagree</p></div></div><aside>side</aside><footer>foot</footer></body></html>"""


def test_main_text_of_a_page(spark):
    assert pages.main_text(PAGE) == "Head First boldpart & more Second one line"
    short = PAGE.replace("post-12", "post-7").replace("First", "Other")
    lone = '<div class="else"><p>nothing here of that path</p></div>'
    made = spark.createDataFrame([(1, "http://a.example/1", PAGE), (2, "http://A.example/2", short), (3, "http://a.example/3", lone), (4, None, None), (5, "x", ""), (5, "x", "<p")], "page_id long, url string, html string")
    got = [r.asDict() for r in pages.extract(made).orderBy("page_id").collect()]
    assert [g["text"][:10] for g in got[:3]] == ["Head First", "Head Other", "nothing he"] and got[3]["text"] == "" and len(got) == 6
    assert pages.extract(made.limit(0)).count() == 0
    paths = {r["host"]: r["path"] for r in pages.host_paths(made).collect()}
    assert paths["a.example"].endswith("div.post-#")


def test_headlines_leads_and_sections_belong_to_the_article():
    long, short = (" ".join(f"Sentence {w} {k} tells a little more of it." for k in range(n)) for w, n in (("one", 60), ("two", 20)))
    around = "<html><body><nav><a href=/>Home</a></nav>{}<footer>All rights reserved</footer></body></html>".format
    for page in (
        f"<article><h1>Head</h1><p class=lead>Lead.</p><div class=body><p>{long}</p><p>{short}</p></div></article>",
        f"<div class=wrap><div class=post><h1>Head</h1><p class=lead>Lead.</p><section class=a><p>{long}</p></section><section class=b><p>{short}</p></section></div></div>",
        f"<main><h1>Head</h1><p>Lead.</p><section class=a><p>{long}</p></section><section class=b><p>{short}</p></section></main>",
    ):
        assert pages.main_text(around(page)) == f"Head Lead. {long} {short}"
    # What is mostly links, or no prose, is not taken along.
    for other in ("<ul class=more><li><a href=/a>Another story of the day</a></li></ul>", "<div class=date>12 May</div>"):
        assert pages.main_text(around(f"<div class=wrap><div class=post><p>{long}</p></div>{other}</div>")) == long


def test_pages_equal_their_articles(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").join(queries.op4_pages(spark, SF), "page_id").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", article))).split())


# --- op5 ---


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_equal_plain_patterns(spark, texts):
    rnd = random.Random(5)
    parts = ["a@b.co", "x%y@q-r.s.t", "@", ".", "%", " ", "-", "+", "1.2.3.4", "256.1.1.1", "001.02.3.255", ".7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49 30 123456", "0", "12", "é", "😀", "(", "tel "]
    made = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(1500)] + list(texts.values())
    got = pii.find(frame(spark, made)).collect()
    assert len(got) == len(made)
    for r in got:
        want = plain_spans(made[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(","))


def test_looser_spans_are_added_by_the_classifier(spark):
    strict = [f"please call +1 (555) 010-{k:04d} today" for k in range(60)]
    loose = [f"please call (555) 010-{k:04d} 77 today" for k in range(20)] + ["order no. 555 010 9999 12"]
    got = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, strict + loose)).collect()}
    assert all(got[k].startswith("phone:12:") for k in range(60)) and sum(bool(got[k]) for k in range(60, 80)) == 20 and got[80] == ""


def test_masking_and_odd_rows(spark, odd, none):
    made = frame(spark, ["mail é@ a.b@c.org or 1.2.3.4!", None, ""])
    assert [r["text"] for r in pii.mask(made).orderBy("doc_id").collect()] == ["mail é@ <EMAIL> or <IP>!", None, ""]
    assert pii.mask(odd).columns == odd.columns and pii.mask(odd).count() == pii.find(odd).count() == odd.count()
    assert pii.find(none).count() == pii.mask(none).count() == 0


# --- op6, op8 ---


@pytest.fixture(scope="module")
def reference_ids():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: whole.encode(t or "", add_special_tokens=False).ids + [1]


def strange(n, seed=1):
    rnd = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "23", ".", ",", "'s", "中", "😀", "é", "İ", "ΑΣ", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "ﬁ", "²", "\r\n", "\x00", "aaaa"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_byte_ids_equal_the_library(texts, reference_ids):
    encode = byte_ids.Encoder()
    for t in [*strange(3000), *texts.values()]:
        assert np.frombuffer(encode(t), "<u4").tolist() + [1] == reference_ids(t)


def check_packed(rows, ids_of, length=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, own in by_doc.items():
        ids, at = np.array(ids_of[doc], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_packing_is_whole_and_without_padding(spark, docs, texts, reference_ids):
    want = {i: reference_ids(t) for i, t in texts.items()}
    assert check_packed(queries.op6_packing(spark, SF).collect(), want) == 0
    # Many tasks, so that their last windows are merged.
    assert check_packed(packing.pack(docs.repartition(40), with_ids=True).collect(), want) == 0


def test_packing_odd_rows(odd, none, reference_ids):
    got = packing.pack(odd.where("doc_id IS NULL OR doc_id <> 4")).collect()
    want = {r["doc_id"]: reference_ids(r["text"]) for r in odd.collect() if r["doc_id"] != 4}
    assert check_packed(got, want) == 0
    assert packing.pack(odd).count() >= odd.count() and packing.pack(none).count() == 0


def test_shards_are_written_in_rounds(spark, docs, tmp_path, monkeypatch):
    """No round shuffles more than its share of the shards, and its shuffle files go when it ends."""
    rounds, real = [], shards.stored

    def stored(df, label):
        found = real(df, label)
        if label == "shards":
            rounds.append((spark.conf.get(shards.DROP_SHUFFLES), [r["shard"] for r in found.collect()]))
        return found

    monkeypatch.setattr(shards, "stored", stored)
    before = spark.conf.get(shards.DROP_SHUFFLES)
    shards.materialise(docs, str(tmp_path / "shards"), per_shard=8, length=256)
    written = sorted(s for _, own in rounds for s in own)
    assert written == list(range(len(written))) and len(written) >= 6
    assert len(rounds) == 3 and max(len(own) for _, own in rounds) <= -(-len(written) // 3)
    assert {dropped for dropped, _ in rounds} == {"true"} and spark.conf.get(shards.DROP_SHUFFLES) == before


def test_shards_round_trip(spark, docs, texts, reference_ids, odd, none, tmp_path):
    path = str(tmp_path / "shards")
    rows = shards.materialise(docs.repartition(5), path, per_shard=64, length=256).collect()
    total = 1 + max(r["slot"] for r in rows)
    read = list(shards.read_slots(f"file://{path}", 0, total, 256, 64))
    assert len(read) == total and {len(w) for w in read} == {256} and {r["slot"] for r in rows} == set(range(total))
    # Any slot stands at its own offset, and reading goes on from there, over the end of a shard.
    assert all((x == y).all() for x, y in zip(shards.read_slots(f"file://{path}", 60, 9, 256, 64), read[60:69]))
    size = os.path.getsize(f"{path}/{shards.shard_name(0)}")
    assert size == 64 * 512 and sorted(os.listdir(path)) == [shards.shard_name(k) for k in range(-(-total // 64))]
    found = {}
    for r in rows:
        part = read[r["slot"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["shard"].endswith(shards.shard_name(r["slot"] // 64))
        found.setdefault(r["doc_id"], []).append((r["start"], part.tolist(), r["doc_tokens"]))
    assert set(found) == set(texts)
    for i, parts in found.items():
        ids = [x for _, p, _ in sorted(parts) for x in p]
        assert ids == reference_ids(texts[i]) and {n for *_, n in parts} == {len(ids)}
    first = [r["slot"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"]))]
    assert first != sorted(first)  # the order is not the table's
    assert shards.materialise(odd).select("doc_id").distinct().count() == 8 and shards.materialise(none).count() == 0


@pytest.mark.parametrize("domain", [1, 2, 3, 5, 64, 65, 1000])
def test_feistel_is_a_permutation(spark, domain):
    got = spark.range(domain).select(shards.slot(F.col("id"), domain).alias("s")).collect()
    assert sorted(r["s"] for r in got) == list(range(domain))


# --- op7 ---


def test_token_counts_equal_the_library(spark, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made = strange(3000, 2) + ["abcabcab" * 300, "ΣΑΣ ςσ"]
    assert token_counts.Counter().count(made) == [len(whole.encode(t, add_special_tokens=False).ids) for t in made]
    for r in queries.op7_token_counts(spark, SF).collect():
        t = texts[r["doc_id"]]
        n = len(whole.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_token_counts_on_odd_rows(odd, none):
    got = token_counts.token_counts(odd).collect()
    assert len(got) == odd.count() and {(r["n_bytes"], r["n_tokens"]) for r in got if r["doc_id"] in (0, 1)} == {(0, 0)}
    assert token_counts.token_counts(none).count() == 0


# --- op9 ---


def test_benchmark_passages_are_found(spark, docs, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    want = {i for i, t in texts.items() if any(words(b) in words(t) for b in items.values())}
    got = {r["doc_id"]: r for r in queries.op9_decontamination(spark, SF).collect()}
    assert len(got) == len(texts) and want and want <= {i for i, r in got.items() if r["contaminated"]}
    five = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"\w+", t.lower())] for k in range(len(w) - 4)}
    for i in {i for i, r in got.items() if r["contaminated"]} - want:
        assert any(len(five(items[b]) & five(texts[i])) >= 0.7 * len(five(items[b])) for b in got[i]["item_ids"])


def test_templates_and_slots(spark, odd, none):
    item = "If Paris sells 3 apples and 4.5 pears for 12 km each day, then who pays 3 euros."
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, "one two")], "item_id long, text string")
    made = frame(
        spark,
        [
            "Well. If Rome sells 7 apples and 9.25 pears for 44 km each day, then who pays 7 euros. Bye",
            "If Rome sells 7 apples and 9.25 pears for 44 km each day, then who pays 8 euros.",
            "Nothing to be seen here at all, 3 apples or not.",
            item.upper().replace("PARIS", "Paris"),
        ],
    )
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(made, bench).collect()}
    assert got[0] == [1] and got[1] == [] and got[2] == []
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    assert decontaminate.keep_clean(odd, bench).columns == odd.columns
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(made, bench.limit(0)).where("contaminated").count() == 0


def plain_cover(text, item):
    """(share of the item's words covered, longest run) by windows of five and equal words beside them, for plain lower-case words."""
    t, w = text.split(), item.split()
    by_diagonal = {}
    for a in range(len(t) - 4):
        for b in range(len(w) - 4):
            if t[a : a + 5] == w[b : b + 5]:
                near = {k for k in range(max(0, b - 4), min(len(w), b + 9)) if 0 <= a - b + k < len(t) and t[a - b + k] == w[k]}
                by_diagonal.setdefault(a - b, set()).update(near)
    longest = max((sum(1 for _ in g) for d in by_diagonal.values() for _, g in itertools.groupby(enumerate(sorted(d)), lambda x: x[1] - x[0])), default=0)
    return len(set().union(*by_diagonal.values())) / len(w), longest


def test_coverage_equals_a_plain_comparison(spark):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("bcdfghklmnprstvw", k=6)) for _ in range(300)]
    items = [" ".join(rnd.choices(vocabulary, k=rnd.choice([5, 6, 12, 20, 40, 100]))) for _ in range(40)]
    texts = []
    for k in range(400):
        words = rnd.choice(items).split()
        a = rnd.randrange(len(words))
        words = words[a:] if k % 3 == 0 else words[: a + 1] if k % 3 == 1 else words
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            at = rnd.randrange(len(words))
            words[at : at + rnd.choice([0, 1, 1])] = rnd.choices(vocabulary, k=rnd.choice([0, 1, 1]))
            words = words or ["x"]
        texts.append(" ".join(rnd.choices(vocabulary, k=rnd.randrange(9)) + words + rnd.choices(vocabulary, k=rnd.randrange(9))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(frame(spark, texts), bench).collect()}
    flagged = 0
    for i, text in enumerate(texts):
        cover = {k: plain_cover(text, item) for k, item in enumerate(items)}
        want = {k: share for k, (share, run) in cover.items() if share >= 0.8 or run >= 30}
        flagged += bool(want)
        assert set(got[i]["item_ids"]) == set(want) and abs(got[i]["covered"] - max(want.values(), default=0)) < 1e-9
    assert 50 < flagged < 380


def test_edited_short_and_numeric_items_are_found(spark):
    prose = "the old mill beside our river grinds barley every second spring while children watch from a narrow bridge above water".split()
    long = [f"{a}{b}" for a in ("lantern", "harbour", "meadow", "copper", "willow", "saddle", "thimble", "orchard", "pebble", "ribbon") for b in "abcdefghij"]
    bench = spark.createDataFrame(
        [(1, " ".join(prose)), (2, "12 + 35 * 7 - 4 = 253 ?"), (3, "blue herring waltz"), (4, " ".join(long)), (5, "of it"), (6, "weighs " + "9" * 50 + " kg or less then"), (7, "Walk 9 km to Oslo")],
        "item_id long, text string",
    )
    around = lambda t: f"Something else was said before this. {t} And much more came after it, as always."
    changed = [around(" ".join(prose[:k] + ["zzz"] + prose[k + 1 :])) for k in range(len(prose))]
    made = [
        around("12 + 35 * 7 - 4 = 253 ?"),
        around("12 + 35 * 8 - 4 = 253 ?"),
        around("blue herring waltz"),
        around("blue herring tango"),
        around(" ".join(long[15:85])),
        around(" ".join(long[15:40])),
        around("of it"),
        "Of it!",
        "it weighs " + "8" * 60 + " kg or less then",
        around("walk 12 km to Bergen"),
    ]
    got = [r["item_ids"] for r in decontaminate.contamination(frame(spark, changed + made), bench).orderBy("doc_id").collect()]
    assert got[: len(changed)] == [[1]] * len(changed)
    assert got[len(changed) :] == [[2], [], [3], [], [4], [], [], [5], [6], [7]]


def test_rows_without_id_are_judged_each_by_its_text(spark):
    words = [f"word{a}{b}" for a in "abcd" for b in "efghi"]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    made = frame(spark, [" ".join(words[:10]), " ".join(words[10:]), "nothing", " ".join(words), "nothing", " ".join(words)], [None, None, None, None, 7, 7])
    got = sorted((str(r["doc_id"]), r["contaminated"]) for r in decontaminate.contamination(made, bench).collect())
    assert got == [("7", False), ("7", True), ("None", False), ("None", False), ("None", False), ("None", True)]
    assert sorted(r["text"] for r in decontaminate.keep_clean(made, bench).collect()) == sorted([" ".join(words[:10]), " ".join(words[10:]), "nothing", "nothing"])


# --- op10 ---


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = queries.op10_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) > 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    field = quality.Field(rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2)))
    lengths = [1, 4, 3]
    evidence, firsts = rng.normal(size=(sum(lengths), quality.FEATURES)) * 0.3, np.array([0, 1, 5])
    good, pairs = field.marginals(evidence, firsts)
    for d, n in enumerate(lengths):
        rows, total, want, moves = evidence[firsts[d] : firsts[d] + n] @ field.weights, 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(u for u, v in zip(rows, y) if v) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
            total, want = total + p, want + p * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += p
        assert np.allclose(good[firsts[d] : firsts[d] + n], want / total) and np.allclose(pairs[d], moves / total)


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1), (4, None)], "doc_id long, quality int")
    field = quality.train(odd, labels)
    got = quality.score(odd, field).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(none, field).count() == 0
    assert {r["score"] for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}


# --- pipeline ---


def test_pipeline_equals_its_stages_by_brute_force(spark, docs, texts, reference_ids):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    told = {i: t for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    first = {i: c for i, (_, c) in plain_components(told).items()}
    leaks = {r["doc_id"] for r in queries.op9_decontamination(spark, SF).collect() if r["contaminated"]}
    kept = [i for i in told if first[i] == i and i not in leaks]

    def masked(t):
        out, at = "", 0
        for s, e, k in sorted((s, e, k) for k, s, e in plain_spans(t)):
            if s >= at:
                out += t[at:s] + f"<{k.upper()}>"
            at = max(at, e)
        return out + t[at:]

    assert check_packed(got, {i: reference_ids(masked(texts[i])) for i in kept}) == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "personal_data", "packing"]
