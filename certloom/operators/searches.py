"""Saved searches as a table: search texts to terms, and one pass that matches all of them.

Grammar of a search text: filters (`wildcard:`, `domain_count:`, `created:`, `after:`, `before:`)
are cut out first and hold for the whole search; the rest is split at OR; a column prefix at the
start of a group scopes all its terms; `-` negates; quotes make a term exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions import times
from certloom.functions.hosts import has_wildcard
from certloom.functions.predicates import SearchError, SearchSpec, Term
from certloom.operators.key_sets import KeySet, key_set
from certloom.session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, stored

# White space in search texts, as the inside of a character class.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS, TEXT = f"[{SPACE}]", f"[^{SPACE}]"

# Fixed patterns of the filters.
# The word edge is ASCII: `\b` would take letters of all scripts for parts of a word.
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
NO_WORD_BEFORE = r"(?<![A-Za-z0-9_])"
WILDCARD = rf"(?i){NO_WORD_BEFORE}wildcard:(true|false){WORD_EDGE}"
DOMAIN_COUNT = rf"(?i){NO_WORD_BEFORE}domain_count:(>=?|<=?|=)([0-9]+){WORD_EDGE}"
CREATED = rf"(?i){NO_WORD_BEFORE}created:({TEXT}+)\.\.({TEXT}+){WORD_EDGE}"
SEEN = rf"{NO_WORD_BEFORE}(?:after|before):{TEXT}"
SEEN_PIECES = rf"(?is){SEEN}+|(?:(?!{SEEN}).)+"
OR = rf"(?i){WS}+OR{WS}+"
PREFIXES = ["domain", "issuer", "cn"]
TOKEN = rf"""(?s)(?:-{WS}*+)?+(?:"(?:\\.?|[^"\\])*+"?|'(?:\\.?|[^'\\])*+'?|{TEXT}+)"""

NO_TERM = "no search term"
NO_POSITIVE = "a group without a positive term"
MAX_LONG = 9223372036854775807


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _last(array: Column) -> Column:
    """Last element that is not null, null when there is none."""
    present = F.filter(array, lambda x: x.isNotNull())
    return F.get(present, F.size(present) - 1)


def _term(token: Column, column: Column) -> Column:
    body = F.regexp_replace(token, rf"\A-{WS}*+", "")
    quoted = F.startswith(body, F.lit('"')) | F.startswith(body, F.lit("'"))
    inner = F.regexp_extract(body, r"""(?s)\A(?:"((?:\\.?|[^"\\])*+)|'((?:\\.?|[^'\\])*+))""", 1)
    single = F.regexp_extract(body, r"""(?s)\A(?:"((?:\\.?|[^"\\])*+)|'((?:\\.?|[^'\\])*+))""", 2)
    plain = F.regexp_replace(F.concat(inner, single), r"(?s)\\(.?)", "$1")
    return F.struct(
        column.alias("column"),
        F.when(quoted, plain).otherwise(body).alias("text"),
        F.startswith(token, F.lit("-")).alias("negate"),
        quoted.alias("exact"),
    )


def _group(segment: Column) -> Column:
    column, rest = F.lit(None).cast("string"), segment
    for name in reversed(PREFIXES):
        scoped = F.startswith(F.lower(segment), F.lit(name + ":"))
        column = F.when(scoped, name).otherwise(column)
        rest = F.when(scoped, _trim(F.substring(segment, len(name) + 2, 2147483647))).otherwise(rest)
    terms = F.transform(_all(rest, TOKEN, 0), lambda token: _term(token, column))
    return F.filter(terms, lambda t: t["text"] != "")


def parse_searches(df: DataFrame, id_col: str = "search_id", text_col: str = "text") -> DataFrame:
    """One row per search: `groups` (arrays of terms), the filters, and `reject` with a reason or null."""
    s = df.select(F.col(id_col).alias("search_id"), _trim(F.col(text_col)).alias("_t"))
    s = s.withColumn("wildcard", F.lower(_last(_all(F.col("_t"), WILDCARD, 1))) == "true")
    s = s.withColumn("_t", F.regexp_replace("_t", WILDCARD, ""))
    n = _last(_all(F.col("_t"), DOMAIN_COUNT, 2))
    s = s.withColumn("count_op", _last(_all(F.col("_t"), DOMAIN_COUNT, 1)))
    s = s.withColumn("count_n", F.when(n.isNotNull(), F.coalesce(n.try_cast("long"), F.lit(MAX_LONG))))
    s = s.withColumn("_t", F.regexp_replace("_t", DOMAIN_COUNT, ""))

    ranges = F.transform(_all(F.col("_t"), CREATED, 0), lambda m: times.created_range(F.substring(m, 9, 2147483647)))
    s = s.withColumn("_r", ranges)
    s = s.withColumn("_t", F.regexp_replace("_t", CREATED, ""))

    def value_of(key: str):
        return lambda piece: F.when(
            piece.rlike(rf"(?i)\A{key}:{TEXT}"), times.parse_time(F.substring(piece, len(key) + 2, 2147483647))
        )

    def bound(key: str):
        return lambda r: r[key]

    s = s.withColumn("_p", _all(F.col("_t"), SEEN_PIECES, 0))
    for key in ("after", "before"):
        s = s.withColumn(
            key, F.coalesce(_last(F.transform("_p", value_of(key))), _last(F.transform("_r", bound(key))))
        )
    kept = F.filter("_p", lambda p: F.coalesce(value_of("after")(p), value_of("before")(p)).isNull())
    s = s.withColumn("_t", _trim(F.array_join(kept, "")))

    segments = F.filter(F.transform(F.split("_t", OR), _trim), lambda g: g != "")
    s = s.withColumn("groups", F.filter(F.transform(segments, _group), lambda g: F.size(g) > 0))
    positive = F.forall("groups", lambda g: F.exists(g, lambda t: ~t["negate"]))
    reject = F.when(F.coalesce(F.size("groups"), F.lit(0)) == 0, NO_TERM).when(~positive, NO_POSITIVE)
    return s.select("search_id", "groups", "after", "before", "wildcard", "count_op", "count_n", reject.alias("reject"))


def explode_searches(parsed: DataFrame) -> DataFrame:
    """Term rows `(search_id, grp, pos, column, text, negate, exact)` of the accepted searches."""
    return (
        parsed.filter(F.col("reject").isNull())
        .select("search_id", F.posexplode("groups").alias("grp", "_terms"))
        .select("search_id", "grp", F.posexplode("_terms").alias("pos", "_t"))
        .select("search_id", "grp", "pos", "_t.column", "_t.text", "_t.negate", "_t.exact")
    )


def search_filters(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject").isNull()).select(
        "search_id", "after", "before", "wildcard", "count_op", "count_n"
    )


def search_rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject").isNotNull()).select("search_id", F.col("reject").alias("reason"))


def parse_one(spark: SparkSession, text: str) -> SearchSpec:
    """The spec of one search text; a table of literals is evaluated with the plan, without a job."""
    rows = spark.sql("SELECT * FROM VALUES (0, :text) AS t(search_id, text)", args={"text": text})
    row = parse_searches(rows).first()
    if row["reject"]:
        raise SearchError(row["reject"])
    groups = [[Term(t["text"], t["column"], t["negate"], t["exact"]) for t in g] for g in row["groups"]]
    return SearchSpec(groups, row["after"], row["before"], row["wildcard"], row["count_op"], row["count_n"])


# --- Matching -------------------------------------------------------------------------------

GRAM = 3

# Lengths of the keys cut from a text: a term is looked up by the longest that fits.
KEY_LENGTHS = [6, 3, 2, 1]


def grams(c: Column, n: int) -> Column:
    """All runs of `n` characters that do not cross a line end."""
    return _all(c, rf"(?=([^\n]{{{n}}}))", 1)


def cut(df: DataFrame, pieces: Column, *columns: str) -> DataFrame:
    """`columns` and `key`: all runs of `n` characters of every `(line, n)` in an array of pieces, repeats included.

    What `grams` does by a pattern per character, as rows that need not stay: a test of `key` that follows runs with it.
    """
    lines = df.select(*columns, F.explode(pieces).alias("_piece")).filter(F.length("_piece.line") >= F.col("_piece.n"))
    starts = F.sequence(F.lit(1), F.length("_piece.line") - F.col("_piece.n") + 1)
    placed = lines.select(*columns, "_piece", F.explode(starts).alias("_at"))
    # As a row source of its own a run is cut once, however often the test asks for it.
    run = F.explode(F.array(F.substr("_piece.line", F.col("_at"), F.col("_piece.n"))))
    return placed.select(*columns, run.alias("key"))


def lines_of(text: Column, *lengths: int) -> Column:
    """Pieces for `cut`: the lines of a text for every length of runs."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda line: F.array(*[F.struct(line.alias("line"), F.lit(n).alias("n")) for n in lengths])))


def _searched_text(*columns: str) -> Column:
    return F.lower(F.concat_ws("\n", *columns))


def trigrams(df: DataFrame) -> DataFrame:
    """`(gram, fingerprint)` of the names, the issuer and the subject, each pair once per row."""
    text = _searched_text("domains", "issuer_org", "subject_cn")
    return df.select(F.explode(F.array_distinct(grams(text, GRAM))).alias("gram"), "fingerprint")


def trigram_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


# A row with more lead trigrams than that is looked up by single ones.
MOST_LEADS = 64


def trigram_candidates(df: DataFrame, texts: DataFrame) -> DataFrame:
    """`(text_id, fingerprint)` of rows that hold every trigram of the text; to be verified.

    The rows' trigrams are counted as far as the texts ask for them. A text then meets only the rows that hold its
    two rarest trigrams, where the others are looked for in the row's text, so a common trigram never pairs its rows
    with its texts, and texts that differ little rarely meet each other's rows. Other pairs are dropped within their row,
    so a row's text is carried once per lead pair it holds, not once per trigram. A row with more than MOST_LEADS of
    the lead trigrams is looked up by the rarest trigram alone, as its pairs would be too many. Texts below three
    characters have no trigram and no candidate here.
    """
    wanted = stored(
        texts.select("text_id", F.array_distinct(grams(F.lower("text"), GRAM)).alias("_grams")).filter(F.size("_grams") > 0),
        "texts",
    )
    each = wanted.select("text_id", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram"))
    listed = stored(each.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")), "listed")
    kept = key_set(listed, "gram", listed.count())
    rows = df.select("fingerprint", _searched_text("domains", "issuer_org", "subject_cn").alias("_text"))
    asked = cut(rows, lines_of(F.col("_text"), GRAM)).filter(kept.may_hold(F.col("key")))
    counts = asked.groupBy(F.col("key").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    cost = listed.join(counts, "gram").select("gram", (F.col("texts") * F.col("n")).alias("cost"))
    # A text with a trigram that no row holds has no candidate, and none of its trigrams is looked up.
    complete = F.count(F.lit(1)) == F.max("_n")
    leads = stored(
        each.join(cost, "gram")
        .groupBy("text_id")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", "gram"))), 1, 2)["gram"].alias("_lead"), complete.alias("_complete"))
        .filter("_complete")
        .select("text_id", F.get("_lead", F.lit(0)).alias("gram"), F.array_join(F.array_sort("_lead"), "").alias("pair"), F.explode("_lead").alias("lead"))
        .join(wanted, "text_id"),
        "leads",
    )
    total = leads.count()
    lead_set, pair_set = key_set(leads, "lead", total), key_set(leads, "pair", total)
    # Only lead pairs leave their row, with its text.
    held = F.array_sort(F.filter(F.array_distinct(grams(F.col("_text"), GRAM)), lead_set.may_hold))
    found = rows.withColumn("_held", held).withColumn("_long", F.size("_held") > MOST_LEADS)
    pairs = F.flatten(F.transform("_held", lambda a, i: F.transform(F.slice("_held", i + 2, F.lit(MOST_LEADS)), lambda b: F.concat(a, b))))
    keys = F.when(F.col("_long"), F.col("_held")).otherwise(F.concat("_held", pairs))
    kept_keys = F.filter(F.array_distinct(keys), lambda k: F.col("_long") | pair_set.may_hold(k))
    led = found.select("fingerprint", "_text", "_long", F.explode(kept_keys).alias("key"))
    own = leads.filter("lead = gram")
    either = own.select("text_id", "_grams", F.inline(F.array(F.struct(F.col("pair").alias("key"), F.lit(False).alias("_long")), F.struct(F.col("gram").alias("key"), F.lit(True).alias("_long")))))
    side = broadcast_if_small(either, F.size("_grams") * 8 + 24)
    every = F.forall("_grams", lambda g: F.contains(F.col("_text"), g))
    return led.join(side, ["key", "_long"]).filter(every).select("text_id", "fingerprint").distinct()


# Kinds of keys, best first: a whole value, a name ending, or a run of that many characters.
WHOLE, ENDING = "whole", "ending"
KINDS = [WHOLE, ENDING, *map(str, KEY_LENGTHS)]


def _term_keys(term: Column) -> Column:
    """The keys of a term with their kind; a row that fulfils the term has all of them."""
    text = F.lower(term["text"])
    ending = F.coalesce(term["column"] == "domain", F.lit(False)) & F.contains(term["text"], F.lit("."))
    kind = F.when(term["exact"], WHOLE).when(ending, ENDING)
    keys = F.when(term["exact"], F.array(term["text"])).when(ending, F.array(text))
    for n in KEY_LENGTHS:
        kind = kind.when(F.length(text) >= n, str(n))
        keys = keys.when(F.length(text) >= n, F.array_distinct(grams(text, n)))
    return F.transform(keys, lambda key: F.struct(kind.alias("kind"), key.alias("key")))


def _row_keys(kinds: frozenset[str], few: dict[str, list[str]]) -> Column:
    """Keys of a certificate row, of the kinds that the searches use; repeats do no harm.

    Kinds share one space of keys: a clash only gives a candidate that fails its verification.
    A kind of run with few keys is tested key by key, which gives the same keys for less than cutting all runs.
    """
    names, text = F.col("_names"), F.col("_text")

    def runs(n: int) -> Column:
        if str(n) in few:
            return F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in few[str(n)]])
        return grams(text, n)

    parts = {
        WHOLE: F.concat(F.coalesce("domains", F.array().cast("array<string>")), F.array("issuer_org", "subject_cn")),
        ENDING: _all(names, r"(?<![^.\n])(?=([^\n]+))", 1),
        **{str(n): runs(n) for n in KEY_LENGTHS},
    }
    return F.concat(*[F.coalesce(parts[k], F.array().cast("array<string>")) for k in KINDS if k in kinds])


def _term_holds(term: Column) -> Column:
    """A term of a search row against a certificate row."""
    text, lowered = term["text"], F.lower(term["text"])
    column = F.coalesce(term["column"], F.lit("any"))

    def any_name(test) -> Column:
        return F.coalesce(F.exists(F.col("domains"), test), F.lit(False))

    def scoped(domain: Column, field) -> Column:
        issuer, cn = (field(F.coalesce(F.col(c), F.lit(""))) for c in ("issuer_org", "subject_cn"))
        return (
            F.when(column == "domain", domain)
            .when(column == "issuer", issuer)
            .when(column == "cn", cn)
            .otherwise(domain | issuer | cn)
        )

    equal = scoped(any_name(lambda d: d == text), lambda c: c == text)
    ending = any_name(lambda d: (F.lower(d) == lowered) | F.endswith(F.lower(d), F.concat(F.lit("."), lowered)))
    inside = scoped(
        any_name(lambda d: F.contains(F.lower(d), lowered)), lambda c: F.contains(F.lower(c), lowered)
    )
    holds = (
        F.when(term["exact"], equal)
        .when((column == "domain") & F.contains(text, F.lit(".")), ending)
        .otherwise(inside)
    )
    return holds != term["negate"]


def search_anchors(parsed: DataFrame, gram_counts: DataFrame | None = None) -> DataFrame:
    """One row per OR group with the key to look it up by, the terms to verify and the filters.

    Every positive term offers its keys; the group takes the one shared by the fewest groups,
    weighted with how many certificates hold it when `gram_counts` is given, so that no key
    collects many searches. Which key is taken does not change the matches.
    """
    groups = parsed.filter(F.col("reject").isNull()).select(
        "search_id",
        F.posexplode("groups").alias("grp", "terms"),
        "after",
        "before",
        "wildcard",
        "count_op",
        "count_n",
    )
    positives = F.filter("terms", lambda t: ~t["negate"])
    offered = groups.select(
        "search_id", "grp", F.inline(F.array_distinct(F.flatten(F.transform(positives, _term_keys))))
    )
    load = offered.groupBy("key").agg(F.count(F.lit(1)).alias("load"))
    weighed = offered.join(load, "key")
    cost = F.col("load").cast("double")
    if gram_counts is not None:
        held = gram_counts.select(F.col("gram").alias("key"), F.col("n").alias("held"))
        weighed = weighed.join(held, "key", "left")
        cost = cost * F.coalesce(F.col("held"), F.lit(1))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    choice = F.min(F.struct(cost.alias("cost"), order.alias("order"), "kind", "key")).alias("best")
    best = weighed.groupBy("search_id", "grp").agg(choice)
    return groups.join(best.select("search_id", "grp", "best.kind", "best.key"), ["search_id", "grp"])


# A kind of run with at most this many keys is tested key by key: over the sf0.1 tables the whole match
# took 14.9 s this way and 18.5 s by cutting all runs (one run each, warm).
FEW_KEYS = 32


@dataclass(frozen=True)
class SearchIndex:
    """Stored anchors of a set of searches, with what was measured when they were stored."""

    anchors: DataFrame
    kinds: frozenset[str]
    rows: int
    size: int
    keys_size: int
    few: dict[str, list[str]]
    keys: KeySet | None = None


def _measured(anchors: DataFrame) -> SearchIndex:
    """An index of stored anchors."""
    # One row per kind, of which there are six.
    sizes = (
        anchors.groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.length(F.to_json("terms")) + 100).alias("size"),
            F.sum(F.octet_length("key") + 16).alias("keys"),
            F.countDistinct("key").alias("distinct"),
        )
        .collect()
    )
    rows, size, keys = (sum(r[c] for r in sizes) for c in ("rows", "size", "keys"))
    few = {r["kind"]: [] for r in sizes if r["distinct"] <= FEW_KEYS and r["kind"].isdigit()}
    for r in anchors.filter(F.col("kind").isin(list(few))).select("kind", "key").distinct().collect() if few else []:
        few[r["kind"]].append(r["key"])
    wanted = key_set(anchors, "key", sum(r["distinct"] for r in sizes)) if sizes else None
    return SearchIndex(anchors, frozenset(r["kind"] for r in sizes), rows, size, keys, few, wanted)


def index_searches(parsed: DataFrame, gram_counts: DataFrame | None = None) -> SearchIndex:
    """Store the anchors of parsed searches; a stream does this once, not per batch."""
    return _measured(stored(search_anchors(stored(parsed, "searches"), gram_counts), "anchors"))


def update_index(index: SearchIndex, added: DataFrame, removed: DataFrame) -> SearchIndex:
    """The index without the searches of `removed` (search_id) and with the parsed searches `added`, which alone are
    anchored; the others keep their keys."""
    kept = index.anchors.join(removed.select("search_id").distinct(), "search_id", "left_anti")
    new = search_anchors(stored(added, "searches"))
    return _measured(stored(kept.unionByName(new.select(*kept.columns)), "anchors"))


# Candidates of one key are dealt over this many tasks where the anchors are too many for a broadcast.
SALTS = 16


def match_index(certs: DataFrame, index: SearchIndex) -> DataFrame:
    """Distinct `(search_id, fingerprint)` of all indexed searches over all certificates.

    Every certificate looks up its own keys among the searches, so a search meets only rows that
    share its key, and is verified there as a whole: AND, NOT and the filters need no regrouping.
    That is one scan for any number of searches. Keys that no search has are dropped within their row, by a
    bitmap of the searches' keys, and what that lets pass by the distinct keys; only what is left meets the searches, by a broadcast of measured size or else by a shuffle of
    those candidates, salted so that a common key is many tasks. Searches without a match give no row.
    """
    columns = ["fingerprint", "domains", "issuer_org", "subject_cn", "seen_at", "domain_count"]
    keys = _row_keys(index.kinds, index.few) if index.kinds else F.array().cast("array<string>")
    keyed = certs.select(
        *columns,
        _searched_text("domains").alias("_names"),
        _searched_text("domains", "issuer_org", "subject_cn").alias("_text"),
    )
    if index.keys is not None:
        keys = F.filter(keys, index.keys.may_hold)
    keyed = keyed.select(*columns, F.explode(keys).alias("key"))
    countable = index.rows <= BROADCAST_ROWS
    known = index.anchors.select("key").distinct()
    candidates = keyed.join(F.broadcast(known) if countable and index.keys_size <= BROADCAST_BYTES else known, "key", "left_semi")
    if countable and index.size <= BROADCAST_BYTES:
        found = candidates.join(F.broadcast(index.anchors), "key")
    else:
        salt = F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = candidates.withColumn("salt", salt).join(index.anchors.withColumn("salt", every), ["key", "salt"])
    n = F.col("domain_count")
    compared = (
        F.when(F.col("count_op") == ">", n > F.col("count_n"))
        .when(F.col("count_op") == ">=", n >= F.col("count_n"))
        .when(F.col("count_op") == "<", n < F.col("count_n"))
        .when(F.col("count_op") == "<=", n <= F.col("count_n"))
        .when(F.col("count_op") == "=", n == F.col("count_n"))
        .otherwise(F.lit(True))
    )
    in_time = (F.col("after").isNull() | (F.col("seen_at") >= F.col("after"))) & (
        F.col("before").isNull() | (F.col("seen_at") < F.col("before"))
    )
    wild = F.col("wildcard").isNull() | (F.col("wildcard") == has_wildcard(F.col("domains")))
    verified = in_time & compared & wild & F.forall("terms", _term_holds)
    return found.filter(verified).select("search_id", "fingerprint").distinct()


def match_searches(certs: DataFrame, parsed: DataFrame, gram_counts: DataFrame | None = None) -> DataFrame:
    """`match_index` for searches that are used once."""
    return match_index(certs, index_searches(parsed, gram_counts))
