"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, units and names become typed placeholders, so a question with other parameters has the same template.
Windows of five template tokens of all documents meet those of the benchmark in a hash join. Windows with fewer
than two ordinary words, whose template says little, meet by their literal words instead. Each match covers its
window and the equal words up to four places beside it, so a changed word costs only itself. Matches of one
document and item that are equally far apart make an alignment; one in which an item's value stands for two
values of the document is dropped. A document is contaminated by an item if the alignments left cover four fifths
of its words, or one of them has 30 covered words in a row. Items of three or four words are also looked for by
their literal words anywhere; items of one or two words, which clean texts hold too, only as the whole text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.llm.runtime import gathered, stored
from certloom.session import broadcast_if_small

WORDS, COVERED = 5, 0.8
RUN = 30  # covered words in a row that are enough, whatever the item's length
CONCRETE = 2  # ordinary words that a window needs to be known by its template
BESIDE = 4  # words beside a window that are compared
MOST_BITS = 1 << 23  # of the table of known templates

# Number words and units of the languages in question.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "deux trois quatre cinq sept huit neuf dix zwei drei vier fünf sechs sieben acht neun zehn dos tres cuatro cinco seis siete ocho nueve diez"
).split()
UNITS = (
    "km|m|cm|mm|mi|miles|mile|feet|foot|ft|inches|inch|kg|g|mg|lb|lbs|pounds|pound|oz|liters|litres|l|ml|hours|hour|h|minutes|minute|min|seconds|second|s|ms|"
    "days|day|weeks|week|months|month|years|year|dollars|dollar|usd|eur|euros|euro|cents|percent|degrees|celsius|kmh|mph|kwh|kw|w|v|hz|gb|mb|kb"
)
_NUMBER, _UNIT, _NAME = "\u0001", "\u0002", "\u0003"  # mark a token's type; they sort before all letters


def tokens(text: Column) -> Column:
    """Lower-cased words; numbers, units after a number, and capitalised words inside a sentence carry a mark."""
    marked = F.regexp_replace(F.regexp_replace(text, "[\u0001-\u0003]", " "), "(?<=[0-9])[.,](?=[0-9])", "")
    marked = F.regexp_replace(marked, "[0-9]+", f" {_NUMBER}$0 ")
    marked = F.regexp_replace(marked, rf"(?i)(\u0001[0-9]++ {{1,3}})(?=(?:{UNITS})\b)", f"$1{_UNIT}")
    # Looking for single characters is far cheaper than a pattern, and most texts have none of these.
    gate = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "0123456789" + _NUMBER + _UNIT + _NAME])
    named = F.regexp_replace(F.when(gate, marked).otherwise(text), r" (?<=[\p{Ll}\p{N},;:] )(?=\p{Lu})", f" {_NAME}")
    return F.array_remove(F.split(F.lower(named), "[^\\p{L}\\p{N}\u0001-\u0003]+"), "")


def _is_slot(word: Column) -> Column:
    return (word < "\u0004") | word.isin(NUMBER_WORDS)


def _literal(word: Column) -> Column:
    """A word without its type."""
    return F.translate(word, _NUMBER + _UNIT + _NAME, "")


def _windows_of(words: Column, short: list[int], known: Callable[[Column], Column] | None) -> Column:
    """Array of (template, hash, at, slots, around) of the windows of one text whose template passes `known`.

    Windows have WORDS words, a shorter text is one window, and sizes of `short` are made too, by literal words.
    """
    marks = [F.xxhash64(F.lit(m)) for m in (_NUMBER, _UNIT, _NAME)]
    hashed = F.transform(words, lambda w: F.when(w < "\u0004", F.xxhash64(F.left(w, F.lit(1)))).when(w.isin(NUMBER_WORDS), marks[0]).otherwise(F.xxhash64(w)))

    def build(bound: Column) -> Column:
        h, w = bound["h"], bound["w"]
        n = F.size(h)

        def templates(size: int) -> Column:
            # Windows that end behind the text have no template.
            return F.transform(h, lambda _, i: F.struct(F.when(i <= n - size, F.xxhash64(*[F.get(h, i + k) for k in range(size)])).alias("template"), i.alias("at")))

        def described(found: Column, size: Column | int, tag: str) -> Column:
            wanted = lambda x: x["template"].isNotNull() & (known(x["template"]) if known else F.lit(True))

            def one(x: Column) -> Column:
                here = F.slice(w, x["at"] + 1, size)
                plain = F.transform(here, _literal)
                slots = F.filter(here, _is_slot)
                by_words = F.lit(tag == "short") | (F.size(here) - F.size(slots) < CONCRETE)
                places = F.sequence(x["at"] - BESIDE, x["at"] + F.size(here) + BESIDE - 1)
                around = F.transform(places, lambda j: F.when(by_words, F.xxhash64(_literal(F.get(w, j)))).otherwise(F.get(h, j)))
                return F.struct(
                    x["template"].alias("template"),
                    F.when(by_words, F.xxhash64(F.lit(f"{tag} words"), plain)).otherwise(F.xxhash64(F.lit(tag), x["template"])).alias("hash"),
                    x["at"].alias("at"),
                    F.when(by_words, F.array().cast("array<string>")).otherwise(slots).alias("slots"),
                    F.transform(around, lambda v, k: F.when(F.get(w, x["at"] - BESIDE + k).isNotNull(), v)).alias("around"),
                )

            return F.transform(F.filter(found, wanted), one)

        kind = "array<struct<template:bigint,hash:bigint,at:int,slots:array<string>,around:array<bigint>>>"
        whole = F.array(F.struct(F.when(n > 0, F.xxhash64(h)).alias("template"), F.lit(0).alias("at")))
        own = F.when(n >= WORDS, described(templates(WORDS), WORDS, "window").cast(kind)).otherwise(described(whole, F.greatest(n, F.lit(1)), "whole").cast(kind))
        return F.concat(own, *[described(templates(size), size, "short").cast(kind) for size in short]) if short else own

    bound = F.array(F.struct(hashed.alias("h"), words.alias("w")))
    return F.element_at(F.transform(bound, build), 1)  # binds the arrays once


def _words(text_column: str) -> Column:
    return tokens(F.coalesce(F.col(text_column), F.lit("")))


def _digest(text_column: str) -> Column:
    """Tells rows with one id apart by their texts."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("y"))


def templates(benchmark: DataFrame, item_column: str, item_text: str) -> tuple[DataFrame, list[int]]:
    """(item, of, item_at, template, hash, item_slots, item_around) for each window of an item of `of` words, and the short sizes among them."""
    items = stored(benchmark.select(F.col(item_column).alias("item"), _words(item_text).alias("w")), "items")
    sizes = items.where(F.size("w").between(3, WORDS - 1)).select(F.size("w").alias("n")).distinct().collect()
    # An item is a short window of its own size only.
    made = [items.select("item", F.size("w").alias("of"), F.explode(_windows_of(F.col("w"), [], None)).alias("x"))]
    for size in sorted(r["n"] for r in sizes):
        some = items.where(F.size("w") == size)
        made.append(some.select("item", F.lit(size).alias("of"), F.explode(_windows_of(F.col("w"), [size], None)).alias("x")))
    rows = reduce(DataFrame.unionByName, made)
    asked = rows.select("item", "of", F.col("x.at").alias("item_at"), "x.template", "x.hash", F.col("x.slots").alias("item_slots"), F.col("x.around").alias("item_around"))
    windows = items.agg(F.coalesce(F.sum(2 * F.size("w") + 1), F.lit(0))).first()[0]  # at most
    return stored(gathered(asked.distinct(), windows), "templates"), sorted(r["n"] for r in sizes)


def _known(asked: DataFrame) -> Callable[[Column], Column]:
    """A test that passes all templates of the benchmark, and of others one in sixteen, or more beyond MOST_BITS.

    The bits of the benchmark's templates are a literal of the plan, so a text drops its windows before they are rows.
    """
    bits = 1 << 12
    count = asked.select("template").distinct().count()
    while bits < 16 * count and bits < MOST_BITS:
        bits *= 2
    place = lambda template: template.bitwiseAND(F.lit(bits - 1).cast("long"))
    word = F.shiftright(place(F.col("template")), 6).cast("int")
    one = F.expr("shiftleft(1L, cast(template & 63 AS int))")
    words = dict(asked.groupBy(word.alias("word")).agg(F.bit_or(one)).collect())
    # One text constant, which Spark turns into an array of numbers before it runs.
    table = F.split(F.lit(",".join(str(words.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>")
    return lambda template: F.getbit(F.get(table, F.shiftright(place(template), 6).cast("int")), template.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def _longest(places: Column) -> Column:
    """Length of the longest run of consecutive numbers in an array."""

    def step(acc: Column, p: Column) -> Column:
        n = F.when(p == acc["last"] + 1, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), n.alias("n"), F.greatest(acc["best"], n).alias("best"))

    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best"))
    return F.aggregate(F.array_sort(places), start, step, lambda acc: acc["best"])


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str, item_text: str, covered: float = COVERED, run: int = RUN) -> DataFrame:
    """(id, digest, item, covered) for every text and item whose words are covered by `covered` or more, or by `run` words in a row."""
    asked, short = templates(benchmark, item_column, item_text)
    known = _known(asked)
    width = F.lit(160) + F.length(F.array_join("item_slots", ""))
    found = docs.select(F.col(id_column).alias("id"), _digest(text_column).alias("digest"), F.explode(_windows_of(_words(text_column), short, known)).alias("x"))
    met = found.select("id", "digest", "x.hash", "x.at", "x.slots", "x.around").join(broadcast_if_small(asked.drop("template"), width), "hash")
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("asked"), b.alias("given")))
    same = F.zip_with("item_around", "around", lambda a, b: a == b)
    places = F.filter(F.transform(same, lambda s, k: F.when(s, F.col("item_at") - BESIDE + k)), lambda p: p.isNotNull())
    # At most one window per item position is on a diagonal, so what is gathered is bounded by the item.
    aligned = (
        met.select("id", "digest", "item", "of", (F.col("at") - F.col("item_at")).alias("diagonal"), places.alias("places"), pairs.alias("pairs"))
        .groupBy("id", "digest", "item", "of", "diagonal")
        .agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
        .where(F.size(F.array_distinct(F.transform("pairs", lambda p: p["asked"]))) == F.size("pairs"))
        .withColumn("longest", _longest(F.col("places")))
    )
    each = aligned.select("id", "digest", "item", "of", "longest", F.explode("places").alias("place"))
    total = each.groupBy("id", "digest", "item", "of").agg(F.countDistinct("place").alias("n"), F.max("longest").alias("longest"))
    share = (F.col("n") / F.col("of")).alias("covered")
    return total.where((F.col("n") >= F.lit(covered) * F.col("of")) | (F.col("longest") >= run)).select("id", "digest", "item", share)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    covered: float = COVERED,
    run: int = RUN,
) -> DataFrame:
    """One row per row of `docs`: id, contaminated, item_ids (ascending), covered (highest share of an item's words, 0 if none).

    Null and empty texts are clean, and null or empty items match nothing. A null item id is an id like others, but
    not listed. Rows with one id, or without, are judged each by its own text. Other columns are not looked at.
    """
    found = matches(docs, benchmark, id_column, text_column, item_column, item_text, covered, run)
    verdict = found.groupBy("id", "digest").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("covered").alias("covered"))
    verdict = verdict.withColumnRenamed("digest", "of_text")
    ids = docs.select(F.col(id_column).alias("doc"), _digest(text_column).alias("digest"))
    same = F.col("doc").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of_text"))
    return ids.join(verdict, same, "left").select(
        F.col("doc").alias(id_column),
        F.col("covered").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast(verdict.schema["item_ids"].dataType)).alias("item_ids"),
        F.coalesce("covered", F.lit(0.0)).alias("covered"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that no item contaminates, as they are; rows with one id, or without, each by its own text."""
    found = matches(docs, benchmark, id_column, text_column, item_column, item_text).select("id", "digest").distinct()
    found = stored(gathered(found, docs.count()), "leaks")
    lost = broadcast_if_small(found.withColumnRenamed("digest", "of_text"), F.lit(40))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_column).alias("doc"), _digest(text_column).alias("digest"))
    same = F.col("doc").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of_text"))
    return rows.join(lost, same, "left_anti").select("row.*")
