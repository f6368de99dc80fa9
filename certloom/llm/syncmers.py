"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a row of units: its words; single characters in scripts that put no space between words; and every character
but the last ones of a run of more than LONGEST without white space. A window of WINDOW units is an anchor if the least
of its inner pairs, by hash, stands at one of its ends. Whether it is one depends on its own units alone, so equal
passages have equal anchors wherever they stand. A fingerprint is the list of all anchors of the text with their places.

Two fingerprints are compared by position. Equal anchors of both lie on the diagonal that is the difference of their
places; where an anchor repeats, the ones next to each other in place meet. A shared passage has a diagonal of its own, so
a diagonal with a single match is taken for chance, unless one of the texts has no other anchor. Likeness is the share of
the anchors of both texts that lie on the other diagonals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certloom.llm.runtime import checkpointed

INNER, WINDOW = 2, 4  # units; an anchor has WINDOW - INNER + 1 = 3 inner pairs
LONGEST = 32  # characters of a word
SPACELESS = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
# A word of characters below U+0E00, where none of these scripts begins, is tried first: looking up the script of every
# character costs more than all else.
UNIT = rf"[!-\u0dff]{{1,{LONGEST}}}+(?!\S)|[{SPACELESS}]|[^\s{SPACELESS}]{{1,{LONGEST}}}+(?![^\s{SPACELESS}])|\S"


def _let(value: Column, body: Callable[[Column], Column], kind: str) -> Column:
    """`body(value)` with the value computed once: a lambda's argument is not computed again at each use."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def anchors(text: Column) -> Column:
    """The anchors in order of place, each as one long: its hash in the upper 32 bits, twice its place (the index of its
    first unit) in the lower ones. Texts of 1 to 3 units have one anchor, the whole sequence; texts without any have none."""
    units = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda w: F.xxhash64(w))
    return _let(units, _anchors_of, "array<bigint>")


def _anchors_of(hashed: Column) -> Column:
    def anchor(value: Column, place: Column) -> Column:
        return F.shiftleft(value.cast("long"), 32) + place.cast("long") * 2

    def chosen(pairs: Column) -> Column:
        # Pairs i, i + 1, i + 2 are those inside the window of units i .. i + 3.
        ends = F.transform(
            pairs,
            lambda x, i: F.when(
                (F.get(pairs, i + 2).isNotNull()) & (F.least(x, F.get(pairs, i + 2)) <= F.get(pairs, i + 1)),
                anchor(F.hash(x, F.get(pairs, i + 2)), i),
            ),
        )
        return F.filter(ends, lambda h: h.isNotNull())

    pairs = F.transform(F.slice(hashed, 1, F.size(hashed) - 1), lambda x, i: F.xxhash64(x, F.get(hashed, i + 1)))
    whole = F.array(anchor(F.hash(hashed), F.lit(0)))
    return (
        F.when(F.size(hashed) >= WINDOW, _let(pairs, chosen, "array<bigint>"))
        .when(F.size(hashed) > 0, whole)
        .otherwise(F.array().cast("array<bigint>"))
    )


def shown(found: Column) -> Column:
    """The fingerprint as text: for each anchor 8 hex digits of its hash, a colon and its place; empty without anchors."""

    def one(x: Column) -> Column:
        value = F.lpad(F.lower(F.hex(F.shiftright(x, 32).bitwiseAND(0xFFFFFFFF))), 8, "0")
        return F.concat(value, F.lit(":"), _place(x).cast("string"))

    return F.array_join(F.transform(found, one), ",")


def _place(x: Column) -> Column:
    return F.shiftright(x.bitwiseAND(0xFFFFFFFF), 1)


def matches(a: Column, b: Column) -> Column:
    """Equal anchors on diagonals that count, sorted: each as one long, the diagonal (place in `a` less place in `b`) in the
    upper 32 bits and the place in `a` in the lower ones. One sort of both lists; no pair of lists is multiplied out."""
    marked = F.sort_array(F.concat(a, F.transform(b, lambda x: x + 1)))  # the lowest bit tells the text

    def meeting(m: Column) -> Column:
        def match(x: Column, i: Column) -> Column:
            y = F.get(m, i + 1)
            of_a, of_b = (F.when(x.bitwiseAND(1) == 0, p).otherwise(q) for p, q in ((x, y), (y, x)))
            diagonal = F.shiftleft(_place(of_a) - _place(of_b), 32) + _place(of_a)
            return F.when((F.shiftright(x, 32) == F.shiftright(y, 32)) & (x.bitwiseXOR(y).bitwiseAND(1) == 1), diagonal)

        return F.sort_array(F.filter(F.transform(m, match), lambda d: d.isNotNull()))

    alone = F.least(F.size(a), F.size(b)) == 1

    def supported(p: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            return F.coalesce(F.shiftright(F.get(p, i), 32) == F.shiftright(x, 32), F.lit(False))

        return F.filter(p, lambda x, i: alone | same(x, i - 1) | same(x, i + 1))

    return _let(_let(marked, meeting, "array<bigint>"), supported, "array<bigint>")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of the anchors of both texts that match by position. Two empty fingerprints are equal (1)."""

    def places(found: Column) -> Column:
        in_a = F.transform(found, lambda d: d.bitwiseAND(0xFFFFFFFF))
        in_b = F.transform(found, lambda d: d.bitwiseAND(0xFFFFFFFF) - F.shiftright(d, 32))
        return F.size(F.array_distinct(in_a)) + F.size(F.array_distinct(in_b))

    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(_let(matches(a, b), places, "int") / both)


def successors(docs: DataFrame, id_column: str) -> DataFrame:
    """(id, next): the next lower distinct id (after the last: the first).

    Only ids are moved. They are ranged by id, so that neighbours are together, and what crosses
    the edge of a range comes from a table with one row per range.
    """
    ids = docs.select(F.col(id_column).alias("id")).distinct()
    ranged = checkpointed(ids.repartitionByRange(F.col("id").desc_nulls_last()).withColumn("range", F.spark_partition_id()))
    down = F.col("id").desc_nulls_last()
    inside = ranged.select("*", F.lead(F.struct("id")).over(Window.partitionBy("range").orderBy(down)).alias("after"))
    # A null id comes last, so it heads a range only where it is alone there.
    heads = ranged.groupBy("range").agg(F.struct(F.max("id").alias("id")).alias("head"))
    in_order = Window.orderBy("range")  # over one row per range
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = heads.select("range", F.coalesce(F.lead("head").over(in_order), F.first("head").over(whole)).alias("beyond"))
    return inside.join(edges, "range").select("id", F.coalesce("after", "beyond")["id"].alias("next"))


def _key(ident: Column) -> Column:
    """An id as a join key that is never null, so that one shuffle by it serves all joins."""
    return F.when(ident.isNull(), "").otherwise(F.concat(F.lit("="), ident.cast("string")))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many of
    the next document, by descending id; after the last comes the first, and null ids come last of all. Null
    texts are empty. Of rows with one id, the one with the greatest text is the "next document" of others.
    Other columns are not looked at. Texts are shuffled, not anchors, which take as much room and are found again where
    they are compared.
    """
    after = successors(docs, id_column)
    text = F.coalesce(F.col(text_column), F.lit(""))
    # Both uses of `base` read the same columns, so its one shuffle is used twice; the id comes back from its key.
    base = docs.select(_key(F.col(id_column)).alias("k"), text.alias("t"))
    ident = F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)).cast(docs.schema[id_column].dataType)
    asked = after.select(_key(F.col("next")).alias("k"), _key(F.col("id")).alias("asker"))
    follower = base.join(asked, "k").select("asker", F.col("t").alias("next_text"))
    first = F.row_number().over(Window.partitionBy("asker").orderBy(F.col("next_text").desc()))
    given = follower.withColumn("n", first).where("n = 1").drop("n")
    joined = base.join(given, F.col("k") == F.col("asker"))
    n = F.length("t").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("t", (n - third).cast("int")), F.left("next_text", third))
    texts = joined.select(ident.alias("id"), n.alias("n_chars"), "t", "next_text", edited.alias("edited"))
    found = texts.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        anchors(F.col("t")).alias("own"), anchors(F.col("edited")).alias("other"), anchors(F.col("next_text")).alias("next_own"),
    )
    return found.select(
        F.col("id").alias(id_column),
        "n_chars",
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
