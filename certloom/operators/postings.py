"""A stored index of trigrams over a certificate table: for each trigram and day, a bitmap of the times it was seen.

A day is cut into 32,768 blocks of a few seconds; a bit says that a certificate of that block holds the trigram in a
name, the issuer or the subject. Inserts add bitmaps, which are united when they are read or when the day is compacted.
A search unites and intersects the bitmaps of its trigrams, and reads the days and blocks that are left; days lie in
folders and rows in order of time, so the others are not opened. The index is in `_grams` of the table's folder.
"""

from __future__ import annotations

import uuid
from collections import Counter
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom import schemas
from certloom.files import delete_path, folder_names, move, path_exists
from certloom.functions import times
from certloom.functions.predicates import SearchSpec, match_spec
from certloom.operators.searches import GRAM, cut, grams, lines_of

FOLDER = "_grams"
BLOCKS = 32_768  # of a day: the size of Spark's bitmaps
WORD = 64  # blocks that are added up as one number
RANGES = 200  # ranges of time that one search reads at most; the nearest ones are joined beyond that
POSTING = T.StructType([T.StructField("gram", T.StringType()), T.StructField("bits", T.BinaryType()), T.StructField("seen_date", T.DateType())])


def _block() -> Column:
    return F.expr(f"((seen_at % {times.DAY} + {times.DAY}) % {times.DAY}) * {BLOCKS} div {times.DAY}")


def _text() -> Column:
    return F.lower(F.concat_ws("\n", "domains", "issuer_org", "subject_cn"))


def _bitmap(words: Column) -> Column:
    """The bitmap of sorted `(word, bits)`, each word once; what lies between them is zero."""

    def digits(e: Column, i: Column) -> Column:
        before = F.when(i == 0, -1).otherwise(F.element_at(words, i)["word"])
        gap = F.repeat(F.lit("0"), WORD // 4 * (e["word"] - before - 1).cast("int"))
        return F.concat(gap, F.lpad(F.hex(e["bits"]), WORD // 4, "0"))

    return F.unhex(F.rpad(F.array_join(F.transform(words, digits), ""), BLOCKS // 4, "0"))


def postings_of(rows: DataFrame) -> DataFrame:
    """(gram, bits, seen_date) of some certificates.

    Trigrams are added up as words of 64 bits, in which a task's rows of one day and time meet before they are
    shuffled or sorted; only the words become bitmaps.
    """
    placed = rows.select(times.seen_date(F.col("seen_at")).alias("seen_date"), _block().alias("block"), _text().alias("_text"))
    each = cut(placed, lines_of(F.col("_text"), GRAM), "seen_date", "block")
    block = F.col("block")
    # The hex digits of a word are its bytes in order, lowest byte first.
    place = (WORD // 8 - 1 - F.expr(f"block % {WORD} div 8")) * 8 + block % 8
    words = each.groupBy("seen_date", "key", F.expr(f"block div {WORD}").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))).alias("bits")
    )
    packed = words.groupBy("seen_date", F.col("key").alias("gram")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return packed.select("gram", _bitmap(F.col("words")).alias("bits"), "seen_date")


def has_index(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/{FOLDER}")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(gram, bits, seen_date); a trigram may have several rows of a day, to be united."""
    return spark.read.schema(POSTING).parquet(f"{path}/{FOLDER}")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    dealt = rows.hint("rebalance", "seen_date").sortWithinPartitions("seen_date", "gram")
    dealt.write.mode(mode).partitionBy("seen_date").parquet(path)


def build(spark: SparkSession, path: str) -> None:
    """Index the whole table at `path`; from then on inserts, compaction and retention keep the index."""
    staged = f"{path}/{FOLDER}-{uuid.uuid4().hex}"
    _write(postings_of(spark.read.schema(schemas.CERTIFICATE).parquet(path)), staged, "errorifexists")
    delete_path(spark, f"{path}/{FOLDER}")
    move(spark, staged, f"{path}/{FOLDER}")


def add(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Index rows before they are inserted: what a broken insert leaves only costs a look."""
    if has_index(spark, path):
        _write(postings_of(rows), f"{path}/{FOLDER}", "append")


def _days(spark: SparkSession, path: str) -> list[date]:
    names = folder_names(spark, f"{path}/{FOLDER}")
    return [date.fromisoformat(n.removeprefix("seen_date=")) for n in names if n.startswith("seen_date=")]


def drop_before(spark: SparkSession, path: str, day: date) -> None:
    for old in _days(spark, path):
        if old < day:
            delete_path(spark, f"{path}/{FOLDER}/seen_date={old.isoformat()}")


def rebuild(spark: SparkSession, path: str, start: date, end: date) -> None:
    """Index the days `[start, end)` anew, each in few files and one row per trigram. A day's old index goes when the
    new one is there to take its place."""
    if not has_index(spark, path):
        return
    chosen = spark.read.schema(schemas.CERTIFICATE).parquet(path).filter((F.col("seen_date") >= F.lit(start)) & (F.col("seen_date") < F.lit(end)))
    staged = f"{path}/{FOLDER}-{uuid.uuid4().hex}"
    _write(postings_of(chosen), staged, "errorifexists")
    for day in _days(spark, path):
        if start <= day < end:
            delete_path(spark, f"{path}/{FOLDER}/seen_date={day.isoformat()}")
    for name in folder_names(spark, staged):
        if name.startswith("seen_date="):
            move(spark, f"{staged}/{name}", f"{path}/{FOLDER}/{name}")
    delete_path(spark, staged)


def candidate_blocks(spark: SparkSession, path: str, spec: SearchSpec) -> DataFrame | None:
    """(seen_date, bits) of the blocks that may hold a match; None where a group has no trigram to look up.

    A group's trigrams must all have been seen in a block; a day that lacks one of them has no row.
    """
    texts = [(k, t.text) for k, group in enumerate(spec.groups) for t in group if not t.negate]
    cut = spark.createDataFrame(texts, "grp int, text string").select("grp", F.explode(grams(F.lower("text"), GRAM)).alias("gram"))
    # The trigrams of one search, cut as the index cuts them.
    wanted = {(r["grp"], r["gram"]) for r in cut.distinct().collect()}
    sizes = Counter(grp for grp, _ in wanted)
    if len(sizes) < len(spec.groups):
        return None
    listed = spark.createDataFrame([(k, g, sizes[k]) for k, g in sorted(wanted)], "grp int, gram string, n long")
    days = read_postings(spark, path).filter(F.col("gram").isin(sorted({g for _, g in wanted})))
    if spec.after is not None:
        days = days.filter(F.col("seen_date") >= times.seen_date(F.lit(spec.after)))
    if spec.before is not None:
        days = days.filter(F.col("seen_date") <= times.seen_date(F.lit(spec.before - 1)))
    united = days.groupBy("seen_date", "gram").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = united.join(F.broadcast(listed), "gram").groupBy("seen_date", "grp")
    whole = both.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).where("m = n")
    return whole.groupBy("seen_date").agg(F.bitmap_or_agg("bits").alias("bits")).where(F.bitmap_count("bits") > 0)


def _ranges(days: list[tuple[date, bytes]], most: int = RANGES) -> list[tuple[int, int]]:
    """`[first, last)` seconds that cover the set blocks of all days, at most `most` of them."""
    found: list[list[int]] = []
    for day, bits in sorted(days):
        start = (day - date(1970, 1, 1)).days * times.DAY
        whole = int.from_bytes(bits, "little")
        while whole:
            first = (whole & -whole).bit_length() - 1
            run = ((whole >> first) + 1 & ~(whole >> first)).bit_length() - 1
            whole = whole >> (first + run) << (first + run)
            # Block b holds the seconds s with s x BLOCKS div DAY = b.
            low, high = (start - (-b * times.DAY // BLOCKS) for b in (first, first + run))
            if found and found[-1][1] >= low:
                found[-1][1] = high
            else:
                found.append([low, high])
    if len(found) > most:
        gaps = sorted(range(1, len(found)), key=lambda k: found[k][0] - found[k - 1][1])
        joined = set(gaps[: len(found) - most])
        merged: list[list[int]] = []
        for k, r in enumerate(found):
            if k in joined:
                merged[-1][1] = r[1]
            else:
                merged.append(list(r))
        found = merged
    return [(a, b) for a, b in found]


def index_search(spark: SparkSession, path: str, spec: SearchSpec) -> DataFrame:
    """The matches of a search over the table at `path`, read from the days and blocks that the index leaves.

    Every match is verified. Searches with a group whose terms are all shorter than three characters read the table.
    What reaches the driver is one bitmap per day that is left.
    """
    table = spark.read.schema(schemas.CERTIFICATE).parquet(path)
    blocks = candidate_blocks(spark, path, spec) if has_index(spark, path) else None
    if blocks is None:
        return table.filter(match_spec(spec))
    days = [(r["seen_date"], bytes(r["bits"])) for r in blocks.collect()]
    if not days:
        return table.filter(F.lit(False))
    in_time = reduce(or_, [(F.col("seen_at") >= a) & (F.col("seen_at") < b) for a, b in _ranges(days)])
    on_days = F.col("seen_date").isin([d for d, _ in days])
    return table.filter(on_days & in_time & match_spec(spec))

