"""A Merkle manifest of a table: one tree per group of rows, and one tree over the groups' roots.

Leaves are numbered within their group without gathering a group anywhere: rows are sorted by range, and each
range's count of a group tells where the next range goes on. Every level is an equijoin of the nodes with
themselves: the slot-zero node of a run computes the indices of its siblings (by XOR in a binary tree, by slot
offsets otherwise), meets them, and emits the parent. Proofs come down the same tables, a level at a time, so
what a node carries is its own way up, whatever the size of its group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.llm.runtime import stored
from certloom.session import broadcast_if_small

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<left:string,right:string>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def framed(value: Column) -> Column:
    """A field of a leaf: its UTF-8 byte count, a colon and the value, or `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return digest(F.concat(*[framed(c) for c in fields]))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """`rows` with `i`, their place in their group `g` by `order` from 0 on, and `n`, the group's size.

    Rows are dealt by range of group and order and written once, numbered within their range; a range knows from
    the counts of those before it where its groups go on. Those counts are one row per range and group it touches.
    """
    ranged = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = stored(ranged.withColumn("row", F.monotonically_increasing_id()), label).withColumn("part", F.shiftright("row", 33))
    counts = placed.groupBy("g", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.expr("sum(m) OVER (PARTITION BY g ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    starts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.expr("sum(m) OVER (PARTITION BY g)").alias("n"))
    side = broadcast_if_small(starts, F.octet_length("g") + F.lit(24))
    return placed.join(side, ["g", "part"]).withColumn("i", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def levels(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The parents `(g, i, n, h, kids)` of each level above `nodes` `(g, i, n, h)`, lowest first.

    `n` is the number of nodes of the group on the level; a group with one node is done and has no parent.
    """
    found: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        open_nodes = nodes.where("n > 1").select("g", "i", "n", "h")
        last_slot = F.least(F.lit(arity).cast("long"), F.col("n") - F.col("i")) - 1
        heads = open_nodes.where(F.col("i") % arity == 0).select(
            F.col("g").alias("of"), F.col("i").alias("head"), F.explode(F.sequence(F.lit(0).cast("long"), last_slot)).alias("slot")
        )
        sibling = F.col("head").bitwiseXOR(F.col("slot")) if arity == 2 else F.col("head") + F.col("slot")
        runs = heads.join(open_nodes, (F.col("of") == F.col("g")) & (sibling == F.col("i"))).groupBy("g", "head")
        kids = F.transform(F.array_sort(F.collect_list(F.struct("slot", "h"))), lambda s: s["h"])
        joined = runs.agg(F.max("n").alias("n"), kids.alias("kids"))
        parents = joined.select(
            "g", F.expr(f"head div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), digest(F.concat_ws("", "kids")).alias("h"), "kids"
        )
        nodes = stored(parents, "nodes")
        found.append(nodes)
        most = -(-most // arity)
    return found


def _finished(tables: list[DataFrame]) -> DataFrame:
    """`(g, h)` of the groups' topmost nodes."""
    tops = [t.where("n = 1").select("g", "h") for t in tables]
    return reduce(DataFrame.unionByName, tops)


def _step(kids: Column, slot: Column) -> Column:
    """What stands left and right of a node in its run."""
    left = F.concat_ws("", F.slice(kids, F.lit(1), slot))
    right = F.concat_ws("", F.slice(kids, slot + 2, F.size(kids)))
    return F.struct(left.alias("left"), right.alias("right"))


def ways(nodes: DataFrame, parents: list[DataFrame], tops: DataFrame | None = None, arity: int = ARITY) -> DataFrame:
    """`nodes` with `path`, the steps from the node up, and the other columns of `tops`.

    `tops` has for every group the path of its single topmost node, which without it has no step to go. A node
    joins its parent by a computed index.
    """
    extra = [c for c in tops.columns if c not in ("g", "path")] if tops is not None else []
    above: DataFrame | None = None
    for level in [*reversed(parents), nodes]:
        alone = level.where("n = 1")
        alone = alone.join(tops, "g") if tops is not None else alone.withColumn("path", F.array().cast(f"array<{STEP}>"))
        if above is not None:
            up = above.select("g", F.col("i").alias("up"), F.col("kids").alias("run"), "path", *extra)
            slot = (F.col("i") % arity).cast("int")
            below = level.where("n > 1").withColumn("up", F.expr(f"i div {arity}")).join(up, ["g", "up"])
            below = below.withColumn("path", F.concat(F.array(_step(F.col("run"), slot)), "path"))
            alone = alone.unionByName(below.select(*alone.columns))
        above = alone
    return above


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf's run up, each run left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(docs: DataFrame, id_column: str = "doc_id", fields: tuple[str, ...] = FIELDS, group: str = "source", text_column: str = "text", arity: int = ARITY, tampered_fold: int = 5) -> DataFrame:
    """One row per row of `docs`: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The rows whose id has a crc32 divisible by `tampered_fold` have A-Z of their text lower-cased before their leaf
    is checked against the untampered siblings. Null groups are a group of their own, before all others; null
    texts stay. Rows without an id come first in their group and are not tampered with. Rows with one id follow
    each other by leaf, and rows equal in all fields are leaves each. An empty table gives no row. Other columns
    are not looked at.
    """
    row_id = F.col(id_column)
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text_column else F.col(c) for c in fields]
    hit = F.crc32(row_id.cast("string")) % tampered_fold == 0
    leaves = docs.select(
        row_id.alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n")).alias("g"),  # null before any text
        leaf_of([F.col(c) for c in fields]).alias("h"),
        F.when(hit, leaf_of(changed)).alias("tampered"),
    )
    nodes = numbered(stored(leaves, "leaves"), ["id", "h"], "numbered")
    parents = levels(nodes, arity)
    subroots = stored(_finished([nodes, *parents]), "subroots")
    groups = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), ["name"], "groups")
    upper = levels(groups, arity)
    # The root is one digest.
    top = (upper[-1] if upper else groups).select("h").first()
    placed = ways(groups, upper, arity=arity).select(F.col("name").alias("g"), F.col("h").alias("subroot"), "path")
    shown = ways(nodes, parents, stored(placed, "tops"), arity)
    root = F.lit(top[0] if top else None).cast("string")
    again = folded(F.coalesce("tampered", "h"), F.col("path"))
    return shown.select(
        F.col("id").alias(id_column), F.col("h").alias("leaf"), "subroot", root.alias("root"), proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
