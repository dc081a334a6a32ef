"""Merkle manifest of a table by sibling-shift self-joins.

Rows become leaves, numbered within their group. On every level each node is joined by equality with the nodes whose
computed index is that of a sibling: the index of the run's first slot plus the node's own slot shifted by 1, 2 and so
on around the run (for two children that is the index XOR 1). Then the rows of slot zero hold all digests of their run
and emit the parent. Each level is written, so that a lost executor costs one level, and no node meets more than
``fan - 1`` others: no group, however large, is collected.

The roots of the groups are the leaves of one more tree. Proofs are handed down from the top: a node's path is its own
siblings and the path of its parent, and a parent has ``fan`` children at most, so no join key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.session import materialize

FAN = 8
_PATH = "array<struct<before:binary,after:binary>>"


def _empty() -> Column:
    return F.lit(b"")


def _hash(raw: Column) -> Column:
    """Digest, as 32 bytes, of the lower-case hex text of concatenated digests."""
    return F.unhex(F.sha2(F.lower(F.hex(raw)), 256))


def hex_text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def row_digest(values: Sequence[Column]) -> Column:
    """Digest, as 32 bytes, of a row: each value as byte count, colon and text; a null as ``-``."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def group_key(value: Column) -> Column:
    """A text that orders as the value does bytewise, with null first, and is never null."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``idx``, the place of a row among the rows of its ``group``, and ``n``, how many they are.

    Rows are range-sorted and written; places are added up within a file and, over one row per group and file, between
    files, so a group of any size is numbered by many tasks.
    """
    by = ["group", *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle-ranged")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("group", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("group").orderBy("_part")
    whole = Window.partitionBy("group")
    parts = parts.select(
        "group",
        "_part",
        (F.sum("_rows").over(before) - F.col("_rows") - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"),
    )
    found = placed.join(materialize(parts, "merkle-parts"), ["group", "_part"])
    return found.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes (group, idx, digest, n) with ``before`` and ``after``: the digests of their run left and right of them."""
    slot = F.col("idx") % fan
    joined = nodes.select("group", "idx", "digest", "n")
    for shift in range(1, fan):
        # This node is the sibling `shift` slots on, around the run, of the node at `idx` here.
        of = F.col("idx") - slot + F.pmod(slot - shift, F.lit(fan))
        shifted = nodes.select("group", of.alias("idx"), F.col("digest").alias(f"_{shift}"))
        joined = joined.join(shifted, ["group", "idx"], "left")
    around = F.array("digest", *[f"_{s}" for s in range(1, fan)])

    def side(wanted) -> Column:
        at = lambda j: F.get(around, F.pmod(F.lit(j) - slot, F.lit(fan)).cast("int"))
        return F.concat(*[F.when(wanted(F.lit(j)), F.coalesce(at(j), _empty())).otherwise(_empty()) for j in range(fan)])

    return joined.select(
        "group", "idx", "digest", "n", side(lambda j: j < slot).alias("before"), side(lambda j: j > slot).alias("after")
    )


@dataclass(frozen=True)
class Tree:
    """Written levels of the trees of all groups, and one root per group.

    ``levels[k]`` has (group, idx, digest, n, before, after) for groups with several nodes on level k; ``roots`` has
    (group, level, digest).
    """

    levels: tuple[DataFrame, ...]
    roots: DataFrame
    fan: int


def grow(leaves: DataFrame, fan: int = FAN) -> Tree:
    """The tree of every group of ``leaves`` (group, idx, digest, n). No leaves give no roots."""
    nodes = leaves.select("group", "idx", "digest", "n")
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    roots = nodes.where("n = 1").select("group", F.lit(0).alias("level"), "digest")
    while most > 1:
        level = materialize(_with_siblings(nodes.where("n > 1"), fan), "merkle-level")
        levels.append(level)
        # A node of slot zero has nothing before it.
        nodes = level.where(F.col("idx") % fan == 0).select(
            "group",
            F.floor(F.col("idx") / fan).cast("long").alias("idx"),
            _hash(F.concat("digest", "after")).alias("digest"),
            F.ceil(F.col("n") / fan).cast("long").alias("n"),
        )
        most = -(-most // fan)
        roots = roots.unionByName(nodes.where("n = 1").select("group", F.lit(len(levels)).alias("level"), "digest"))
    return Tree(tuple(levels), materialize(roots, "merkle-roots"), fan)


def hand_down(tree: Tree, tops: DataFrame) -> DataFrame:
    """Paths of all leaves: (group, idx, path, ...) where ``tops`` (group, path, ...) has the path of each root.

    ``path`` lists, from the leaf up, the digests left and right of the node on the way.
    """
    given = [c for c in tops.columns if c not in ("group", "path")]
    starts = tree.roots.select("group", "level").join(tops, "group")

    def rooted(level: int) -> DataFrame:
        return starts.where(F.col("level") == level).select("group", F.lit(0).cast("long").alias("idx"), "path", *given)

    paths = rooted(len(tree.levels))
    for k in reversed(range(len(tree.levels))):
        own = F.array(F.struct("before", "after"))
        level = tree.levels[k].select(
            "group", "idx", F.floor(F.col("idx") / tree.fan).cast("long").alias("_up"), own.alias("_own")
        )
        above = paths.withColumnRenamed("idx", "_up")
        lower = level.join(above, ["group", "_up"]).select("group", "idx", F.concat("_own", "path").alias("path"), *given)
        paths = lower.unionByName(rooted(k))
        if k:
            # The last paths are as many as the leaves: they are read once, as they come.
            paths = materialize(paths, "merkle-paths")
    return paths


def proof_digest(path: Column) -> Column:
    """Hex digest of all siblings of a path, level by level, left to right."""
    whole = F.aggregate(path, _empty(), lambda found, s: F.concat(found, s["before"], s["after"]))
    return F.sha2(hex_text(whole), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to, as 32 bytes."""
    return F.aggregate(path, leaf, lambda d, s: _hash(F.concat(s["before"], d, s["after"])))


def prove(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """Every row of ``rows`` (group, doc_id, leaf and others) with subroot, root and path, digests as 32 bytes.

    Within a group, leaves ascend by doc_id with null first, then by digest; repeated rows stand side by side, each with
    its own path. ``group`` comes from :func:`group_key`, so a null group is one like any other. Very long texts matter
    to :func:`row_digest` alone: only digests travel. No rows give no rows.
    """
    rows = materialize(rows, "merkle-leaves")
    placed = materialize(_numbered(rows, ["doc_id", "leaf"]), "merkle-numbered")
    tree = grow(placed.withColumnRenamed("leaf", "digest"), fan)
    subroots = tree.roots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    named = _numbered(subroots, ["name"])
    named = materialize(named, "merkle-subroots")
    top = grow(named, fan)
    crown = top.roots.select("group", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    down = hand_down(top, crown).join(named.select("group", "idx", "name", F.col("digest").alias("subroot")), ["group", "idx"])
    tops = materialize(down.select(F.col("name").alias("group"), "path", "root", "subroot"), "merkle-tops")
    return placed.drop("n").join(hand_down(tree, tops), ["group", "idx"]).drop("group", "idx")


def manifest(docs: DataFrame, fan: int = FAN, tampered: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root and path.

    Nulls in any of the five columns have a digest of their own; an empty text is not a null one. Other columns are
    ignored. With ``tampered``, a text expression, ``tampered_leaf`` is the digest of the row with that text, null where
    the expression is null.
    """
    names = ("doc_id", "source", "lang", "n_chars")
    digest = lambda text: row_digest([*map(F.col, names), text])
    columns = [group_key(F.col("lang")).alias("group"), "doc_id", digest(F.col("text")).alias("leaf")]
    if tampered is not None:
        columns.append(F.when(tampered.isNotNull(), digest(tampered)).alias("tampered_leaf"))
    return prove(docs.select(*columns), fan)
