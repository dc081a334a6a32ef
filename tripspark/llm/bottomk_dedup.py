"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles; a document retains its ``SKETCH`` smallest values. Inverted lists over retained
values propose pairs, the sketch of the union estimates their similarity, and the full sets confirm it.

How the lists stay short without dropping anything:

* Documents with equal sets are one class from the start, so exact copies never meet in a list.
* Two sets of similarity 0.75 share at least ``SHARED`` of 64 retained values (the chance of fewer is below 2e-9 for a
  pair exactly at the limit and falls fast above it). So they also share one of the values that remain when each leaves
  out its ``SHARED - 1`` most frequent ones. Passages that many documents share are the most frequent and go first.
* Each list first compares its members with one representative for each step of size. What these links join needs no
  further pair, and a list whose members are all joined is done.
* Members of the lists that stay open get sketches of ``WIDE`` values: the whole sets of most texts, where nothing is
  left to chance. Their lists hold only texts that are alike in most shingles, and only members of different components
  are compared.
* A pair is proposed only if enough values are left, from the one it meets at, for the overlap it needs: at its first
  common value, all its common values come from there on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tripspark.llm.components import connected_components
from tripspark.llm.shingles import shingle_set
from tripspark.session import materialize

SKETCH, WIDE = 64, 512
#: Six standard deviations below the shared values that are expected of sets that are just similar enough.
SHARED, WIDE_SHARED = 24, 325
#: Similarity of at least NEAR_PARTS / 100.
NEAR_PARTS = 75

_SKETCHED = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_shingles", LongType()),
        StructField("digest", BinaryType()),
        StructField("sketch", ArrayType(LongType(), False)),
    ]
)
_WIDE = StructType([StructField("rep", LongType()), StructField("sketch", ArrayType(LongType(), False))])
_SETS = StructType([StructField("doc_id", LongType()), StructField("prints", BinaryType())])
_LINKS = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                _lists(sets, SKETCH),
            ],
            ["doc_id", "n_shingles", "digest", "sketch"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "prints"])


def _lists(sets: list[np.ndarray], size: int) -> pa.ListArray:
    heads = [s[:size] for s in sets]
    ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
    values = np.concatenate(heads) if heads else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prints")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(sets, WIDE)], ["rep", "sketch"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("prints_a"), batch.column("prints_b"), strict=True):
            one, two = (np.frombuffer(z.as_buffer(), np.int64) for z in (x, y))
            shared = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(100 * shared >= NEAR_PARTS * (len(one) + len(two) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _estimate(a: Column, b: Column, size: int) -> Column:
    """Share of the union's smallest values that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _least_estimate(size: int) -> float:
    """Six standard deviations of an estimate from ``size`` values below the similarity asked for."""
    near = NEAR_PARTS / 100
    return near - 6 * (near * (1 - near) / size) ** 0.5


def _may_overlap(x: Column, y: Column, left: Column, size: int) -> Column:
    """Whether ``left`` common values are enough for sets of x and y shingles whose sketches hold ``size`` values.

    Similar sets share (x + y) * 75 / 175 shingles. Whole sets need all of these; of sketches, the share that falls
    below both ends is expected, less six standard deviations.
    """
    shared = (x + y) * NEAR_PARTS / (100 + NEAR_PARTS)
    part = shared / F.greatest(x, y)
    expected = size * part - 6 * F.sqrt(size * part * (1 - part))
    needed = F.when((x <= size) & (y <= size), shared - 1e-6).otherwise(F.least(expected, shared - 1e-6))
    return (100 * F.least(x, y) >= NEAR_PARTS * F.greatest(x, y)) & (left >= needed)


def _sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Full sets (doc_id, prints) of the documents named by ``wanted`` (doc_id), written."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    # Rows that repeat a doc_id may differ; all their sets stand for it.
    return materialize(texts.mapInArrow(_full_sets, _SETS).dropDuplicates(["doc_id", "prints"]), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = materialize(pairs, "proposed")
    first = sets.select(F.col("doc_id").alias("a"), F.col("prints").alias("prints_a"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("prints").alias("prints_b"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(_confirmed, _LINKS)


def _likely(pairs: DataFrame, sketches: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) that the sketch of their union finds similar."""
    first = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
    second = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
    near = _estimate(F.col("sketch_a"), F.col("sketch_b"), size) >= _least_estimate(size)
    return pairs.join(first, "a").join(second, "b").where(near).select("a", "b")


def _inverted_lists(classes: DataFrame, size: int, shared: int) -> DataFrame:
    """Rows (value, rep, n_shingles, common, left) of the retained values that similar sets cannot all miss.

    ``common`` is how many of its retained values the set has in common with others, ``left`` how many of these come
    from this value on.
    """
    postings = classes.select("rep", "n_shingles", F.explode("sketch").alias("value"))
    frequent = postings.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    # Where partners have fewer shingles than a sketch holds, both sketches are whole sets.
    whole = F.col("n_shingles") < size * NEAR_PARTS // 100
    needed = F.when(whole, F.ceil(F.col("n_shingles") * NEAR_PARTS / 100)).otherwise(shared)
    held = (
        postings.join(frequent, "value")
        .groupBy("rep", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("held"))
        .where(F.size("held") >= needed)
    )
    chosen = F.slice("held", F.lit(1), (F.size("held") - needed + 1).cast("int"))
    each = held.select("rep", "n_shingles", F.size("held").alias("common"), F.posexplode(chosen).alias("place", "item"))
    left = F.col("common") - F.col("place")
    return each.select("rep", "n_shingles", "common", left.alias("left"), F.col("item.value").alias("value"))


def _mixed_lists(lists: DataFrame) -> DataFrame:
    """The rows of lists that hold several components, with ``earlier``: the values that the set met before this one.

    A set has at most WIDE values. A pair's first common value leaves most values over for its overlap, so a pair that
    may not overlap enough there may not do so later either.
    """
    several = lists.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = lists.join(several.where("lo < hi").select("value"), "value")
    before = Window.partitionBy("rep").orderBy(F.desc("left")).rowsBetween(Window.unboundedPreceding, -1)
    return materialize(mixed.withColumn("earlier", F.collect_list("value").over(before)), "across")


def _discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        folders = {file.rpartition("/")[0] for file in table.inputFiles()}
        for folder in folders:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    Null and blank texts have no shingles and are their own component. Rows that repeat a doc_id are one node with the
    links of all its rows. A null doc_id belongs to no component; its component_id and kept are null unless another
    row has the same set. Other columns are ignored, no rows give no rows.
    """
    sketched = materialize(docs.select("doc_id", "text").mapInArrow(_sketched, _SKETCHED), "sketches")
    filled = sketched.where("n_shingles > 0")
    classes = materialize(
        filled.groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        .where("rep is not null"),
        "classes",
    )
    lists = materialize(_inverted_lists(classes, SKETCH, SHARED), "lists")
    # Texts move once: every set that is compared below belongs to a member of a list.
    sets = _sets_of(lists.select(F.col("rep").alias("doc_id")).distinct(), docs)

    step = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(100 / NEAR_PARTS)))
    sized = lists.withColumn("step", step)
    # The text that edited copies come from has most in common with them; ties go to the smallest id.
    rank = F.struct("common", -F.col("rep"), "rep", "n_shingles", "left")
    heads = sized.groupBy("value", "step").agg(F.max(rank).alias("head"))
    stars = sized.join(heads, ["value", "step"]).where("head.rep <> rep")
    enough = _may_overlap(F.col("n_shingles"), F.col("head.n_shingles"), F.least("left", "head.left"), SKETCH)
    stars = stars.where(enough)
    pairs = stars.select(F.least("head.rep", "rep").alias("a"), F.greatest("head.rep", "rep").alias("b")).distinct()
    found = materialize(_confirm(_likely(pairs, classes, SKETCH), sets), "near")
    joined = materialize(connected_components(found, "a", "b"), "joined")

    member = lists.join(joined, F.col("rep") == F.col("node"), "left").drop("node")
    member = member.withColumn("component", F.coalesce("component", "rep"))
    open_lists = member.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    still = member.join(open_lists.where("lo < hi").select("value"), "value")
    still = materialize(still.select("rep", "n_shingles", "component").distinct(), "open")
    opened = sets.join(still.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    wide = materialize(opened.mapInArrow(_widened, _WIDE).dropDuplicates(["rep"]).join(still, "rep"), "wide")
    around = _mixed_lists(_inverted_lists(wide, WIDE, WIDE_SHARED).join(still.select("rep", "component"), "rep"))
    x, y = around.alias("x"), around.alias("y")
    meet = (
        (F.col("x.value") == F.col("y.value"))
        & (F.col("x.component") < F.col("y.component"))
        & _may_overlap(F.col("x.n_shingles"), F.col("y.n_shingles"), F.least("x.left", "y.left"), WIDE)
        # Alike texts share many values; they are compared at the first of them.
        & ~F.arrays_overlap("x.earlier", "y.earlier")
    )
    across = x.join(y, meet).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = _confirm(_likely(across, wide, WIDE), sets)

    rows = filled.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left")
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi")
    same_id = rows.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    # What is joined already comes in as stars, not as the links that made them.
    links = joined.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more).union(same_id)
    component = materialize(connected_components(links, "a", "b"), "components")
    # The components are written; what they were found with is as large as the texts.
    _discard(lists, sets, still, wide, around, found, joined)
    rows = rows.join(component, F.col("rep") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    blank = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.union(blank).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns.

    Every row is a node of its own, whatever its doc_id: rows with null or repeated ids go only if they are copies. Of a
    group, the row with the smallest doc_id stays, null last. Rows whose text is null, empty or blank are copies of
    nothing and stay. Very long texts are compared whole; columns of any name come back as they are; no rows give none.
    """
    # Written with a key of their own, so that the key means the same row wherever it is read.
    keyed = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_key")), "keyed")
    found = near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), F.col("row.text").alias("text")))
    ids = keyed.select("row_key", F.col("row.doc_id").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "row_key")
    kept = found.join(ids, found["doc_id"] == ids["row_key"]).groupBy("component_id").agg(F.min(order).alias("first"))
    kept = materialize(kept.select(F.col("first.row_key").alias("row_key")), "kept-rows")
    return keyed.join(kept, "row_key", "left_semi").select("row.*")
