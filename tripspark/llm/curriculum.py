"""Mixing sources to target weights as a time-varying curriculum.

Targets: sources share a budget by weight, none above ``MOST_REPEATS`` times its size. Within a source, documents stand in
a fixed pseudo-random order and their words form a line that repeats after its end; the mix takes the line up to the
target. Each source has a weight schedule over training time; the integral of the schedule says what share of the
target is due by a time, so inverting it gives the time at which a word of the line is due, and that is the training
position of its document.

Sums along a line are made in two levels: documents of a source are dealt into buckets by the digest that orders them,
bucket totals are added up, and each bucket is added up by itself. So a source with a third of all documents is spread
over as many tasks as there are buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.llm.words import word_list
from tripspark.session import materialize

#: Fixed values of the mix: weights by source in code point order, repeating; words taken for each word there is.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_REPEATS = 2
#: Relative weight at equally spaced times from the start to the end of training, by source like the weights:
#: more and more, less and less, highest halfway.
SCHEDULES = ((0.5, 1.0, 1.5), (1.5, 1.0, 0.5), (0.75, 1.5, 0.75))
#: Hexadecimal digits of the ordering digest that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Per source of ``sizes`` (source, size): source_size, weight, turn (its place in the lists) and target.

    The excess over the limit is reshared by weight until no source is above it: sources are full in the order of
    limit by weight, and the first for which the budget does not suffice sets the common level for it and all after.
    This runs over one row per source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    lists = F.array(*[F.lit(w) for w in weights])
    turn = F.pmod(place, F.lit(len(weights)))
    own = own.withColumn("turn", turn).withColumn("weight", F.get(lists, F.col("turn")))
    own = own.withColumn("most", F.col("source_size") * MOST_REPEATS)
    everything = Window.partitionBy()
    upward = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(
        "*",
        (F.sum("source_size").over(everything) * BUDGET).alias("budget"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
    )
    level = (F.col("budget") - F.col("full")) / F.col("open_weight")
    # A source is full where the level before it would lift it over its limit. After the first that is not full, the
    # levels fall, so the largest of those left is the one that holds.
    level = F.when(level * F.col("weight") <= F.col("most"), level)
    own = own.withColumn("level", F.max(level).over(everything))
    share = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return own.select("source", "source_size", "turn", "weight", share.alias("target"))


def due_time(share: Column, schedule: Sequence[float]) -> Column:
    """The time in [0, 1] by which a share of the target is due: the inverse of the schedule's integral.

    Weights are linear between equally spaced times, so the integral is quadratic on each piece and its inverse a
    square root, written without loss where the slope is small.
    """
    pieces = len(schedule) - 1
    areas = [(schedule[i] + schedule[i + 1]) / 2 for i in range(pieces)]
    total, found, before = sum(areas), F.lit(1.0), sum(areas)
    for i in reversed(range(pieces)):
        low, slope = schedule[i], schedule[i + 1] - schedule[i]
        before -= areas[i]
        area = F.greatest(F.lit(0.0), share * total - before)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(low * low) + 2 * slope * area))
        inside = F.try_divide(2 * area, low + root)
        time = (i + F.least(F.lit(1.0), F.coalesce(inside, F.lit(0.0)))) / pieces
        found = F.when(share * total <= before + areas[i], time).otherwise(found)
    return found


def _ordered(docs: DataFrame, carried: Sequence[Column]) -> DataFrame:
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        F.coalesce("source", F.lit("")).alias("s"),
        F.col("source").isNull().alias("none"),
        digest.alias("digest"),
        F.substring(digest, 1, BUCKET_DIGITS).alias("bucket"),
        F.size(word_list(F.col("text"))).cast("long").alias("size"),
        *carried,
    )


def _line(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``rows`` of :func:`_ordered` with source_size, turn, target and ``at``, the words before the document."""
    key = ["s", "none", "bucket"]
    buckets = materialize(narrow.groupBy(*key).agg(F.sum("size").alias("size")), "buckets")
    source = F.when(~F.col("none"), F.col("s"))
    wanted = targets(buckets.select(source.alias("source"), "size"))
    along = Window.partitionBy("s", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.select(*key, F.coalesce(F.sum("size").over(along), F.lit(0)).alias("base"))
    wanted = wanted.select(
        F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "turn", "target"
    )
    base = materialize(base.join(wanted, ["s", "none"]), "lines")
    tie = [F.col(c) for c in ("digest", "size", "tie") if c in rows.columns]
    inside = Window.partitionBy(*key).orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(base, key).withColumn("at", F.col("base") + F.col("own"))


def _taken(whole: bool) -> Column:
    """Words of each pass over the line that the mix takes, as an array by pass."""
    passes = []
    for number in range(MOST_REPEATS):
        start = F.col("at") + number * F.col("source_size")
        if whole:
            words = F.when(start + F.col("size") / 2 < F.col("target"), F.col("size")).otherwise(F.lit(0))
        else:
            words = F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - start))
        passes.append(words.cast("long"))
    return F.array(*passes)


def _position(number: Column) -> Column:
    """Training position of a document's copy: when the first of its words is due."""
    share = F.try_divide((F.col("at") + number * F.col("source_size")).cast("double"), F.col("target"))
    times = F.lit(None).cast("double")
    for turn, schedule in enumerate(SCHEDULES):
        times = F.when(F.col("turn") == turn, due_time(share, schedule)).otherwise(times)
    return times


def mix(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken and positions.

    ``taken`` counts the words that the mix takes, repeats counted; a source's sum is its target, rounded. Only the
    last document of a line is taken in part. A null text has no words and is not taken; documents without a source
    are a source, the last; rows that repeat a doc_id follow each other. No rows give no rows.
    """
    rows = materialize(_ordered(docs, [F.col("doc_id")]), "sized")
    line = _line(rows, rows).withColumn("words", _taken(whole=False))
    copies = F.filter(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), lambda n: F.get("words", n) > 0)
    return line.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b).alias("taken"),
        F.transform(copies, _position).alias("positions"),
    )


def mix_in_training_order(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` what :func:`mix` says, made from copies that are range-sorted by training position.

    Each copy that the mix takes is a row of its own; a document that it doesn't take is one without a position. The
    sorted copies are written, and ``taken`` and ``positions`` are put together from them. Documents come in the order
    of their first copy, those that are not taken last.
    """
    rows = materialize(_ordered(docs, [F.col("doc_id")]), "sized")
    line = _line(rows, rows).withColumn("words", _taken(whole=False)).withColumn("row", F.monotonically_increasing_id())
    line = materialize(line, "mixed")
    copies = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), lambda n: F.get("words", n) > 0),
        lambda n: F.struct(_position(n).alias("position"), F.get("words", n).alias("words")),
    )
    own = ["row", "doc_id", "size", "source_size", "target"]
    each = line.select(*own, F.explode_outer(copies).alias("copy")).select(*own, "copy.*")
    order = [F.col("position").asc_nulls_last(), F.col("doc_id"), F.col("row")]
    each = materialize(each.repartitionByRange(*order).sortWithinPartitions(*order), "training-copies")
    whole = each.groupBy(*own).agg(
        F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"),
        F.sort_array(F.collect_list("position")).alias("positions"),
    )
    first = [F.get("positions", F.lit(0)).asc_nulls_last(), F.col("doc_id"), F.col("row")]
    whole = whole.repartitionByRange(*first).sortWithinPartitions(*first)
    return whole.select("doc_id", "size", "source_size", "target", "taken", "positions")


def in_training_order(docs: DataFrame) -> DataFrame:
    """The mixed documents with all their columns, whatever their names: each as often as the mix takes it, range-sorted
    by training position.

    Whole documents are taken: a copy is in if its middle lies before the target. Documents without words are in the
    mix once, at the place where they stand, if their source still takes words there. Ties stand by doc_id.
    """
    carried = [F.struct("*").alias("doc"), F.xxhash64("text").alias("tie"), F.col("doc_id").alias("id")]
    line = _line(_ordered(docs, carried), _ordered(docs, []))
    line = line.withColumn("words", _taken(whole=True))
    empty = (F.col("size") == 0) & (F.col("at") < F.col("target"))
    copies = F.filter(
        F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), lambda n: (F.get("words", n) > 0) | (empty & (n == 0))
    )
    placed = line.select("doc", "id", F.explode(F.transform(copies, _position)).alias("position"))
    return placed.repartitionByRange("position", "id").sortWithinPartitions("position", "id").select("doc.*")
