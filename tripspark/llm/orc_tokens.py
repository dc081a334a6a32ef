"""Token ids as ORC files: one row per document in ascending doc_id order, ids run-length encoded as integers.

Files hold disjoint ranges of doc_id, so file and stripe statistics prune whole files and stripes; row indexes prune
inside a stripe and Bloom filters on doc_id answer lookups of single documents. Readers split large files by stripe.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripspark.llm.bpe import encoder, ship
from tripspark.session import materialize

END_ID = 2
ROW_INDEX_STRIDE = 1_000
STRIPE_BYTES = 32 << 20
BLOOM_FALSE_POSITIVES = 0.01
#: Bytes of ids that meet in one array, unless a single document has more.
ARRAY_BYTES = 8 << 20
#: Input bytes of a range of doc_id, which becomes a file.
RANGE_BYTES = 16 << 20
SCHEMA = "doc_id long, ordinal long, ids array<int>"


def _bounded(batch: pa.RecordBatch, encode) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows of a batch with their encoded texts, a few at a time: very long texts must not meet in one array."""
    first, held, size = 0, [], 0
    for row, text in enumerate(batch.column("text")):
        held.append(encode(text.as_py()))
        size += len(held[-1])
        if size >= ARRAY_BYTES or row + 1 == batch.num_rows:
            yield batch.slice(first, row + 1 - first), held
            first, held, size = row + 1, [], 0


def _range_number(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds are below a value, found in two steps; 0 for null."""
    step = max(1, round(len(bounds) ** 0.5))
    parts = [list(bounds[i : i + step]) for i in range(0, len(bounds), step)]
    if not parts:
        return F.lit(0)
    heads, rows = F.lit([p[0] for p in parts]), F.array(*[F.lit(p) for p in parts])
    whole = F.size(F.filter(heads, lambda head: head < value))
    last = F.get(rows, whole - 1)
    return F.when(whole == 0, 0).otherwise((whole - 1) * step + F.size(F.filter(last, lambda b: b < value)))


def _in_ranges(docs: DataFrame) -> DataFrame:
    """The rows dealt out by ascending ranges of doc_id, with bounds from that column alone: texts are read once."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # A plan that doesn't know its size says a number near the largest there is.
    known = size if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGE_BYTES
    parts = max(spark.sparkContext.defaultParallelism, known // RANGE_BYTES)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = docs.agg(F.percentile_approx("doc_id", shares, F.lit(20 * parts))).first()[0] if parts > 1 else None
    number = _range_number(F.col("doc_id"), sorted(set(found or ())))
    return docs.repartitionById(parts, F.coalesce(number, F.lit(0)).cast("int"))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write the ids of every whole text of ``docs`` (doc_id, text), each followed by ``end_id``.

    Texts are shuffled once, by range of doc_id, and encoded on the reading side. A null text is empty: its row holds
    the end id alone. Null ids come first; rows that repeat a doc_id stand next to each other, ordered by text.
    ``ordinal`` numbers the rows of a file. Other columns are ignored; no rows give a folder without rows.
    """
    shipped = ship(docs.sparkSession, tokenizer_path)
    end = np.uint32(end_id).tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, row = encoder(shipped), 0
        for batch in batches:
            for part, raw in _bounded(batch, lambda text: code.ids(text) + end):
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                rows = pa.array(np.arange(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), rows, ids], ["doc_id", "ordinal", "ids"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = _in_ranges(rows).sortWithinPartitions("doc_id", "text")
    (
        ranged.mapInArrow(encoded, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FALSE_POSITIVES))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """Rows (doc_id, ordinal, ids); with ``doc_ids``, only stripes that may hold one of them are read."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends = lists.offsets.to_numpy()
        raw = memoryview(lists.values.to_numpy().astype("<i4", copy=False).tobytes())
        marks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file"),
                batch.column("doc_id"),
                batch.column("ordinal"),
                pa.array(np.diff(ends), pa.int64()),
                pa.array(marks, pa.int64()),
            ],
            ["file", "doc_id", "ordinal", "n_tokens", "ids_crc32"],
        )


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Per document read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts are added up within each file and, over one row per file, between files; no task sees all documents.
    """
    rows = read_tokens(spark, path).select(F.col("_metadata.file_path").alias("file"), "doc_id", "ordinal", "ids")
    read = materialize(
        rows.mapInArrow(_digests, "file string, doc_id long, ordinal long, n_tokens long, ids_crc32 long"), "positions"
    )
    # One row per file. Ranges are disjoint; a file of null ids comes first.
    files = read.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("size"))
    before = Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return read.join(files, "file").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
