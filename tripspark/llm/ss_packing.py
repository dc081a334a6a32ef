"""Packing documents into sequences of a fixed length by sums of squares.

Only documents longer than a sequence are cut. Pieces are dealt into groups of about ``GROUP_PIECES`` by position in
the written table, so no value can make a group hot, and each group is packed by itself, longest piece first: a piece
goes into the open sequence that leaves the smallest sum of squared counts of open sequences per residual gap; a new
sequence is opened only when no open one has room. A group loses at most the room of its last sequences, a fraction of
a thousandth of its length on texts of mixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.llm.bpe import encoder, ship
from tripspark.session import materialize

CAPACITY = 4096
END_ID = 1
#: Pieces packed by one task; bounds its memory, not the result's coverage.
GROUP_PIECES = 8192

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32")


def cut_into_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Per piece of every whole text: doc_id, piece, start, length, ids_crc32 and, on demand, the ids themselves.

    A null text is empty and has one piece with the end id alone. Every row is a document of its own, also where doc_id
    is null or repeats. Other columns are ignored.
    """
    shipped = ship(docs.sparkSession, tokenizer_path)
    end = np.uint32(end_id).tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(shipped)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, parts = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = code.ids(text) + end
                    for number, start in enumerate(range(0, len(raw), width)):
                        own = raw[start : start + width]
                        rows.append((doc, number, start // 4, len(own) // 4, zlib.crc32(own)))
                        parts.append(own)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                names = list(_FIELDS)
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECE + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order."""
    open_bins = np.zeros(capacity + 1, np.int64)
    by_gap: dict[int, list[int]] = {}
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    closed = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        gaps = open_bins[size:]
        # A bin that moves from gap g to g - size changes the sum by 2 (count there - count here) + 2;
        # one that becomes full leaves the count, so only its own term falls.
        change = 2 * (open_bins[: capacity + 1 - size] - gaps) + 2
        change[0] = 1 - 2 * gaps[0]
        change[gaps == 0] = closed
        best = int(change.argmin())
        if change[best] == closed:
            gap, chosen = capacity, made
            made += 1
        else:
            gap = size + best
            chosen = by_gap[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = chosen, capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            by_gap.setdefault(gap - size, []).append(chosen)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces (see :func:`cut_into_pieces`) with sequence_id and offset; sequences are filled without gaps from 0.

    Ties in length are ordered by doc_id, piece and the other columns, so equal tables give equal sequences. No rows
    give no rows.
    """
    pieces = materialize(pieces.select(*_FIELDS), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))
    # Numbers of rows of a written table: the same in every attempt of a task.
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")

    def packed(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["length", *_FIELDS[:3], "ids_crc32"], ascending=[False] + [True] * 4)
        bins, offsets = sum_of_squares(table["length"].to_numpy(), capacity)
        table["sequence_id"] = bins * groups + int(table["bucket"].iloc[0])
        table["offset"] = offsets
        return table.drop(columns="bucket")

    return (
        pieces.withColumn("bucket", spread)
        .groupBy("bucket")
        .applyInPandas(packed, _PIECE + ", sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Cut and pack all documents: one row per piece with its place."""
    return pack(cut_into_pieces(docs, tokenizer_path, capacity, end_id), capacity)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The training sequences themselves: sequence_id, n_tokens and ids (little-endian unsigned 32-bit)."""
    ids = cut_into_pieces(docs, tokenizer_path, capacity, end_id, with_ids=True)
    ids = ids.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    placed = pack_documents(docs, tokenizer_path, capacity, end_id)
    same = placed["doc_id"].eqNullSafe(ids["doc_id"]) & (placed["piece"] == ids["piece"])
    rows = placed.join(ids, same & (placed["ids_crc32"] == ids["ids_crc32"]))
    in_order = F.sort_array(F.collect_list(F.struct(placed["offset"], ids["ids"])))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, p) -> a || p.ids)")
    return (
        rows.groupBy("sequence_id")
        .agg(F.sum(placed["length"]).alias("n_tokens"), in_order.alias("parts"))
        .select("sequence_id", "n_tokens", joined.alias("ids"))
    )
