"""Fill-in-the-middle texts, with cuts found through content-defined chunks.

A rolling hash over the last 32 bytes cuts each text into chunks where its upper bits are zero, so passages that texts
share give the same chunks wherever they stand. A worker keeps a summary of each chunk it has met, found again by the
chunk's whole content: how many lines end in it and where, how many code points it has, and what matters at its
boundaries (whether a control string is inside, its first and last bytes). Adding up the counts of a text's chunks gives
its lines and names the chunk that holds a cut; the offset inside comes from the summary.

No row needs another, so nothing is shuffled. Summaries are a function of the content alone: a worker that is lost, or a
memo that starts again, changes nothing but time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, RATE, SPM_SHARE = "7", 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARKS = (PREFIX, SUFFIX, MIDDLE)

#: Bytes under the rolling hash; shortest and longest chunk; a chunk ends with a chance of 1 in 2048 at each byte.
WINDOW, SHORTEST, LONGEST, ZERO_BITS = 32, 256, 16_384, 11
#: Bytes hashed at a time, bytes of chunks in a generation of the memo, bytes of texts that meet in one array.
_BLOCK, _MEMO_BYTES, _ARRAY_BYTES = 1 << 20, 32 << 20, 8 << 20


def _spread(byte: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random number per byte value, by two rounds of multiply and shift."""
    x = (byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(16)).astype(np.uint32)


_NUMBERS = _spread(np.arange(256))


def _hash_ends(data: bytes) -> Iterator[int]:
    """Ascending ends of the places where the rolling hash asks for a cut."""
    for start in range(0, len(data), _BLOCK):
        before = min(start, WINDOW - 1)
        block = np.frombuffer(data, np.uint8, min(len(data), start + _BLOCK) - start + before, start - before)
        mixed = _NUMBERS[block]
        width = 1
        while width < WINDOW:
            # Sums over a window of twice the width, the older half shifted out of the way.
            mixed[width:] += mixed[: max(0, len(mixed) - width)] << np.uint32(width)
            width *= 2
        cuts = np.flatnonzero(mixed[before:] >> np.uint32(32 - ZERO_BITS) == 0)
        yield from (cuts + start + 1).tolist()


def chunks(data: bytes) -> Iterator[bytes]:
    """The content-defined chunks of a text, in order."""
    start = 0
    for end in _hash_ends(data):
        while end - start > LONGEST:
            yield data[start : start + LONGEST]
            start += LONGEST
        if end - start >= SHORTEST:
            yield data[start:end]
            start = end
    while start < len(data):
        yield data[start : start + LONGEST]
        start += LONGEST


def _code_points(data: bytes) -> int:
    raw = np.frombuffer(data, np.uint8)
    return len(raw) - int(np.count_nonzero((raw & 0xC0) == 0x80))


@dataclass(frozen=True, slots=True)
class Summary:
    """What a chunk adds to its text."""

    line_ends: np.ndarray
    code_points: int
    marked: bool
    head: bytes
    tail: bytes


def summarise(chunk: bytes) -> Summary:
    ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10).astype(np.int32) + 1
    marked = any(mark in chunk for mark in _MARKS)
    return Summary(ends, _code_points(chunk), marked, chunk[:2], chunk[-2:])


class ChunkMemo:
    """Summaries by content, in two generations of bounded bytes; what is met again moves to the young one."""

    def __init__(self, most_bytes: int = _MEMO_BYTES):
        self.most, self.held, self.young, self.old = most_bytes, 0, {}, {}

    def __getitem__(self, chunk: bytes) -> Summary:
        # A dictionary compares whole contents, so equal hashes of other chunks don't count.
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or summarise(chunk)
            if self.held > self.most:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = found
            self.held += len(chunk) + 4 * len(found.line_ends) + 200
        return found


class CutText:
    """A text with the summaries of its chunks."""

    def __init__(self, data: bytes, memo: ChunkMemo):
        self.data = data
        self.parts = list(chunks(data))
        self.summaries = [memo[part] for part in self.parts]
        self.line_ends = list(accumulate(len(s.line_ends) for s in self.summaries))
        self.n_lines = (self.line_ends[-1] if self.parts else 0) + (bool(data) and not data.endswith(b"\n"))

    def holds_mark(self) -> bool:
        """Whether a control string stands in the text, inside a chunk or across the ends of chunks."""
        edge = b""
        for part, summary in zip(self.parts, self.summaries, strict=True):
            if summary.marked or any(mark in edge + summary.head for mark in _MARKS):
                return True
            edge = summary.tail if len(part) > 1 else (edge + summary.tail)[-2:]
        return False

    def after_line(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` lines."""
        if k == 0:
            return 0, 0
        # The chunk in which line k ends; a last line without an end lies in none.
        at = bisect_left(self.line_ends, k)
        points = sum(s.code_points for s in self.summaries[:at])
        start = sum(map(len, self.parts[:at]))
        if at == len(self.parts):
            return start, points
        inside = int(self.summaries[at].line_ends[k - 1 - (self.line_ends[at - 1] if at else 0)])
        return start + inside, points + _code_points(self.parts[at][:inside])


def _draws(seed: str, doc_id: int | None) -> list[int]:
    name = f"{seed}:" + ("" if doc_id is None else str(doc_id))
    found = hashlib.sha256(name.encode()).hexdigest()
    return [int(found[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearrange(doc_id: int | None, text: str | None, memo: ChunkMemo, seed: str, rate: int, spm_share: int):
    """(n, form, prefix_chars, middle_chars, output bytes) of one text."""
    data = (text or "").encode()
    cut = CutText(data, memo)
    h1, h2, h3, h4 = _draws(seed, doc_id)
    if not data or h3 % 100 >= rate or cut.holds_mark():
        return cut.n_lines, "plain", None, None, data
    first, second = sorted((h1 % (cut.n_lines + 1), h2 % (cut.n_lines + 1)))
    (a, a_points), (b, b_points) = cut.after_line(first), cut.after_line(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_share:
        form, output = "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    else:
        form, output = "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return cut.n_lines, form, a_points, b_points - a_points, output


_MEMO = ChunkMemo()
_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n lines, form, prefix_chars, middle_chars and the output text.

    ``rate`` percent of the texts are rearranged, ``spm_share`` percent of these with the suffix first; the draws depend
    on seed and doc_id alone, so rows that repeat a doc_id draw alike and a null doc_id draws as an empty one. A null
    text is empty; empty texts and texts that hold a control string stay plain. Very long texts are hashed in blocks.
    Other columns are ignored; no rows give no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def columns(rows: list) -> pa.RecordBatch:
            values = list(zip(*rows, strict=True))
            arrays = [pa.array(v, k) for v, k in zip(values[:5], kinds, strict=True)]
            arrays.append(pa.array(values[5], pa.binary()).cast(pa.string()))
            return pa.RecordBatch.from_arrays(arrays, _NAMES)

        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                key = doc_id.as_py()
                rows.append((key, *rearrange(key, text.as_py(), _MEMO, seed, rate, spm_share)))
                size += len(rows[-1][-1])
                if size > _ARRAY_BYTES:
                    yield columns(rows)
                    rows, size = [], 0
            if rows:
                yield columns(rows)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(
        cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(form: Column, output: Column) -> Column:
    """The text behind an output: each control string occurs once in a rearranged text."""
    p, s, m = (mark.decode() for mark in _MARKS)
    body = F.substring_index(output, m, 1)
    middle = F.substring_index(output, m, -1)
    left = lambda first, second: F.substring_index(F.substring_index(body, first, -1), second, 1)
    psm = F.concat(left(p, s), middle, F.substring_index(body, s, -1))
    spm = F.concat(F.substring_index(body, p, -1), middle, left(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
