"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine >= s are points at distance <= sqrt(2 - 2 s). Every vector is at home in the cell of its
nearest pivot; the triangle inequality and the distance to the bisecting plane of two pivots say which other cells may
hold a partner, and the vector visits those. Cells then join independently, in blocks of bounded size: a pair of blocks
is one task's work, so a crowded cell is split over many tasks and no task holds more than two blocks.

Equal vectors are one class from the start and stand for all their rows. Blocks report how many links each class has
and a spanning forest of the links, never the pairs.

Pivots are drawn from a bounded sample; they decide where work is done, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.llm.components import connected_components
from tripspark.session import materialize

COSINE = 0.95
#: Vectors in a block; two of them are joined by one task.
BLOCK = 8192
#: Mean vectors for each pivot, and the largest number of pivots. The pivots are the only thing sent to all tasks.
CELL, MOST_PIVOTS = 8192, 256
#: Vectors among which pivots are chosen.
PIVOT_SAMPLE = 4096
#: Room for rounding in distance bounds; it can only add visits.
SLACK = 1e-6
_ROWS_AT_ONCE = 512


def _far_apart(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Points of the sample, the first near its mean, each next one at the third quarter of the distances so far:
    far from those before it, yet no outlier."""
    chosen = [int((sample @ sample.mean(axis=0)).argmax())]
    away = 2 - 2 * sample @ sample[chosen[0]]
    while len(chosen) < min(wanted, len(sample)):
        chosen.append(int(np.argsort(away, kind="stable")[3 * len(away) // 4]))
        away = np.minimum(away, 2 - 2 * sample @ sample[chosen[-1]])
    return sample[sorted(set(chosen))]


def _units(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large or small components neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _unit_vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column, all of one length, as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _units(values.reshape(len(column), -1))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


class _Pivots:
    """Pivots by vector length, and which cells a vector must visit."""

    def __init__(self, sample: pd.DataFrame, total: int):
        self.points: dict[int, np.ndarray] = {}
        for dim, rows in sample.groupby("dim"):
            wanted = total * len(rows) / len(sample) / CELL
            points = _units(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
            self.points[int(dim)] = _far_apart(points, int(min(MOST_PIVOTS, max(1, round(wanted)))))
        self.radius: dict[tuple[int, int], float] = {}

    def distances(self, dim: int, rows: np.ndarray) -> np.ndarray:
        if dim not in self.points:
            return np.zeros((len(rows), 1))
        return np.sqrt(np.maximum(0, 2 - 2 * rows @ self.points[dim].T))

    def visits(self, dim: int, away: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the later cells that may hold a partner of theirs."""
        if dim not in self.points:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        points = self.points[dim]
        home = away.argmin(axis=1)
        own = away[np.arange(len(away)), home]
        between = np.sqrt(np.maximum(0, 2 - 2 * points @ points.T))[home]
        plane = (away**2 - own[:, None] ** 2) / (2 * np.maximum(between, 1e-12))
        radius = np.array([self.radius.get((dim, cell), -np.inf) for cell in range(len(points))])
        open_to = (away <= radius + reach + SLACK) & (plane <= reach + SLACK)
        open_to &= np.arange(len(points)) > home[:, None]
        return np.nonzero(open_to)


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the label trees of linked positions; returns labels with every tree flat."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not (labels[labels] == labels).all():
            labels = labels[labels]


def _join_blocks(table: pa.Table, cosine: float) -> pa.Table:
    """Links of one pair of blocks, or of one block with itself: for each class its number of linked rows, and the
    smallest class that links reach here."""
    table = table.sort_by([("side", "ascending"), ("k", "ascending")])
    sides, ids = table.column("side").to_numpy(), table.column("k").to_numpy()
    weights, points = table.column("rows").to_numpy(), _unit_vectors(table.column("embedding"))
    first = int((sides == 0).sum())
    alone = bool(table.column("alone")[0].as_py())
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    counts, labels = np.zeros(len(ids)), np.arange(len(ids))
    shift = 0 if alone else first
    for at in range(0, first, _ROWS_AT_ONCE):
        near = points[at : min(at + _ROWS_AT_ONCE, first)] @ points[shift:].T >= cosine
        if alone:
            near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        a, b = np.nonzero(near)
        a, b = a + at, b + shift
        counts += np.bincount(a, weights[b], len(ids))
        if not alone:
            counts += np.bincount(b, weights[a], len(ids))
        labels = _forest(labels, place[a], place[b])
    linked = counts > 0
    return pa.table(
        {
            "k": pa.array(ids[linked], pa.int64()),
            "n": pa.array(counts[linked].astype(np.int64)),
            "head": pa.array(ids[order][labels[place]][linked], pa.int64()),
        }
    )


def _links(classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """Rows (k, n, head) of every pair of blocks in which a class has links."""
    reach = float(np.sqrt(2 - 2 * cosine))
    # The vectors with the smallest hashes; only hashes meet in one task.
    drawn = classes.select("dim", "embedding", F.xxhash64("k").alias("draw"))
    last = drawn.select("draw").orderBy("draw").limit(PIVOT_SAMPLE).agg(F.max("draw")).first()[0]
    sample = drawn.where(F.col("draw") <= F.lit(last).cast("long")).select("dim", "embedding").toPandas()
    pivots = _Pivots(sample, classes.count())

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                away = pivots.distances(dim, _unit_vectors(part.column("embedding")))
                cells, where = np.unique(away.argmin(axis=1), return_inverse=True)
                most = np.zeros(len(cells))
                np.maximum.at(most, where, away.min(axis=1))
                columns = [np.full(len(cells), dim), cells, most, np.bincount(where)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["dim", "cell", "radius", "n"])

    # At most one row for each pivot and vector length.
    sized = classes.mapInArrow(homes, "dim long, cell long, radius double, n long").groupBy("dim", "cell")
    cells = sized.agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()
    pivots.radius = {(c.dim, c.cell): c.radius for c in cells}
    home_blocks = {(c.dim, c.cell): -(-c.n // block) for c in cells}

    def visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                away = pivots.distances(dim, _unit_vectors(part.column("embedding")))
                found, n = np.unique(pivots.visits(dim, away, reach)[1], return_counts=True)
                columns = [np.full(len(found), dim), found, n]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["dim", "cell", "n"])

    counted = classes.mapInArrow(visitors, "dim long, cell long, n long").groupBy("dim", "cell")
    guest_blocks = {(c.dim, c.cell): -(-c.n // block) for c in counted.agg(F.sum("n").alias("n")).collect()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                away = pivots.distances(dim, _unit_vectors(part.column("embedding")))
                home = away.argmin(axis=1)
                # A block is drawn from the class's own number: the same in every attempt.
                draw = part.column("k").to_numpy() * 2654435761 % 4294967291
                rows, units = [], []
                for row, cell in enumerate(home.tolist()):
                    blocks, guests = home_blocks[dim, cell], guest_blocks.get((dim, cell), 0)
                    own = int(draw[row] % blocks)
                    for other in range(blocks):
                        low, high = min(own, other), max(own, other)
                        units.append((cell, low, high, int(own > other), own == other))
                        rows.append(row)
                    for guest in range(guests):
                        units.append((cell, own, -1 - guest, 0, False))
                        rows.append(row)
                for row, cell in zip(*(x.tolist() for x in pivots.visits(dim, away, reach)), strict=True):
                    guest = int(draw[row] % guest_blocks[dim, cell])
                    for other in range(home_blocks[dim, cell]):
                        units.append((cell, other, -1 - guest, 1, False))
                        rows.append(row)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                for at in range(0, len(rows), 8192):
                    dealt = part.select(["dim", "k", "rows", "embedding"]).take(pa.array(rows[at : at + 8192]))
                    columns = [pa.array([u[i] for u in units[at : at + 8192]], kind) for i, kind in enumerate(kinds)]
                    names = [*dealt.schema.names, "cell", "one", "two", "side", "alone"]
                    yield pa.RecordBatch.from_arrays([*dealt.columns, *columns], names)

    kind = dict(classes.dtypes)["embedding"]
    dealt = classes.mapInArrow(
        work,
        f"dim long, k long, rows long, embedding {kind}, cell long, one long, two long, side long, alone boolean",
    )
    grouped = dealt.groupBy("dim", "cell", "one", "two")
    return grouped.applyInArrow(lambda table: _join_blocks(table, cosine), "k long, n long, head long")


def embedding_links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id and kept.

    ``n_links`` counts the other rows with a cosine of at least ``cosine``; rows with equal vectors are linked, also
    where the vec_id repeats. ``component_id`` is the smallest vec_id that links reach, its own included. Vectors that
    are null, empty or all zero, or hold a null, infinite or undefined component, link with nothing; so do vectors of
    different lengths. Rows without a vec_id have no ``kept``. Other columns, a label too, are ignored; no rows give no
    rows.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    usable = finite & F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    rows = vectors.select("vec_id", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    classes = rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows"))
    classes = materialize(classes.withColumn("dim", F.size("embedding").cast("long")), "vectors")
    # Numbers of rows of a written table: the same whenever it is read.
    classes = materialize(classes.withColumn("k", F.monotonically_increasing_id()), "vector-classes")
    links = materialize(_links(classes, cosine, block), "vector-links")
    counts = links.groupBy("k").agg(F.sum("n").alias("n"))
    joined = connected_components(links.select("k", "head"), "k", "head")
    member = classes.select("k", "rep").join(joined, F.col("k") == F.col("node")).select("k", "rep", "component")
    least = member.groupBy("component").agg(F.min("rep").alias("least"))
    linked = counts.join(member.join(least, "component").select("k", "least"), "k", "left")
    classed = classes.select("embedding", "k", "rep", F.col("rows").alias("copies")).join(linked, "k", "left")
    known = rows.where("usable").select("vec_id", "embedding").join(classed, "embedding")
    known = known.select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("least", "rep").alias("component_id"),
    )
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), "vec_id")
    return known.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
