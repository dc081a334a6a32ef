"""Quantile boosting on histograms: many models grown in lockstep from the same passes over the rows.

Every feature is cut once into at most ``BINS`` bins. A round grows one tree for each model; a pass counts, for every open
leaf of every model, the rows per feature and bin that lie above and below the current prediction. The gradient of the
pinball loss takes two values, so these counts are all that a split needs: tasks add up their rows, one group per model
and leaf adds up the tasks. Of two leaves that one split has made only the smaller is counted; the counts of the other are
what is left of their parent's. Leaves are split in order of gain, a part of the leaf budget in each pass, so the tree goes
deep where the gain is. One more pass counts residuals on a scale fine near zero, whose wanted quantile is the leaf's value
(Friedman 2001).

Rows keep the bins and one running prediction per model. They travel in blocks of a thousand, training and validation
rows apart, with a matrix per column as bytes, so that a pass costs Spark a copy per block and not a conversion per value.
Blocks are persisted for the passes of a round. Every few rounds the rows are written, so a lost executor replays few trees;
one by one, because a reader of files holds thousands of them at once, which must not be thousands of blocks. The first
pass of a round also adds up the loss on the validation rows.
What the driver holds is bounded by models, leaves and features, whatever the number of rows: the counts of the leaves
that may still be split, some 20 KB for 44 features.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.operators.orderstats import Quantile, group_quantiles
from tripspark.session import materialize, removed, session_conf, written
from tripspark.vocab import COMPONENTS, TARGET

#: Bins of a feature, the first of which holds missing values; bins of a leaf's residuals on either side of zero.
BINS, RESIDUAL_BINS = 64, 512
#: Points that stand for a feature's values in a task, and rows that a task keeps waiting before it joins them.
EDGE_POINTS, EDGE_BUFFER = 4096, 1 << 17
#: Rounds between writes of the running predictions.
WRITE_EVERY = 10
#: Rows of a block, and blocks that a task joins and works on at once. A block is a row of Spark's: some hundred KB, for
#: the JVM keeps several copies of a row on the way and caches many.
BLOCK, TAKEN = 1024, 8
#: Blocks that Spark caches as one, and blocks that go to Python at once; Spark's own numbers are meant for plain rows.
#: Where memory runs out, a task keeps a hundred of the former at a time on their way to disk.
CACHED = {"spark.sql.inMemoryColumnarStorage.batchSize": "4"}
SENT = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass(frozen=True)
class BoostParams:
    """What shapes a model. ``l2`` damps the gain of small leaves; shares are drawn anew for every tree."""

    rounds: int = 200
    rate: float = 0.3
    leaves: int = 31
    depth: int = 5
    min_rows: int = 50
    row_share: float = 1.0
    column_share: float = 1.0
    l2: float = 0.0
    patience: int = 5
    seed: int = 0

    def __post_init__(self) -> None:
        if not (0 < self.row_share <= 1 and 0 < self.column_share <= 1):
            raise ValueError("shares of rows and columns lie in (0, 1]")
        if self.rounds < 1 or self.leaves < 2 or self.depth < 1 or self.rate <= 0 or self.min_rows < 1:
            raise ValueError("rounds, leaves, depth, rate and min_rows must allow a split")


@dataclass(frozen=True)
class Task:
    """One model to fit: the quantile ``level`` of the column ``label``; ``group`` names those it competes with."""

    name: str
    level: float
    params: BoostParams
    label: str = TARGET
    group: str = ""


@dataclass(frozen=True, eq=False)
class Tree:
    """Nodes as parallel arrays; node 0 is the root, a leaf has feature -1. Missing values go left.

    ``value`` of an inner node is the mean of its leaves, weighted by training rows.
    """

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @property
    def depth(self) -> int:
        deep = np.zeros(len(self.feature), np.int64)
        # Children come after their parent.
        for node in np.flatnonzero(self.feature >= 0).tolist():
            deep[self.left[node]] = deep[self.right[node]] = deep[node] + 1
        return int(deep.max())

    def leaves(self, table: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The leaf of each row of a table that has a line per row; above a node's limit a row goes right."""
        start = np.arange(0, table.size, table.shape[1])
        values = table.reshape(-1)
        inner = self.feature >= 0
        every = np.arange(len(inner))
        # A row that has come to a leaf stays there.
        feature = np.where(inner, self.feature, 0).astype(np.int64)
        after = np.stack([np.where(inner, side, every) for side in (self.left, self.right)], axis=1).ravel().astype(np.int64)
        limits = limits.astype(table.dtype)
        node = np.zeros(len(table), np.int64)
        for _ in range(self.depth):
            above = values.take(start + feature.take(node)) > limits.take(node)
            node = after.take(2 * node + above)
        return node

    def add_to(self, total: np.ndarray, table: np.ndarray, limits: np.ndarray) -> None:
        """Adds to each row's total the value of its leaf."""
        total += self.value.take(self.leaves(table, limits))


@dataclass(frozen=True, eq=False)
class QuantileModel:
    """A start value and the trees whose values are added to it. ``losses`` are those of the validation rows by round."""

    name: str
    level: float
    start: float
    features: tuple[str, ...]
    trees: tuple[Tree, ...] = ()
    losses: tuple[float, ...] = ()
    stopped: str = ""
    params: BoostParams = field(default_factory=BoostParams)

    @property
    def base(self) -> float:
        """The prediction before any split: the start and the mean of every tree."""
        return self.start + sum(float(t.value[0]) for t in self.trees)


# ---- rows ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """Binned training and validation rows (row_key, is_valid, bins, labels), written."""

    table: DataFrame
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]


def _as_points(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending values with their weights, equal ones joined; of more than EDGE_POINTS as many at evenly spread ranks."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.diff(values, prepend=np.nan) != 0)
    values, weights = values[first], np.add.reduceat(weights, first) if len(first) else weights[:0]
    if len(values) <= EDGE_POINTS:
        return values, weights
    upto = weights.cumsum()
    at = np.searchsorted(upto, (np.arange(EDGE_POINTS) + 0.5) * (upto[-1] / EDGE_POINTS))
    return values[at], np.full(EDGE_POINTS, upto[-1] / EDGE_POINTS)


def feature_edges(train: DataFrame, features: Sequence[str]) -> tuple[tuple[float, ...], ...]:
    """At most BINS - 2 ascending thresholds per feature, at evenly spread quantiles of its known values.

    Every task reads all its rows and hands on weighted points of each feature, which are exact up to EDGE_POINTS
    distinct values; a group per feature joins the tasks' points.
    """
    names = [f"_{i}" for i in range(len(features))]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0), np.zeros(0)
        held, waiting, n = [none for _ in names], [[] for _ in names], 0

        def join() -> None:
            for i, parts in enumerate(waiting):
                new = np.concatenate(parts) if parts else none[0]
                held[i] = _as_points(np.concatenate([held[i][0], new]), np.concatenate([held[i][1], np.ones(len(new))]))
                parts.clear()

        for batch in batches:
            for i, name in enumerate(names):
                x = batch.column(name).to_numpy(zero_copy_only=False)
                waiting[i].append(x[~np.isnan(x)])
            n += batch.num_rows
            if n >= EDGE_BUFFER:
                join()
                n = 0
        join()
        packed = [pa.array([pair[k].tobytes() for pair in held], pa.binary()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), *packed], ["feature", "v", "w"])

    def edges(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        values, weights = (np.concatenate([np.frombuffer(x) for x in parts[c]]) for c in ("v", "w"))
        order = np.argsort(values, kind="stable")
        values, upto = values[order], weights[order].cumsum()
        wanted = np.arange(1, BINS - 1) / (BINS - 1) * (upto[-1] if len(upto) else 0.0)
        # Rounding must not lift a rank over the last value.
        at = np.minimum(np.searchsorted(upto, wanted * (1 - 1e-12)), len(values) - 1) if len(upto) else []
        return pd.DataFrame({"feature": [key[0]], "edges": [np.unique(values[at]).tolist() if len(upto) else []]})

    numbers = train.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)])
    found = numbers.mapInArrow(points, "feature int, v binary, w binary")
    rows = found.groupBy("feature").applyInPandas(edges, "feature int, edges array<double>").collect()
    of = {r["feature"]: tuple(r["edges"]) for r in rows}
    return tuple(of.get(i, ()) for i in range(len(features)))


def prepare(
    train: DataFrame, valid: DataFrame | None, features: Sequence[str], key: str, labels: Sequence[str] = (TARGET,)
) -> Prepared:
    """Bin the rows of both tables by the thresholds of the training rows.

    Null and NaN features fall into the bin of missing values. A null label leaves a row out of the models of that label.
    """
    edges = feature_edges(train, features)

    def shaped(frame: DataFrame, is_valid: bool) -> DataFrame:
        numbers = [F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)]
        known = [F.col(c).cast("double").alias(c) for c in labels]
        return frame.select(F.xxhash64(key).alias("row_key"), F.lit(is_valid).alias("is_valid"), *known, *numbers)

    rows = shaped(train, False) if valid is None else shaped(train, False).unionByName(shaped(valid, True))
    kept = ["row_key", "is_valid", *labels]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [np.array(e) for e in edges]
        for batch in batches:
            bins = np.zeros((batch.num_rows, len(cuts)), np.int8)
            for i, cut in enumerate(cuts):
                x = batch.column(f"_{i}").to_numpy(zero_copy_only=False)
                bins[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cut, x, "left"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _rows_as_bytes(bins)], [*kept, "bins"])

    schema = "row_key long, is_valid boolean, " + "".join(f"`{c}` double, " for c in labels) + "bins binary"
    # Every pass reads all rows, so they are dealt evenly over all cores once; binned, a row has a byte per feature.
    spark = train.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.mapInArrow(binned, schema).repartition(parts, "row_key")
    return Prepared(materialize(spread, "binned-rows"), tuple(features), edges)


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows_as_bytes(values: np.ndarray) -> pa.BinaryArray:
    """Each row of a matrix as one binary value."""
    ends = np.arange(0, values.nbytes + 1, values.shape[1] * values.itemsize, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def _byte_columns(column: pa.Array, width: int, kind: type = np.int8) -> np.ndarray:
    """What ``_rows_as_bytes`` has packed, one line per column."""
    joined = np.frombuffer(b"".join(column.to_pylist()), kind)
    return np.ascontiguousarray(joined.reshape(-1, width).T)


_STATE = "is_valid boolean, key binary, y binary, bins binary, p binary, signs binary"
_STATE_COLUMNS = ["is_valid", "key", "y", "bins", "p", "signs"]
#: What a histogram pass reads of the training rows: a bit per model instead of a prediction of eight bytes.
_COUNTED_COLUMNS = ["is_valid", "key", "bins", "signs"]


@dataclass(frozen=True)
class _Shape:
    features: int
    labels: int
    models: int
    label_of: tuple[int, ...]


@dataclass(eq=False)
class _Block:
    """Rows in matrices: ``table`` has the bins with a line per row, the others a line per label or model. ``above`` says
    where a model's label lies above its prediction, ``known`` where a label is no null; columns that a pass doesn't read
    are none. ``stored`` are the blocks that were joined, ``sizes`` their rows."""

    is_valid: bool
    key: np.ndarray
    table: np.ndarray
    y: np.ndarray | None = None
    p: np.ndarray | None = None
    above: np.ndarray | None = None
    known: np.ndarray | None = None
    stored: pa.RecordBatch | None = None
    sizes: Sequence[int] = ()
    _draws: dict = field(default_factory=dict)
    _codes: np.ndarray | None = None

    @staticmethod
    def of(batch: pa.RecordBatch, shape: _Shape) -> Iterator[_Block]:
        """The blocks of a batch, up to TAKEN training or validation blocks joined."""
        valid = batch.column("is_valid").to_numpy(zero_copy_only=False)
        every = [np.flatnonzero(valid == side) for side in (False, True)]
        for at in (here[k : k + TAKEN] for here in every for k in range(0, len(here), TAKEN)):
            stored = batch.take(pa.array(at))
            views = {c: [x.as_buffer() for x in stored.column(c)] for c in stored.schema.names if c != "is_valid"}
            keys = [np.frombuffer(x, np.int64) for x in views["key"]]
            sizes = [len(x) for x in keys]
            ends = np.cumsum(sizes)
            table = np.empty((ends[-1], shape.features), np.int8)
            for x, end, n in zip(views["bins"], ends, sizes, strict=True):
                table[end - n : end] = np.frombuffer(x, np.int8).reshape(-1, n).T
            joined = {
                c: np.concatenate([np.frombuffer(x).reshape(-1, n) for x, n in zip(views[c], sizes, strict=True)], axis=1)
                for c in ("y", "p")
                if c in views
            }
            if "signs" in views:
                lines = shape.models + shape.labels
                packed = [(np.frombuffer(x, np.uint8).reshape(lines, -1), n) for x, n in zip(views["signs"], sizes, strict=True)]
                bits = np.concatenate([np.unpackbits(x, axis=1, count=n) for x, n in packed], axis=1).view(bool)
                joined |= {"above": bits[: shape.models], "known": bits[shape.models :]}
            yield _Block(bool(valid[at[0]]), np.concatenate(keys), table, **joined, stored=stored, sizes=sizes)

    def signs(self, label_of: Sequence[int]) -> np.ndarray:
        return np.stack([*(self.y[label] > p for label, p in zip(label_of, self.p, strict=True)), *~np.isnan(self.y)])

    def draw(self, seed: int, share: float) -> np.ndarray:
        if (seed, share) not in self._draws:
            self._draws[seed, share] = _drawn(self.key, seed, share)
        return self._draws[seed, share]

    def counted(self, rows: np.ndarray) -> np.ndarray:
        """Of some rows (positions), how many have each bin of each feature."""
        width = self.table.shape[1] * BINS
        if self._codes is None:
            kind = np.int16 if width <= 1 << 15 else np.int32
            self._codes = np.add(self.table, np.arange(0, width, BINS, dtype=kind), dtype=kind)
        return np.bincount(self._codes.take(rows, axis=0).ravel(), minlength=width)


def _stored(lines: np.ndarray, sizes: Sequence[int]) -> pa.BinaryArray:
    """A matrix with a line per column as blocks of so many rows."""
    ends = np.cumsum([0, *sizes])
    out = np.empty(lines.size, lines.dtype)
    for a, b in zip(ends, ends[1:], strict=False):
        out[a * len(lines) : b * len(lines)].reshape(len(lines), -1)[:] = lines[:, a:b]
    places = (ends * (len(lines) * lines.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(out)])


def _stored_signs(signs: np.ndarray, sizes: Sequence[int]) -> pa.BinaryArray:
    ends = np.cumsum([0, *sizes])
    return pa.array([np.packbits(signs[:, a:b], axis=1).tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())


def _in_blocks(
    prepared: Prepared, labels: Sequence[str], starts: Sequence[float], label_of: Sequence[int] | None = None
) -> DataFrame:
    """The prepared rows in blocks, every model at its start; ``label_of`` has the models' labels, else all have the first.

    Rows that ``_in_rows`` has made go on from their own predictions."""
    width = len(prepared.features)
    places = tuple(label_of or [0] * len(starts))
    begin = np.array(starts)[:, None]
    going_on = "p" in prepared.table.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = {False: [], True: []}

        def blocks(is_valid: bool, last: bool) -> Iterator[pa.RecordBatch]:
            n = sum(len(part[0]) for part in waiting[is_valid])
            whole = n if last else n - n % BLOCK
            if whole:
                joined = [np.concatenate(x, axis=-1) for x in zip(*waiting[is_valid], strict=True)]
                waiting[is_valid] = [[x[..., whole:] for x in joined]]
                key, y, bins, p = (x[..., :whole] for x in joined)
                sizes = [min(BLOCK, whole - k) for k in range(0, whole, BLOCK)]
                plain = [pa.array([is_valid] * len(sizes)), *(_stored(x, sizes) for x in (key[None], y, bins, p))]
                signs = _Block(is_valid, key, bins.T, y, p).signs(places)
                yield pa.RecordBatch.from_arrays([*plain, _stored_signs(signs, sizes)], _STATE_COLUMNS)

        for batch in batches:
            valid = batch.column("is_valid").to_numpy(zero_copy_only=False)
            key = batch.column("row_key").to_numpy()
            y = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in labels])
            bins = _byte_columns(batch.column("bins"), width)
            p = _byte_columns(batch.column("p"), len(places), float) if going_on else np.repeat(begin, len(key), axis=1)
            for side in waiting:
                chosen = np.flatnonzero(valid == side)
                if len(chosen):
                    waiting[side].append([x[..., chosen] for x in (key, y, bins, p)])
                yield from blocks(side, False)
        for side in waiting:
            yield from blocks(side, True)

    kept = ["row_key", "is_valid", *labels, "bins", *(["p"] if going_on else [])]
    return prepared.table.select(*kept).mapInArrow(packed, _STATE)


def _in_rows(state: DataFrame, shape: _Shape, labels: Sequence[str]) -> DataFrame:
    """The rows of the blocks, one by one, with their models' predictions."""
    names = ["row_key", "is_valid", *labels, "bins", "p"]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _Block.of(batch, shape):
                plain = [pa.array(rows.key), pa.array(np.full(len(rows.key), rows.is_valid)), *map(pa.array, rows.y)]
                yield pa.RecordBatch.from_arrays([*plain, _rows_as_bytes(rows.table), _rows_as_bytes(rows.p.T)], names)

    schema = "row_key long, is_valid boolean, " + "".join(f"`{c}` double, " for c in labels) + "bins binary, p binary"
    return state.select("is_valid", "key", "y", "bins", "p").mapInArrow(unpacked, schema)


def _drawn(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Rows of a sample: a function of their key and the seed alone."""
    if share >= 1:
        return np.ones(len(key), bool)
    x = key.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


# ---- growing ---------------------------------------------------------------------------------------------


@dataclass(eq=False)
class _Sprout:
    """A tree that grows: nodes as rows, splits waiting by gain, and what the passes need to know of its model."""

    at: int
    label: int
    task: Task
    round: int
    columns: tuple[int, ...]
    span: float
    nodes: list[dict] = field(default_factory=lambda: [{"depth": 0}])
    best: dict[int, dict] = field(default_factory=dict)
    fresh: list[int] = field(default_factory=lambda: [0])
    held: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def draw_seed(self) -> int:
        return self.task.params.seed * 1_000_003 + self.round

    def tree(self) -> Tree:
        get = lambda name, none: [n.get(name, none) for n in self.nodes]
        return Tree(
            np.array(get("feature", -1), np.int32),
            np.array(get("cut", 0), np.int32),
            np.array(get("threshold", 0.0)),
            np.array(get("left", 0), np.int32),
            np.array(get("right", 0), np.int32),
            np.array(get("value", 0.0)),
            np.array(get("rows", 0), np.int64),
        )

    @property
    def counted(self) -> list[int]:
        """Fresh leaves whose rows are counted: the root, and the smaller one of each pair."""
        return [n for n in self.fresh if not n or self.nodes[n]["counted"]]

    def note(self, found: dict[int, np.ndarray]) -> None:
        """Takes the counts of the counted leaves, works out those of their siblings, and notes the best split of each."""
        for node in self.counted:
            sums = {node: found[node]}
            if node:
                sums[self.nodes[node]["sibling"]] = self.held.pop(self.nodes[node]["parent"]) - found[node]
            for at, counts in sums.items():
                best = _best_split(counts, self.task.level, self.task.params)
                if best["gain"] > 0 and self.nodes[at]["depth"] < self.task.params.depth:
                    self.best[at], self.held[at] = best, counts

    def split(self, edges: Sequence[Sequence[float]]) -> None:
        """Split the waiting leaves of highest gain: half of the leaves that may still come, one at least."""
        room = self.task.params.leaves - sum("feature" not in n for n in self.nodes)
        order = sorted(self.best, key=lambda n: (-self.best[n]["gain"], n))
        self.fresh = []
        for node in order[: max(1, math.ceil(room / 2))] if room > 0 else []:
            found = self.best.pop(node)
            feature = self.columns[found["place"]]
            left, right = len(self.nodes), len(self.nodes) + 1
            children = {"left": left, "right": right}
            # Bin b holds values above edge b - 2 up to edge b - 1; bin 0 holds what is missing.
            threshold = edges[feature][found["cut"] - 1] if found["cut"] > 0 else -math.inf
            self.nodes[node] |= {"feature": feature, "cut": found["cut"], "threshold": threshold, **children}
            common = {"depth": self.nodes[node]["depth"] + 1, "parent": node}
            on_left = 2 * found["left_rows"] <= found["all_rows"]
            self.nodes += [
                {**common, "sibling": right, "counted": on_left}, {**common, "sibling": left, "counted": not on_left}
            ]
            self.fresh += children.values()

    def finish(self, values: dict[int, tuple[float, int]]) -> Tree:
        for at in reversed(range(len(self.nodes))):
            node = self.nodes[at]
            if "feature" in node:
                kids = [self.nodes[node[side]] for side in ("left", "right")]
                node["rows"] = sum(k["rows"] for k in kids)
                node["value"] = sum(k["value"] * k["rows"] for k in kids) / max(1, node["rows"])
            else:
                quantile, node["rows"] = values.get(at, (0.0, 0))
                node["value"] = self.task.params.rate * quantile
        return self.tree()


@dataclass(frozen=True)
class _Pass:
    """What a task needs of one sprout in one pass: picklable and small."""

    at: int
    label: int
    level: float
    tree: Tree
    slots: np.ndarray
    columns: tuple[int, ...]
    draw_seed: int
    share: float
    scale: float


def _passes(sprouts: Sequence[_Sprout], leaves: bool) -> list[_Pass]:
    made = []
    for s in sprouts:
        wanted = [i for i, n in enumerate(s.nodes) if "feature" not in n] if leaves else s.counted
        slots = np.full(len(s.nodes), -1, np.int32)
        slots[wanted] = np.arange(len(wanted))
        p = s.task.params
        made.append(
            _Pass(s.at, s.label, s.task.level, s.tree(), slots, s.columns, s.draw_seed, p.row_share,
                  s.span / 1e4 or 1.0)
        )
    return made


_PARTIAL = "model int, node int, counts binary"


def _partials(found: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """Counts travel in four bytes: a task counts fewer rows than fit."""
    keys = list(found)
    found = {k: v.astype(np.uint32) if v.dtype == np.int64 else v for k, v in found.items()}
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.int32()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([found[k].tobytes() for k in keys], pa.binary()),
        ],
        ["model", "node", "counts"],
    )


def _added(parts: pd.DataFrame) -> np.ndarray:
    total = 0
    for x in parts["counts"]:
        total = total + np.frombuffer(x, np.uint32).astype(np.int64)
    return total


def _places_of(one: _Pass, rows: _Block) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each row's leaf, and whether the row is of the tree's sample and in a wanted leaf."""
    known = rows.known[one.label] if rows.known is not None else ~np.isnan(rows.y[one.label])
    slot = one.slots.take(one.tree.leaves(rows.table, one.tree.cut))
    return slot, known & rows.draw(one.draw_seed, one.share) & (slot >= 0)


def _pinball_sum(residual: np.ndarray, level: float) -> float:
    return float(np.maximum(level * residual, (level - 1.0) * residual).sum())


def _alike(passes: Sequence[_Pass]) -> list[list[_Pass]]:
    """Passes over a root, in groups that take the same rows of the same label; a group's rows are counted once for each
    pattern of signs. Eight at most go together, so that the patterns stay few."""
    groups: dict[tuple, list[_Pass]] = {}
    for one in passes:
        groups.setdefault((one.label, one.draw_seed, one.share), []).append(one)
    return [g[k : k + 8] for g in groups.values() for k in range(0, len(g), 8)]


def _histogram_pass(state: DataFrame, shape: _Shape, sprouts: Sequence[_Sprout], losses: bool) -> dict:
    """Counts of every counted leaf (column, bin, sign), by (model, node); with ``losses``, node -1 holds the mean
    validation loss."""
    passes = _passes(sprouts, leaves=False)
    of = {one.at: one for one in passes}
    width = shape.features * BINS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _alike([one for one in passes if len(one.tree.feature) == 1])
        others = [one for one in passes if len(one.tree.feature) > 1]
        totals = {one.at: np.zeros((int(one.slots.max()) + 1, 2, width), np.int64) for one in passes}
        for batch in batches:
            for rows in _Block.of(batch, shape):
                for group in roots:
                    first = group[0]
                    taken = np.flatnonzero(rows.known[first.label] & rows.draw(first.draw_seed, first.share))
                    pattern = np.zeros(len(taken), np.uint8)
                    for k, one in enumerate(group):
                        pattern |= rows.above[one.at][taken].astype(np.uint8) << k
                    for seen in np.unique(pattern).tolist():
                        found = rows.counted(taken[pattern == seen])
                        for k, one in enumerate(group):
                            totals[one.at][0, seen >> k & 1] += found
                for one in others:
                    slot, taken = _places_of(one, rows)
                    place = np.where(taken, 2 * slot + rows.above[one.at], -1).astype(np.int16)
                    for k in range(2 * len(totals[one.at])):
                        chosen = np.flatnonzero(place == k)
                        if len(chosen):
                            totals[one.at][k >> 1, k & 1] += rows.counted(chosen)
        found = {}
        for one in passes:
            for n in np.flatnonzero(one.slots >= 0):
                whole = totals[one.at][one.slots[n]].reshape(2, -1, BINS)[:, list(one.columns)]
                found[one.at, int(n)] = np.ascontiguousarray(whole.transpose(1, 2, 0))
        yield _partials(found)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checked = {(one.at, -1): np.zeros(2) for one in passes}
        for batch in batches:
            for rows in _Block.of(batch, shape):
                for one in passes:
                    residual = rows.y[one.label] - rows.p[one.at]
                    residual = residual[~np.isnan(residual)]
                    checked[one.at, -1] += (_pinball_sum(residual, one.level), len(residual))
        yield _partials(checked)

    def added(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        if int(key[1]) < 0:
            # Added without rounding, so that the order in which tasks end doesn't matter.
            total = [math.fsum(x) for x in zip(*(np.frombuffer(x) for x in parts["counts"]), strict=True)]
            counts = np.array([total[0] / total[1] if total[1] else math.nan])
        else:
            counts = _added(parts)
        return pd.DataFrame([(key[0], key[1], counts.tobytes())], columns=["model", "node", "counts"])

    parts = state.filter("not is_valid").select(*_COUNTED_COLUMNS).mapInArrow(count, _PARTIAL)
    if losses:
        valid = state.filter("is_valid").select("is_valid", "key", "y", "bins", "p")
        parts = parts.unionByName(valid.mapInArrow(check, _PARTIAL))
    found = parts.groupBy("model", "node").applyInPandas(added, _PARTIAL)
    out: dict[int, dict] = {at: {} for at in of}
    for r in found.collect():
        counts = r["counts"]
        out[r["model"]][r["node"]] = (
            float(np.frombuffer(counts)[0]) if r["node"] < 0 else np.frombuffer(counts, np.int64).reshape(-1, BINS, 2)
        )
    return out


def _best_split(counts: np.ndarray, level: float, params: BoostParams) -> dict:
    """Place and cut of highest gain of a leaf with these counts (column, bin, sign); a gain of -1 where none is allowed."""
    left = counts.cumsum(axis=1)
    whole = left[:, -1:]
    score = lambda c: _gradient(c, level) ** 2 / np.maximum(c.sum(axis=-1) + params.l2, 1e-9)
    gain = score(left) + score(whole - left) - score(whole)
    enough = (left.sum(axis=-1) >= params.min_rows) & ((whole - left).sum(axis=-1) >= params.min_rows)
    gain = np.where(enough, gain, -1.0)
    place, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return {
        "place": int(place), "cut": int(cut), "gain": float(gain[place, cut]),
        "left_rows": int(left[place, cut].sum()), "all_rows": int(whole[place].sum()),
    }


def _gradient(counts: np.ndarray, level: float) -> np.ndarray:
    """Sum of the pinball loss's gradients: 1 - level for each row at or below the prediction, -level above it."""
    return (1.0 - level) * counts[..., 0] - level * counts[..., 1]


def _residual_place(residual: np.ndarray, scale: float) -> np.ndarray:
    """Place on a scale that is linear near zero and logarithmic beyond: 0 to twice RESIDUAL_BINS."""
    reach = math.asinh(2e4)
    return (np.arcsinh(residual / scale) / reach + 1.0) * RESIDUAL_BINS


def _residual_at(place: float, scale: float) -> float:
    return math.sinh((place / RESIDUAL_BINS - 1.0) * math.asinh(2e4)) * scale


def _leaf_pass(state: DataFrame, shape: _Shape, sprouts: Sequence[_Sprout]) -> dict[int, dict[int, tuple[float, int]]]:
    """Wanted quantile of the residuals in every leaf, and the leaf's rows, by model and node."""
    passes = _passes(sprouts, leaves=True)
    of = {one.at: one for one in passes}
    width = 2 * RESIDUAL_BINS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {one.at: np.zeros((int(one.slots.max()) + 1, width), np.int64) for one in passes}
        for batch in batches:
            for rows in _Block.of(batch, shape):
                for one in passes:
                    slot, taken = _places_of(one, rows)
                    residual = (rows.y[one.label] - rows.p[one.at])[taken]
                    place = np.clip(_residual_place(residual, one.scale), 0, width - 1).astype(np.int64)
                    total = totals[one.at]
                    place += slot[taken].astype(np.int64) * width
                    total += np.bincount(place, minlength=total.size).reshape(total.shape)
        yield _partials(
            {(one.at, int(n)): totals[one.at][one.slots[n]] for one in passes for n in np.flatnonzero(one.slots >= 0)}
        )

    def value(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        one = of[int(key[0])]
        counts = _added(parts)
        upto = counts.cumsum()
        n = int(upto[-1])
        if not n:
            return pd.DataFrame([(key[0], key[1], 0.0, 0)], columns=["model", "node", "value", "rows"])
        wanted = (n - 1) * one.level + 0.5
        at = int(np.searchsorted(upto, wanted, "right"))
        part = (wanted - (upto[at] - counts[at])) / counts[at]
        found = _residual_at(at + part, one.scale)
        return pd.DataFrame([(key[0], key[1], found, n)], columns=["model", "node", "value", "rows"])

    rows = (
        state.filter("not is_valid").select("is_valid", "key", "y", "bins", "p").mapInArrow(count, _PARTIAL)
        .groupBy("model", "node")
        .applyInPandas(value, "model int, node int, value double, rows long")
        .collect()
    )
    out: dict[int, dict[int, tuple[float, int]]] = {}
    for r in rows:
        out.setdefault(r["model"], {})[r["node"]] = (r["value"], r["rows"])
    return out


def _kept(state: DataFrame) -> DataFrame:
    """The rows, persisted by a job of its own: a pass that reads them twice would have both readers compute them.

    Blocks stay as they are, not serialized, so that a pass reads only its columns."""
    state = state.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    state.agg(F.count("is_valid")).collect()
    return state


def _advanced(state: DataFrame, shape: _Shape, trees: dict[int, Tree]) -> DataFrame:
    """The rows with each model's new tree added to its running prediction."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _Block.of(batch, shape):
                for at, tree in trees.items():
                    tree.add_to(rows.p[at], rows.table, tree.cut)
                kept = [rows.stored.column(c) for c in ("is_valid", "key", "y", "bins")]
                new = [_stored(rows.p, rows.sizes), _stored_signs(rows.signs(shape.label_of), rows.sizes)]
                yield pa.RecordBatch.from_arrays([*kept, *new], _STATE_COLUMNS)

    return state.select("is_valid", "key", "y", "bins", "p").mapInArrow(add, _STATE)


def _starts(prepared: Prepared, tasks: Sequence[Task]) -> dict[tuple[str, float], tuple[float, float]]:
    """Exact quantile of each label among its training rows, and the span of the label's values."""
    labels = sorted({t.label for t in tasks})
    levels = sorted({t.level for t in tasks})
    parts = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("v")) for c in labels])
    rows = prepared.table.filter("not is_valid").select(F.inline(parts)).filter("v is not null")
    spans = {r["label"]: r["span"] for r in rows.groupBy("label").agg((F.max("v") - F.min("v")).alias("span")).collect()}
    missing = set(labels) - set(spans)
    if missing:
        raise ValueError(f"no training rows with labels {sorted(missing)}")
    found = group_quantiles(rows, ["label"], "v", {f"q{i}": Quantile(a) for i, a in enumerate(levels)}).collect()
    return {(r["label"], a): (float(r[f"q{i}"]), spans[r["label"]]) for r in found for i, a in enumerate(levels)}


@dataclass(eq=False)
class _Model:
    """A model while it is fitted."""

    task: Task
    at: int
    label: int
    start: float
    span: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    stopped: str = ""

    @property
    def best_round(self) -> int:
        """Rounds up to the lowest validation loss; ties go to fewer rounds."""
        return self.losses.index(min(self.losses)) if self.losses else len(self.trees)

    def sprout(self, round_no: int, n_features: int) -> _Sprout:
        p = self.task.params
        draw = random.Random(p.seed * 7919 + round_no)
        wanted = max(1, math.ceil(p.column_share * n_features))
        columns = tuple(sorted(draw.sample(range(n_features), wanted)))
        return _Sprout(self.at, self.label, self.task, round_no, columns, self.span)


def _halve(models: Sequence[_Model]) -> None:
    """Of the models of a group that still grow, the worse half stops."""
    groups: dict[str, list[_Model]] = {}
    for m in models:
        groups.setdefault(m.task.group, []).append(m)
    for rivals in groups.values():
        rivals.sort(key=lambda m: (min(m.losses), m.task.name))
        for m in rivals[(len(rivals) + 1) // 2 :]:
            m.stopped = "halved"


def fit(prepared: Prepared, tasks: Sequence[Task], halve_after: Sequence[int] = ()) -> dict[str, QuantileModel]:
    """All models by name, grown in lockstep.

    With validation rows, a model keeps the rounds up to its lowest validation loss and stops ``patience`` rounds after
    it. ``halve_after`` names rounds after which the worse half of each group's growing models stops.
    ``stopped`` says why a model ended: ``early``, ``halved`` or ``rounds`` (its limit).
    """
    if len({t.name for t in tasks}) < len(tasks):
        raise ValueError("tasks need names of their own")
    labels = sorted({t.label for t in tasks})
    starts = _starts(prepared, tasks)
    models = [
        _Model(t, i, labels.index(t.label), *starts[t.label, t.level]) for i, t in enumerate(tasks)
    ]
    checked = not prepared.table.filter("is_valid").isEmpty()
    shape = _Shape(len(prepared.features), len(labels), len(models), tuple(m.label for m in models))
    starts, paths, round_no = [m.start for m in models], [], 0
    spark = prepared.table.sparkSession
    plain_rows = {SENT: spark.conf.get(SENT)}
    with session_conf(spark, CACHED):
        before = state = _kept(_in_blocks(prepared, labels, starts, shape.label_of))
    try:
        with session_conf(spark, CACHED | {SENT: str(4 * TAKEN)}):
            while growing := [m for m in models if not m.stopped]:
                sprouts = {m.at: m.sprout(round_no, shape.features) for m in growing}
                for step in range(max(m.task.params.depth for m in growing)):
                    open_ones = [s for s in sprouts.values() if s.fresh]
                    if not open_ones:
                        break
                    found = _histogram_pass(state, shape, open_ones, checked and step == 0)
                    if step == 0:
                        if checked:
                            _note_losses(growing, found, round_no, halve_after)
                        for m in growing:
                            if not m.stopped and round_no >= m.task.params.rounds:
                                m.stopped = "rounds"
                            if m.stopped:
                                sprouts.pop(m.at)
                    for s in sprouts.values():
                        if s.fresh:
                            s.note(found[s.at])
                        s.split(prepared.edges)
                if not sprouts:
                    continue
                values = _leaf_pass(state, shape, list(sprouts.values()))
                trees = {at: s.finish(values[at]) for at, s in sprouts.items()}
                for m in models:
                    if m.at in trees:
                        m.trees.append(trees[m.at])
                before, state = state, _advanced(state, shape, trees)
                round_no += 1
                if round_no % WRITE_EVERY == 0:
                    rows, path = written(_in_rows(state, shape, labels), "boosting-rows")
                    # Nothing reads the rows before them any more.
                    before.unpersist()
                    removed(spark, paths)
                    paths = [path]
                    with session_conf(spark, plain_rows):
                        state = _kept(_in_blocks(replace(prepared, table=rows), labels, starts, shape.label_of))
                else:
                    state = _kept(state)
                    before.unpersist()
    finally:
        before.unpersist()
        state.unpersist()
        removed(spark, paths)
    return {m.task.name: _finished(m, prepared.features) for m in models}


def _note_losses(growing: Sequence[_Model], found: dict, round_no: int, halve_after: Sequence[int]) -> None:
    for m in growing:
        m.losses.append(found[m.at][-1])
        if round_no - m.best_round >= m.task.params.patience:
            m.stopped = "early"
    if round_no in halve_after:
        _halve([m for m in growing if not m.stopped])


def _finished(m: _Model, features: tuple[str, ...]) -> QuantileModel:
    kept = m.best_round if m.losses else len(m.trees)
    return QuantileModel(
        m.task.name, m.task.level, m.start, features, tuple(m.trees[:kept]), tuple(m.losses), m.stopped, m.task.params
    )


# ---- applying --------------------------------------------------------------------------------------------


def _values(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def predictions(spark: SparkSession, models: Sequence[QuantileModel]) -> Column:
    """The models' predictions in order, as an array, for a frame that has their features."""
    width = len(models[0].features)
    if any(m.features != models[0].features for m in models):
        raise ValueError("models of one call read the same features")
    shipped = spark.sparkContext.broadcast([(m.start, m.trees) for m in models])

    @F.arrow_udf("array<double>")
    def predict(x: pa.Array) -> pa.Array:
        rows = _matrix(x, width)
        out = np.empty((len(x), len(shipped.value)))
        for i, (start, trees) in enumerate(shipped.value):
            # Added in the order of the trees, so that every reader of the same trees gets the same number.
            total = np.full(len(x), start)
            for tree in trees:
                tree.add_to(total, rows, tree.threshold)
            out[:, i] = total
        return _lists(out)

    return predict(_values(models[0].features))


def contributions(spark: SparkSession, model: QuantileModel) -> Column:
    """What each feature adds to the model's ``base``, as an array in feature order.

    A split adds the difference between the value of the node it leads to and its own, so the contributions of a row
    add up to its prediction minus the base.
    """
    width = len(model.features)
    shipped = spark.sparkContext.broadcast(model.trees)

    @F.arrow_udf("array<double>")
    def explain(x: pa.Array) -> pa.Array:
        rows = _matrix(x, width)
        every = np.arange(len(rows))
        out = np.zeros((len(rows), width))
        for tree in shipped.value:
            node = np.zeros(len(rows), np.int32)
            while (inner := tree.feature[node] >= 0).any():
                at, here = every[inner], node[inner]
                feature = tree.feature[here]
                down = np.where(rows[at, feature] > tree.threshold[here], tree.right[here], tree.left[here])
                # A row meets one node of a tree at a time, so no pair of row and feature comes twice here.
                out[at, feature] += tree.value[down] - tree.value[here]
                node[inner] = down
        return _lists(out)

    return explain(_values(model.features))


# ---- node tables -----------------------------------------------------------------------------------------

NODE_SCHEMA = (
    "model string, place int, level double, start double, round int, node int, feature string, threshold double, "
    "left_node int, right_node int, value double, n_rows long"
)


def node_table(spark: SparkSession, models: Sequence[QuantileModel]) -> DataFrame:
    """One row per node of every tree, and one row of round -1 per model with its start."""
    rows = []
    for place, m in enumerate(models):
        head = (m.name, place, m.level, m.start)
        rows.append((*head, -1, 0, ",".join(m.features), 0.0, 0, 0, m.start, 0))
        for k, t in enumerate(m.trees):
            for i in range(len(t.feature)):
                name = m.features[t.feature[i]] if t.feature[i] >= 0 else None
                rows.append((*head, k, i, name, float(t.threshold[i]), int(t.left[i]), int(t.right[i]), float(t.value[i]), int(t.rows[i])))
    return spark.createDataFrame(rows, NODE_SCHEMA)


def from_node_table(nodes: DataFrame) -> list[QuantileModel]:
    """The models of a node table, in their places. The table has as many rows as the trees have nodes."""
    by_model: dict[int, list] = {}
    for r in nodes.orderBy("place", "round", "node").collect():
        by_model.setdefault(r["place"], []).append(r)
    models = []
    for _, rows in sorted(by_model.items()):
        head, rounds = rows[0], {}
        if head["round"] != -1:
            raise ValueError(f"model {head['model']} has no start row")
        features = tuple(head["feature"].split(","))
        for r in rows[1:]:
            rounds.setdefault(r["round"], []).append(r)
        trees = []
        for k in sorted(rounds):
            nodes_of = rounds[k]
            if [r["node"] for r in nodes_of] != list(range(len(nodes_of))):
                raise ValueError(f"model {head['model']} lacks nodes of round {k}")
            column = lambda name, kind: np.array([r[name] for r in nodes_of], kind)  # noqa: B023, E731
            feature = np.array([-1 if r["feature"] is None else features.index(r["feature"]) for r in nodes_of], np.int32)
            trees.append(
                Tree(feature, np.zeros(len(nodes_of), np.int32), column("threshold", float), column("left_node", np.int32),
                     column("right_node", np.int32), column("value", float), column("n_rows", np.int64))
            )
        models.append(QuantileModel(head["model"], head["level"], head["start"], features, tuple(trees)))
    return models


# ---- compositions ----------------------------------------------------------------------------------------


def bundle_tasks(levels: Sequence[float], params: BoostParams, seeds: Sequence[int] = (0,), label: str = TARGET) -> list[Task]:
    """One task per seed and level, each fitted without looking at the others, so their predictions may cross."""
    return [Task(f"seed{s}_p{round(100 * a)}", a, replace(params, seed=s), label) for s in seeds for a in levels]


def fit_composition(
    prepared: Prepared, levels: Sequence[float], params: BoostParams, seeds: Sequence[int] = (0,),
    base: Sequence[QuantileModel] = (),
) -> dict[int, list[QuantileModel]]:
    """Per seed the lowest level first, then for each next level a model of what is left above the levels so far.

    All seeds of a level grow in lockstep. ``base`` has models of the lowest level that were fitted before with the same
    rows and parameters, one per seed: a fit depends on nothing else, so they are not fitted again.
    """
    found: dict[int, list[QuantileModel]] = {s: [] for s in seeds}
    rows = prepared
    for i, level in enumerate(levels):
        labels = {s: TARGET if i == 0 else f"_rest{s}" for s in seeds}
        tasks = [Task(f"seed{s}_step{i}", level, replace(params, seed=s), labels[s]) for s in seeds]
        if i == 0 and base:
            models = {t.name: replace(m, name=t.name) for t, m in zip(tasks, base, strict=True)}
        else:
            models = fit(rows, tasks)
        for s, t in zip(seeds, tasks, strict=True):
            found[s].append(models[t.name])
        if i + 1 < len(levels):
            steps = [models[t.name] for t in tasks]
            rows = replace(rows, table=materialize(_left_over(rows, steps, seeds, i == 0), "composition-rows"))
    return found


def _left_over(rows: Prepared, steps: Sequence[QuantileModel], seeds: Sequence[int], first: bool) -> DataFrame:
    shipped = rows.table.sparkSession.sparkContext.broadcast([(m.start, m.trees) for m in steps])
    width = len(rows.features)

    @F.arrow_udf("array<double>")
    def predicted(bins: pa.Array) -> pa.Array:
        rows = np.ascontiguousarray(_byte_columns(bins, width).T)
        out = np.empty((len(bins), len(shipped.value)))
        for i, (start, trees) in enumerate(shipped.value):
            total = np.zeros(len(bins))
            for tree in trees:
                tree.add_to(total, rows, tree.cut)
            out[:, i] = start + total
        return _lists(out)

    step = predicted(F.col("bins"))
    rest = rows.table.withColumn("_step", step)
    for j, s in enumerate(seeds):
        before = F.col(TARGET) if first else F.col(f"_rest{s}")
        value = F.col("_step")[j] if first else F.greatest(F.col("_step")[j], F.lit(0.0))
        rest = rest.withColumn(f"_rest{s}", before - value)
    return rest.drop("_step")


def composed_levels(steps: Column) -> Column:
    """Levels of a composition from its base and raw increments; they never descend."""
    return F.aggregate(
        F.slice(steps, F.lit(2), F.size(steps)),
        F.slice(steps, 1, 1),
        lambda done, step: F.concat(done, F.array(F.element_at(done, -1) + F.greatest(step, F.lit(0.0)))),
    )


def composed(frame: DataFrame, models: Sequence[QuantileModel]) -> DataFrame:
    """Adds ``steps`` (base and raw increments) and ``q``."""
    out = frame.withColumn("steps", predictions(frame.sparkSession, models))
    return out.withColumn("q", composed_levels(F.col("steps")))


def component_tasks(level: float, params: BoostParams) -> list[Task]:
    """One task per component of the trip time; their predictions are summed."""
    return [Task(part, level, params, part) for part in COMPONENTS]


# ---- search ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchSpace:
    """Ranges of the six searched parameters; rates, leaves, rows and l2 are drawn evenly in their logarithm."""

    # The default ranges.
    rate: tuple[float, float] = (0.02, 0.2)
    leaves: tuple[int, int] = (31, 255)
    min_rows: tuple[int, int] = (50, 1000)
    column_share: tuple[float, float] = (0.6, 1.0)
    row_share: tuple[float, float] = (0.6, 1.0)
    l2: tuple[float, float] = (1e-3, 10.0)


def search_seed(seed: int, level: float) -> int:
    """Distinct per seed and level, so two levels never draw the same candidates."""
    return seed * 1000 + round(level * 100)


def candidates(base: BoostParams, level: float, trials: int, seed: int, space: SearchSpace) -> list[BoostParams]:
    draw = random.Random(search_seed(seed, level))

    def log_uniform(low: float, high: float) -> float:
        return math.exp(draw.uniform(math.log(low), math.log(high)))

    return [
        replace(
            base,
            rate=log_uniform(*space.rate),
            leaves=round(log_uniform(*space.leaves)),
            min_rows=round(log_uniform(*space.min_rows)),
            column_share=draw.uniform(*space.column_share),
            row_share=draw.uniform(*space.row_share),
            l2=log_uniform(*space.l2),
            seed=seed,
        )
        for _ in range(trials)
    ]


def search(
    prepared: Prepared, levels: Sequence[float], trials: int, base: BoostParams, halve_after: Sequence[int],
    seed: int = 0, space: SearchSpace = SearchSpace(),
) -> dict[float, list[QuantileModel]]:
    """Candidates of every level with their validation losses, best first.

    All candidates of all levels grow from the same passes; after each round of ``halve_after`` the worse half of a
    level's candidates stops. Only training and validation rows enter.
    """
    tasks = [
        Task(f"p{round(100 * a)}_{i}", a, p, group=str(a))
        for a in levels
        for i, p in enumerate(candidates(base, a, trials, seed, space))
    ]
    models = fit(prepared, tasks, halve_after)
    of_level = {a: [models[t.name] for t in tasks if t.level == a] for a in levels}
    # A halved candidate ranks below every one that outlived it.
    order = lambda m: (m.stopped == "halved", -len(m.losses) if m.stopped == "halved" else 0, min(m.losses), m.name)
    return {a: sorted(found, key=order) for a, found in of_level.items()}
