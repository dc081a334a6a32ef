"""Conversations as training windows with a loss mask.

Prefix sums of turn tokens choose the windows: a conversation's token line is cut into steps, and the turns that start in
a step are a span. A step is half the room that a window has beside the system turn and its history, so a span overruns
its window only by a turn longer than a step, and such a turn gets a window of its own. Windows are thus known from sums
alone: a conversation of any length is spread over many tasks, and no task holds more than a window.

A window repeats the system turn and, before its new turns, the last turns of the span before it as far as the history
budget goes. Only new assistant turns are under the loss mask, so each is learnt once.

A turn is ``### role: text</turn>`` and a line feed. A backslash stands before every backslash, ``#`` and ``<`` of a text
(and ``:`` of a role), so no text can hold a control string, and taking the backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripspark.llm.bpe import encoder, ship
from tripspark.session import materialize

BUDGET = 2048
HISTORY = 256
#: Tokens that the template itself takes for a turn.
TURN_COST = 8
#: Turns whose tokens are added up together before they are added up by conversation.
CHUNK_TURNS = 1024

_CONTROL = re.compile(r"([\\#<])")
_ROLE_CONTROL = re.compile(r"([\\#<:])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.DOTALL)

_SYSTEM, _HISTORY, _NEW = 0, 1, 2


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text starts and how long it is."""
    head = f"### {_ROLE_CONTROL.sub(chr(92) * 2 + chr(92) + '1', role)}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn of a formatted window; anything that is not a turn is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at} of a window of {len(formatted)} characters")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _with_prefix_sums(turns: DataFrame) -> DataFrame:
    """The turns with ``start`` (tokens before), ``end`` and ``place`` (turns before), summed in two levels."""
    order = ["turn", "role", "text"]
    chunked = turns.withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS))
    chunks = chunked.groupBy("conv_id", "chunk").agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"))
    along = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = chunks.select(
        F.col("conv_id").alias("c"),
        F.col("chunk").alias("k"),
        F.coalesce(F.sum("sum").over(along), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base_n"),
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    summed = chunked.withColumn("own", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    summed = summed.withColumn("row", F.row_number().over(inside) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("chunk").eqNullSafe(F.col("k"))
    return summed.join(base, same).select(
        "conv_id",
        "role",
        "text",
        (F.col("base") + F.col("own")).alias("start"),
        (F.col("base") + F.col("own") + F.col("tokens")).alias("end"),
        (F.col("base_n") + F.col("row")).alias("place"),
    )


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for turns in batch.column("turns").to_pylist():
            parts, loss, at = [], [], 0
            for turn in turns:
                text, start, length = format_turn(turn["role"], turn["text"])
                if turn["kind"] == _NEW and turn["role"] == "assistant":
                    loss.append({"start": at + start, "length": length})
                parts.append(text)
                at += len(text)
            rows.append(("".join(parts), loss, sum(t["kind"] != _NEW for t in turns)))
        spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("window"),
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], spans),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            ["conv_id", "window", "text", "loss", "repeated"],
        )


def training_windows(
    conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """Windows of ``conversations`` (conv_id, turn, role, text): conv_id, window, text, loss, repeated.

    ``window`` is the number of tokens before the first new turn, so it orders the windows of a conversation; ``loss`` has
    the start and length of each masked text in code points; ``repeated`` counts the turns that come before the new
    ones. Null roles and texts are empty. Turns with the same number are ordered by role and text, repeated rows stay,
    null numbers come first; a null conv_id is a conversation. A turn longer than the budget has a window of its own.
    A system turn counts as such if it is the first. Other columns are ignored; no rows give no rows.
    """
    shipped = ship(conversations.sparkSession, tokenizer_path)
    kinds = dict(conversations.dtypes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(shipped)
        for batch in batches:
            tokens = [TURN_COST + code.count(escape(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], names)

    names = ["conv_id", "turn", "role", "text", "tokens"]
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.mapInArrow(
        counted, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, tokens long"
    )
    turns = materialize(_with_prefix_sums(materialize(rows, "turn-tokens")), "turns")

    head = turns.where((F.col("place") == 0) & (F.col("role") == "system"))
    head = head.select(F.col("conv_id").alias("c"), F.col("end").alias("system"), F.struct("role", "text").alias("first"))
    room = F.greatest(F.lit(2), budget - history - F.coalesce("system", F.lit(0)))
    step = F.floor(room / 2)
    stepped = turns.join(head, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    number = F.floor(F.col("start") / step)
    stepped = stepped.withColumn("step", number).withColumn("alone", F.col("end") - number * step > room)

    key = ["conv_id", "step", "alone"]
    spans = stepped.groupBy(*key).agg(F.min("start").alias("window"), F.max("end").alias("next"))
    spans = spans.select(F.col("conv_id").alias("c"), F.col("step").alias("s"), F.col("alone").alias("a"), "window", "next")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("step") == F.col("s")) & (F.col("alone") == F.col("a"))
    placed = materialize(stepped.join(spans, same).drop("c", "s", "a"), "placed-turns")

    def dealt(rows: DataFrame, window, kind: int, role="role", text="text") -> DataFrame:
        turn = F.struct(
            F.lit(kind).alias("kind"), F.col("place"), F.col(role).alias("role"), F.col(text).alias("text")
        )
        return rows.select("conv_id", window.alias("window"), turn.alias("turn"))

    is_head = (F.col("place") == 0) & (F.col("role") == "system")
    fresh = dealt(placed, F.col("window"), _NEW)
    before = placed.where((F.col("next") - F.col("start") <= history) & ~is_head)
    repeats = dealt(before, F.col("next"), _HISTORY)
    # One row for each window after the first.
    opens = placed.where((F.col("start") == F.col("window")) & (F.col("window") > 0) & F.col("first").isNotNull())
    opens = opens.select("conv_id", "window", F.lit(0).cast("long").alias("place"), "first.role", "first.text")
    system = dealt(opens, F.col("window"), _SYSTEM)
    gathered = fresh.union(repeats).union(system).groupBy("conv_id", "window")
    gathered = gathered.agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # History that no window follows is not a window.
    gathered = gathered.where(F.exists("turns", lambda t: t["kind"] == _NEW))
    return gathered.mapInArrow(
        _formatted,
        f"conv_id {kinds['conv_id']}, window long, text string, loss array<struct<start:long,length:long>>, repeated long",
    )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose windows come one after another; only the running digests are held."""
    now: list | None = None

    def done() -> tuple:
        conv, n, all_turns, chars, learnt, total = now
        return conv, n, all_turns.hexdigest(), chars, learnt.hexdigest(), total

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    kind = None
    for batch in batches:
        rows, kind = [], batch.column("conv_id").type
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "repeated"))
        for conv, text, loss, repeated in zip(*columns, strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    rows.append(done())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text)[repeated:]:
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                learnt = unescape(text[span["start"] : span["start"] + span["length"]])
                now[3] += len(learnt)
                now[4].update(learnt.encode())
            now[5] += len(text)
        if rows:
            yield batch_of(rows, kind)
    if now is not None:
        yield batch_of([done()], kind)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation of written windows: what their texts and masks say, without the repeated turns."""
    kind = dict(windows.dtypes)["conv_id"]
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(
        _digested,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
