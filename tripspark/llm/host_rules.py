"""Quality rules with host verdicts, in column expressions only.

Each document is measured over its whole text. Failures of each rule are counted by host (``source``), the host rates are
shrunk towards all hosts by a beta prior that is fitted to the hosts themselves, and a host whose shrunk rate of some
rule is above ``HOST_LIMIT`` loses all its documents; so a few bad documents of a small host do not condemn it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tripspark.llm.words import SPACE, count_of, let, word_characters, word_list
from tripspark.session import materialize

LEAST_WORDS = 50
REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
HOST_LIMIT = 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, each counted once.

    Windows are sorted by a 64-bit hash with their places, so equal ones are neighbours; a place adds the words that
    the place before it has not covered.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        ),
    )

    def places(ordered: Column) -> Column:
        def again(x: Column, j: Column) -> Column:
            before, after = F.get(ordered, j - 1)["h"], F.get(ordered, j + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, again), lambda x: x["i"]))

    covered = F.aggregate(
        let(F.sort_array(windows), places),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda state, place: F.struct(
            place.alias("last"), (state["n"] + F.least(F.lit(3), place - state["last"])).alias("n")
        ),
        lambda state: state["n"],
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(covered).cast("long")


def _measured(text: Column) -> Column:
    """All measures of a whole text as one struct; a null text has no words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    return let(
        word_list(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            word_characters(text).alias("word_chars"),
            count_of(text, SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
        ),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEATED_PERCENT * n_words)


def rule_failures() -> dict[str, Column]:
    """Rules over the measures whose failures hosts are judged by."""
    words = F.col("n_words")
    return {
        "short": words < LEAST_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > REPEATED_PERCENT * words,
        "symbols": F.col("n_symbols") > words,
        "long_words": F.col("word_chars") > 40 * words,
    }


def _prior(total: Row, rule: str) -> tuple[float, float]:
    """Mean and strength of a rule's beta prior from sums over hosts; infinite strength where hosts do not differ."""
    docs = total["docs"]
    if not docs:
        return 0.0, math.inf
    mean = total[f"all_{rule}"] / docs
    noise = mean * (1 - mean)
    # Between hosts: weighted squares of deviations, less what sampling alone makes of them.
    excess = total[f"spread_{rule}"] - docs * mean * mean - (total["hosts"] - 1) * noise
    scale = docs - total["squares"] / docs
    variance = excess / scale if scale > 0 else 0.0
    return mean, max(1.0, noise / variance - 1) if variance > 0 else math.inf


def host_verdicts(measured: DataFrame, host: str = "host", limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: n_docs, the shrunk failure rate of each rule, and host_failed. A null host is a host.

    The prior of a rule has the mean of all documents and the strength that makes beta-binomial counts vary between
    hosts as they do (method of moments, at least one document's weight). With one host, or hosts that do not differ,
    all hosts get the common rate.
    """
    rules = rule_failures()
    counted = measured.groupBy(host).agg(
        F.count("*").alias("n_docs"), *[F.sum(rule.cast("long")).alias(f"failed_{name}") for name, rule in rules.items()]
    )
    # One row, whatever the number of hosts.
    total = counted.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"),
        F.count("*").alias("hosts"),
        F.sum(F.pow(F.col("n_docs").cast("double"), F.lit(2.0))).alias("squares"),
        *[F.sum(f"failed_{name}").alias(f"all_{name}") for name in rules],
        *[F.sum(F.pow(F.col(f"failed_{name}"), F.lit(2.0)) / F.col("n_docs")).alias(f"spread_{name}") for name in rules],
    ).first()
    rates = {}
    for name in rules:
        mean, strength = _prior(total, name)
        shared = F.lit(mean)
        own = (F.col(f"failed_{name}") + strength * mean) / (F.col("n_docs") + strength)
        rates[name] = own if math.isfinite(strength) else shared
    shrunk = counted.select(host, "n_docs", *[rate.alias(f"rate_{name}") for name, rate in rates.items()])
    worst = F.greatest(*[F.col(f"rate_{name}") for name in rules])
    return shrunk.withColumn("host_failed", worst > limit)


def _verdicts(docs: DataFrame, host: str, limit: float) -> tuple[DataFrame, DataFrame]:
    """The measures of ``docs`` (doc_id, host), written, and the verdict of each host (_host, host_failed), written so
    that the planner sees how small it is."""
    narrow = docs.select("doc_id", F.col(host).alias("host"), _measured(F.col("text")).alias("m"))
    stored = materialize(narrow.select("doc_id", "host", "m.*"), "measures")
    verdicts = host_verdicts(stored, limit=limit).select(F.col("host").alias("_host"), "host_failed")
    return stored, materialize(verdicts, "verdicts")


def _judged(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of host and measures with base_failed and kept."""
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("host_failed"))


def quality(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, host column): doc_id, the measures, base_failed and kept.

    A null or blank text has no words and fails. Documents without a host share one. Repeated rows are measured and
    counted each; other columns are ignored; no rows give no rows.
    """
    stored, verdicts = _verdicts(docs, host, limit)
    return _judged(stored, verdicts).select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns, whatever their names.

    Texts are measured a second time rather than written or shuffled with their measures.
    """
    _, verdicts = _verdicts(docs, host, limit)
    whole = docs.select(F.struct("*").alias("doc"), F.col(host).alias("host"), _measured(F.col("text")).alias("m"))
    return _judged(whole.select("doc", "host", "m.*"), verdicts).where("kept").select("doc.*")
