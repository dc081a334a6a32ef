"""Quality rules and source mixing against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from tripspark.llm import curriculum, host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum((text or "").count(s) for s in host_rules.SYMBOLS)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def base_failed(text):
    n, *_, repeated = measures(text)
    return n < 50 or 100 * repeated > 50 * n


ODD = [
    None, "", " \n\t", "a", "a b c a b c", "a a a a", "\n\nx\n x\nx\n\n", "é\u00a0b\u2003c # $$ <|>\\ d", "a b c x a b c y a b c",
    "l\nl\r\nl", "#*$%&|<>" * 20, "w " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i % 50}" for i in range(9000)),
]


def test_measures_of_odd_texts(spark):
    rows = [(i, t, "s", "clash") for i, t in enumerate(ODD)] + [(None, "x", None, "clash"), (3, "a", "s", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    got = host_rules.quality(docs).collect()
    want = [(i, *measures(t), base_failed(t)) for i, t, *_ in rows]
    assert sorted([tuple(r)[:-1] for r in got], key=str) == sorted(want, key=str)
    assert host_rules.quality(docs.limit(0)).count() == 0
    assert host_rules.keep_good(docs).columns == docs.columns


def test_all_documents(documents, given):
    got = {r.doc_id: r for r in host_rules.quality(documents).collect()}
    for doc, text in zip(given.doc_id, given.text, strict=True):
        r = got[doc]
        assert tuple(r)[1:6] == measures(text)
        assert r.base_failed == base_failed(text) and r.kept == (not r.base_failed)
    kept = host_rules.keep_good(documents).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, r in got.items() if r.kept)


def test_bad_host_loses_good_documents_and_small_host_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(0, "many", good)] * 95 + [(0, "many", bad)] * 5 + [(0, "spam", bad)] * 90 + [(1, "spam", good)] * 10
    rows += [(2, "tiny", bad), (3, "tiny", good), (0, "fair", good), (4, None, good)] + [(0, "fair", good)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = Counter(r.source for r in host_rules.keep_good(docs).collect())
    assert kept == {"many": 95, "fair": 61, "tiny": 1, None: 1}


def test_hosts_that_do_not_differ_get_the_common_rate(spark):
    rows = [(h, 60 if i % 4 else 10, 0, 240, 0) for h in ("a", "b") for i in range(40)]
    table = spark.createDataFrame(rows, "host string, n_words long, n_repeat_words long, word_chars long, n_symbols long")
    rates = {r.host: r.rate_short for r in host_rules.host_verdicts(table).collect()}
    assert rates == {"a": 0.25, "b": 0.25}


def wanted_targets(sizes):
    """Reshare the excess until no source is above its limit, as the words of the contract say."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: curriculum.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, level, open_, found = 1.5 * sum(sizes.values()), 0, set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            found[s] = 2 * sizes[s]
            left -= found[s]
        open_ -= full
    return found | {s: level * weight[s] for s in open_}


def check_mix(rows, docs):
    sizes: dict = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = wanted_targets(sizes)
    by_target: dict = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        assert len(r.positions) <= 2 and all(0 <= p <= 1 for p in r.positions)
        by_target[r.target, r.source_size] = by_target.get((r.target, r.source_size), 0) + r.taken
    got = sorted((s, pytest.approx(t)) for t, s in by_target)
    assert [s for s, _ in got] == sorted(sizes[k] for k in target)
    for (t, s), taken in by_target.items():
        assert any(sizes[k] == s and t == pytest.approx(target[k]) for k in target)
        assert abs(taken - t) <= 0.5


def test_mix_of_all_documents(documents, given):
    rows = curriculum.mix(documents).collect()
    check_mix(rows, list(zip(given.doc_id, given.text, given.source, strict=True)))
    again = curriculum.mix(documents.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_of_odd_rows(spark):
    docs = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, " ", None), (None, "p q", "z")]
    docs += [(5, "w " * 500, "v"), (6, "w " * 7, "Z"), (7, "ä ö", "é"), (8, "k", None)]
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, size string")
    rows = curriculum.mix(table).collect()
    sizes: dict = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want, total = wanted_targets(sizes), {}
    for r in rows:
        total[r.target] = total.get(r.target, 0) + r.taken
    assert len(rows) == len(docs)
    assert sum(total.values()) == pytest.approx(sum(want.values()), abs=4)
    assert curriculum.mix(table.limit(0)).count() == 0
    ordered = curriculum.in_training_order(table)
    assert ordered.columns == table.columns and set(ordered.collect()) <= set(table.collect())


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    schedule = (0.5, 2.0, 0.0, 1.0)
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for r in rows.select("u", curriculum.due_time(F.col("u"), schedule).alias("t")).collect():
        steps = [i / 3 for i in range(4)]
        done = 0.0
        for i in range(3):
            x = min(max((r.t - steps[i]) * 3, 0), 1)
            done += schedule[i] * x + (schedule[i + 1] - schedule[i]) * x * x / 2
        assert done / 2.75 == pytest.approx(r.u, abs=1e-9)


def test_documents_stand_in_training_order(documents):
    ordered = curriculum.in_training_order(documents)
    assert ordered.columns == documents.columns
    names = [r.source for r in ordered.select("source").collect()]
    first, last = Counter(names[: len(names) // 4]), Counter(names[-len(names) // 4 :])
    sources = sorted(set(names))
    rising = [s for i, s in enumerate(sources) if i % 3 == 0]
    falling = [s for i, s in enumerate(sources) if i % 3 == 1]
    assert sum(last[s] for s in rising) > sum(first[s] for s in rising)
    assert sum(last[s] for s in falling) < sum(first[s] for s in falling)


def test_query_of_the_mix_stands_in_training_order(spark, sf_dir, documents):
    from tripspark.llm import queries

    mixed = {r.doc_id: r for r in curriculum.mix(documents).collect()}
    rows = queries.op4(spark, sf_dir).collect()
    assert len(rows) == len(mixed)
    assert all(r == tuple(mixed[r.doc_id])[:5] for r in rows)
    first = [min(mixed[r.doc_id].positions, default=2.0) for r in rows]
    assert first == sorted(first) and first[0] < 0.1
    full = curriculum.mix_in_training_order(documents).collect()
    assert all(r.positions == sorted(mixed[r.doc_id].positions) for r in full)


def test_positions_follow_the_schedules(spark, monkeypatch):
    """Other schedules give the same words at other times; copies of one line come in its order."""
    docs = spark.createDataFrame([(i, "word " * (1 + i % 5), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")

    def mixed():
        return {r.doc_id: r for r in curriculum.mix_in_training_order(docs).collect()}

    one = mixed()
    monkeypatch.setattr(curriculum, "SCHEDULES", ((1.0, 1.0), (1.0, 1.0), (1.0, 1.0)))
    flat = mixed()
    assert {i: r.taken for i, r in one.items()} == {i: r.taken for i, r in flat.items()}
    moved = [i for i in one if one[i].positions and one[i].positions != flat[i].positions]
    assert len(moved) > 200
    for r in [*one.values(), *flat.values()]:
        assert r.positions == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        assert bool(r.positions) == (r.taken > 0)
