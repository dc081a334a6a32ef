"""Near-duplicate documents and embeddings against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tripspark.llm import bottomk_dedup, pivot_join
from tripspark.llm.components import connected_components
from tripspark.llm.shingles import ascii_lower_words


def shingles(text):
    words = ascii_lower_words(text)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def brute_documents(ids, texts):
    """Set sizes and the smallest reachable id of each row; rows in ascending order of id."""
    sets, holders, shared = [shingles(t) for t in texts], {}, {}
    for row, own in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(row)
    for rows in holders.values():
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return [(i, len(s), ids[c]) for i, s, c in zip(ids, sets, components(len(ids), links), strict=True)]


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = bottomk_dedup.near_duplicates(docs).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in found)


def test_all_documents(spark, documents, given):
    found = bottomk_dedup.near_duplicates(documents).collect()
    want = brute_documents(given.doc_id.tolist(), given.text.tolist())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(want)
    assert sum(not r.kept for r in found) > 20


def test_edited_copies_and_shared_passages(spark):
    """Copies with few to many edits, so that similarities lie on both sides of the limit, and short texts around one
    long common passage."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(150):
        copy = base.copy()
        for _ in range(draw.randint(0, 9)):
            copy[draw.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    for _ in range(120):
        around = [word() for _ in range(draw.randint(3, 40))]
        texts.append(" ".join(around[: len(around) // 2] + passage + around[len(around) // 2 :]))
    long = [word() for _ in range(3000)]
    for _ in range(20):
        copy = long.copy()
        for _ in range(draw.randint(50, 200)):
            copy[draw.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    assert result(spark, rows) == sorted(brute_documents(list(range(len(texts))), texts))


def test_words_are_cut_at_ascii_white_space_and_lowered_in_ascii(spark):
    rows = [
        (1, "A b\tc\nd\x0be f"),
        (2, "a B C D E F"),
        (3, "a b c d e f"),
        (4, "Ä b c d e f"),
        (5, "ä b c d e f"),
    ]
    got = {i: c for i, _, c in result(spark, rows)}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_empty_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "two one"), (7, "x"), (9, "x"), (8, "x")]
    rows += [(10, "a b c d e"), (10, "a b c d e"), (11, "A B C D E")]
    got = result(spark, rows)
    assert got == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7), (9, 1, 7)]
        + [(10, 1, 10), (10, 1, 10), (11, 1, 10)]
    )
    assert result(spark, []) == []


def test_rows_of_one_id_are_one_node(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (7, "U V W X Y Z")]
    assert result(spark, rows) == [(1, 2, 1), (5, 2, 1), (5, 2, 1), (7, 2, 1)]


def test_one_of_each_group_stays_with_its_columns(spark):
    rows = [(1, "a b c", "s", 1), (2, "A B C", "t", 2), (3, "q", None, 3), (None, "a b c", "u", 4), (1, "a b c", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string, component_id int")
    kept = bottomk_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([docs.collect()[i] for i in (0, 2)], key=str)


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (5, 4)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert connected_components(links.limit(0), "a", "b").count() == 0


def brute_vectors(vectors):
    unit = np.array(vectors, float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= pivot_join.COSINE
    np.fill_diagonal(near, False)
    return near.sum(axis=1), components(len(unit), np.argwhere(near).tolist())


@pytest.mark.parametrize(("block", "cell"), [(8192, 8192), (40, 30)])
def test_vectors_in_few_and_in_many_cells(spark, monkeypatch, block, cell):
    monkeypatch.setattr(pivot_join, "CELL", cell)
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(6, 16))
    vectors = [c + draw.normal(size=16) * spread for c in centres for spread in (0.05, 0.2, 0.3) for _ in range(12)]
    vectors += list(draw.normal(size=(60, 16))) + [centres[0]] * 40
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pivot_join.embedding_links(table, block=block).collect()}
    links, reach = brute_vectors(vectors)
    assert [got[i].n_links for i in range(len(vectors))] == links.tolist()
    assert [got[i].component_id for i in range(len(vectors))] == reach
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    got = sorted(pivot_join.embedding_links(table).collect(), key=lambda r: r.vec_id)
    links, reach = brute_vectors([r.embedding for r in rows])
    assert [r.n_links for r in got] == links.tolist()
    assert [r.component_id for r in got] == [rows[i].vec_id for i in reach]


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [nan, 1.0], None), (5, [inf, 1.0], "a"),
        (6, [None, 1.0], "b"), (7, [1.0, 2.0], "b"), (8, [2.0, 4.0], "b"), (9, [1.0, 2.0, 0.0], "b"),
        (10, [1e-300, 2e-300], "b"), (11, [1e300, 2e300], "b"), (12, [1.0, 2.0], "c"), (None, [1.0, 2.0], "c"),
        (3, [1.0, 2.0], "c"), (13, [-1.0, -2.0], "c"), (7, [1.0, 2.0], "b"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, k string")
    got = [(r.vec_id, r.n_links, r.component_id) for r in pivot_join.embedding_links(table).collect()]
    linked = [7, 7, 8, 10, 11, 12, None, 3]
    alone = [1, 2, 3, 4, 5, 6, 9, 13]
    want = [(i, len(linked) - 1, 3) for i in linked] + [(i, 0, i) for i in alone]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pivot_join.embedding_links(table.limit(0)).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    """Null ids, one id for different texts, copies under different ids, and columns named as the stage's own."""
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-2], "x", "y"]), " ".join(reversed(words))
    rows = [
        (None, text, "a", 1, 7), (None, text, "b", 2, 7), (5, near, "c", 3, 7), (5, other, "d", 4, 7), (9, other, "e", 5, 7),
        (None, None, "f", 6, 7), (None, "", "g", 7, 7), (3, " ", "h", 8, 7), (3, " ", "h", 8, 7), (2, "one two", "i", 9, 7),
        (1, "one two", "j", 10, 7), (4, "lone " * 200_000 + "end", "k", 11, 7), (6, "lone " * 200_000 + "end", "l", 12, 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, row_key int, _kept_id int")
    got = bottomk_dedup.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r._row for r in got.collect()) == ["c", "d", "f", "g", "h", "h", "j", "k"]
    assert bottomk_dedup.keep_one_of_each(docs.limit(0)).count() == 0


def test_components_of_stars_take_few_jobs(spark):
    rows = [(100 * k, 100 * k + i) for k in range(20) for i in range(1, 30)]
    links = spark.createDataFrame(rows, "a long, b long")
    spark.sparkContext.setJobGroup("components-of-stars", "components of stars")
    try:
        got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {x: 100 * (x // 100) for x in [b for _, b in rows] + [a for a, _ in rows]}
    # What is a star forest from the start needs no round.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components-of-stars")) <= 8
