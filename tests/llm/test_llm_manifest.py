"""Merkle manifests against a plain recursive version."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tripspark.llm import merkle_shift

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int, idx int, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def paths_and_root(leaves, fan):
    """Per leaf the siblings [(before, after)] up to the root, and the root."""
    paths, nodes, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        up, up_under = [], []
        for at in range(0, len(nodes), fan):
            run = nodes[at : at + fan]
            for j in range(len(run)):
                for leaf in under[at + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            up_under.append([i for u in under[at : at + fan] for i in u])
        nodes, under = up, up_under
    return paths, nodes[0] if nodes else None


def plain(rows, fan):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf_of(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        own[name] = paths_and_root([d for _, d in groups[name]], fan)
    above, root = paths_and_root([own[name][1] for name in names], fan)
    found = []
    for name, up in zip(names, above, strict=True):
        for (doc_id, leaf), path in zip(groups[name], own[name][0], strict=True):
            proof = sha("".join(a + b for a, b in path + up))
            found.append((doc_id, leaf, own[name][1], root, proof))
    return found


def proved(spark, rows, fan):
    docs = spark.createDataFrame([(*r, "leaf", 1, 2, 3) for r in rows], SCHEMA)
    text = lambda c: merkle_shift.hex_text(F.col(c)).alias(c)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lower("text"))
    got = merkle_shift.manifest(docs, fan, tampered).withColumns(
        {
            "proof": merkle_shift.proof_digest(F.col("path")),
            "good": merkle_shift.hex_text(merkle_shift.fold(F.col("leaf"), F.col("path"))),
            "bad": merkle_shift.hex_text(merkle_shift.fold(F.coalesce("tampered_leaf", "leaf"), F.col("path"))),
        }
    )
    return got.select("doc_id", text("leaf"), text("subroot"), text("root"), "proof", "good", "bad").collect()


@pytest.mark.parametrize(("n", "fan"), [(1, 8), (2, 8), (8, 8), (9, 8), (65, 8), (300, 8), (70, 2), (20, 3)])
def test_manifest_is_the_plain_one(spark, n, fan):
    draw = random.Random(n)
    langs = [None, "", "en", "é", "zz"][: 1 + n % 5]
    rows = []
    for i in range(n):
        text = draw.choice([None, "", "Some Text ", "漢字 A"]) if i % 4 else f"Row {i}"
        rows.append((draw.choice([i, i, None]), draw.choice(["s", None]), draw.choice(langs), draw.choice([i, None]), text))
    rows += rows[: n // 3]
    got = proved(spark, rows, fan)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(plain(rows, fan), key=repr)
    changed = 0
    for r in got:
        assert r.good == r.root
        changed += r.bad != r.root
    lower = [r for r in rows if r[0] is not None and r[4] and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] != r[4].lower()]
    assert changed == len(lower)


def test_no_rows_and_long_texts(spark):
    assert proved(spark, [], 8) == []
    rows = [(1, "s", "en", 1, "Long " * 1_000_000), (2, "s", "en", 1, "x")]
    assert sorted((tuple(r)[:5] for r in proved(spark, rows, 8)), key=repr) == sorted(plain(rows, 8), key=repr)


def test_groups_of_one_size_are_even_and_levels_are_linear(spark):
    """Every level has an eighth of the nodes of the one below, whatever the group."""
    rows = spark.range(5000).select(F.lit("=en").alias("group"), F.col("id").alias("idx"),
                                    F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"),
                                    F.lit(5000).cast("long").alias("n"))
    tree = merkle_shift.grow(rows)
    assert [level.count() for level in tree.levels] == [5000, 625, 79, 10, 2]
    assert [r.level for r in tree.roots.collect()] == [5]
