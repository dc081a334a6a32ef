"""License spans: edited copies, near diagonals, repeats, odd rows."""

from __future__ import annotations

import random

import pytest

from tripspark.llm import license_diagonals as lic

MIT = lic.TEMPLATES["mit-grant"][1]
SCHEMA = "doc_id long, text string, digest string, grams int, label string"


def scanned(spark, texts):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in lic.scan(spark.createDataFrame(rows, SCHEMA)).collect()}


def plain_spans(text, name):
    """Spans of a template by the definition: all pairs of equal windows, diagonals side by side, words compared."""
    words, wanted = lic.license_words(text), lic.license_words(lic.TEMPLATES[name][1])
    k, shift = lic.GRAM, max(1, min(lic.MOST_SHIFT, len(wanted) // 8))
    votes = {}
    for p in range(len(words) - k + 1):
        for q in range(len(wanted) - k + 1):
            if words[p : p + k] == wanted[q : q + k]:
                votes.setdefault(p - q, set()).add(q)
    groups = []
    for d in sorted(votes):
        if groups and d - groups[-1][-1] <= shift:
            groups[-1].append(d)
        else:
            groups.append([d])
    found = []
    for group in groups:
        if len(set().union(*(votes[d] for d in group))) < lic.LEAST_VOTES * (len(wanted) - k + 1):
            continue
        same = [(q, q + d) for d in group for q, w in enumerate(wanted) if 0 <= q + d < len(words) and words[q + d] == w]
        share = len({q for q, _ in same}) / len(wanted)
        if share >= lic.LEAST_SHARE:
            found.append((name, min(p for _, p in same), max(p for _, p in same), share))
    return found


def edited(text, draw, rate):
    out = []
    for word in text.split():
        kind = draw.random()
        if kind < rate / 3:
            continue
        out.append("changed" if kind < 2 * rate / 3 else word)
        if kind > 1 - rate / 3:
            out.append("inserted")
    return " ".join(out)


def test_spans_equal_brute_force(spark):
    draw = random.Random(4)
    names = list(lic.TEMPLATES)
    texts = []
    for i in range(150):
        parts = []
        for name in draw.sample(names, draw.randint(0, 3)):
            parts += [" ".join(draw.choice("a b cc dd eee".split()) for _ in range(draw.randint(0, 60)))]
            parts += [edited(lic.TEMPLATES[name][1], draw, draw.choice([0, 0.05, 0.1, 0.3]))] * draw.randint(1, 2)
        texts.append("\n".join(parts).upper() if i % 7 == 0 else "\n".join(parts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    got = {}
    for r in lic.license_spans(docs).collect():
        got.setdefault(bytes(r.digest), []).append((r.template, r["first"], r["last"], r.share))
    want = {}
    for t in texts:
        spans = [s for name in names for s in plain_spans(t, name)]
        if spans:
            want[lic._digest(t)] = spans
    assert {k: sorted(set(v)) for k, v in got.items()} == {k: sorted(set(v)) for k, v in want.items()}
    assert len(want) > 60


def test_copies_edits_and_neighbours(spark):
    inserted = MIT.replace("free of charge,", "free of any charge at all,").replace("to deal in", "to deal freely in")
    got = scanned(
        spark,
        [
            f"intro\n{MIT}\nend",
            inserted,
            " ".join(MIT.split()[:20]),
            "Use it under the MIT, license terms apply. GNU General Public License; Apache  License/CC-BY",
            MIT + " words between " + MIT,
            "Licensed under CC BY-NC 4.0. " * 50,
        ],
    )
    assert (got[0].labels, got[0].base_labels, got[0].score) == ("mit", "", 1.0)
    assert got[1].labels == "mit" and 0.9 < got[1].score <= 1
    assert (got[2].labels, got[2].score) == ("", 0.0)
    assert got[3].base_labels == "apache,cc-by,gpl,mit" and (got[3].n_base, got[3].first_word, got[3].last_word) == (4, 4, 14)
    assert (got[4].labels, got[4].n_words) == ("mit", 2 * len(lic.license_words(MIT)) + 2)
    assert (got[5].labels, got[5].n_base) == ("cc-by,cc-by-nc-4.0", 50)


def test_odd_rows(spark):
    long = "plain words " * 200_000 + MIT + " tail" * 100_000
    rows = [
        (1, None, "d", 1, "l"),
        (2, "", "d", 1, "l"),
        (3, "\x00 _ \n", "d", 1, "l"),
        (4, "mit license", None, None, None),
        (None, MIT, "d", 1, "l"),
        (4, "mit license", "d", 2, "l"),
        (5, long, "d", 1, "l"),
        (6, "ÉTÉ mit license 漢字", "d", 1, "l"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels, r.score) for r in lic.scan(docs).collect())
    n = len(lic.license_words(MIT))
    assert got == [
        (0, n, 0, "mit", 1.0), (1, 0, 0, "", 0.0), (2, 0, 0, "", 0.0), (3, 0, 0, "", 0.0), (4, 2, 1, "mit", 1.0),
        (4, 2, 1, "mit", 1.0), (5, 500_000 + n, 0, "mit", 1.0), (6, 4, 1, "mit", 1.0),
    ]
    assert lic.scan(docs.limit(0)).count() == 0
    assert [len(lic.scan(docs).columns)] == [8]
    with pytest.raises(ValueError):
        lic.template_windows(spark, {"short": ("x", "two words")})
