"""Fill-in-the-middle texts against lines cut by a pattern, chunks, round trips, odd rows."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripspark.llm import fim_chunks as fim

pieces = st.lists(st.sampled_from(["a", "é", "漢\n", "\n", "word ", "a line\n", "<P", "<", "S>", "<M>", "x" * 900]), max_size=60)


def plain(doc_id, text, seed="7", rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(found[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), pieces, st.integers(0, 100))
def test_cuts_are_those_of_the_lines(doc_id, parts, rate):
    text = "".join(parts)
    n, form, prefix, middle, output = fim.rearrange(doc_id, text, fim.ChunkMemo(500), "7", rate, 50)
    assert (n, form, prefix, middle, output.decode()) == plain(doc_id, text, rate=rate)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=50_000), st.binary(min_size=1, max_size=300))
def test_chunks_are_the_text_and_follow_content(data, more):
    whole = list(fim.chunks(data))
    assert b"".join(whole) == data and all(len(c) <= fim.LONGEST for c in whole)
    assert all(len(c) >= fim.SHORTEST for c in whole[:-1])


def test_texts_share_chunks_wherever_a_passage_stands():
    shared = b"".join(hashlib.sha256(str(i).encode()).hexdigest().encode() + b"\n" for i in range(3000))
    one, two = set(fim.chunks(shared)), list(fim.chunks(b"another start\n" * 77 + shared))
    assert len(one) > 20 and sum(c in one for c in two) > 0.8 * len(one)
    memo = fim.ChunkMemo()
    fim.CutText(shared, memo)
    known = len(memo.young)
    fim.CutText(b"another start\n" * 77 + shared, memo)
    assert len(memo.young) < 1.3 * known


def test_memo_is_bounded():
    memo = fim.ChunkMemo(10_000)
    for i in range(500):
        memo[b"%d" % i * 100]
    assert sum(map(len, memo.young)) < 12_000 and sum(map(len, memo.old)) < 12_000


def test_given_documents_and_odd_rows(spark, given):
    texts = [None, "", "\n", "no end", "<S>", "a<P>b\n", "x\n" * 300_000, "é" * 50_000 + "\n" + "y" * 3_000_000, "a\nb"]
    rows = [(i, t, "form", 1) for i, t in enumerate(texts)] + [(None, "a\nb\nc", "f", 2), (8, "a\nb", "f", 3)]
    rows += [(1000 + int(d), t, None, None) for d, t in zip(given.doc_id, given.text, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert len(got) == len(rows)
    want = sorted(((d, *plain(d, t)) for d, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert sorted(((r.doc_id, r.back) for r in got), key=repr) == sorted(((d, t or "") for d, t, *_ in rows), key=repr)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert {r.form for r in got} == {"plain", "psm", "spm"}
