"""Token ids, counts, files and packing against the tokenizers library."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tripspark.llm import bpe, orc_tokens, ss_packing, token_counts
from tripspark.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)

ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "It's we're I'LL 'tis ''s \"'s don't",
    "<|endoftext|>a<|startoftext|> <|endoftext|><| endoftext |>",
    "é ́x Ångström Å ﬁ ẞ İi ΣΣ oΣ",
    "a b c\u0085d\x1ce\x1ff​g　h",
    "x1y22z333 ½ ²³ ٣٤ 漢字かな 한글 \U0001f600\U0001f468‍\U0001f469",
    "“quoted” – dash—dash… it’s ‘x’ ‰ ‽ \u2028 \u2060 \u200b",
    "!!!???...,,,---___***$$$%%%&&&### a,b.c;d:e",
    "ſtraße ŉ Ĳ ĳ ŒœŸ ÀÖØÞ ×÷ ªº",
    "x" * 5000,
    "word " * 3000,
]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD_TEXTS)] + [(3, ODD_TEXTS[3], "y", 2), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


@pytest.fixture(scope="module")
def encoder(spark):
    return bpe.Encoder(bpe.ship(spark, PATH).value)


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_ids_and_counts_are_the_librarys(encoder, text):
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids_of(text)
    assert encoder.count(text) == len(ids_of(text))


@settings(max_examples=300, deadline=None)
@examples(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text("aB'st<|>é ß\nΣ́.7", max_size=40))
def test_any_text_has_the_librarys_ids(encoder, text):
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids_of(text)


def test_memos_start_again_when_full(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(bpe, "MEMO_CHUNKS", 2)
    small = bpe.Encoder(bpe.ship(spark, PATH).value)
    text = "one two three zzqx four zzqx five, yyqw one two yyqw zzqx"
    assert np.frombuffer(small.ids(text), "<u4").tolist() == ids_of(text)
    assert small.count(text) == len(ids_of(text))
    odd = text.replace("z", "漢") + " 漢qx é́"
    assert np.frombuffer(small.ids(odd), "<u4").tolist() == ids_of(odd) and small.count(odd) == len(ids_of(odd))
    assert len(small.pieces) <= 3 and len(small.lengths) <= 3 and len(small.chunks) <= 2


def test_whole_tokens_are_proven(spark):
    whole = bpe.ship(spark, PATH).value["whole"]
    assert len(whole) > 10_000
    assert all(ids_of(text) == [i] for text, i in list(whole.items())[::97])


def test_counts_of_odd_rows(odd):
    rows = token_counts.token_counts(odd, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == sorted(
        (r.doc_id is None, r.doc_id or 0, len(ids_of(r.text))) for r in odd.collect()
    )
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_bytes == 0 and not by_id[0].over_limit
    assert by_id[12].over_limit and by_id[12].n_bytes == len(ODD_TEXTS[12])
    assert token_counts.token_counts(odd.limit(0), PATH).count() == 0


def test_counts_of_all_documents(documents, given):
    got = token_counts.token_counts(documents, PATH).toPandas().set_index("doc_id")
    want = [len(x.ids) for x in LIBRARY.encode_batch(given.text.fillna("").tolist(), add_special_tokens=False)]
    assert got.n_tokens.loc[given.doc_id].tolist() == want


def test_token_files_hold_all_ids_in_order(spark, documents, given):
    path = fresh_path(spark, "test-tokens")
    orc_tokens.write_tokens(documents, path, PATH)
    got = orc_tokens.positions(spark, path).toPandas().set_index("doc_id").loc[given.doc_id]
    start = 0
    for text, row in zip(given.text, got.itertuples(), strict=True):
        raw = packed(ids_of(text) + [orc_tokens.END_ID])
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    some = orc_tokens.read_tokens(spark, path, [int(given.doc_id[7])])
    assert [r.ids[:-1] for r in some.collect()] == [ids_of(given.text[7])]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in plan or "PushedFilters: [In(doc_id" in plan


def test_token_files_have_indexes_and_bloom_filters(spark, documents):
    import pyarrow.orc as orc

    path = fresh_path(spark, "test-tokens")
    orc_tokens.write_tokens(documents, path, PATH)
    from urllib.parse import urlparse

    files = [urlparse(f).path for f in spark.read.orc(path).inputFiles()]
    seen = []
    for name in files:
        found = orc.ORCFile(name)
        ids = found.read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and found.row_index_stride == orc_tokens.ROW_INDEX_STRIDE
        seen.append((ids[0], ids[-1]))
        with open(name, "rb") as raw:
            assert b"ORC" in raw.read(3)
    seen.sort()
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))


def test_token_files_of_odd_rows(spark, odd):
    path = fresh_path(spark, "test-tokens")
    orc_tokens.write_tokens(odd, path, PATH)
    got = orc_tokens.positions(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, 13)]
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    empty = fresh_path(spark, "test-tokens")
    orc_tokens.write_tokens(odd.limit(0), empty, PATH)
    assert orc_tokens.positions(spark, empty).count() == 0


def check_packing(rows, texts):
    """Every document's pieces and every sequence's places; returns the number of sequences."""
    want = []
    for doc, text in texts:
        ids = ids_of(text) + [ss_packing.END_ID]
        for number, at in enumerate(range(0, len(ids), ss_packing.CAPACITY)):
            own = ids[at : at + ss_packing.CAPACITY]
            want.append((doc is None, doc or 0, number, at, len(own), zlib.crc32(packed(own))))
    got = [(r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= ss_packing.CAPACITY
    return len(sequences)


def test_packing_of_all_documents(documents, given):
    rows = ss_packing.pack_documents(documents, PATH).collect()
    made = check_packing(rows, list(zip(given.doc_id.tolist(), given.text, strict=True)))
    least = -(-sum(r.length for r in rows) // ss_packing.CAPACITY)
    assert made <= least * 1.01 + 1


def test_packing_of_odd_rows(odd):
    rows = ss_packing.pack_documents(odd, PATH).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert ss_packing.pack_documents(odd.limit(0), PATH).count() == 0


def test_groups_share_no_sequence(documents):
    pieces = ss_packing.cut_into_pieces(documents, PATH)
    rows = ss_packing.pack(pieces, group_pieces=100).collect()
    total, places = sum(r.length for r in rows), {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == len(rows)
    assert len({r.sequence_id for r in rows}) <= total / ss_packing.CAPACITY + 12


def test_sum_of_squares_places_each_piece_best():
    lengths = np.sort(np.random.default_rng(3).integers(1, 60, 200))[::-1]
    bins, offsets = ss_packing.sum_of_squares(lengths, 100)
    room: dict[int, int] = {}
    for size, chosen, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        def cost(to):
            after = dict(room)
            after[to] = after.get(to, 100) - size
            counts = np.bincount([g for g in after.values() if g > 0], minlength=101)
            return int((counts.astype(int) ** 2).sum())

        fits = [b for b, gap in room.items() if gap >= size]
        assert (chosen in fits) == bool(fits) and offset == 100 - room.get(chosen, 100)
        if fits:
            assert cost(chosen) == min(cost(b) for b in fits)
        room[chosen] = room.get(chosen, 100) - size


def test_sequences_hold_the_ids(documents, given):
    few = documents.where("doc_id < 40")
    found = ss_packing.sequences(few, PATH, capacity=512).collect()
    total = b"".join(sorted(bytes(r.ids) for r in found))
    assert all(len(r.ids) == 4 * r.n_tokens <= 2048 for r in found)
    texts = given[given.doc_id < 40].text
    assert len(total) == 4 * sum(len(ids_of(t)) + 1 for t in texts)
