"""Token ids of whole texts by a tokenizers file, with memos of the chunks and pieces a worker has met.

A text falls apart at ASCII white space without changing its ids: the vocabulary's pre-tokens, normalisation and special
strings never reach across it. Natural text repeats its chunks, so most of them are looked up. What is not known is cut
into pre-tokens and only those that are not whole vocabulary entries are merged by the library.

The tokenizer file is read on the driver and broadcast with the table of whole tokens. Both are bounded by the
vocabulary, not by the data.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession
#: Entries of a generation of the memos of pieces and of odd chunks. A worker holds two generations: 250 MB at most.
MEMO_PIECES, MEMO_CHUNKS = 500_000, 100_000

# Characters whose class, lower case and normal form are the same in every Unicode version: ASCII, Latin letters, general
# punctuation. Texts of these alone are cut as a whole; of others, the chunks that hold anything else or may hold a
# special string go to the library as they are.
_SIGNS = "!-/:-@\\[-`{-~\u2010-\u2027\u2030-\u203e"
_PLAIN = re.compile(f"[0-9A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ{_SIGNS}\t-\r ]*")
# The file's own pre-token pattern for these characters, lower-cased; alternatives that start with different characters
# may stand in any order.
_PIECES = re.compile(f"[a-zß-öø-ſ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[{_SIGNS}]+")
# That pattern as the file states it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_END = "</w>"


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter that byte-level vocabularies write for it."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(tokenizer) -> dict[str, int]:
    """Texts that are one pre-token and encode alone as one token, with its id.

    Every vocabulary entry that ends a word is encoded by the library; those that come back as themselves, from a text
    that normalisation leaves as it is, are proven. Merging does not look beyond a pre-token, so the proof holds in
    any text.
    """
    letters = _byte_letters()
    texts, ids = [], []
    for entry, entry_id in tokenizer.get_vocab(with_added_tokens=False).items():
        if entry.endswith(_WORD_END) and all(x in letters for x in entry[: -len(_WORD_END)]):
            try:
                texts.append(bytes(letters[x] for x in entry[: -len(_WORD_END)]).decode())
            except UnicodeDecodeError:
                continue
            ids.append(entry_id)
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return {
        text: i
        for text, i, code in zip(texts, ids, found, strict=True)
        if text
        and code.ids == [i]
        and (not tokenizer.normalizer or tokenizer.normalizer.normalize_str(text) == text)
        and len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1
    }


def _proven(spark: SparkSession, text: str) -> dict[str, int]:
    """:func:`whole_tokens` of a tokenizer file, worked out in one task so that the driver never loads the library."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        for _ in batches:
            found = whole_tokens(Tokenizer.from_str(text))
            columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["text", "id"])

    rows = spark.range(0, 1, 1, 1).mapInArrow(prove, "text string, id long").collect()
    return {r["text"]: r["id"] for r in rows}


_SHIPPED: dict[tuple[str, str], Broadcast] = {}


def ship(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer of a file, broadcast once in an application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHIPPED:
        with open(path, encoding="utf-8") as file:
            text = file.read()
        plain = _PATTERN in text and re.search(r'"type": ?"BPE"', text) is not None
        shipped = {"name": hashlib.md5(text.encode()).hexdigest(), "text": text, "plain": plain}
        shipped["whole"] = _proven(spark, text) if plain else {}
        _SHIPPED[key] = spark.sparkContext.broadcast(shipped)
    return _SHIPPED[key]


class _Memo(dict):
    """Results by text in two generations: when the young one is full it becomes the old one, whose entries come back
    as they are met. What is frequent is thus never computed again, and what is rare goes."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class Encoder:
    """Encodes texts in one worker."""

    def __init__(self, shipped: dict):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(shipped["text"])
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = shipped["plain"]
        self.whole = {k: np.uint32(v).tobytes() for k, v in shipped["whole"].items()}
        self.pieces = _Memo(self._piece_ids, MEMO_PIECES)
        self.lengths = _Memo(self._piece_length, MEMO_PIECES)
        self.chunks = _Memo(self._merged, MEMO_CHUNKS)

    def _merged(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece_ids(self, piece: str) -> bytes:
        return self.whole.get(piece) or self._merged(piece)

    def _piece_length(self, piece: str) -> int:
        # A whole token counts as it stands; only the rest is merged.
        return 1 if piece in self.whole else len(self._merged(piece)) // 4

    def _cut(self, text: str) -> list[str] | None:
        """The pre-tokens of a text of plain characters."""
        if not self.plain or "<|" in text or not _PLAIN.fullmatch(text):
            return None
        return _PIECES.findall(text.lower())

    def _parts(self, text: str) -> Iterator[tuple[str, list[str] | None]]:
        """The chunks of a text between ASCII white space, with the pre-tokens of the plain ones."""
        for chunk in text.encode("utf-8", "surrogatepass").split():
            part = chunk.decode("utf-8", "surrogatepass")
            yield part, self._cut(part)

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; none for null."""
        text = text or ""
        pieces = self._cut(text)
        if pieces is not None:
            return b"".join(map(self.pieces.__getitem__, pieces))
        return b"".join(
            self.chunks[chunk] if own is None else b"".join(map(self.pieces.__getitem__, own))
            for chunk, own in self._parts(text)
        )

    def count(self, text: str | None) -> int:
        """The number of ids of a whole text."""
        text = text or ""
        pieces = self._cut(text)
        if pieces is not None:
            return sum(map(self.lengths.__getitem__, pieces))
        return sum(
            len(self.chunks[chunk]) // 4 if own is None else sum(map(self.lengths.__getitem__, own))
            for chunk, own in self._parts(text)
        )


_ENCODERS: dict[str, Encoder] = {}


def encoder(shipped: Broadcast) -> Encoder:
    """This worker's encoder, kept from task to task."""
    name = shipped.value["name"]
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(shipped.value)
    return _ENCODERS[name]
