"""Encoding of a corpus with a public byte-level BPE vocabulary.

A piece of text is merged through a segment tree over its byte positions. Each
leaf holds the rank of the pair that begins there (or no rank), each inner node
the position of its leftmost minimum. A merge takes the root's position, and
updates only the pairs of the live neighbours: two or three logarithmic point
updates. The cost is O(n log n) for a piece of n bytes, so texts without any
white space stay cheap.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Where the public vocabularies are; a parameter, never part of the repository.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: The pattern that splits text before merging (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of the bytes, blank, rank, line by line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: always the leftmost pair of the lowest rank first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 2:
        return [ranks[piece[:1]], ranks[piece[1:]]]
    get = ranks.get
    size = 1 << (n - 1).bit_length()
    # tree[i] is the minimum of (rank * n + position) below: the leftmost of the lowest
    tree = [_NONE * n] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    none = _NONE * n

    def put(at: int, value: int) -> None:
        i = size + at
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while tree[1] < none:
        at = tree[1] % n
        gone = after[at]
        then = after[gone]
        after[at] = then
        put(gone, none)
        if then < n:
            before[then] = at
            r = get(piece[at : after[then]])
            put(at, none if r is None else r * n + at)
        else:
            put(at, none)
        prev = before[at]
        if prev >= 0:
            r = get(piece[prev:then])
            put(prev, none if r is None else r * n + prev)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Pieces(dict):
    """Ids of pieces as packed 32-bit numbers; unknown ones are merged when asked for.
    Long pieces are not kept, and the memory is emptied when it is full."""

    def __init__(self, ranks: dict[bytes, int], remember: int):
        super().__init__()
        self.ranks, self.remember = ranks, remember

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", merge_bytes(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.remember:
                self.clear()
            self[piece] = ids
        return ids


class _Words(dict):
    """Packed ids of whole words with the space before them."""

    def __init__(self, split, pieces: _Pieces, remember: int):
        super().__init__()
        self.split, self.pieces, self.remember = split, pieces, remember

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.pieces.__getitem__, self.split(word)))
        if len(word) <= 64:
            if len(self) >= self.remember:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts; words and pieces seen before come from a bounded memory.

    The pattern always breaks before a lone space between two other characters, as
    only a space can open a piece and no piece goes over one. So a text without
    white space beside a space is looked up word by word, and only new words are
    split into pieces.
    """

    def __init__(self, path: str, pattern: str = PATTERN, remember: int = 200_000):
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.ranks, remember)
        self.words = _Words(self.split, self.pieces, remember) if pattern == PATTERN else None
        self.uneven = regex.compile(r" \s|\s ").search

    def packed(self, text: str | None) -> bytes:
        """Ids without special tokens as 32-bit numbers; empty for null and empty texts."""
        if not text:
            return b""
        if self.words is None or self.uneven(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.words.__getitem__, (first, *[" " + w for w in rest])))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker: loaded once, kept while the worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(directory: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(directory or TOKENIZER_DIR, f"{name}.tiktoken")


def _lists(packed: list[bytes]):
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))


def encode_corpus(df: DataFrame, id_column: str, text_column: str, path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text, one row per row of ``df``.

    Null and empty texts give an empty list; text that looks like a special token
    is ordinary text. No shuffle; one text is held at a time besides its batch.
    """
    where = path or vocabulary_path()

    def run(batches) -> Iterator:
        import pyarrow as pa

        from quorumlake.llm.tokens import encoder as held

        encode = held(where).packed
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):
                part = [encode(t) for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), _lists(part)], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_column: str, text_column: str, path: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row."""
    where = path or vocabulary_path()

    def run(batches) -> Iterator:
        import pyarrow as pa

        from quorumlake.llm.tokens import encoder as held

        encode = held(where).packed
        for batch in batches:
            texts = batch.column(1)
            n = [len(encode(t)) // 4 for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[id_column, "n_tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint")
