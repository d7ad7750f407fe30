"""Corpus encoding with a public byte-level BPE vocabulary.

Method: the pairs of neighbouring symbols of a piece are the leaves of a segment tree that
holds minimum (rank, place); its root is the leftmost pair of lowest rank. A merge changes
at most three leaves, each a logarithmic point update, until the root holds no pair.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary file is shipped to the executors; larger files are refused.
VOCABULARY_BYTES = 64 << 20
#: Pieces remembered by a worker, and the longest piece worth remembering.
CACHE_PIECES, CACHE_CHARS = 400_000, 48
NO_PAIR = 1 << 62


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary lies on the driver; pass another path to use another file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return data


class PairTree:
    """Segment tree over the pairs of neighbouring symbols of one piece."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, len(keys) - 1).bit_length()
        self.nodes = [NO_PAIR] * self.size + keys + [NO_PAIR] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            self.nodes[i] = min(self.nodes[2 * i], self.nodes[2 * i + 1])

    def root(self) -> int:
        return self.nodes[1]

    def set(self, place: int, key: int) -> None:
        nodes, i = self.nodes, place + self.size
        nodes[i] = key
        while i > 1:
            i >>= 1
            least = min(nodes[2 * i], nodes[2 * i + 1])
            if nodes[i] == least:
                break
            nodes[i] = least


class Encoder(dict):
    """piece -> ids; a missing piece is encoded and, within bounds, remembered."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        super().__init__()
        lines = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode_piece(piece.encode("utf-8", "replace")))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode_piece(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        if n < 2:
            return [ranks[data]] if n else []
        starts, ends = list(range(n)), list(range(1, n + 1))  # of the symbol that begins at a place
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(i: int) -> int:
            j = after[i]
            rank = ranks.get(data[i : ends[j]]) if j < n else None
            return NO_PAIR if rank is None else rank * n + i

        tree = PairTree([key(i) for i in range(n - 1)])
        while (top := tree.root()) != NO_PAIR:
            i = top % n
            j = after[i]
            ends[i], after[i] = ends[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            if j < n - 1:
                tree.set(j, NO_PAIR)
            tree.set(i, key(i))
            if (h := before[i]) >= 0:
                tree.set(h, key(h))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[starts[i] : ends[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> array:
        ids = array("i")
        if text:
            ids.extend(chain.from_iterable(map(self.__getitem__, self.split(text))))
        return ids


_encoders: dict[int, Encoder] = {}


def encoder_of(vocabulary: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>): every row's token ids, without special tokens.

    Null and empty texts give the empty list; strings of special tokens in a text are
    ordinary text. Repeated rows and null ids are kept. One narrow pass: nothing is
    shuffled, so a skewed source costs nothing. Other columns are not read.
    """
    data = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(data.value).encode
        for batch in batches:
            values, offsets = array("i"), np.zeros(batch.num_rows + 1, np.int32)
            for k, text in enumerate(batch.column(1).to_pylist(), 1):
                values.extend(encode(text))
                offsets[k] = len(values)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(values, np.int32) if values else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, tokens int): the number of tokens of every text, 0 for null and empty ones."""
    data = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(data.value)
        for batch in batches:
            sizes = [sum(map(len, map(e.__getitem__, e.split(t)))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], ["id", "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tokens int").select(F.col("id").alias(id_col), "tokens")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text): the texts that lists of token ids stand for.

    An empty or null list gives the empty text. An id that the vocabulary doesn't have is an
    error. Bytes that are no UTF-8 (ids cut within a character) come out as replacement
    characters. Repeated rows and null ids are kept; other columns are not read.
    """
    data = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in encoder_of(data.value).ranks.items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").select(F.col("id").alias(id_col), "text")
