"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Text is split by the vocabulary's pattern; each piece starts as single bytes in
a doubly linked list, a priority queue holds the merges of neighbours by rank,
and entries whose neighbours have changed since are skipped when they come up.
A piece of n bytes takes O(n log n), also where a script without blanks makes
one piece of a whole text. Decoding concatenates vocabulary strings.

Defined results: a null, empty text gives an empty list; text that looks like a
special token is ordinary text; any string encodes, since all 256 bytes are in
the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every operator.
TOKENIZER_DIR = os.environ.get("POLYQUILL_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the split pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per Python worker with their ids; the store starts anew when full.
CACHE_PIECES = 200_000
CACHE_PIECE_CHARS = 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary string -> id; ids are merge ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}
        self._strings: dict[int, bytes] | None = None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # An entry is (rank, left place, the merged string): it is stale unless
        # both places still hold what it was made from.
        queue = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, merged = heapq.heappop(queue)
            left = symbol[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbol[j]) != len(merged) or left + symbol[j] != merged:
                continue
            symbol[i], symbol[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = merged + symbol[k]
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(queue, (r, i, pair))
            if (h := before[i]) >= 0:
                pair = symbol[h] + merged
                if (r := ranks.get(pair)) is not None:
                    heapq.heappush(queue, (r, h, pair))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self.cache, []
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8"))
                if len(piece) <= CACHE_PIECE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        if self._strings is None:
            self._strings = {i: s for s, i in self.ranks.items()}
        return b"".join(self._strings[i] for i in ids).decode("utf-8", "replace")


_CODERS: dict[int, tuple[object, ByteBPE]] = {}


def _coder(shared: Broadcast) -> ByteBPE:
    """One encoder, with its store of pieces, per worker and vocabulary."""
    ranks = shared.value
    held = _CODERS.get(id(ranks))
    if held is None or held[0] is not ranks:
        held = _CODERS[id(ranks)] = (ranks, ByteBPE(ranks))
    return held[1]


def share_ranks(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Broadcast:
    """The vocabulary for the executors: under 1 MB whatever the data."""
    return spark.sparkContext.broadcast(load_ranks(os.path.join(folder, f"{name}.tiktoken")))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ids array<int>) of every row; map-only."""
    shared = share_ranks(df.sparkSession, name, folder)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            rows = [coder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=ends[1:])
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=[id_col, "ids"])

    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, text) from ids; a null list gives an empty text."""
    shared = share_ranks(df.sparkSession, name, folder)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(r or []) for r in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def token_counts(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """`df` without its text, with the number of tokens of the text."""
    shared = share_ranks(df.sparkSession, name, folder)
    rest = [f for f in df.schema.fields if f.name not in (text_col, out_col)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            n = pa.array([coder.count(t) for t in batch.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], n], names=[*(f.name for f in rest), out_col])

    return df.select(*(F.col(f"`{f.name}`") for f in rest), F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(run, f"{schema}, {out_col} bigint")
