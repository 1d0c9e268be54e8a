"""Encoding and decoding of a corpus by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE of this family cuts text into pieces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks whose ids a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 400_000

_SPACE = "\t-\r \x85\xa0  -     　"
#: Blank-separated chunks. No piece crosses their bounds, so a chunk's ids depend on nothing else.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → id, from a file of base64 tokens and ranks."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class _Known(dict):
    """Chunk → ids, computed when first asked for; starts anew when full, so a worker's memory is bounded."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, text: str) -> bytes:
        ids = self.compute(text)
        if len(text) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = ids
        return ids


class BytePairs:
    """Byte-level BPE by a priority queue of merges over a doubly linked list of symbols."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(PIECES).findall
        self.known = _Known(self.chunk)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece.

        The queue holds (rank of the merged pair, position, the two symbols). A merge lengthens the left
        symbol and unlinks the right one; entries whose symbols have changed since are stale and skipped.
        Equal ranks are taken from the left.
        """
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        symbol = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := ranks.get(symbol[i] + symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = left + right, b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(symbol[i] + symbol[k])) is not None:
                    heapq.heappush(queue, (r, i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(symbol[h] + symbol[i])) is not None:
                heapq.heappush(queue, (r, h, symbol[h], symbol[i]))
        return [ranks[s] for s in symbol if s]

    def chunk(self, text: str) -> bytes:
        """The ids of one blank-separated chunk, as packed 32-bit integers."""
        return array("i", chain.from_iterable(self.merge(p.encode("utf-8", "surrogatepass")) for p in self.split(text))).tobytes()

    def packed(self, text: str) -> bytes:
        """encode() as packed 32-bit integers."""
        return b"".join(map(self.known.__getitem__, _CHUNK.findall(text)))

    def encode(self, text: str) -> list[int]:
        """The ids of text without special tokens; text that looks like one is ordinary text."""
        return array("i", self.packed(text)).tolist()

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are: the concatenated vocabulary strings."""
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _of(packed: bytes) -> BytePairs:
    return BytePairs({base64.b64decode(t): int(r) for t, r in (line.split() for line in packed.splitlines() if line)})


def _vocabulary(df: DataFrame, path: str | None):
    """The vocabulary file, broadcast: its size is fixed (under 1 MB) and executors need no copy of their own."""
    return df.sparkSession.sparkContext.broadcast(Path(path or vocabulary_path()).read_bytes())


def encode(df: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each text.

    Null and empty texts give an empty list, blank ones the tokens of their blanks. One narrow Arrow
    pass over whole texts, however long; no shuffle. Repeated ids give a row each, other columns are
    ignored, an empty table gives no rows.
    """
    packed = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(packed.value)
        for batch in batches:
            lists = [bpe.packed(t) if t else b"" for t in batch.column("text").to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in lists], out=offsets[1:])
            flat = np.frombuffer(b"".join(lists), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, id_column: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text): the texts of lists of ids; a null list gives null, an unknown id an error."""
    packed = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(packed.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def count(df: DataFrame, columns: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """(columns…, tokens): the number of tokens of each text, 0 for a null or empty one."""
    packed = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(packed.value)
        for batch in batches:
            n = [bpe.count(t) if t else 0 for t in batch.column("text__").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(n, type=pa.int64())], names=[*columns, "tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, F.col(text).alias("text__")).mapInArrow(run, f"{kinds}, tokens bigint")
