"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

A text is cut by the vocabulary's pattern; each piece is a doubly linked list of
byte symbols. All adjacent pairs that form a vocabulary entry wait in a priority
queue by rank; the best is merged, its two new neighbours enter the queue, and
entries whose symbols have changed since are skipped when they come up. A piece
of n bytes costs O(n log n), so a text without any blank is no worse than
others. Decoding concatenates the vocabulary strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces remembered by a Python worker before it starts afresh.
REMEMBERED = 300_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k's ranks among the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class BytePairEncoder:
    """Vocabulary of byte strings with their ranks, which are their ids."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.strings = {i: s for s, i in self.ranks.items()}
        self.cut = regex.compile(pattern)
        self.seen: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # symbol i is piece[i:end[i]]; end[i] is also the next symbol
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = ranks.get(piece[i:i + 2])
            if rank is not None:
                queue.append((rank, i, i + 1, i + 2))
        heapq.heapify(queue)
        while queue:
            rank, left, right, stop = heapq.heappop(queue)
            if end[left] != right or (right < n and end[right] != stop):
                continue  # stale: a symbol was merged since
            end[left], end[right] = stop, -1
            if stop < n:
                before[stop] = left
                new = ranks.get(piece[left:end[stop]])
                if new is not None:
                    heapq.heappush(queue, (new, left, stop, end[stop]))
            prior = before[left]
            if prior >= 0:
                new = ranks.get(piece[prior:stop])
                if new is not None:
                    heapq.heappush(queue, (new, prior, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; no special tokens, their strings are ordinary text."""
        out: list[int] = []
        seen = self.seen
        for m in self.cut.finditer(text):
            piece = m.group()
            ids = seen.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder per worker process and vocabulary."""
    return BytePairEncoder(path, pattern)


def encoded(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every document, one row per input row.

    Null and empty texts have an empty list; blank texts have the ids of their
    blanks. Repeated rows and ids stay as they are; null ids are kept. Whole
    texts of any length; no shuffle. ``vocabulary`` is a file of ranks that all
    executors can read.
    """
    path, cut = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, cut)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lists = [bpe.encode(t) if t else [] for t in texts]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["d", "ids"])

    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"d {kind}, ids array<int>").withColumnRenamed("d", doc_id)


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``documents`` but the text, and n_tokens. The ids stay in Python."""
    path, cut = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, cut)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            sizes = pa.array([len(bpe.encode(t)) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], sizes], names=[*[batch.schema.names[i] for i in keep], "n_tokens"])

    rest = [c for c in documents.columns if c != text]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest) + ", n_tokens long"
    return documents.select(*rest, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def decoded(ids: DataFrame, doc_id: str = "doc_id", column: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) of lists of ids; an empty or null list gives an empty text."""
    path, cut = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, cut)
        for batch in batches:
            texts = pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["d", "text"])

    kind = ids.schema[doc_id].dataType.simpleString()
    return ids.select(F.col(doc_id).alias("d"), F.col(column).cast("array<int>").alias("x")).mapInArrow(run, f"d {kind}, text string").withColumnRenamed("d", doc_id)
