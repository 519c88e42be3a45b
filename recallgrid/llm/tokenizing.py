"""Problem 8: encoding the whole corpus with a public byte-level BPE tokenizer.

Words are cut by the tokenizer's pattern.  A word that is no token itself is merged in a contiguous rank array: the part
boundaries and, beside each, the rank of the pair that begins there; the smallest rank is found by a scan, its boundary
deleted and the two neighbouring ranks refreshed.  Words of more than ``LONG`` bytes take a heap over the same ranks
instead of the scan, which is quadratic.  Each Python worker keeps the ids of the words it has met.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recallgrid.sources.tables import table

LONG = 160
CACHED_WORDS = 1 << 18
NONE = 1 << 60
#: Fixed value: the pre-tokenizer pattern of the public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """The path of byte_bpe_50k: $RECALLGRID_TOKENIZERS or the folder of public tokenizers of this machine."""
    return os.path.join(os.environ.get("RECALLGRID_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE over a contiguous array of ranks."""
    bounds = list(range(len(word) + 1))
    adjacent = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]

    def rank(i: int) -> int:
        """Of the pair that begins with part i, as the bounds stand."""
        return ranks.get(word[bounds[i] : bounds[i + 2]], NONE) if i + 2 < len(bounds) else NONE

    while adjacent:
        least = min(adjacent)
        if least == NONE:
            break
        i = adjacent.index(least)
        del bounds[i + 1]
        del adjacent[i]
        if i < len(adjacent):
            adjacent[i] = rank(i)
        if i:
            adjacent[i - 1] = rank(i - 1)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same result in O(n log n): a heap of (rank, place) over linked parts; stale entries are skipped."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Text to ids.  Null and empty texts give no ids."""

    def __init__(self, raw: bytes, pattern: str = PATTERN):
        import regex

        self.ranks, self.words, self.cut = load_ranks(raw), {}, regex.compile(pattern).findall

    def word(self, word: str) -> list[int]:
        b = word.encode("utf-8", "replace")
        if (rank := self.ranks.get(b)) is not None:
            ids = [rank]
        else:
            ids = merge_short(b, self.ranks) if len(b) <= LONG else merge_long(b, self.ranks)
        if len(self.words) < CACHED_WORDS and len(word) <= LONG:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, ids = self.words, []
        for w in self.cut(text):
            ids += known.get(w) or self.word(w)
        return ids


_encoders: dict[int, Encoder] = {}


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of every row of ``docs``: no special tokens; null and empty texts give an empty list.

    Rows stay where they are: no shuffle.  The vocabulary file (one megabyte) is read on the driver and broadcast.
    Repeated rows and null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(raw.value[:4096]) ^ len(raw.value)
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(raw.value))
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_documents(table(spark, root, "documents"))


ORACLE: dict = {}
QUERIES = {"p8_ids": p8_ids}
