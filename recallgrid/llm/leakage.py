"""Problem 9: evaluation texts leaking into training text.

Pigeonhole edit matching over words.  Every window of ``WINDOW`` words of a test item is split into ``ERRORS + 1``
pieces; a passage with at most ``ERRORS`` altered words keeps one piece whole, so exact hits of pieces find all
candidates.  Around a hit Myers' bit-parallel distance tells whether the text carries the window with that many errors,
and an alignment that allows no two errors in a row makes sure.  Words are compared after folding case, width,
look-alike letters, accents, invisible characters, markup and punctuation.  The items are broadcast in blocks of a fixed
size, however many there are; documents stay where they are.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.sources.tables import table

WINDOW, ERRORS = 12, 2
PIECE = WINDOW // (ERRORS + 1)
BLOCK_CHARS = 4_000_000

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = str.maketrans(
    "авсеһіјкӏмнорԛѕтуѵԝхАВСЕНІЈКМОРЅТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορτυιкɑɡıℓ",
    "abcehijklmhopqstuvwxABCEHIJKMOPSTYXABEZHIKMNOPTYXavoptuikagil",
)
_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_BULLET = re.compile(r"(?m)^[ \t>*•·‣▪#|-]*(?:\d{1,3}[.)][ \t]+)?")
_BREAK = re.compile(r"-\n[ \t>]*(?=\w)")
_WORD = re.compile(r"[^\W_]+(?:[-'’‐‑][^\W_]+)*")
_INNER = re.compile(r"[-'’‐‑]")


def words_of(text: str) -> list[str]:
    """The words of ``text`` in the form in which they are compared."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKC", text).translate(LOOK_ALIKE)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "-\n" in text:
        text = _BREAK.sub("-", text)
    return [_INNER.sub("", w) for w in _WORD.findall(_BULLET.sub(" ", text).lower())]


def myers(peq: dict[str, int], m: int, text: list[str]) -> int:
    """The least number of word errors with which the pattern stands somewhere in ``text`` (Myers 1999).

    peq: for each word of the pattern the bits of its places; m: the pattern's length.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best


def longest_passage(item: list[str], text: list[str]) -> int:
    """Words of the longest passage of ``item`` in ``text``, of which isolated words may be replaced, added or dropped.

    A passage begins and ends with an equal word; no two errors follow each other.  A word of the item may also stand as
    two words of the text (a hyphen turned into a blank).
    """
    n, best = len(text), 0
    zero = [0] * (n + 1)
    m_1, e_1 = zero, zero  # of the row before: passages that end in a match or in an error
    for w in item:
        m_0, e_0 = [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            t = text[j - 1]
            if t == w:
                m_0[j] = max(m_1[j - 1], e_1[j - 1]) + 1
            elif j > 1 and len(w) > len(t) and w.endswith(t) and text[j - 2] + t == w:
                m_0[j] = max(m_1[j - 2], e_1[j - 2]) + 1
            best = max(best, m_0[j])
            # replaced, dropped from the text, added to the text
            e = max(m_1[j - 1], m_1[j])
            e_0[j] = max(e + 1 if e else 0, m_0[j - 1])
        m_1, e_1 = m_0, e_0
    return best


class Index:
    """Pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[tuple[int, list[str]]] = []
        self.pieces: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        self.bits: list[dict[str, int]] = []
        for item_id, text in items:
            words = words_of(text)
            if len(words) < WINDOW:
                continue
            k = len(self.items)
            self.items.append((item_id, words))
            bits: dict[str, int] = defaultdict(int)
            for p, w in enumerate(words):
                bits[w] |= 1 << p
            self.bits.append(dict(bits))
            for p in range(len(words) - PIECE + 1):
                self.pieces[tuple(words[p : p + PIECE])].append((k, p))
        self.first = {p[0] for p in self.pieces}

    def leaked(self, text: str) -> list[int]:
        """The ids of the items of which ``text`` carries a passage."""
        words = words_of(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        first, pieces = self.first, self.pieces
        for q in range(len(words) - PIECE + 1):
            if words[q] in first:
                for k, p in pieces.get(tuple(words[q : q + PIECE]), ()):
                    hits[k].append((p, q))
        return [self.items[k][0] for k, found in hits.items() if self._verify(k, found, words)]

    def _verify(self, k: int, hits: list[tuple[int, int]], words: list[str]) -> bool:
        item, bits = self.items[k][1], self.bits[k]
        mask = (1 << WINDOW) - 1
        for p, q in hits:
            region = words[max(0, q - WINDOW - ERRORS) : q + WINDOW + ERRORS + PIECE]
            if sum(w in bits for w in region) < WINDOW - ERRORS:
                continue
            for s in range(max(0, p - WINDOW + PIECE), min(p, len(item) - WINDOW) + 1):
                peq = {w: b for w in set(region) if (b := bits.get(w, 0) >> s & mask)}
                if myers(peq, WINDOW, region) <= ERRORS and longest_passage(item[s : s + WINDOW], region) >= WINDOW:
                    return True
        return False


_HELD: list = [None, None]


def index_of(rows: list[tuple[int, str]]) -> Index:
    """The index of a block of items, built once per worker: a broadcast gives the same list to all tasks of a worker."""
    if _HELD[0] is not rows:
        _HELD[:] = [rows, Index(rows)]
    return _HELD[1]


def leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) of each document that carries a passage of at least ``WINDOW`` words of an item, once.

    docs: doc_id, text; items: item_id, item_text; other columns are ignored.  Null, empty and short texts carry
    nothing, items of fewer than ``WINDOW`` words can't leak; repeated documents count once per doc_id.  No item, no row.
    """
    spark = docs.sparkSession
    sizes = items.where(F.length("item_text") > 0).agg(F.sum(F.length("item_text")), F.count(F.lit(1))).first()
    blocks = max(1, -(-int(sizes[0] or 0) // block_chars))
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = [(r[0], r[1]) for r in block.where(F.length("item_text") > 0).select("item_id", "item_text").collect()]
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value)
            for batch in batches:
                found = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i in index.leaked(t)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "item_id"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def item_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Each test item with the number of documents that it leaked into."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))
    return items.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.col("docs").isNotNull().alias("leaked"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    return item_report(p9_found(spark, root), table(spark, root, "eval_items"))


ORACLE: dict = {}
QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
