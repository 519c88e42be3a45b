"""Problem 7: splitting oversized texts at natural boundaries.

Cuts are independent of each other: with pieces of at most ``size`` characters of which ``overlap`` repeat the piece
before, two neighbouring cuts may lie ``span = size - overlap`` apart.  Cut k is the best boundary (paragraph, line,
sentence, word, else the end) in the last ``zone`` characters of the k-th cell of ``span - zone`` characters, so that
neighbours are never farther apart than ``span``.  A worker therefore needs a range of the text and a halo of two pieces,
never the text before it: ranges of giant items are cut in parallel, and each emits the pieces that begin in it by
offset.  Columns and giant files use the same rule; for files, where ranges are bytes, a prefix sum over the ranges'
lengths in characters gives the offsets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.operators.skew import checkpoint_folder, shared_checkpoint
from recallgrid.sources.tables import table

SIZE, OVERLAP = 1500, 120
ZONE_SHARE = 0.275
RANGE_CELLS = 64

#: From strong to weak, as patterns whose match ends at the last such boundary of a zone.
BOUNDARIES = (
    ("paragraph", r"(?s)^(.*\n[ \t\r]*\n\s*)"),
    ("line", r"(?s)^(.*\n)"),
    ("sentence", r"(?s)^(.*(?:[.!?…][\"'”’)\]]*\s+|[。！？][”’」』]*))"),
    ("word", r"(?s)^(.*\s)"),
)


def geometry(size: int = SIZE, overlap: int = OVERLAP) -> tuple[int, int]:
    """(cell, zone) in characters."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    span = size - overlap
    zone = max(1, int(span * ZONE_SHARE))
    return max(1, span - zone), zone


def _cut_in(zone: Column) -> tuple[Column, Column]:
    """(kind, characters before the cut) of the best boundary of a zone."""
    kind, at = F.lit("hard"), F.char_length(zone)
    for name, pattern in reversed(BOUNDARIES):
        n = F.char_length(F.regexp_extract(zone, pattern, 1))
        kind, at = F.when(n > 0, F.lit(name)).otherwise(kind), F.when(n > 0, n).otherwise(at)
    return kind, at


def _cells(n: Column, size: int, overlap: int) -> Column:
    """Enough cells for the last needed cut of a text of n characters."""
    cell, zone = geometry(size, overlap)
    return F.ceil((n - (size - overlap) + zone) / F.lit(cell)).cast("int")


def _cuts_of(text: Column, first: Column, count: Column, cell: int, zone: int) -> Column:
    """array<struct<k, cut, kind>> of the ``count`` cells that ``text`` begins with; ``first`` cells lie before it."""
    zones = F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(k.alias("k"), F.substr(text, (k - 1) * cell + F.lit(cell - zone + 1), F.lit(zone)).alias("zone")))

    def cut(z: Column) -> Column:
        kind, at = _cut_in(z["zone"])
        k = first + z["k"]
        return F.struct(k.alias("k"), ((k - 1) * cell + (cell - zone) + at).alias("cut"), kind.alias("kind"))

    return F.transform(zones, cut)


def _needed(cuts: Column, n: Column, span: int) -> Column:
    """The sorted ``cuts`` up to the first that leaves a last piece of at most ``span`` new characters."""
    return F.slice(cuts, F.lit(1), F.size(F.filter(cuts, lambda c: c < n - span)) + 1)


def _placed(ends: Column, overlap: int) -> Column:
    """array<struct<piece_no, start, end>> from the pieces' ends."""
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.get(ends, F.greatest(i - 1, F.lit(0))) - overlap))
    return F.transform(ends, lambda e, i: F.struct((i + 1).alias("piece_no"), start(i).alias("start"), e.alias("end")))


def pieces(items: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, start, length, piece) of each item of more than ``size`` characters, piece_no from 1.

    items: id (unique), content; more columns may be there and are ignored.  Characters are Unicode code points.  Null,
    empty and short contents have no pieces.  Every piece has at most ``size`` characters, all but the first begin with
    the last ``overlap`` characters of the one before, and the pieces without those give the content again.  Items of at
    most ``RANGE_CELLS`` cells are cut where they lie, without a shuffle; larger ones are handed out in ranges, each with
    a halo on either side, and every range emits the pieces that begin in it.
    """
    cell, zone = geometry(size, overlap)
    n = F.char_length("content")
    items = items.select("id", "content", n.alias("n")).where(F.col("n") > size).withColumn("cells", _cells(F.col("n"), size, overlap))
    small = items.where(F.col("cells") <= RANGE_CELLS)
    own = F.filter(F.transform(_cuts_of(F.col("content"), F.lit(0), F.col("cells"), cell, zone), lambda c: c["cut"]), lambda c: c < F.col("n"))
    small = small.withColumn("cuts", own).withColumn("cuts", _needed(F.col("cuts"), F.col("n"), size - overlap))
    spans = small.withColumn("ends", F.concat("cuts", F.array("n"))).select("id", "content", F.inline(_placed(F.col("ends"), overlap)))
    whole = spans.select("id", F.col("piece_no").cast("long").alias("piece_no"), F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("length"), F.substr("content", F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
    giant = items.where(F.col("cells") > RANGE_CELLS).select("id", "content")
    return whole.unionByName(giant_pieces(giant, size, overlap))


def giant_pieces(items: DataFrame, size: int = SIZE, overlap: int = OVERLAP, range_chars: int | None = None) -> DataFrame:
    """``pieces`` of giant items: an item leaves its task in ranges of ``range_chars`` characters, which are cut in parallel."""
    cell, _ = geometry(size, overlap)
    wide = range_chars or RANGE_CELLS * cell
    halo = 2 * size

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                for a in range(0, len(text), wide):
                    row = [batch.column(0)[k].as_py(), a, min(wide, len(text) - a), len(text), max(0, a - halo), text[max(0, a - halo) : a + wide + halo]]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["id", "c0", "chars", "n", "at", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = [(i, *p) for i, c0, chars, n, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in emitted(text, at, c0, chars, n, size, overlap)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "piece_no", "start", "length", "piece"])

    spread = items.mapInArrow(ranges, "id long, c0 long, chars long, n long, at long, text string").repartition("id", "c0")
    return spread.mapInArrow(cut, "id long, piece_no long, start long, length long, piece string")


def emitted(text: str, at: int, c0: int, chars: int, n: int, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """(piece_no, start, length, piece) of the pieces that the range [c0, c0 + chars) of an item of n characters emits.

    text: the range with what is known around it, from character ``at`` on.  The range in which the zone of cut k begins
    emits piece k, and the last piece after the last cut that is needed.
    """
    cell, zone = geometry(size, overlap)
    span = size - overlap
    for k in range(max(1, -(-(c0 + zone) // cell)), (c0 + chars - 1 + zone) // cell + 1):
        start, end = cut_at(text, at, k - 1, cell, zone), cut_at(text, at, k, cell, zone)
        if k > 1 and start >= n - span:
            return
        s = max(0, start - overlap)
        yield k, s, end - s, text[s - at : end - at]
        if end >= n - span:
            s = max(0, end - overlap)
            yield k + 1, s, n - s, text[s - at : n - at]


# Giant files ---------------------------------------------------------------------------------------------------------


def _read(path: str, start: int, size: int) -> bytes:
    """Bytes of a file under any address that Arrow's file systems know (file, hdfs, s3 ...)."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    with where.open_input_file(name) as f:
        start = max(0, start)
        return f.read_at(max(0, min(size, f.size() - start)), start)


def _range_chars(path: str, start: int, end: int, size: int) -> tuple[int, int, str]:
    """The text whose characters begin in [start, end), with its first and last byte."""
    raw = _read(path, start, end - start + 4)
    a = 0
    while a < len(raw) and start and a < 4 and raw[a] & 0xC0 == 0x80:
        a += 1
    b = min(end - start, len(raw))
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return start + a, start + b, raw[a:b].decode("utf-8", "replace")


def file_pieces(spark: SparkSession, files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, range_bytes: int = 8 << 20) -> DataFrame:
    """(path, piece_no, start, length, piece) of UTF-8 files of any size.

    files: path, n_bytes; the paths must be readable on every executor.  No task holds more than two ranges of a file:
    the first pass counts the characters of each byte range, a prefix sum gives the character at which it begins, and
    the second pass reads a range with a halo of one piece on either side and emits the pieces that end in it.  Files
    of at most ``size`` characters give one piece, empty files none.
    """
    ranges = files.select("path", F.col("n_bytes").cast("long").alias("n_bytes")).where(F.col("n_bytes") > 0).select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / range_bytes))).alias("r")
    )
    ranges = ranges.select("path", "n_bytes", "r", (F.col("r") * range_bytes).alias("a"), F.least((F.col("r") + 1) * range_bytes, F.col("n_bytes")).alias("b"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["chars"] = [len(_range_chars(p, a, b, size)[2]) for p, a, b in zip(pdf["path"], pdf["a"], pdf["b"], strict=True)]
            yield pdf

    many = max(spark.sparkContext.defaultParallelism, 1)
    counted = shared_checkpoint(ranges.repartition(many * 4, "path", "r").mapInPandas(count, "path string, n_bytes long, r long, a long, b long, chars long"))
    by_file = W.partitionBy("path")
    placed = counted.withColumn("c0", F.sum("chars").over(by_file.orderBy("r").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("chars")).withColumn("n", F.sum("chars").over(by_file))
    reach = 4 * 2 * size

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, nb, a, b, c0, chars, n in zip(*(pdf[x] for x in ("path", "n_bytes", "a", "b", "c0", "chars", "n")), strict=True):
                before = _range_chars(path, max(0, a - reach), a, size)[2] if a else ""
                own = _range_chars(path, a, b, size)[2]
                after = _range_chars(path, b, min(nb, b + reach), size)[2] if b < nb else ""
                if n <= size:
                    out += [(path, 1, 0, n, own)] * (c0 == 0 and n > 0)
                else:
                    out += [(path, *p) for p in emitted(before + own + after, c0 - len(before), c0, chars, n, size, overlap)]
            yield pd.DataFrame(out, columns=["path", "piece_no", "start", "length", "piece"])

    return placed.repartition(many * 4, "path", "r").mapInPandas(emit, "path string, piece_no long, start long, length long, piece string")


def cut_at(text: str, at: int, k: int, cell: int, zone: int) -> int | None:
    """Cut k of a text of which ``text`` is the part that begins at character ``at``; None if its zone isn't in it."""
    if k <= 0:
        return 0
    a = k * cell - zone - at
    if a < 0 or a >= len(text):
        return None
    return at + a + best_cut(text[a : a + zone])


def best_cut(zone: str) -> int:
    """Python's form of the boundary rule, for files and tests."""
    import regex

    for _, pattern in BOUNDARIES:
        if m := regex.match(pattern, zone):
            if m.end(1):
                return m.end(1)
    return len(zone)


def p7_pieces(spark: SparkSession, root: str) -> DataFrame:
    return pieces(table(spark, root, "memories"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """The memories that the operator gives pieces of."""
    return pieces(table(spark, root, "memories")).select("id").distinct()


def p7_files(spark: SparkSession, root: str, parts: int = 8, range_bytes: int = 8 << 20) -> DataFrame:
    """The contents of memories as a few big text files in the shared folder, cut by byte ranges: pieces and characters of each."""
    folder = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    table(spark, root, "memories").where(F.col("content").isNotNull()).select("id", "content").repartitionByRange(parts, "id").sortWithinPartitions("id").select("content").write.text(folder)
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("n_bytes"))
    cut = file_pieces(spark, files, range_bytes=range_bytes)
    return cut.groupBy(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file_no")).agg(F.count(F.lit(1)).alias("pieces"), F.max(F.col("start") + F.col("length")).alias("chars"), F.max("length").alias("longest"))


ORACLE = {"p7_found": "select id from memories where length(content) > 1500"}
QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces, "p7_files": p7_files}
