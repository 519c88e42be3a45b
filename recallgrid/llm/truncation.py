"""Problem 10: texts cut off by field limits or broken transfers.

A backward character n-gram model: for each text's final context (its last n characters, a mark of a cut put aside) the
whole corpus says how often that context was followed by an end (of a sentence, a line or a text) and how often by more
text.  The log-odds of the longest context with enough support are compared with a threshold per language and end
symbol.  End symbols are nothing, a mark ("…", "[truncated]") and U+FFFD; what a mark says is learned too, as the share
of its texts that their contexts alone show to be cut.  U+FFFD stands for bytes whose rest is missing: to the model a
text goes on after it.

Only final contexts are counted.  A Bloom filter, sized by their number, holds them; contexts of one place are nested, so
a place is looked up from the shortest context on and dropped at the first that no text ends with.  More contexts than
one filter takes are counted in several passes, each with the places whose shortest context falls into its range.  Each worker sorts and sums up what
passes before anything is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators.skew import shared_checkpoint
from recallgrid.sources.tables import table

LENGTHS = (3, 4, 6, 8, 12, 16, 24)
#: Contexts that also know the first ``HEAD`` characters of their line ("Tags:", "user:").
HEAD, HEADED = 5, (4, 6, 12)
LEVELS = len(LENGTHS) + len(HEADED) + 1  # the last: a final U+FFFD by itself
SUPPORT, HEAD_SUPPORT, HEAD_GOOD = 6, 3, 12
#: Bits of the filter for each final context, and the most words of 64 bits that one pass broadcasts (32 MB).
FILTER_BITS, MOST_WORDS, PASS_SHIFT = 16, 1 << 22, 24
#: Log-odds of an end below which a text is cut, before its language's and its end symbol's level are taken into account.
THRESHOLD = -1.5
#: A final U+FFFD has been followed by the rest of a text that often before any text is counted.
BROKEN_PRIOR = 8

MARK = re.compile(r"(?:…|\.\.\.|\[(?:more|…|\.\.\.|truncated|cut|continued)\]|\((?:more|truncated|continued)\)|<(?:truncated|snip)>)$", re.I)
LONGEST_MARK = 16
BROKEN, BROKEN_CODE, SEPARATOR = "\ufffd", 0xFFFD, 0x110000
#: Texts are counted in slices of at most so many characters, each with the characters before it that contexts need.
SLICE, AFTER = 1 << 18, 8
#: Characters that a worker hashes at once, hits that it sorts at once, and sorted runs that it merges at once.
CHUNK, RUN, RUNS = 1 << 16, 1 << 20, 12

_B = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE, _TERM, _CLOSE, _BREAK, _WIDE = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    out[0x2E80:] |= _WIDE
    for flag, chars in ((_SPACE, " \t\xa0　\n\r"), (_TERM, ".!?。！？…"), (_CLOSE, "\"')]}”’»」』"), (_BREAK, "\n\r")):
        out[[ord(c) for c in chars]] |= flag
    return out


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            out[done : 2 * done] = out[: min(done, n - done)] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
    return out


_CLASS = _classes()
_TABLE: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers for at least ``n`` places, kept per worker."""
    got = _TABLE.get(base)
    if got is None or len(got) < n:
        got = _TABLE[base] = _powers(base, 1 << max(17, (n - 1).bit_length()))
    return got[:n]


_Q = pow(_B, -1, 1 << 64)


def core_of(text: str) -> tuple[str, bool]:
    """The text without blanks and marks of a cut at its end, and whether there was such a mark."""
    core, marked = text.rstrip(), False
    while m := MARK.search(core, max(0, len(core) - LONGEST_MARK)):
        core, marked = core[: m.start()].rstrip(), True
    return core, marked


def slices(text: str) -> Iterator[tuple[str, int, bool]]:
    """Parts of a text as (part, characters of it that count elsewhere, whether the text goes on after it).

    A part that begins within a line has the line's head put before it.
    """
    halo = max(LENGTHS) + HEAD
    line, seen = 0, 0
    for a in range(0, max(len(text), 1), SLICE):
        lo, hi = max(0, a - halo), min(len(text), a + SLICE + AFTER)
        line = max(line, text.rfind("\n", seen, lo) + 1, text.rfind("\r", seen, lo) + 1)
        seen = lo
        head = text[line : line + HEAD] if line < lo else ""
        yield head + text[lo:hi], a - lo + len(head), hi < len(text)


def codes_of(text: str) -> np.ndarray:
    """Code points, all digits as 0."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    a[(a >= 48) & (a <= 57)] = 48
    return a


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(32))


def _key(h: np.ndarray) -> np.ndarray:
    """A context's key: its hash without the last bit, which is free for the event that follows."""
    return h & ~np.uint64(1)


class Contexts:
    """Hashes of the contexts that end at given places of a text or of several texts put together.

    With S the running sum of c[j] * B ** j, the n characters up to place i hash to (S[i] - S[i - n]) * B ** -i: any
    context of any place takes one subtraction and one product.
    """

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(_B, len(codes)), dtype=np.uint64, out=self.sums[1:])
        self.back = _power(_Q, len(codes))

    def raw(self, n: int, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + 1] - self.sums[at + 1 - n]) * self.back[at]

    def plain(self, n: int, at: np.ndarray) -> np.ndarray:
        return _mix(self.raw(n, at) ^ np.uint64(n))

    def headed(self, n: int, at: np.ndarray, head_end: np.ndarray) -> np.ndarray:
        """Context together with the head of its line, of which ``head_end`` is the last place."""
        with np.errstate(over="ignore"):
            return _mix(self.plain(n, at) + _mix(self.raw(HEAD, head_end)) * np.uint64(3))


def ends_after(codes: np.ndarray) -> np.ndarray:
    """For each place whether an end follows it: a line's or text's end, or the terminal marks of a sentence."""
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    f = _CLASS[np.minimum(codes, 0xFFFF)]
    space, term = (f & _SPACE) != 0, (f & _TERM) != 0
    # done[i]: after the terminal marks and closers from i on comes a blank, a wide character or the end
    stop = np.where((f & (_TERM | _CLOSE)) == 0, np.arange(n), n)
    after = np.minimum.accumulate(stop[::-1])[::-1]
    ended = np.append((f & (_SPACE | _WIDE)) != 0, True)[after]
    out = np.empty(n, bool)
    out[-1] = True
    out[:-1] = (f[1:] & _BREAK) != 0
    out[:-1] |= term[1:] & ended[1:]
    out[:-1] |= term[:-1] & (space[1:] | (codes[:-1] >= 0x3000))
    return out


def final_hashes(cores: list[str]) -> list[list[int | None]]:
    """For each text the keys of its final contexts by level, as ``Contexts`` gives them at its last place."""
    if not cores:
        return []
    lines = [max(c.rfind("\n"), c.rfind("\r")) + 1 for c in cores]
    most = max(LENGTHS)
    tails = [c[-most:].rjust(most, "\0") for c in cores]
    heads = [c[a : a + HEAD].ljust(HEAD, "\0") for c, a in zip(cores, lines, strict=True)]
    codes = codes_of("".join(t + h for t, h in zip(tails, heads, strict=True)))
    c = Contexts(codes)
    last = np.arange(len(cores)) * (most + HEAD) + most - 1
    size = np.array([len(x) for x in cores])
    deep = size - np.array(lines) >= HEAD
    cols = [(c.plain(n, last), size >= n) for n in LENGTHS]
    cols += [(c.headed(n, last, last + HEAD), deep & (size >= n)) for n in HEADED]
    cols.append((c.plain(1, last), codes[last] == BROKEN_CODE))
    rows = ([v if ok else None for v, ok in zip(_key(h).view(np.int64).tolist(), fits.tolist(), strict=True)] for h, fits in cols)
    return [list(row) for row in zip(*rows, strict=True)]


def _finals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, cores = [], []
        for doc_id, text, source, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not text or not text.strip():
                continue
            core, mark = core_of(text)
            core = core or text.strip()
            cores.append(core)
            rows.append((doc_id, source, lang, "broken" if core.endswith(BROKEN) else "mark" if mark else "none"))
        cols = [*(zip(*rows, strict=True) if rows else [()] * 4), final_hashes(cores)]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "source", "lang", "symbol", "ctx"])


FINAL_SCHEMA = "doc_id long, source string, lang string, symbol string, ctx array<long>"


def final_contexts(docs: DataFrame) -> DataFrame:
    """One row per text with content: its end symbol and the keys of its final contexts by level."""
    return docs.select("doc_id", "text", "source", "lang").mapInArrow(_finals, FINAL_SCHEMA)


def filter_shape(contexts: int) -> tuple[int, int]:
    """(words, passes) for so many distinct contexts, both powers of two."""
    want = max(64, contexts * FILTER_BITS // 64)
    passes = 1 << max(0, -(-want // MOST_WORDS) - 1).bit_length()
    return min(MOST_WORDS, 1 << (max(1, want // passes) - 1).bit_length()), passes


def context_filter(contexts: DataFrame, words: int) -> np.ndarray:
    """Two bits of one word for each of ``contexts`` (h)."""
    h = F.col("h")
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    got = contexts.groupBy(F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(words - 1)).alias("w")).agg(F.bit_or(bit(58).bitwiseOR(bit(52))).alias("b")).toPandas()
    out = np.zeros(words, dtype=np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = (np.uint64(1) << (h >> np.uint64(58))) | (np.uint64(1) << ((h >> np.uint64(52)) & np.uint64(63)))
    return bits[((h >> np.uint64(1)) & np.uint64(len(bits) - 1)).astype(np.int64)] & mask == mask


def _hits(parts: list[tuple[str, int, bool]], bits: np.ndarray, number: int = 0, passes: int = 1) -> Iterator[np.ndarray]:
    """Keys of the contexts that pass the filter, the last bit telling whether an end follows.

    The texts stand one after the other behind separators that are no character, so that a context which reaches beyond
    its text's start is one that no text ends with.
    """
    mine = lambda h: ((h >> np.uint64(PASS_SHIFT)) & np.uint64(passes - 1)) == number
    most = max(LENGTHS)
    codes = codes_of("\n" * most + "".join(p + "\n" for p, _, _ in parts))
    sizes = np.array([len(p) for p, _, _ in parts])
    stops = most + np.cumsum(sizes + 1) - 1
    ends = ends_after(codes)
    ends &= codes != BROKEN_CODE
    event = ends.astype(np.uint64)
    brk = (_CLASS[np.minimum(codes, 0xFFFF)] & _BREAK) != 0
    codes[:most] = codes[stops] = SEPARATOR
    fresh = None
    for (_, done, more), size, stop in zip(parts, sizes.tolist(), stops.tolist(), strict=True):
        if done or more:  # what a slice shares with the one before or after it counts once
            fresh = np.ones(len(codes), bool) if fresh is None else fresh
            fresh[stop - size : stop - size + done] = False
            fresh[stop - AFTER * more : stop] = False
    ctx = Contexts(codes)
    broken = np.flatnonzero(codes == BROKEN_CODE)
    if len(broken):
        if fresh is not None:
            broken = broken[fresh[broken]]
        h = ctx.plain(1, broken)
        yield (_key(h) | event[broken])[_holds(bits, h) & mine(h)]
    with np.errstate(over="ignore"):
        first, sums = LENGTHS[0], ctx.sums
        h = _mix(((sums[first:] - sums[:-first]) * ctx.back[first - 1 :]) ^ np.uint64(first))
        ok = _holds(bits, h)
        if passes > 1:
            ok &= mine(h)
        if fresh is not None:
            ok &= fresh[first - 1 :]
        ok = np.flatnonzero(ok)
        at = ok + (first - 1)
        upto, back, ev = sums[1:].take(at), ctx.back.take(at), event.take(at)
        yield _key(h.take(ok)) | ev
        head = line_of = None
        for n in LENGTHS[1:]:
            h = _mix(((upto - sums.take(at + (1 - n), mode="wrap")) * back) ^ np.uint64(n))
            ok = np.flatnonzero(_holds(bits, h))
            if len(ok) < len(at):
                at, upto, back, ev, h = (x.take(ok) for x in (at, upto, back, ev, h))
            yield _key(h) | ev
            if head is not None:
                line_of = line_of.take(ok)
            elif n in HEADED:
                starts = np.flatnonzero(np.r_[True, brk[:-1]])
                head = _mix(ctx.raw(HEAD, np.minimum(starts + HEAD - 1, len(codes) - 1))) * np.uint64(3)
                line_of = (np.cumsum(np.r_[True, brk[:-1]]) - 1)[at]
                line_of[at - starts[line_of] < HEAD - 1] = -1
            if n in HEADED:
                deep = np.flatnonzero(line_of >= 0)
                hh = _mix(h[deep] + head[line_of[deep]])
                ok = _holds(bits, hh)
                yield _key(hh[ok]) | ev[deep[ok]]
                line_of[deep[~ok]] = -1  # a longer context with this head is no final one either


def _runs(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each stands."""
    packed = np.sort(packed)
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, np.int64)
    return packed[first], np.diff(np.r_[first, len(packed)])


def _merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    v, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    o = np.argsort(v, kind="stable")
    v, n = v[o], n[o]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    return v[first], np.add.reduceat(n, first) if len(v) else n


def asked_contexts(finals: DataFrame) -> DataFrame:
    """(doc_id, level, h, k) of the final contexts; k, the key of the shortest of the place, decides on the pass."""
    asked = finals.select("doc_id", F.col("ctx")[0].alias("s"), F.posexplode("ctx").alias("level", "h")).where(F.col("h").isNotNull())
    return asked.select("doc_id", "level", "h", F.when(F.col("level") == LEVELS - 1, F.col("h")).otherwise(F.col("s")).alias("k"))


def count_contexts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(h, ends, goes) over the whole corpus for ``contexts`` (h, k; each once)."""
    words, passes = filter_shape(contexts.count())
    out = None
    for p in range(passes):
        some = contexts.where(F.shiftrightunsigned("k", PASS_SHIFT).bitwiseAND(F.lit(passes - 1)) == p) if passes > 1 else contexts
        shared = docs.sparkSession.sparkContext.broadcast(context_filter(some, words))
        part = docs.select("text").mapInArrow(_counter(shared, p, passes), "h long, ends long, goes long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))


def _counter(shared, number: int, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: list[np.ndarray] = []
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(x: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            ends = (x[0] & np.uint64(1)).astype(np.int64)
            n = x[1].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(_key(x[0]).view(np.int64)), pa.array(n * ends), pa.array(n * (1 - ends))], names=["h", "ends", "goes"])

        for batch in batches:
            chunk, chars = [], 0
            parts = [p for t in batch.column(0).to_pylist() if t and t.strip() for p in slices(t)]
            for k, part in enumerate(parts):
                chunk.append(part)
                chars += len(part[0])
                if chars < CHUNK and k + 1 < len(parts):
                    continue
                for hits in _hits(chunk, bits, number, passes):
                    held.append(hits)
                    size += len(hits)
                chunk, chars = [], 0
                if size >= RUN:
                    runs.append(_runs(np.concatenate(held)))
                    held, size = [], 0
                    if len(runs) >= RUNS:
                        runs = [_merge(runs)]
                        if len(runs[0][0]) > RUN:
                            yield out(runs[0])
                            runs = []
        if held:
            runs.append(_runs(np.concatenate(held)))
        if runs:
            yield out(_merge(runs))

    return run


def _language(lang):
    return F.coalesce(F.lower(F.substring(F.trim(lang), 1, 2)), F.lit("un"))


def end_scores(docs: DataFrame) -> DataFrame:
    """Each text with content: doc_id, source, lang, symbol, odds (log-odds that it may end there)."""
    finals = shared_checkpoint(final_contexts(docs))
    asked = asked_contexts(finals)
    counts = count_contexts(docs, shared_checkpoint(asked.select("h", "k").distinct()))
    # the text's own end is no evidence
    broken = F.col("level") == LEVELS - 1
    ends = F.when(broken, F.col("ends")).otherwise(F.greatest(F.lit(0), F.col("ends") - 1))
    goes = F.when(broken, F.greatest(F.lit(0), F.col("goes") - 1) + BROKEN_PRIOR).otherwise(F.col("goes"))
    least = F.when(F.col("level") < len(LENGTHS), SUPPORT).otherwise(HEAD_SUPPORT)
    judged = asked.join(counts, "h").select("doc_id", "level", ends.alias("ends"), goes.alias("goes")).where(F.col("ends") + F.col("goes") >= least)
    odds = F.struct("level", F.log((F.col("ends") + 0.5) / (F.col("goes") + 0.5)).alias("odds"), "ends")
    plain, line = F.col("level") < len(LENGTHS), F.col("level").between(len(LENGTHS), LEVELS - 2)
    best_head = F.struct((F.col("ends") + F.col("goes") >= HEAD_GOOD).alias("good"), odds.alias("o"))
    best = judged.groupBy("doc_id").agg(
        F.max(F.when(plain, odds)).alias("p"), F.max(F.when(line, best_head)).alias("hh"), F.max(F.when(broken, odds)).alias("b")
    ).select("doc_id", "p", F.col("hh.o").alias("h"), "b")
    # the longest context that is known; one that knows its line instead if it has seen an end and finds it likelier
    headed_odds = F.when(F.col("h.ends") > 0, F.col("h.odds"))
    best = best.select("doc_id", F.coalesce("b.odds", F.greatest(F.coalesce("p.odds", "h.odds"), headed_odds)).alias("odds"))
    return finals.drop("ctx").join(best, "doc_id", "left")


def cut_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, odds, cut) of every text with content.

    Null, empty and blank texts can't be judged and are left out; a text of which no final context has support is not
    cut.  Repeated rows are judged alike; null sources and languages form a group of their own; other columns are
    ignored.
    """
    scored = shared_checkpoint(end_scores(docs).withColumn("language", _language(F.col("lang"))))
    # per language: what the middle of the complete texts looks like, in the one column text
    level = scored.where(F.col("odds") > THRESHOLD).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("odds", F.lit(0.05), 1000).alias("low"))
    limit = F.when(F.col("n") >= 50, F.least(F.lit(THRESHOLD), F.col("low") - 0.5)).otherwise(F.lit(THRESHOLD))
    scored = scored.join(F.broadcast(level.select("language", F.greatest(F.lit(THRESHOLD - 1.0), limit).alias("limit"))), "language", "left")  # one row per two letters
    scored = scored.withColumn("limit", F.coalesce("limit", F.lit(THRESHOLD)))
    sure = F.coalesce(F.col("odds") < F.col("limit"), F.lit(False)).cast("double")
    # per end symbol: how much likelier a cut is than after no symbol, as far as the contexts alone show
    share = scored.groupBy("symbol").agg(F.log((F.sum(sure) + 1) / (F.sum(1 - sure) + 19)).alias("prior"))
    none = share.where(F.col("symbol") == "none").select(F.col("prior").alias("base"))
    prior = share.join(F.broadcast(none), F.lit(True), "left").select("symbol", F.greatest(F.lit(0.0), F.col("prior") - F.coalesce("base", "prior")).alias("more"))
    judged = scored.join(F.broadcast(prior), "symbol")  # at most one row per symbol
    return judged.select("doc_id", "source", "lang", "odds", F.coalesce(F.col("odds") < F.col("limit") + F.col("more"), F.lit(False)).alias("cut"))


def source_report(cut: DataFrame) -> DataFrame:
    """How often each source cuts."""
    return cut.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut_texts"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return cut_texts(table(spark, root, "documents")).where("cut").select("doc_id")


def p10_sources(spark: SparkSession, root: str) -> DataFrame:
    return source_report(cut_texts(table(spark, root, "documents")))


ORACLE: dict = {}
QUERIES = {"p10_found": p10_found, "p10_sources": p10_sources}
