"""References to rows that do not exist.

A blocked Bloom filter of the parent keys (one 64-bit word and ``PROBES`` bits of it per key), built with plain
aggregates and sized by the number of parents, proves definite orphans.  References are then summed up per key before
anything is shuffled, so that a key with a third of all references is one row per task: only filter-positive keys are
verified by an exact join with the parents, and the few keys that turn out to be without a parent, or to have one that
came late, are joined back to the references.  The filter is broadcast up to ``MAX_WORDS`` words (128 MB); a larger one
is joined by shuffle, part by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.skew import shared_checkpoint

PROBES = 4
KEYS_PER_WORD = 4
MAX_WORDS = 1 << 24
#: Words of one row of the filter.
CHUNK = 1 << 10
#: The most keys that are broadcast to find their references; more are joined by shuffle.
MOST_KEYS = 1_000_000


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    """``PROBES`` bits of a word, chosen by a second hash of the key."""
    h, mask = F.xxhash64(key, F.lit(0)), None
    for i in range(PROBES):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def filter_words(n_keys: int) -> int:
    """Words for ``n_keys``: a power of two, at least one row of the filter."""
    return max(CHUNK, 1 << (max(1, n_keys // KEYS_PER_WORD) - 1).bit_length())


def bloom_filter(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(chunk, bits): rows of ``CHUNK`` words of the filter of the non-null keys."""
    c = F.col(key)
    filled = keys.where(c.isNotNull()).groupBy(_word(c, words).alias("word")).agg(F.bit_or(_mask(c)).alias("bits"))
    chunk = F.shiftright("word", CHUNK.bit_length() - 1)
    rows = filled.groupBy(chunk.alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(CHUNK - 1)).cast("int").alias("at"), "bits"))).alias("m"))
    return rows.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bits"))


def may_hold(rows: DataFrame, key: str, filt: DataFrame, words: int) -> DataFrame:
    """``rows`` with maybe: false where the filter proves that it doesn't hold the key."""
    c = F.col(key)
    if words <= MAX_WORDS:
        filt = F.broadcast(filt)  # at most MAX_WORDS * 8 bytes
    at = (_word(c, words).bitwiseAND(F.lit(CHUNK - 1)) + 1).cast("int")
    found = F.element_at("bits", at).bitwiseAND(_mask(c)) == _mask(c)
    placed = rows.withColumn("chunk", F.shiftright(_word(c, words), CHUNK.bit_length() - 1))
    return placed.join(filt, "chunk", "left").withColumn("maybe", F.coalesce(found, F.lit(False))).drop("chunk", "bits")


def orphan_keys(refs: DataFrame, parents: DataFrame, removed: DataFrame) -> DataFrame:
    """(ref_id, born, known): the keys without a parent (born is null), and those of which some reference may be early.

    known: whether ``removed`` holds the key.
    """
    words = filter_words(parents.count())
    keys = refs.where(F.col("ref_id").isNotNull()).groupBy("ref_id").agg(F.min("row_time").alias("first"))
    probed = may_hold(keys, "ref_id", bloom_filter(parents, "id", words), words)
    born = (
        parents.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("ref_id"))
        .agg(F.min("created_at").alias("t"), F.max(F.col("created_at").isNull()).alias("timeless"))
        .select("ref_id", F.when(~F.col("timeless"), F.col("t")).alias("born"), F.lit(True).alias("there"))
    )
    verified = probed.where("maybe").join(born, "ref_id", "left")
    late = verified.where(F.col("there") & (F.col("born") > F.col("first"))).select("ref_id", "born", F.lit(False).alias("known"))
    gone = probed.where(~F.col("maybe")).select("ref_id").unionByName(verified.where(F.col("there").isNull()).select("ref_id"))
    revised = removed.select(F.col("memory_id").alias("ref_id")).where(F.col("ref_id").isNotNull()).distinct().withColumn("_known", F.lit(True))
    gone = gone.join(revised, "ref_id", "left").select("ref_id", F.lit(None).cast(dict(parents.dtypes)["created_at"]).alias("born"), F.coalesce("_known", F.lit(False)).alias("known"))
    return late.unionByName(gone)


def orphan_references(refs: DataFrame, parents: DataFrame, removed: DataFrame) -> DataFrame:
    """Each non-null reference without a parent at its time.

    refs: any columns, among them ref_id and row_time.  parents: id, created_at.  removed: memory_id.
    Returns the rows of ``refs`` with ref_state: 'late' (the parent came after row_time), 'deleted' (``removed`` knows
    the id) or 'missing'.  A parent or a row without a time is never late.  Repeated parents count once, with their
    earliest time, and as without a time if one of them has none.  Null references and null parents are left out; with
    no parents at all every reference is an orphan.
    """
    keys = shared_checkpoint(orphan_keys(refs.select("ref_id", "row_time"), parents, removed).withColumnsRenamed({"born": "_born", "known": "_known"}))
    if keys.count() <= MOST_KEYS:
        keys = F.broadcast(keys)
    found = refs.join(keys, "ref_id").where(F.col("_born").isNull() | (F.col("_born") > F.col("row_time")))
    state = F.when(F.col("_born").isNotNull(), "late").when(F.col("_known"), "deleted").otherwise("missing")
    return found.withColumn("ref_state", state).drop("_born", "_known")


def reference_rows(connections: DataFrame, insights: DataFrame) -> DataFrame:
    """The references of both tables, one row each: tab, row_id, fld, ref_id, row_time."""
    from_edges = connections.select(
        F.lit("connections").alias("tab"), F.col("id").alias("row_id"), F.col("ingestion_time").alias("row_time"),
        F.inline(F.array(F.struct(F.lit("source_id").alias("fld"), F.col("source_id").alias("ref_id")), F.struct(F.lit("target_id").alias("fld"), F.col("target_id").alias("ref_id")))),
    )
    from_insights = insights.select(
        F.lit("dream_insights").alias("tab"), F.col("id").alias("row_id"), F.col("created_at").alias("row_time"),
        F.lit("source_memory_id").alias("fld"), F.col("source_memory_id").alias("ref_id"),
    )
    return from_edges.unionByName(from_insights)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, state and month."""
    return orphans.groupBy("tab", "fld", "ref_state", F.date_format("row_time", "yyyy-MM").alias("ym")).agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("ref_id").alias("ids"))
