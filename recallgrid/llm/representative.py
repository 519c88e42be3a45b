"""Problem 3: the best representative of each duplicate group, field by field.

Every row of a group is ranked per field by completeness (has it a usable value?), trust (has it a usable time?) and
recency, ties broken by the larger id, and a window keeps the first.  Before the ranking each (group, shard) is cut down
to its best row per field by a map-side aggregate, so that a group with a third of all rows reaches the window as at
most ``SHARDS`` rows per field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.sources.tables import table

SHARDS = 16
EDGE_TYPES = ("similar", "causal", "supersedes", "bridge", "derived_from", "supports", "synthesis_of", "before")


def clean_edge_type(c: Column) -> Column:
    """The edge type in lower case with '_' for '-' and ' ', without surrounding blanks; null if it is none of ``EDGE_TYPES``."""
    t = F.translate(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "- ", "__")
    return F.when(t.isin(*EDGE_TYPES), t)


def clean_weight(c: Column) -> Column:
    """The weight if it is finite and in [0, 1], else null."""
    return F.when(~F.isnan(c) & (c >= 0) & (c <= 1), c)


def clean_time(c: Column, first_year: int = 2024, last_year: int = 2025) -> Column:
    return F.when(F.year(c).between(first_year, last_year), c)


def best_per_field(rows: DataFrame, group: list[str], row_id: str, recency: str, fields: dict[str, str]) -> DataFrame:
    """One row per group of at least two rows: ``group``, n_rows, and for each field f: f (its value) and f_row (its row).

    ``rows`` has the group columns, ``row_id``, ``recency`` (null: unusable, ranked last) and one cleaned column per
    field (null: unusable).  ``fields`` maps output names to those columns.  A field that no row can fill is null with
    f_row -1.  Ties of recency go to the larger ``row_id``; a repeated row changes nothing but n_rows.
    """
    rank = lambda col: F.when(F.col(col).isNotNull(), F.struct(F.col(recency).isNotNull().alias("trusted"), F.col(recency).alias("at"), F.col(row_id).alias("row"), F.col(col).alias("value")))
    shard = F.pmod(F.xxhash64(row_id), F.lit(SHARDS)).alias("_shard")
    part = rows.groupBy(*group, shard).agg(F.count(F.lit(1)).alias("_n"), *[F.max(rank(c)).alias(f) for f, c in fields.items()])
    stay = part.repartition(*group)
    out = stay.select(*group, F.sum("_n").over(W.partitionBy(*group)).alias("n_rows"), *[
        x
        for f in fields
        for w in [W.partitionBy(*group).orderBy(F.col(f).isNull(), F.desc(f"{f}.trusted"), F.desc(f"{f}.at"), F.desc(f"{f}.row"))]
        for x in (F.first(f).over(w).alias(f"_{f}"),)
    ], F.row_number().over(W.partitionBy(*group).orderBy("_shard")).alias("_k"))
    return out.where((F.col("_k") == 1) & (F.col("n_rows") >= 2)).select(
        *group, "n_rows", *[c for f in fields for c in (F.col(f"_{f}.value").alias(f), F.coalesce(F.col(f"_{f}.row"), F.lit(-1)).alias(f"{f}_row"))]
    )


def best_edges(connections: DataFrame) -> DataFrame:
    """One edge per unordered pair of different memories that two or more rows join, each field from its best row.

    Rows with a null end or equal ends belong to no pair.  Only id, source_id, target_id, weight, edge_type and
    created_at are read; other columns may have any name.  An empty table gives an empty result.
    """
    s, t = F.col("source_id"), F.col("target_id")
    rows = connections.where(s.isNotNull() & t.isNotNull() & (s != t)).select(
        F.least(s, t).alias("lo_id"), F.greatest(s, t).alias("hi_id"), F.col("id").alias("row"),
        clean_weight(F.col("weight")).alias("w"), clean_edge_type(F.col("edge_type")).alias("e"), clean_time(F.col("created_at")).alias("c"),
    )
    return best_per_field(rows, ["lo_id", "hi_id"], "row", "c", {"weight": "w", "edge_type": "e", "created_at": "c"})


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return best_edges(table(spark, root, "connections"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _edges(spark, root).select("lo_id", "hi_id", "weight_row", F.col("edge_type_row").alias("type_row"), F.col("created_at_row").alias("created_row"))


def p3_edges(spark: SparkSession, root: str) -> DataFrame:
    """The surviving edges with their values."""
    return _edges(spark, root).select("lo_id", "hi_id", "n_rows", "weight", "edge_type", "created_at")


_SQL = """
with e as (
  select id, least(source_id, target_id) lo_id, greatest(source_id, target_id) hi_id,
         case when not isnan(weight) and weight between 0 and 1 then weight end w,
         case when replace(replace(lower(regexp_replace(edge_type, '^\\s+|\\s+$', '', 'g')), '-', '_'), ' ', '_')
              in ('similar','causal','supersedes','bridge','derived_from','supports','synthesis_of','before')
              then replace(replace(lower(regexp_replace(edge_type, '^\\s+|\\s+$', '', 'g')), '-', '_'), ' ', '_') end t,
         case when year(created_at) in (2024, 2025) then created_at end c
  from connections where source_id is not null and target_id is not null and source_id <> target_id),
k as (
  select *, row_number() over (partition by lo_id, hi_id order by w is null, c desc nulls last, id desc) kw,
            row_number() over (partition by lo_id, hi_id order by t is null, c desc nulls last, id desc) kt,
            row_number() over (partition by lo_id, hi_id order by c is null, c desc nulls last, id desc) kc
  from e)
"""
ORACLE = {
    "p3_found": _SQL + """select lo_id, hi_id, max(case when kw = 1 then if(w is null, -1, id) end) weight_row, max(case when kt = 1 then if(t is null, -1, id) end) type_row,
      max(case when kc = 1 then if(c is null, -1, id) end) created_row from k group by lo_id, hi_id having count(*) >= 2""",
    "p3_edges": _SQL + """select lo_id, hi_id, count(*) n_rows, max(case when kw = 1 then w end) weight, max(case when kt = 1 then t end) edge_type,
      max(case when kc = 1 then c end) created_at from k group by lo_id, hi_id having count(*) >= 2""",
}
QUERIES = {"p3_found": p3_found, "p3_edges": p3_edges}
