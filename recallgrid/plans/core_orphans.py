"""Queries of the orphan report over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators.orphans import orphan_references, orphan_report, reference_rows
from recallgrid.sources.tables import table


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    refs = reference_rows(table(spark, root, "connections").select("id", "source_id", "target_id", "ingestion_time"), table(spark, root, "dream_insights").select("id", "source_memory_id", "created_at"))
    return orphan_references(refs, table(spark, root, "memories").select("id", "created_at"), table(spark, root, "memory_revisions").select("memory_id"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("tab", "row_id", "fld", "ref_id", "ref_state", F.date_format("row_time", "yyyy-MM").alias("ym"))


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(_orphans(spark, root))


FOUND_SQL = """
with refs as (
  select 'connections' tab, id row_id, 'source_id' fld, source_id ref_id, ingestion_time t from connections
  union all select 'connections', id, 'target_id', target_id, ingestion_time from connections
  union all select 'dream_insights', id, 'source_memory_id', source_memory_id, created_at from dream_insights),
marked as (
  select r.*, m.id is not null as present, m.created_at born,
         exists (select 1 from memory_revisions v where v.memory_id = r.ref_id) as revised
  from refs r left join memories m on m.id = r.ref_id where r.ref_id is not null),
found as (
  select tab, row_id, fld, ref_id,
         case when present then 'late' when revised then 'deleted' else 'missing' end as ref_state, strftime(t, '%Y-%m') as ym
  from marked where not present or born > t)
"""
ORACLE = {
    "p4_found": FOUND_SQL + "select * from found",
    "p4_report": FOUND_SQL + "select tab, fld, ref_state, ym, count(*) as refs, count(distinct ref_id) as ids from found group by all",
}
QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
