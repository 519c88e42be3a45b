"""Common table expressions of the SQL oracles."""

TYPE = """case when replace(replace(lower(regexp_replace(edge_type, '^\\s+|\\s+$', '', 'g')), '-', '_'), ' ', '_')
  in ('similar','causal','supersedes','bridge','derived_from','supports','synthesis_of','before')
  then replace(replace(lower(regexp_replace(edge_type, '^\\s+|\\s+$', '', 'g')), '-', '_'), ' ', '_') else 'similar' end"""
EDGES = f"""ce0 as (select *, {TYPE} ty from connections where source_id is not null and target_id is not null and source_id <> target_id and weight is not null and not isnan(weight)),
ce as (select id, case when ty = 'supersedes' then source_id else least(source_id, target_id) end s, case when ty = 'supersedes' then target_id else greatest(source_id, target_id) end t,
  greatest(0.0, least(1.0, weight)) weight, ty edge_type, created_at, event_time, ingestion_time, valid_from, valid_to from ce0)"""
UPSERTED = EDGES + """, up as (select s, t, edge_type, max(weight) weight, max(created_at) created_at, max(valid_from) valid_from, max(valid_to) valid_to from ce group by all)"""
PAIRS = EDGES + """, pw as (select least(s, t) a, greatest(s, t) b, max(weight) w from ce group by all)"""
BOTH = PAIRS + """, bw as (select a src, b dst, w from pw union all select b, a, w from pw)"""
SYMMETRIC = EDGES + """, sy as (select s src, t dst, weight, edge_type from ce union all select t, s, weight, edge_type from ce)"""
VECTORS = """vec as (select id, embedding::double[] e from memories where len(embedding) = 64 and list_dot_product(embedding::double[], embedding::double[]) > 0)"""
NOW = "timestamp '2025-12-31 00:00:00'"


def walk(seeds: str) -> str:
    """st, wr and wk (seed, id, s, rank): the twenty best nodes of the walks of each id of ``seeds``; needs bw and a recursive with."""
    return f""", st as (select src, dst, w / sum(w) over (partition by src) p from bw where src in (select src from bw group by 1 having sum(w) > 0)),
  wr(i, seed, id, x) as (select 0, id, id, 1.0::double from {seeds} union all select i + 1, seed, id, sum(y) from (select wr.i i, wr.seed, st.dst id, wr.x * st.p * 0.85 y from wr join st on st.src = wr.id where wr.i < 3) where y >= 0.001 group by 1, 2, 3),
  ws as (select seed, id, round(sum(x) * 0.15, 9) s from wr where i > 0 and id <> seed group by 1, 2), wk as (select * from (select *, row_number() over (partition by seed order by s desc, id) rank from ws) where rank <= 20)"""


#: The sample of a consolidation cycle: sp (id).
SAMPLE = """sl as (select id, 1 slice, row_number() over (order by created_at desc nulls last, id) pos from memories union all select id, 2, row_number() over (order by md5(concat(id, ':', 42)), id) from memories
  union all select id, 3, row_number() over (order by salience nulls last, last_accessed nulls first, id) from memories),
  so as (select id, min(slice * 1000000 + pos) o from sl where (slice = 1 and pos <= 1000) or (slice = 2 and pos <= 600) or (slice = 3 and pos <= 400) group by id), sp as (select id from so order by o limit 2000)"""
