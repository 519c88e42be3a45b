"""Scans, sinks, filters, joins, aggregates, windows, top-k and set operations over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import text as X
from recallgrid.operators import edges as E
from recallgrid.plans import ctes as C
from recallgrid.plans.base import Registry, Tables

R = Registry()


def edges(t: Tables) -> DataFrame:
    return E.clean_edges(t("connections"))


# Scans and sinks -----------------------------------------------------------------------------------------------------


@R.add("select id, label, len(embedding)::bigint as dim from memories where len(embedding) > 0")
def src1_rows_with_embedding(t: Tables) -> DataFrame:
    return t("memories").where(F.size("embedding") > 0).select("id", "label", F.size("embedding").cast("long").alias("dim"))


@R.add("select m.id, m.label, m.salience from memories m where exists (select 1 from dream_insights d where d.source_memory_id = m.id)")
def src3_multi_get(t: Tables) -> DataFrame:
    keys = t("dream_insights").select(F.col("source_memory_id").alias("id"))
    return t("memories").select("id", "label", "salience").join(keys, "id", "left_semi")


@R.add("select id, content from memories where label = 'note'")
def src4_by_label(t: Tables) -> DataFrame:
    return t("memories").where(F.col("label") == "note").select("id", "content")


@R.add("select id, label from memories where id > 500 and embedding is not null order by id limit 100")
def src5_page_after_key(t: Tables) -> DataFrame:
    return t("memories").where((F.col("id") > 500) & F.col("embedding").isNotNull()).orderBy("id").limit(100).select("id", "label")


@R.add("""select id, length(content)::bigint as n from memories m where length(content) >= 500 and (label is null or label not like '%::afe::%')
  and not exists (select 1 from memory_revisions r where r.memory_id = m.id)""")
def src6_long_texts(t: Tables) -> DataFrame:
    label = F.col("label")
    long = t("memories").where((F.char_length("content") >= 500) & (label.isNull() | ~label.contains("::afe::")))
    return long.select("id", F.char_length("content").cast("long").alias("n")).join(t("memory_revisions").select(F.col("memory_id").alias("id")), "id", "left_anti")


@R.add("select source_id, target_id, weight from connections where weight >= 0.05 and not isnan(weight)")
def src7_edges_above_floor(t: Tables) -> DataFrame:
    return t("connections").where((F.col("weight") >= E.FLOOR) & ~F.isnan("weight")).select("source_id", "target_id", "weight")


@R.add("""select id, created_at from memories where embedding is not null and created_at is not null and (label is null or label not like 'derived:%')
  order by created_at desc, id limit 200""")
def src8_recency_pool(t: Tables) -> DataFrame:
    label = F.col("label")
    return t("memories").where(F.col("embedding").isNotNull() & F.col("created_at").isNotNull() & (label.isNull() | ~label.startswith("derived:"))).orderBy(F.desc("created_at"), "id").limit(200).select("id", "created_at")


@R.add("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def src9_json_fields(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@R.add("""select (select max(id) from memories) + row_number() over (order by doc_id) as id, 'doc:' || doc_id as label, text as content from documents where text is not null and trim(text) <> ''""")
def snk2_bulk_insert_ids(t: Tables) -> DataFrame:
    """Ids of inserted rows: dense, in key order, after the largest id; numbered without one window over all rows."""
    from recallgrid.operators.skew import global_order

    last = t("memories").agg(F.max("id")).first()[0] or 0
    new = t("documents").where(F.trim("text") != "").select("doc_id", "text")
    place = global_order(new.select("doc_id"), ["doc_id"])  # keys only: texts aren't ordered
    return new.join(place, "doc_id").select((F.col("pos") + 1 + last).alias("id"), F.concat(F.lit("doc:"), "doc_id").alias("label"), F.col("text").alias("content"))


@R.add("""with last as (select memory_id, new_content, row_number() over (partition by memory_id order by created_at desc nulls last, id desc) k from memory_revisions where new_content is not null)
  select m.id, coalesce(l.new_content, m.content) as content, l.memory_id is not null as updated from memories m left join last l on l.memory_id = m.id and l.k = 1""")
def snk5_update_contents(t: Tables) -> DataFrame:
    last = t("memory_revisions").where(F.col("new_content").isNotNull()).groupBy(F.col("memory_id").alias("id")).agg(F.max_by("new_content", F.struct(F.col("created_at").isNotNull(), "created_at", "id")).alias("new"))
    return t("memories").select("id", "content").join(last, "id", "left").select("id", F.coalesce("new", "content").alias("content"), F.col("new").isNotNull().alias("updated"))


@R.add("with " + C.UPSERTED + " select s, t, edge_type, weight, created_at, valid_from, valid_to from up")
def snk6_edge_upsert(t: Tables) -> DataFrame:
    return E.upsert(edges(t))


@R.add("with " + C.UPSERTED + """, nw as (select least(p.source_id, p.target_id) s, greatest(p.source_id, p.target_id) t, 0.5::double weight from connections p where p.source_id <> p.target_id)
  select s, t, 'similar' as edge_type, max(weight) as weight from nw where not exists (select 1 from up where up.s = nw.s and up.t = nw.t and up.edge_type = 'similar') group by s, t""")
def snk7_insert_if_absent(t: Tables) -> DataFrame:
    a, b = F.col("source_id"), F.col("target_id")
    new = t("connections").where(a != b).select(F.least(a, b).alias("s"), F.greatest(a, b).alias("t"), F.lit("similar").alias("edge_type"), F.lit(0.5).alias("weight"))
    return E.insert_absent(E.upsert(edges(t)), new).select("s", "t", "edge_type", "weight")


@R.add("select memory_id, new_content as value from (select *, row_number() over (partition by memory_id order by created_at desc nulls last, id desc) k from memory_revisions) where k = 1")
def snk8_latest_value(t: Tables) -> DataFrame:
    return t("memory_revisions").groupBy("memory_id").agg(F.max_by(F.struct("new_content"), F.struct(F.col("created_at").isNotNull(), "created_at", "id")).alias("v")).select("memory_id", F.col("v.new_content").alias("value"))


@R.add("select id, label, content, 'kept' as origin from memories union all select memory_id, null, max_by(coalesce(new_content, old_content), r.id), 'copied' from memory_revisions r where memory_id is not null and not exists (select 1 from memories m where m.id = r.memory_id) group by 1")
def snk10_copy_missing(t: Tables) -> DataFrame:
    """A copy that adds only rows whose id is missing in the target, each with what its latest revision says."""
    m = t("memories").select("id", "label", "content")
    r = t("memory_revisions").where(F.col("memory_id").isNotNull()).groupBy(F.col("memory_id").alias("id")).agg(F.max_by(F.coalesce("new_content", "old_content"), "id").alias("content"))
    added = r.join(m.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("label"), "content", F.lit("copied").alias("origin"))
    return m.withColumn("origin", F.lit("kept")).unionByName(added)


# Filters -------------------------------------------------------------------------------------------------------------


@R.add("select id, label from memories where label like 'session:%' and label like '%::afe::C%' and label not like '%0'")
def flt1_label_patterns(t: Tables) -> DataFrame:
    c = F.col("label")
    return t("memories").where(c.startswith("session:") & c.contains("::afe::C") & ~c.endswith("0")).select("id", "label")


@R.add("select id, label, coalesce(regexp_matches(label, '(^|:)u(:p[0-9]+)?$'), false) as echo, coalesce(regexp_matches(label, '(^|:)t(:p[0-9]+)?$'), false) or coalesce(label like 'derived:cluster%', false) as turn from memories")
def flt2_echo_labels(t: Tables) -> DataFrame:
    c = F.col("label")
    return t("memories").select("id", "label", X.is_echo(c).alias("echo"), (X.is_echo(c, "t") | F.coalesce(c.startswith("derived:cluster"), F.lit(False))).alias("turn"))


@R.add("""select id, source_id, target_id from connections where coalesce(valid_from, event_time, created_at, timestamp '1970-01-01 00:00:00') <= timestamp '2025-01-01 00:00:00'
  and (valid_to is null or valid_to >= timestamp '2025-01-01 00:00:00')""")
def flt4_edges_as_of(t: Tables) -> DataFrame:
    return t("connections").where(E.valid_at(F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))).select("id", "source_id", "target_id")


@R.add("select id, weight from connections where weight >= 0.3 and weight <= 0.95 and not isnan(weight)")
def flt5_weight_band(t: Tables) -> DataFrame:
    w = F.col("weight")
    return t("connections").where((w >= 0.3) & (w <= 0.95) & ~F.isnan(w)).select("id", "weight")


@R.add("select turn_id from turns where content is null or length(trim(content)) < 20 or " + " or ".join(f"contains(lower(content), '{p}')" for p in (*X.GARBAGE, "dream cycle")))
def flt6_garbage_texts(t: Tables) -> DataFrame:
    """Texts that say nothing; the names of a product's own tools are a parameter."""
    return t("turns").where(X.is_garbage(F.col("content"), ("dream cycle",))).select("turn_id")


@R.add("select turn_id from turns where content is not null and not regexp_matches(substr(lower(content), 1, 300), '" + "|".join(X.NON_ANSWERS).replace("'", "''") + "')")
def flt7_answers(t: Tables) -> DataFrame:
    return t("turns").where(F.col("content").isNotNull() & ~F.substring(F.lower("content"), 1, 300).rlike("|".join(X.NON_ANSWERS))).select("turn_id")


@R.add("""with r as (select id, weight, row_number() over (partition by source_id order by weight desc, id) k, count(*) over (partition by source_id) n from connections where source_id is not null and weight >= 0.2 and not isnan(weight))
  select id, weight from r where k <= greatest(1, round_even(n * 0.5, 0))""")
def flt9_score_percentile(t: Tables) -> DataFrame:
    """Per source the better half of its edges above a floor, at least one."""
    w = W.partitionBy("source_id")
    ok = t("connections").where(F.col("source_id").isNotNull() & (F.col("weight") >= 0.2) & ~F.isnan("weight"))
    ranked = ok.withColumn("k", F.row_number().over(w.orderBy(F.desc("weight"), "id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("k") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * 0.5, 0))).select("id", "weight")


@R.add(rf"""select turn_id, content from turns where content is not null and length(trim(content)) between 4 and 280
  and (lower(trim(content)) like 'user %' or lower(trim(content)) like 'the user %' or regexp_matches(content, '{X.NUMERIC_FACT}') or regexp_matches(content, '{X.PROPER_NAME}'))""")
def flt10_atomic_facts(t: Tables) -> DataFrame:
    return t("turns").where(X.atomic(F.col("content"))).select("turn_id", "content")


_CATEGORY = "case when label like 'peer:%' then 'Peer' when label like 'turn:%' or label like 'msg:%' then 'Conversation' when label like 'session:%' then 'Session' when label like 'doc:%' then 'Document' when label like 'skill:%' then 'Skill' else 'Other' end"


@R.add(f"select id, {_CATEGORY} as category from memories")
def flt11_category(t: Tables) -> DataFrame:
    return t("memories").select("id", X.label_category(F.col("label")).alias("category"))


_AGENT = "case " + " ".join(f"when {' or '.join(f'lower(label) like {chr(39)}{p}%{chr(39)}' for p in ps)} then '{n}'" for n, ps in X.AGENTS) + " when lower(label) like '%:u' then 'User' else 'Other' end"


@R.add(f"select id, {_AGENT} as agent from memories")
def flt12_agent(t: Tables) -> DataFrame:
    return t("memories").select("id", X.label_agent(F.col("label")).alias("agent"))


@R.add("""select bucket, count(*) as n from (select case when weight >= 0.8 then 'Strong (0.8-1.0)' when weight >= 0.6 then 'Med-Strong (0.6-0.8)' when weight >= 0.4 then 'Medium (0.4-0.6)'
  when weight >= 0.2 then 'Weak (0.2-0.4)' else 'Very Weak (0-0.2)' end as bucket from connections where weight is null or not isnan(weight)) group by bucket""")
def flt13_weight_buckets(t: Tables) -> DataFrame:
    w = F.col("weight")
    b = F.when(w >= 0.8, "Strong (0.8-1.0)").when(w >= 0.6, "Med-Strong (0.6-0.8)").when(w >= 0.4, "Medium (0.4-0.6)").when(w >= 0.2, "Weak (0.2-0.4)").otherwise("Very Weak (0-0.2)")
    return t("connections").where(w.isNull() | ~F.isnan(w)).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""select bucket, count(*) as n from (select case when weight < 0.05 then 'dead (<0.05)' when weight < 0.1 then 'weak (0.05-0.1)' when weight < 0.3 then 'low (0.1-0.3)' when weight < 0.5 then 'medium (0.3-0.5)'
  when weight < 0.7 then 'strong (0.5-0.7)' else 'very_strong (0.7+)' end as bucket from connections where weight >= 0 and not isnan(weight)) group by bucket""")
def flt13_maintenance_buckets(t: Tables) -> DataFrame:
    w = F.col("weight")
    b = F.when(w < 0.05, "dead (<0.05)").when(w < 0.1, "weak (0.05-0.1)").when(w < 0.3, "low (0.1-0.3)").when(w < 0.5, "medium (0.3-0.5)").when(w < 0.7, "strong (0.5-0.7)").otherwise("very_strong (0.7+)")
    return t("connections").where((w >= 0) & ~F.isnan(w)).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# Joins ---------------------------------------------------------------------------------------------------------------


@R.add("with " + C.SYMMETRIC + " select src, dst, edge_type, max(weight) as weight, m.label from sy join memories m on m.id = sy.dst group by all")
def jn1_neighbour_rows(t: Tables) -> DataFrame:
    rows = E.symmetric(edges(t)).groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"))
    return rows.join(t("memories").select(F.col("id").alias("dst"), "label"), "dst").select("src", "dst", "edge_type", "weight", "label")


@R.add("""select m.id, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) as total_degree, round(coalesce(o.w, 0), 6) as avg_weight from memories m
  left join (select source_id, count(*) n, avg(case when not isnan(weight) then weight end) w from connections group by 1) o on o.source_id = m.id
  left join (select target_id, count(*) n from connections group by 1) i on i.target_id = m.id""")
def jn2_degree_table(t: Tables) -> DataFrame:
    c = t("connections")
    out = c.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("o"), F.avg(F.when(~F.isnan("weight"), F.col("weight"))).alias("w"))
    into = c.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return t("memories").select("id").join(out, "id", "left").join(into, "id", "left").select("id", zero(F.col("o")).alias("out_degree"), zero(F.col("i")).alias("in_degree"), (zero(F.col("o")) + zero(F.col("i"))).alias("total_degree"), F.round(F.coalesce("w", F.lit(0.0)), 6).alias("avg_weight"))


@R.add("with " + C.SYMMETRIC + " select sy.src as anchor, m.id, m.label, max(weight) as weight from sy join memories m on m.id = sy.dst where m.label like '%::afe::%' group by all")
def jn3_labelled_neighbours(t: Tables) -> DataFrame:
    """Edges that touch an anchor from either side, by an equi-join on the symmetric view."""
    facts = t("memories").where(F.col("label").contains("::afe::")).select(F.col("id").alias("dst"), "label")
    return E.symmetric(edges(t)).join(facts, "dst").groupBy(F.col("src").alias("anchor"), F.col("dst").alias("id"), "label").agg(F.max("weight").alias("weight"))


@R.add("""select c.id from connections c where c.source_id is not null and c.target_id is not null and (not exists (select 1 from memories m where m.id = c.source_id) or not exists (select 1 from memories m where m.id = c.target_id))""")
def jn4_orphan_edges(t: Tables) -> DataFrame:
    ids = t("memories").select("id")
    c = t("connections").where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).select(F.col("id").alias("edge"), "source_id", "target_id")
    a = c.join(ids, c.source_id == ids.id, "left_anti").select("edge")
    b = c.join(ids, c.target_id == ids.id, "left_anti").select("edge")
    return a.union(b).distinct().select(F.col("edge").alias("id"))


@R.add("select i.id from dream_insights i where i.session_id in (select id from dream_sessions where finished_at is not null and finished_at < timestamp '2025-06-01 00:00:00')")
def jn5_insights_of_old_sessions(t: Tables) -> DataFrame:
    old = t("dream_sessions").where(F.col("finished_at") < F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")).select(F.col("id").alias("session_id"))
    return t("dream_insights").join(old, "session_id", "left_semi").select("id")


@R.add("with " + C.BOTH + " select m.id, coalesce(d.n, 0) as degree from memories m left join (select src, count(*) n from bw group by 1) d on d.src = m.id where coalesce(d.n, 0) < 3")
def jn6_isolated_rows(t: Tables) -> DataFrame:
    deg = E.both_ways(E.pair_weights(edges(t))).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return t("memories").select("id").join(deg, "id", "left").select("id", n.alias("degree")).where(F.col("degree") < 3)


@R.add("select least(source_id, target_id) as lo, greatest(source_id, target_id) as hi, count(*) as n, max(weight) as weight from connections where source_id is not null and target_id is not null and not isnan(weight) group by 1, 2 having count(*) > 1")
def jn7_reversed_duplicates(t: Tables) -> DataFrame:
    a, b = F.col("source_id"), F.col("target_id")
    ok = t("connections").where(a.isNotNull() & b.isNotNull() & F.col("weight").isNotNull() & ~F.isnan("weight"))
    return ok.groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")).where(F.col("n") > 1)


# Aggregates ----------------------------------------------------------------------------------------------------------


@R.add("select (select count(*) from memories) as memories, (select count(*) from connections) as connections, (select count(*) from memory_revisions) as revisions, (select max(id) from memories) as last_id")
def ag1_totals(t: Tables) -> DataFrame:
    n = lambda name, what: t(name).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).select(F.lit(what).alias("what"), "n", "m")
    rows = n("memories", "memories").unionByName(n("connections", "connections")).unionByName(n("memory_revisions", "revisions"))
    pick = lambda what, col: F.max(F.when(F.col("what") == what, F.col(col)))
    return rows.agg(pick("memories", "n").alias("memories"), pick("connections", "n").alias("connections"), pick("revisions", "n").alias("revisions"), pick("memories", "m").alias("last_id"))


@R.add("""select count(*) as sessions, coalesce(sum(memories_processed), 0)::bigint as processed, coalesce(sum(connections_strengthened), 0)::bigint as strengthened, coalesce(sum(connections_pruned), 0)::bigint as pruned,
  coalesce(sum(bridges_found), 0)::bigint as bridges, coalesce(sum(insights_created), 0)::bigint as insights from dream_sessions""")
def ag3_cycle_totals(t: Tables) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return t("dream_sessions").agg(F.count(F.lit(1)).alias("sessions"), s("memories_processed").alias("processed"), s("connections_strengthened").alias("strengthened"), s("connections_pruned").alias("pruned"), s("bridges_found").alias("bridges"), s("insights_created").alias("insights"))


@R.add("select insight_type, count(*) as n, count(distinct source_memory_id) as sources from dream_insights group by 1")
def ag3_insight_types(t: Tables) -> DataFrame:
    return t("dream_insights").groupBy("insight_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_memory_id").alias("sources"))


@R.add("select source_id, count(*) as n, round(avg(weight), 6) as avg_weight from connections where not isnan(weight) and source_id is not null group by 1")
def ag4_per_source(t: Tables) -> DataFrame:
    return t("connections").where(F.col("source_id").isNotNull() & F.col("weight").isNotNull() & ~F.isnan("weight")).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 6).alias("avg_weight"))


@R.add(f"select category, count(*) as n from (select {_CATEGORY} as category from memories) group by 1")
def ag5_category_counts(t: Tables) -> DataFrame:
    return t("memories").groupBy(X.label_category(F.col("label")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@R.add("select count(*) as keys, sum(n - 1)::bigint as surplus from (select source_id, target_id, edge_type, count(*) n from connections group by all having count(*) > 1)")
def ag6_duplicate_surplus(t: Tables) -> DataFrame:
    return t("connections").groupBy("source_id", "target_id", "edge_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("surplus"))


@R.add("with " + C.EDGES + " select s, t, edge_type, min(id) as id, max(weight) as weight, min(created_at) as created_at from ce group by all")
def ag7_dedupe_rollup(t: Tables) -> DataFrame:
    return edges(t).groupBy("s", "t", "edge_type").agg(F.min("id").alias("id"), F.max("weight").alias("weight"), F.min("created_at").alias("created_at"))


@R.add("select lower(trim(reason)) as reason, count(*) as n, min(created_at) as first_at, max(created_at) as last_at from memory_revisions group by 1")
def ag8_history_by_reason(t: Tables) -> DataFrame:
    return t("memory_revisions").groupBy(F.lower(F.trim("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@R.add("select source_id, count(*) as n from connections where source_id is not null group by 1 order by n desc, source_id limit 5")
def ag8_top_hubs(t: Tables) -> DataFrame:
    return t("connections").where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_id").limit(5)


@R.add("select distinct source_memory_id as anchor from dream_insights where source_memory_id is not null and created_at >= timestamp '2025-01-01 00:00:00'")
def ag9_recent_anchors(t: Tables) -> DataFrame:
    return t("dream_insights").where(F.col("source_memory_id").isNotNull() & (F.col("created_at") >= F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))).select(F.col("source_memory_id").alias("anchor")).distinct()


@R.add("""with x as (select distinct user_id, date_trunc('day', ts) d, event_type from events)
  select a.event_type as a, b.event_type as b, count(*) as n from x a join x b on a.user_id = b.user_id and a.d = b.d and a.event_type < b.event_type group by 1, 2 having count(*) >= 3""")
def ag11_co_occurrence(t: Tables) -> DataFrame:
    """Pairs of things in one access: an access is a user's day, a thing an event type."""
    sets = t("events").groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.sort_array(F.collect_set("event_type")).alias("s"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3)


@R.add("""with x as (select label, i, avg(v) m from (select label, unnest(embedding)::double v, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2), n as (select label, sqrt(sum(m * m)) l from x group by 1)
  select x.label, (i - 1)::bigint as dim, round(m / l, 6) as value from x join n using (label)""")
def ag12_centroids(t: Tables) -> DataFrame:
    """Unit centroid of each group of vectors, long form."""
    x = t("embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    n = x.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("l"))
    return x.join(n, "label").select("label", F.col("dim").cast("long").alias("dim"), F.round(F.col("m") / F.col("l"), 6).alias("value"))


@R.add("with " + C.BOTH + ", d as (select src, count(*) n from bw group by 1) select src as id, n as degree, round(n / (select max(n) from d)::double, 6) as centrality from d")
def ag15_degree_centrality(t: Tables) -> DataFrame:
    d = E.both_ways(E.pair_weights(edges(t))).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    most = d.agg(F.max("degree")).first()[0] or 1
    return d.withColumn("centrality", F.round(F.col("degree") / F.lit(float(most)), 6))


@R.add("with " + C.BOTH + """, d as (select src, count(*) n from bw group by 1) select (select count(*) from d) as nodes, (select count(*) from pw) as edges,
  round((select count(*) from pw) * 2.0 / ((select count(*) from d) * ((select count(*) from d) - 1)), 9) as density, round((select avg(n) from d), 6) as avg_degree, (select max(n) from d) as max_degree""")
def ag16_graph_stats(t: Tables) -> DataFrame:
    d = E.both_ways(E.pair_weights(edges(t))).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    e = F.sum("n") / 2
    return d.agg(F.count(F.lit(1)).alias("nodes"), e.cast("long").alias("edges"), F.round(e * 2 / (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)), 9).alias("density"), F.round(F.avg("n"), 6).alias("avg_degree"), F.max("n").alias("max_degree"))


@R.add("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events where value is not null group by 1")
def ag17_percentiles(t: Tables) -> DataFrame:
    return t("events").where(F.col("value").isNotNull()).groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@R.add("with p as (select event_type, count(*)::double / (select count(*) from events) q from events group by 1) select round(-sum(q * log2(q)), 6) as entropy, count(*) as kinds from p")
def ag19_entropy(t: Tables) -> DataFrame:
    c = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).first()[0] or 1
    q = F.col("n") / F.lit(float(total))
    return c.agg(F.round(-F.sum(q * F.log2(q)), 6).alias("entropy"), F.count(F.lit(1)).alias("kinds"))


@R.add("with " + C.EDGES + " select id, round(weight / max(weight) over (partition by edge_type), 6) as share from ce where weight > 0")
def ag21_share_of_max(t: Tables) -> DataFrame:
    e = edges(t).where(F.col("weight") > 0)
    top = F.broadcast(e.groupBy("edge_type").agg(F.max("weight").alias("top")))  # one row per type
    return e.join(top, "edge_type").select("id", F.round(F.col("weight") / F.col("top"), 6).alias("share"))


# Windows, top-k, sets ------------------------------------------------------------------------------------------------


@R.add("with " + C.SYMMETRIC + ", u as (select src, dst, max(weight) w from sy group by 1, 2) select src as id, dst, w as weight, k as rank from (select *, row_number() over (partition by src order by w desc, dst) k from u) where k <= 3")
def wn4_top_edges(t: Tables) -> DataFrame:
    u = E.symmetric(edges(t)).groupBy(F.col("src").alias("id"), "dst").agg(F.max("weight").alias("weight"))
    return u.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("weight"), "dst")).cast("long")).where(F.col("rank") <= 3)


@R.add("""select turn_id as a, nxt as b, conv_id from (select turn_id, conv_id, lead(turn_id) over (partition by conv_id order by seq, turn_id) nxt from turns where conv_id is not null and seq is not null) where nxt is not null""")
def wn5_before_chains(t: Tables) -> DataFrame:
    ok = t("turns").where(F.col("conv_id").isNotNull() & F.col("seq").isNotNull())
    return ok.select(F.col("turn_id").alias("a"), F.lead("turn_id").over(W.partitionBy("conv_id").orderBy("seq", "turn_id")).alias("b"), "conv_id").where(F.col("b").isNotNull())


@R.add("""select event_id, user_id, coalesce(w, []) as before from (select event_id, user_id, list(event_type) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 preceding) w from events)""")
def wn6_sequence_windows(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    return t("events").select("event_id", "user_id", F.collect_list("event_type").over(w).alias("before"))


@R.add("""select id, salience, last_accessed from memories where salience is not null order by salience, last_accessed nulls first, id limit 50""")
def tk9_least_salient(t: Tables) -> DataFrame:
    return t("memories").where(F.col("salience").isNotNull()).orderBy("salience", F.asc_nulls_first("last_accessed"), "id").limit(50).select("id", "salience", "last_accessed")


@R.add("select id, access_count from memories order by access_count desc nulls last, created_at nulls last, id limit 64")
def tk10_most_used(t: Tables) -> DataFrame:
    return t("memories").orderBy(F.desc_nulls_last("access_count"), F.asc_nulls_last("created_at"), "id").limit(64).select("id", "access_count")


@R.add("select id, label from memories order by md5(concat(id, ':', 42)), id limit 100")
def tk8_seeded_sample(t: Tables) -> DataFrame:
    return t("memories").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), "id").limit(100).select("id", "label")


@R.add("with " + C.UPSERTED + " select s, t, edge_type, weight from up order by weight desc, s, t, edge_type limit 500")
def tk7_heaviest_edges(t: Tables) -> DataFrame:
    return E.upsert(edges(t)).orderBy(F.desc("weight"), "s", "t", "edge_type").limit(500).select("s", "t", "edge_type", "weight")


@R.add("""with s as (select id, 1 slice, row_number() over (order by created_at desc nulls last, id) pos from memories union all select id, 2, row_number() over (order by md5(concat(id, ':', 42)), id) from memories
  union all select id, 3, row_number() over (order by salience nulls last, last_accessed nulls first, id) from memories),
  c as (select * from s where (slice = 1 and pos <= 1000) or (slice = 2 and pos <= 600) or (slice = 3 and pos <= 400)),
  f as (select id, min(slice * 1000000 + pos) o from c group by id) select id, (o // 1000000)::bigint as slice from f order by o limit 2000""")
def st1_union_of_slices(t: Tables) -> DataFrame:
    """The sample of a cycle: recent, random and least salient rows; of a row in several slices the earliest slice counts."""
    m = t("memories")

    def take(slice_no: int, n: int, *order) -> DataFrame:
        top = m.orderBy(*order).limit(n).select("id", "created_at", "salience", "last_accessed")
        return top.select("id", F.row_number().over(W.orderBy(*order)).alias("pos"), F.lit(slice_no).alias("slice"))  # at most n rows

    recent = take(1, 1000, F.desc_nulls_last("created_at"), F.asc("id"))
    some = take(2, 600, F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), F.asc("id"))
    low = take(3, 400, F.asc_nulls_last("salience"), F.asc_nulls_first("last_accessed"), F.asc("id"))
    first = recent.unionByName(some).unionByName(low).groupBy("id").agg(F.min(F.col("slice") * 1000000 + F.col("pos")).alias("o"))
    return first.orderBy("o").limit(2000).select("id", F.floor(F.col("o") / 1000000).alias("slice"))


@R.add("select distinct memory_id as id from memory_revisions where memory_id not in (select id from memories)")
def st5_set_difference(t: Tables) -> DataFrame:
    known = t("memory_revisions").select(F.col("memory_id").alias("id")).where(F.col("id").isNotNull())
    return known.distinct().join(t("memories").select("id"), "id", "left_anti")
