"""The rest of the inventory: neighbour-smoothed channel, canonical prior, evictions, sequential clusters, audit rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import scoring as S
from recallgrid.functions import text as X
from recallgrid.functions import vectors as V
from recallgrid.operators import dream as D
from recallgrid.operators import edges as E
from recallgrid.operators import graph as G
from recallgrid.operators import search
from recallgrid.operators.skew import shared_checkpoint
from recallgrid.plans import ctes as C
from recallgrid.plans.base import Registry, Tables
from recallgrid.plans.graph_dream import ACTIVE, SMOOTHED, active_pairs, graph, hub, start
from recallgrid.plans.retrieval import _ALL, _CHANNELS, channels, rerank, semantic
from recallgrid.plans.vectors_text import DIM, asking, now, vecs

R = Registry()
REC = lambda body: "with recursive " + body
_SEM = C.VECTORS + ", sp as (select a.id query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) score from vec a join vec b on a.id <> b.id where a.id % 100 = 0), sem as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from sp) where rank <= 50)"


@R.add("select id, label, content from memories union all select (select max(id) from memories) + 1, 'note', 'A new row.'")
def snk1_insert_one(t: Tables) -> DataFrame:
    m = t("memories").select("id", "label", "content")
    last = m.agg(F.max("id")).first()[0] or 0
    return m.unionByName(t.spark.createDataFrame([(last + 1, "note", "A new row.")], m.schema))


@R.add("with last as (select *, row_number() over (partition by memory_id order by created_at desc nulls last, id desc) k from memory_revisions where memory_id is not null) select memory_id, id as version, reason from last where k = 1")
def snk9_replace_by_key(t: Tables) -> DataFrame:
    """A keyed side table after all its writes: the latest row of each key."""
    r = t("memory_revisions").where(F.col("memory_id").isNotNull())
    return r.groupBy("memory_id").agg(F.max_by(F.struct("id", "reason"), F.struct(F.col("created_at").isNotNull(), "created_at", "id")).alias("r")).select("memory_id", F.col("r.id").alias("version"), "r.reason")


@R.add("select max(id) as last_memory, count(*) as n from memories")
def ag2_high_water(t: Tables) -> DataFrame:
    return t("memories").agg(F.max("id").alias("last_memory"), F.count(F.lit(1)).alias("n"))


@R.add("with " + _SEM + " select query_id, id, round(1.0 / rank, 9) as score, round(1.0 / (60 + rank), 9) as fused, round(1.0 / (59 + rank), 9) as fused0 from sem")
def wn2_rank_scores(t: Tables) -> DataFrame:
    """The three ways in which a rank becomes a score."""
    r = F.col("rank")
    return semantic(t).select("query_id", "id", F.round(1.0 / r, 9).alias("score"), F.round(S.rrf(r), 9).alias("fused"), F.round(S.rrf(r, first=0), 9).alias("fused0"))


@R.add("with " + _SEM + " select query_id, min(case when score >= 0.8 then rank end) as first_hit from sem group by 1")
def wn8_first_hit(t: Tables) -> DataFrame:
    return semantic(t).groupBy("query_id").agg(F.min(F.when(F.col("score") >= 0.8, F.col("rank"))).alias("first_hit"))


@R.add("select d.id, m.label from dream_insights d join memories m on m.id = d.source_memory_id")
def jn12_lookup(t: Tables) -> DataFrame:
    """Rows with the label that their key stands for; hot keys are looked up by broadcast, the rest by shuffle."""
    from recallgrid.operators.skew import lookup_join

    d = t("dream_insights").where(F.col("source_memory_id").isNotNull()).select("id", F.col("source_memory_id").alias("key"))
    m = t("memories").select(F.col("id").alias("key"), "label", F.lit(True).alias("there"))
    return lookup_join(d, m, "key").where("there").select("id", "label")


@R.add("with k as (select *, row_number() over (partition by coalesce(split_part(label, ':', 1), '') order by salience desc nulls last, id) k from memories) select id from k where k > 100")
def vx8_evicted(t: Tables) -> DataFrame:
    """Rows beyond the hundred most salient of their kind."""
    kind = F.coalesce(F.element_at(F.split("label", ":"), 1), F.lit(""))
    w = W.partitionBy(kind).orderBy(F.desc_nulls_last("salience"), "id")
    return t("memories").withColumn("k", F.row_number().over(w)).where(F.col("k") > 100).select("id")


@R.add("select item_id, array_to_string(list_filter(regexp_extract_all(lower(item_text), '[a-z0-9_][a-z0-9_/\\-]+')[1:24], lambda t: length(regexp_replace(t, '[^a-z0-9]', '', 'g')) >= 2 and t not in ('" + "','".join(X.STOPWORDS) + "'))[1:12], ' ') as query from eval_items where item_text is not null")
def tx20_keyword_queries(t: Tables) -> DataFrame:
    return t("eval_items").where(F.col("item_text").isNotNull()).select("item_id", F.array_join(X.query_tokens(F.col("item_text")), " ").alias("query"))


@R.add("select id, length(content) >= 500 and content is not null as takes_part, case when content is null then 'none' when length(content) >= 500 then 'structure' else 'short' end as stage from memories")
def tx18_extraction_stage(t: Tables) -> DataFrame:
    n = F.char_length("content")
    return t("memories").select("id", F.coalesce(n >= 500, F.lit(False)).alias("takes_part"), F.when(n.isNull(), "none").when(n >= 500, "structure").otherwise("short").alias("stage"))


@R.add(SMOOTHED + """, sv as (select mx.id, list(mx.m / ln.l order by mx.i)::double[] e from mx join ln using (id) group by 1 union all select id, e from vec where id not in (select id from ws)),
  sp as (select a.id query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) sim from vec a join sv b on a.id <> b.id where a.id % 100 = 0), rk as (select *, row_number() over (partition by query_id order by sim desc, id) rank from sp where sim >= 0)
  select query_id, id, rank, round(1.0 / (60 + rank), 9) as gain from rk where rank <= 50""")
def rt8_smoothed_channel(t: Tables) -> DataFrame:
    """The contribution of neighbourhood-smoothed vectors: each query's nearest rows among them, as reciprocal ranks."""
    rows = vecs(t).select("id", V.doubles(F.col("vec")).alias("vec"))
    smooth = D.smoothed(rows, graph(t))
    hits = search.top_k(asking(t), smooth, 50, DIM, least=0.0)
    return hits.select("query_id", "id", "rank", F.round(S.rrf(F.col("rank")), 9).alias("gain"))


@R.add("with " + _SEM + """, ca as (select s.query_id, s.id, s.score from (select *, row_number() over (partition by query_id order by score desc, id) k from sem where score >= 0.55) s where k <= 10), sz as (select source_memory_id id, count(*) n from dream_insights where source_memory_id is not null group by 1)
  select query_id, coalesce(split_part(m.label, ':', 2), '') as sid, round(max(score * ln(1 + coalesce(sz.n, 0))), 6) as prior from ca join memories m on m.id = ca.id left join sz on sz.id = ca.id group by 1, 2""")
def rt15_canonical_prior(t: Tables) -> DataFrame:
    """Prior of sessions: the best of similarity times log evidence among a query's ten nearest rows of 0.55 and more."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = semantic(t).where(F.col("score") >= 0.55).withColumn("k", F.row_number().over(w)).where(F.col("k") <= 10)
    size = t("dream_insights").where(F.col("source_memory_id").isNotNull()).groupBy(F.col("source_memory_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    m = t("memories").select("id", F.coalesce(F.get(F.split("label", ":"), F.lit(1)), F.lit("")).alias("sid"))
    x = near.join(m, "id").join(size, "id", "left")
    return x.groupBy("query_id", "sid").agg(F.round(F.max(F.col("score") * F.log1p(F.coalesce("n", F.lit(0)).cast("double"))), 6).alias("prior"))


@R.add("with " + _SEM + " select query_id, id, round(0.35 * score / max(score) over (partition by query_id) + 0.65 / (1 + exp(-(case when contains(lower(coalesce(m.content, '')), 'cache') then 1.0 else -1.0 end))), 6) as score from sem join memories m using (id) where rank <= 12")
def rt6_rerank_blend(t: Tables) -> DataFrame:
    """The head of the hits blended with the score of a reranker; here a word test is what is plugged in."""
    head = semantic(t).join(t("memories").select("id", "content"), "id")
    model = F.when(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit("cache")), 1.0).otherwise(-1.0)
    return rerank(head, model, 12).select("query_id", "id", F.round("score", 6).alias("score"))


_MODES = {"semantic": {"semantic": 1.0}, "hybrid": {n: w for n, _, w in _CHANNELS}, "lean": {n: w for n, _, w in _CHANNELS if n not in ("bm25", "temporal")}, "trim": {n: w for n, _, w in _CHANNELS}}


@R.add(_ALL + ", a as (" + " union all ".join(f"select '{m}' as mode, query_id, id, {ws[n]} / (60 + rank) p from {c}" for m, ws in _MODES.items() for n, c, _ in _CHANNELS if n in ws) + """),
  g as (select mode, query_id, id, round(sum(p), 9) f from a group by 1, 2, 3), k as (select *, row_number() over (partition by mode, query_id order by f desc, id) k from g) select mode, query_id, id, k as rank from k where k <= 5""")
def rt4_modes(t: Tables) -> DataFrame:
    """The fused top five under each retrieval mode's channel weights."""
    gain = lambda ws: F.sum(F.coalesce(*[F.when(F.col("channel") == n, S.rrf(F.col("rank"), F.lit(w))) for n, w in ws.items()]))
    # by query only: the sums and the ranks need no further shuffle
    x = channels(t).select("query_id", "id", "channel", "rank").repartition("query_id")
    x = x.groupBy("query_id", "id").agg(*[F.round(gain(ws), 9).alias(m) for m, ws in _MODES.items()])
    x = x.select("query_id", "id", F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("f")) for m in _MODES]))).where(F.col("f").isNotNull())
    w = W.partitionBy("mode", "query_id").orderBy(F.desc("f"), "id")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= 5).select("mode", "query_id", "id", "rank")


_HUB = C.BOTH + ", hub as (select src id from bw group by 1 order by count(*) desc, src limit 1)"


_THINK = "with " + _HUB + "".join(f""", p{d} as (select b.dst id, max(l.act * b.w * 0.85) act from {f"l{d - 1}" if d > 1 else "(select id, 1.0 act from hub)"} l join bw b on b.src = l.id where l.act * b.w * 0.85 >= 0.01 group by 1),
  l{d} as (select * from p{d} where id not in (select id from hub) {"".join(f"and id not in (select id from l{k})" for k in range(1, d))})""" for d in (1, 2, 3))


@R.add(_THINK + ", x as (select id, round(max(act), 6) act from (select * from p1 union all select * from p2 union all select * from p3) where id not in (select id from hub) group by 1) select id, act as activation from x order by act desc, id limit 20")
def gr3_think(t: Tables) -> DataFrame:
    """The twenty most activated nodes within three steps of the hub; a node spreads once, when it is first reached."""
    g = shared_checkpoint(graph(t))
    return G.think(g, hub(t, g)).select("id", F.round("act", 6).alias("activation")).orderBy(F.desc("activation"), "id").limit(20)


@R.add(REC(_HUB + """, st as (select src, dst, w / sum(w) over (partition by src) p from bw where src in (select src from bw group by 1 having sum(w) > 0)),
  r(i, id, x) as (select 0, id, 1.0::double from hub union all select i + 1, id, sum(x) from (select r.i i, st.dst id, r.x * st.p * 0.85 x from r join st on st.src = r.id where r.i < 10 union all select z.i, hub.id, 0.15 from (select distinct i from r) z, hub where z.i < 10) group by 1, 2)
  select id, round(x / (select max(x) from r where i = 10), 6) as score from r where i = 10 and id not in (select id from hub) order by 2 desc, 1 limit 20"""))
def gr6_pagerank_top(t: Tables) -> DataFrame:
    """The twenty best nodes by PageRank from the hub, the hub left out."""
    g = shared_checkpoint(graph(t))
    h = hub(t, g)
    return G.pagerank(g, h.withColumn("share", F.lit(1.0)), rounds=10).join(h, "id", "left_anti").select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@R.add("with recursive " + C.UPSERTED + ACTIVE + " select case when weight < 1 then 'strengthened' else 'full' end as reason, count(*) as edges, round(sum(least(1.0, weight + 0.05) - weight), 6) as gained from up join ac using (s, t) group by 1")
def dr16_audit(t: Tables) -> DataFrame:
    """What a strengthening would write to the audit log, by reason."""
    e = start(t).edges.join(active_pairs(t), ["s", "t"], "left_semi")
    w = F.col("weight")
    return e.groupBy(F.when(w < 1, "strengthened").otherwise("full").alias("reason")).agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum(F.least(F.lit(1.0), w + 0.05) - w), 6).alias("gained"))


@R.add()
def dr18_online_clusters(t: Tables) -> DataFrame:
    """Clusters that form in order of arrival: the first rows of a group start their own, later ones join the nearest.

    Order matters, so a group is one sequence; the groups (labels of the vectors) are independent tasks.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.array(pdf["embedding"].tolist(), dtype=float)
        x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
        k = min(16, len(x))
        sums, label = x[:k].copy(), list(range(k))
        for v in x[k:]:
            c = int(np.argmax(np.round(sums @ v / np.sqrt((sums * sums).sum(1)), 9)))
            label.append(c)
            sums[c] += v
        return pd.DataFrame({"label": pdf["label"], "vec_id": pdf["vec_id"], "cluster": np.array(label, dtype=np.int64)})

    return t("embeddings").select("label", "vec_id", "embedding").groupBy("label").applyInPandas(one, "label int, vec_id long, cluster long")


@R.add("with " + C.EDGES + " select date_trunc('month', ingestion_time) as ym, edge_type, count(*) as n, sum(case when event_time < ingestion_time - interval 1 day then 1 else 0 end)::bigint as late from ce group by 1, 2")
def sm_late_rows_by_month(t: Tables) -> DataFrame:
    """How many edges arrive more than a day after their event."""
    late = F.col("event_time") < F.col("ingestion_time") - F.expr("interval 1 day")
    return E.clean_edges(t("connections")).groupBy(F.date_trunc("month", "ingestion_time").cast("timestamp_ntz").alias("ym"), "edge_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(late, F.lit(False)).cast("long")).alias("late"))


@R.add(f"select id, round(exp(-ln(2) * greatest(0.0, coalesce(epoch_us({C.NOW}) - epoch_us(created_at), 0) / 1e6) / 3600 / 168) * coalesce(salience, 1), 6) as weight from memories where label is not null")
def rt5_time_weighted_salience(t: Tables) -> DataFrame:
    return t("memories").where(F.col("label").isNotNull()).select("id", F.round(S.temporal_score(now(), F.col("created_at")) * F.coalesce("salience", F.lit(1.0)), 6).alias("weight"))
