"""More of the inventory: importers, approximate search, further scores, samples, derived rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import scoring as S
from recallgrid.functions import text as X
from recallgrid.functions import vectors as V
from recallgrid.operators import edges as E
from recallgrid.operators import graph as G
from recallgrid.operators import lsh, search
from recallgrid.operators import sequential as Q
from recallgrid.operators.components import connected_components
from recallgrid.operators.skew import shared_checkpoint
from recallgrid.plans import ctes as C
from recallgrid.plans.base import Registry, Tables
from recallgrid.plans.graph_dream import FACTS_SQL, fact_notes, graph, hub, pairs
from recallgrid.plans.retrieval import semantic
from recallgrid.plans.vectors_text import DIM, asking, now, vecs
from recallgrid.sources import importers as I  # noqa: E741

R = Registry()
REC = lambda body: "with recursive " + body
_SEM = C.VECTORS + ", sp as (select a.id query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) score from vec a join vec b on a.id <> b.id where a.id % 100 = 0), sem as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from sp) where rank <= 50)"


@R.add("select conv_id, seq, role, content, turn_id from turns where conv_id is not null")
def src11_nested_conversations(t: Tables) -> DataFrame:
    """Conversations as nested JSON, read back as rows; messages are nested in groups of at most 64 seqs."""
    m = t("turns").where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("seq", "role", "content", "turn_id").alias("m"), F.floor(F.coalesce("seq", F.lit(0)) / 64).alias("part"))
    nested = m.groupBy("conv_id", "part").agg(F.collect_list("m").alias("messages")).select(F.to_json(F.struct("conv_id", "messages")).alias("json"))
    return I.conversation_rows(nested)


@R.add("select event_id, user_id, event_type, value from events")
def src12_access_log(t: Tables) -> DataFrame:
    return I.through_json_lines(t("events").select("event_id", "user_id", "event_type", "value"))


@R.add("select vec_id, label, len(embedding) as dim, round(list_sum(embedding::double[]), 5) as total, round(embedding[1]::double, 6) as first from embeddings")
def src13_snapshot(t: Tables) -> DataFrame:
    """A snapshot of the vectors, written and read again; the check compares what the vectors hold."""
    x = I.through_snapshot(t("embeddings").select("vec_id", "label", "embedding"))
    return x.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(V.total(V.doubles(F.col("embedding"))), 5).alias("total"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@R.add("select 'pulse:' || id as label, '[finding] ' || trim(content) as content, coalesce(salience, 1.0) as salience from memories where content is not null and trim(content) <> ''")
def src9_pulse_documents(t: Tables) -> DataFrame:
    m = t("memories").where(F.trim("content") != "")
    doc = F.struct(F.lit("pulse.for-memory.v1").alias("schema"), F.lit("topic").alias("topic"), F.array(F.struct(F.concat(F.lit("pulse:"), F.col("id").cast("string")).alias("label"), F.lit("finding").alias("kind"), F.trim("content").alias("content"), "salience")).alias("memories"))
    return I.pulse_rows(m.select(F.to_json(doc).alias("json"))).select("label", "content", "salience")


@R.add("with u as (select label, embedding::double[] e from embeddings), p as (select a.label, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id) select label, round(avg(s), 6) as mean_similarity from p group by 1")
def ag14_mean_pairwise_similarity(t: Tables) -> DataFrame:
    """Mean cosine over the pairs of a group, from the sum of its unit vectors: no pair is formed."""
    x = t("embeddings").select("label", F.posexplode(V.normalize(F.col("embedding"))).alias("i", "v"))
    sums = x.groupBy("label", "i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    g = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").cast("double").alias("n"))
    return g.select("label", F.round(F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0), 6).alias("mean_similarity"))


@R.add("with r as (select event_type, value, row_number() over (partition by event_type order by value) k, count(*) over (partition by event_type) n from events where value is not null) select event_type, max(case when k = 1 + floor((n - 1) * 0.95) then value end) as p95 from r group by 1")
def ag18_nearest_rank(t: Tables) -> DataFrame:
    w = W.partitionBy("event_type")
    r = t("events").where(F.col("value").isNotNull()).select("event_type", "value", F.row_number().over(w.orderBy("value")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where(F.col("k") == 1 + F.floor((F.col("n") - 1) * 0.95)).groupBy("event_type").agg(F.max("value").alias("p95"))


@R.add("select label, id, created_at from (select *, row_number() over (partition by label order by created_at desc nulls last, id desc) k from memories where label is not null) where k = 1")
def wn7_latest_per_label(t: Tables) -> DataFrame:
    m = t("memories").where(F.col("label").isNotNull())
    return m.groupBy("label").agg(F.max_by(F.struct("id", "created_at"), F.struct(F.col("created_at").isNotNull(), "created_at", "id")).alias("m")).select("label", "m.id", "m.created_at")


@R.add()
def tk3_lsh_search(t: Tables) -> DataFrame:
    """Approximate top ten by hyperplane buckets; candidates are verified exactly."""
    return lsh.approximate_top_k(asking(t), vecs(t), 10, DIM)


_PLANES = "pl as (select b, list(case when ('0x' || substr(md5('0:' || b || ':' || i), 1, 2))::int % 2 = 1 then 1.0 else -1.0 end order by i)::double[] p from (select unnest(range(8)) b), (select unnest(range(1, 65)) i) group by 1)"


@R.add("with " + C.VECTORS + ", " + _PLANES + " select id, sum(case when list_dot_product(e, p) >= 0 then (1 << b) else 0 end)::bigint as bucket from vec, pl group by 1")
def vx17_hyperplane_signature(t: Tables) -> DataFrame:
    return vecs(t).select("id", lsh.signature(F.col("vec"), 0, 8, DIM).cast("long").alias("bucket"))


@R.add("select id, max(score) as score from (select id, salience score from memories where salience is not null union all select source_memory_id, confidence from dream_insights where source_memory_id is not null and confidence is not null) group by 1")
def st3_merge_by_best_score(t: Tables) -> DataFrame:
    a = t("memories").where(F.col("salience").isNotNull()).select("id", F.col("salience").alias("score"))
    b = t("dream_insights").where(F.col("source_memory_id").isNotNull() & F.col("confidence").isNotNull()).select(F.col("source_memory_id").alias("id"), F.col("confidence").alias("score"))
    return a.unionByName(b).groupBy("id").agg(F.max("score").alias("score"))


@R.add("select 'memories' as name, count(*) as n from memories union all select 'connections', count(*) from connections union all select 'turns', count(*) from turns union all select 'documents', count(*) from documents")
def st4_row_counts(t: Tables) -> DataFrame:
    out = None
    for name in ("memories", "connections", "turns", "documents"):
        n = t(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@R.add(r"with x as (select id, list_distinct(list_transform(regexp_extract_all(old_content, '\$?\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', ''))) a, list_distinct(list_transform(regexp_extract_all(new_content, '\$?\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', ''))) b from memory_revisions where old_content is not null and new_content is not null) select id, list_sort(a) = list_sort(b) as same, list_has_any(a, b) as shared from x")
def st6_number_sets(t: Tables) -> DataFrame:
    r = t("memory_revisions").where(F.col("old_content").isNotNull() & F.col("new_content").isNotNull())
    a, b = X.numeric_tokens(F.col("old_content")), X.numeric_tokens(F.col("new_content"))
    return r.select("id", (a == b).alias("same"), F.arrays_overlap(a, b).alias("shared"))


@R.add("with x as (select id, list_distinct(regexp_extract_all(lower(old_content), '[\\p{L}\\p{N}]+')) a, list_distinct(regexp_extract_all(lower(new_content), '[\\p{L}\\p{N}]+')) b from memory_revisions where old_content is not null and new_content is not null) select id, round(case when len(list_distinct(list_concat(a, b))) > 0 then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double else 0 end, 6) as jaccard from x")
def st7_word_jaccard(t: Tables) -> DataFrame:
    r = t("memory_revisions").where(F.col("old_content").isNotNull() & F.col("new_content").isNotNull())
    return r.select("id", F.round(X.jaccard(X.words(F.col("old_content")), X.words(F.col("new_content"))), 6).alias("jaccard"))


@R.add("with " + C.VECTORS + ", n as (select v.id, coalesce(split_part(m.label, ':', 1), '') g, round(sqrt(list_dot_product(v.e, v.e)), 6) norm from vec v join memories m using (id)), r as (select *, row_number() over (partition by g order by norm desc, id) k from n) select g, id, norm, k as place from r where k <= 4")
def vx5_strongest_tokens(t: Tables) -> DataFrame:
    """The four longest vectors of each group: a document's tokens cut to a fixed number."""
    g = t("memories").select("id", F.coalesce(F.element_at(F.split("label", ":"), 1), F.lit("")).alias("g"))
    n = vecs(t).select("id", F.round(V.norm(F.col("vec")), 6).alias("norm")).join(g, "id")
    return n.select("g", "id", "norm", F.row_number().over(W.partitionBy("g").orderBy(F.desc("norm"), "id")).cast("long").alias("place")).where(F.col("place") <= 4)


_SIGNALS = "with " + C.PAIRS + ", " + _SEM + """, c as (select s.*, m.last_accessed la, m.created_at ca, coalesce(m.access_count, 0) n, p.a is not null linked from sem s join memories m on m.id = s.id left join pw p on p.a = least(s.query_id, s.id) and p.b = greatest(s.query_id, s.id)),
  w as (select *, max(la) over (partition by query_id) ref, max(n) over (partition by query_id) top from c)"""


@R.add(_SIGNALS + " select query_id, id, round(0.5 * score + 0.2 * exp(-ln(2) * coalesce((epoch_us(ref) - epoch_us(la)) / 1e6, 0) / 3600 / 24) + 0.15 * case when top > 0 then log2(1 + n) / log2(1 + top) else 0 end + 0.15 * case when linked then 0.5 else 0 end, 9) as score from w")
def vx10_multi_signal(t: Tables) -> DataFrame:
    """Cosine, recency of use, frequency and nearness in the graph of each query's fifty nearest rows."""
    return multi_signal(t, semantic(t))


def multi_signal(t: Tables, hits: DataFrame) -> DataFrame:
    """hits (query_id, id, score) scored by several signals: half their score, recency of use, frequency, nearness in the graph."""
    m = t("memories").select("id", "last_accessed", F.coalesce("access_count", F.lit(0)).alias("n"))
    ends = (F.least("query_id", "id"), F.greatest("query_id", "id"))
    linked = E.clean_edges(t("connections")).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct().withColumn("linked", F.lit(0.5))
    x = hits.join(m, "id").withColumns({"a": ends[0], "b": ends[1]}).join(linked, ["a", "b"], "left")
    w = W.partitionBy("query_id")
    x = x.withColumn("ref", F.max("last_accessed").over(w)).withColumn("top", F.max("n").over(w).cast("double"))
    age = F.coalesce(S.seconds_between(F.col("ref"), F.col("last_accessed")), F.lit(0.0)) / 3600
    freq = F.when(F.col("top") > 0, F.log2(1.0 + F.col("n")) / F.log2(1.0 + F.col("top"))).otherwise(0.0)
    return x.select("query_id", "id", F.round(0.5 * F.col("score") + 0.2 * F.exp(age * (-np.log(2) / 24)) + 0.15 * freq + 0.15 * F.coalesce("linked", F.lit(0.0)), 9).alias("score"))


@R.add(_SIGNALS + f" select query_id, id, round(0.6 * score + 0.15 * case when ca is null then 0.5 else exp(-ln(2) * greatest(0.0, (epoch_us({C.NOW}) - epoch_us(ca)) / 1e6) / 86400) end + 0.15 * case when top > 0 then n / top::double else 0 end + 0.1 * case when linked then 1 else 0 end, 6) as score from w")
def vx12_simple_signals(t: Tables) -> DataFrame:
    m = t("memories").select("id", "created_at", F.coalesce("access_count", F.lit(0)).alias("n"))
    linked = pairs(t).select(F.inline(F.array(F.struct(F.col("a").alias("query_id"), F.col("b").alias("id")), F.struct(F.col("b").alias("query_id"), F.col("a").alias("id"))))).distinct().withColumn("linked", F.lit(1.0))
    x = semantic(t).join(m, "id").join(linked, ["query_id", "id"], "left").withColumn("top", F.max("n").over(W.partitionBy("query_id")).cast("double"))
    new = F.when(F.col("created_at").isNull(), 0.5).otherwise(F.exp(F.greatest(F.lit(0.0), S.seconds_between(now(), F.col("created_at"))) * (-np.log(2) / 86400)))
    return x.select("query_id", "id", F.round(0.6 * F.col("score") + 0.15 * new + 0.15 * F.when(F.col("top") > 0, F.col("n") / F.col("top")).otherwise(0.0) + 0.1 * F.coalesce("linked", F.lit(0.0)), 6).alias("score"))


@R.add()
def vx13_next_vector(t: Tables) -> DataFrame:
    """Two-layer recurrent inference over a user's last events with fixed weights, one Arrow batch at a time."""
    rng = np.random.default_rng(1)
    size, kinds = 8, ["click", "error", "purchase", "signup", "view"]
    w = [(rng.normal(0, 0.3, (4 * size, n)), rng.normal(0, 0.3, (4 * size, size)), np.zeros(4 * size)) for n in (len(kinds), size)]

    @F.pandas_udf("array<double>")
    def predict(seqs: pd.Series) -> pd.Series:
        def run(seq) -> list[float]:
            xs = [np.eye(len(kinds))[kinds.index(s)] if s in kinds else np.zeros(len(kinds)) for s in seq]
            for wx, wh, b in w:
                h, c, out = np.zeros(size), np.zeros(size), []
                for x in xs:
                    i, f, g, o = np.split(wx @ x + wh @ h + b, 4)
                    sig = lambda z: 1 / (1 + np.exp(-z))
                    c = sig(f) * c + sig(i) * np.tanh(g)
                    h = sig(o) * np.tanh(c)
                    out.append(h)
                xs = out
            return [float(v) for v in (xs[-1] if len(xs) else np.zeros(size))]

        return seqs.map(run)

    last = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-7, 0)
    x = t("events").withColumn("seq", F.collect_list("event_type").over(last)).groupBy("user_id").agg(F.max_by("seq", F.struct("ts", "event_id")).alias("seq"))
    return x.select("user_id", predict("seq").alias("next"))


@R.add()
def tx6_entity_search(t: Tables) -> DataFrame:
    """Documents by the share of a query's first eight entities that they name."""
    q = t("eval_items").select("item_id", F.slice(X.entities(F.col("item_text")), 1, 8).alias("e")).where(F.size("e") > 0)
    q = q.select("item_id", F.size("e").alias("n"), F.explode(F.array_distinct(F.transform("e", lambda x: F.lower(x)))).alias("term"))
    d = t("documents").select("doc_id", F.explode(F.transform(X.entities(F.col("text")), lambda x: F.lower(x))).alias("term"))
    return d.join(q, "term").groupBy("item_id", "doc_id").agg(F.round(F.count(F.lit(1)) / F.max("n"), 6).alias("score"))


@R.add(r"select doc_id, case when length(text) <= 240 then text else regexp_extract(substr(text, 1, 240), '(?s)^(.*)\s', 1) || '…' end as excerpt from documents where text is not null and (length(text) <= 240 or regexp_matches(substr(text, 1, 240), '\s'))")
def tx19_excerpts(t: Tables) -> DataFrame:
    c = F.col("text")
    head = F.substring(c, 1, 240)
    ok = t("documents").where(c.isNotNull() & ((F.char_length(c) <= 240) | head.rlike(r"\s")))
    return ok.select("doc_id", F.when(F.char_length(c) <= 240, c).otherwise(F.concat(F.regexp_extract(head, r"(?s)^(.*)\s", 1), F.lit("…"))).alias("excerpt"))


@R.add("select event_id, cast(props ->> '$.k' as bigint) as k from events where cast(props ->> '$.k' as bigint) >= 0")
def tx25_json_value(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").where(k >= 0).select("event_id", k.alias("k"))


@R.add(f"select id, round(0.6 * exp(-coalesce((epoch_us({C.NOW}) - epoch_us(last_accessed)) / 1e6, 0) / 3600 / 1000) + 0.4 * least(1.0, ln(1 + coalesce(access_count, 0)) / 10), 6) as salience from memories")
def dt4_use_salience(t: Tables) -> DataFrame:
    age = F.coalesce(S.seconds_between(now(), F.col("last_accessed")), F.lit(0.0))
    return t("memories").select("id", F.round(0.6 * F.exp(-age / 3600 / 1000) + 0.4 * F.least(F.lit(1.0), F.log1p(F.coalesce("access_count", F.lit(0)).cast("double")) / 10), 6).alias("salience"))


@R.add("select id, epoch_us(created_at) as micros, (epoch_us(created_at) // 1000000) as seconds from memories where created_at is not null")
def dt5_epochs(t: Tables) -> DataFrame:
    ts = F.col("created_at").cast("timestamp")
    return t("memories").where(F.col("created_at").isNotNull()).select("id", F.unix_micros(ts).alias("micros"), F.unix_seconds(ts).alias("seconds"))


_MT2 = "with " + C.BOTH + ", " + C.VECTORS + ", cn as (select x.dst a, y.dst b, count(*) n from bw x join bw y on x.src = y.src and x.dst < y.dst group by 1, 2)"


@R.add(_MT2 + " select p.a, p.b, round(0.5 * list_cosine_similarity(u.e, v.e) + 0.3 * exp(-coalesce(abs(epoch_us(m.created_at) - epoch_us(n.created_at)) / 1e6, 0) / 60) + least(0.3, 0.1 * coalesce(cn.n, 0)), 6) as strength from pw p join vec u on u.id = p.a join vec v on v.id = p.b join memories m on m.id = p.a join memories n on n.id = p.b left join cn on cn.a = p.a and cn.b = p.b")
def mt2_connection_strength(t: Tables) -> DataFrame:
    """Cosine, nearness in time and shared neighbours of the ends of every edge."""
    m = vecs(t).join(t("memories").select("id", "created_at"), "id")
    end = lambda s: m.select(F.col("id").alias(s), F.col("vec").alias(f"v{s}"), F.col("created_at").alias(f"t{s}"))
    x = pairs(t).join(end("a"), "a").join(end("b"), "b").join(G.shared_by_edge(pairs(t)), ["a", "b"], "left")
    gap = F.coalesce(F.abs(S.seconds_between(F.col("ta"), F.col("tb"))), F.lit(0.0))
    return x.select("a", "b", F.round(0.5 * V.cosine(F.col("va"), F.col("vb")) + 0.3 * F.exp(-gap / 60) + F.least(F.lit(0.3), 0.1 * F.coalesce("common", F.lit(0))), 6).alias("strength"))


_HUB = C.BOTH + ", hub as (select src id from bw group by 1 order by count(*) desc, src limit 1)"


@R.add(REC(C.BOTH + ", " + _SEM + """, hit as (select query_id, id, score from sem where rank <= 5), sd as (select distinct id from hit)""" + C.walk("sd") + """,
  sc as (select wk.*, s / max(s) over (partition by seed) act from wk), ac as (select h.query_id, sc.id, max(sc.act) act from hit h join sc on sc.seed = h.id where not exists (select 1 from hit z where z.query_id = h.query_id and z.id = sc.id) and sc.id <> h.query_id group by 1, 2),
  al as (select query_id, id, score, 0 hop from hit union all select ac.query_id, ac.id, round(0.5 * coalesce(list_cosine_similarity(q.e, v.e), 0) + 0.5 * act, 6), 1 from ac join vec q on q.id = ac.query_id left join vec v on v.id = ac.id),
  rk as (select *, row_number() over (partition by query_id order by score desc, id) rank from al) select query_id, id, round(score, 6) as score, hop::bigint as hop, rank from rk where rank <= 10"""))
def rt14_multihop(t: Tables) -> DataFrame:
    """Each query's five direct hits and what walks from them reach: half similarity, half activation, the ten best."""
    hit = shared_checkpoint(semantic(t, 5).select("query_id", "id", "score"))
    walk = G.walks(graph(t), hit.select("id").distinct())
    walk = walk.withColumn("act", F.col("score") / F.max("score").over(W.partitionBy("seed"))).select("seed", "id", "act")
    act = hit.select("query_id", F.col("id").alias("seed")).join(walk, "seed").where(F.col("id") != F.col("query_id")).groupBy("query_id", "id").agg(F.max("act").alias("act"))
    act = act.join(hit.select("query_id", "id"), ["query_id", "id"], "left_anti")
    v = vecs(t).select("id", V.doubles(F.col("vec")).alias("vec"))
    x = act.join(v.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id").join(v, "id", "left")
    far = x.select("query_id", "id", F.round(0.5 * F.coalesce(V.cosine(F.col("q"), F.col("vec")), F.lit(0.0)) + 0.5 * F.col("act"), 6).alias("score"), F.lit(1).cast("long").alias("hop"))
    both = hit.withColumn("hop", F.lit(0).cast("long")).unionByName(far)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= 10).select("query_id", "id", F.round("score", 6).alias("score"), "hop", "rank")


@R.add("with q as (select 'token budget' q union all select 'routing hint'), s as (select q, id, (case when contains(lower(content), q) then 0.2 else 0 end + case when contains(lower(coalesce(label, '')), q) then 0.3 else 0 end)::double boost from memories, q where content is not null) select q as query, id, round(boost, 6) as boost from s where boost > 0")
def rt20_substring_boost(t: Tables) -> DataFrame:
    m = t("memories").where(F.col("content").isNotNull())
    has = lambda c, q: F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), q), 1.0).otherwise(0.0)
    x = m.select("id", "content", "label", F.explode(F.array(F.lit("token budget"), F.lit("routing hint"))).alias("query"))
    return x.select("query", "id", F.round(0.2 * has(F.col("content"), F.col("query")) + 0.3 * has(F.col("label"), F.col("query")), 6).alias("boost")).where(F.col("boost") > 0)


_LOCAL = """, nb as (select distinct b.dst id from hub join bw b on b.src = hub.id), n2 as (select id from hub union select id from nb), lw as (select b.src, b.dst, b.w from bw b where b.src in (select id from n2) and b.dst in (select id from n2)), st as (select src, dst, w / sum(w) over (partition by src) p from lw where src in (select src from lw group by 1 having sum(w) > 0))"""


@R.add(REC(_HUB + _LOCAL + """, r(i, id, x) as (select 0, id, 1.0::double from hub union all select i + 1, id, sum(x) from (select r.i i, st.dst id, r.x * st.p * 0.85 x from r join st on st.src = r.id where r.i < 10 union all select z.i, hub.id, 0.15 from (select distinct i from r) z, hub where z.i < 10) group by 1, 2)
  select id, round(x / (select max(x) from r where i = 10), 6) as score from r where i = 10"""))
def gr4_local_pagerank(t: Tables) -> DataFrame:
    """PageRank on the graph that the hub and its neighbours induce."""
    g, h = graph(t), hub(t)
    near = G.hops(g, h, 1).select("id").distinct()
    local = g.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")
    return G.pagerank(local, h.withColumn("share", F.lit(1.0)), rounds=10).select("id", F.round("score", 6).alias("score"))


@R.add(REC(C.BOTH + ", sd as (select distinct src id from bw where src % 100 = 0), r(d, id, act) as (select 0, id, 0.5::double from sd union all select d + 1, id, max(act) from (select r.d d, b.dst id, r.act * b.w * 0.85 act from r join bw b on b.src = r.id where r.d < 2) where act >= 0.01 group by 1, 2) select id, round(max(act), 9) as activation from r where id not in (select id from sd) group by 1"))
def gr7_many_seeds(t: Tables) -> DataFrame:
    g = graph(t)
    seeds = g.where(F.col("src") % 100 == 0).select(F.col("src").alias("id")).distinct().withColumn("act", F.lit(0.5))
    return G.activation(g, seeds, depth=2).select("id", F.round("act", 9).alias("activation"))


@R.add(REC(C.VECTORS + ", e as (select a.id a, b.id b from vec a join vec b on a.id < b.id where round(list_cosine_similarity(a.e, b.e), 6) >= 0.85), bw as (select a src, b dst from e union select b, a from e), r(id, root) as (select distinct src, src from bw union select b.dst, r.root from r join bw b on b.src = r.id where r.root < b.dst) select id, min(root) as root from r group by 1"))
def gr15_similarity_groups(t: Tables) -> DataFrame:
    """Groups that all pairs of 0.85 and more link together; rows without such a pair are in none."""
    return connected_components(search.similar_groups(vecs(t), DIM, 0.85))


@R.add("with " + C.PAIRS + " select a, b, w as weight from pw where a not in (select memory_id from memory_revisions where memory_id is not null) and b not in (select memory_id from memory_revisions where memory_id is not null)")
def gr20_remove_nodes(t: Tables) -> DataFrame:
    gone = t("memory_revisions").where(F.col("memory_id").isNotNull()).select(F.col("memory_id").alias("id")).distinct()
    return pairs(t).join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b", F.col("w").alias("weight"))


@R.add("with " + C.BOTH + ", dg as (select m.id, m.salience, m.created_at, coalesce(d.n, 0) n from memories m left join (select src, count(*) n from bw group by 1) d on d.src = m.id), lo as (select * from dg where n < 3), s as (select id, 1 sl, row_number() over (order by created_at desc nulls last, id) p from lo union all select id, 2, row_number() over (order by salience nulls last, id) from lo union all select id, 3, row_number() over (order by md5(concat(id, ':', 42)), id) from lo) select id, min(sl)::bigint as slice from s where (sl = 1 and p <= 40) or (sl = 2 and p <= 20) or (sl = 3 and p <= 20) group by id")
def dr2_isolated_sample(t: Tables) -> DataFrame:
    """Of the rows with fewer than three neighbours the newest, the least salient and some at random (by a hash)."""
    deg = graph(t).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    low = t("memories").select("id", "salience", "created_at").join(deg, "id", "left").where(F.coalesce("n", F.lit(0)) < 3)
    new = low.orderBy(F.desc_nulls_last("created_at"), "id").limit(40).select("id", F.lit(1).cast("long").alias("slice"))
    dull = low.orderBy(F.asc_nulls_last("salience"), "id").limit(20).select("id", F.lit(2).cast("long").alias("slice"))
    some = low.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), "id").limit(20).select("id", F.lit(3).cast("long").alias("slice"))
    return new.unionByName(dull).unionByName(some).groupBy("id").agg(F.min("slice").alias("slice"))


@R.add("with " + C.UPSERTED + " select -1::bigint as s, -1::bigint as t, count(*) as edges, round(sum(weight), 6) as old_weight, round(sum(greatest(0, weight - 0.01)), 6) as new_weight from up where weight > 0.05")
def dr5_weaken_summary(t: Tables) -> DataFrame:
    """One history row for the weakening of all edges."""
    e = E.upsert(E.clean_edges(t("connections"))).where(F.col("weight") > 0.05)
    return e.agg(F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("t"), F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("old_weight"), F.round(F.sum(F.greatest(F.lit(0.0), F.col("weight") - 0.01)), 6).alias("new_weight"))


@R.add("with e as (select label, vec_id, embedding::double[] v from embeddings), s as (select label, i, sum(v[i] / sqrt(list_dot_product(v, v))) s from e, (select unnest(range(1, 65)) i) group by 1, 2), c as (select label, list(s order by i)::double[] c from s group by 1), r as (select e.label, e.vec_id, round(list_cosine_similarity(e.v, c.c), 6) sim, row_number() over (partition by e.label order by round(list_cosine_similarity(e.v, c.c), 6) desc, e.vec_id) k from e join c using (label)) select label, vec_id as medoid, sim from r where k = 1")
def dr11_theme_medoid(t: Tables) -> DataFrame:
    """The member nearest to its group's centroid."""
    e = t("embeddings").select("label", "vec_id", V.normalize(F.col("embedding")).alias("u"))
    sums = e.groupBy("label").agg(F.array(*[F.sum(F.element_at("u", i + 1)) for i in range(DIM)]).alias("c"))
    sim = F.round(V.cosine(F.col("u"), F.col("c")), 6)
    x = e.join(sums, "label").select("label", "vec_id", sim.alias("sim"))
    return x.groupBy("label").agg(F.max_by(F.struct("vec_id", "sim"), F.struct("sim", -F.col("vec_id"))).alias("m")).select("label", F.col("m.vec_id").alias("medoid"), "m.sim")


@R.add(FACTS_SQL + " select doc_id as source_id, coalesce(source, '') || '::afe::A' || no as label, text as content, 'supports' as edge_type, 0.95::double as weight from f")
def dr12_fact_rows(t: Tables) -> DataFrame:
    """Facts of notes as rows with a supporting edge to their source."""
    f = fact_notes(t).select("doc_id", "source", F.posexplode(Q.markdown_facts(F.col("note"))).alias("no", "f"))
    return f.select(F.col("doc_id").alias("source_id"), F.concat(F.coalesce("source", F.lit("")), F.lit("::afe::A"), F.col("no").cast("string")).alias("label"), F.col("f.text").alias("content"), F.lit("supports").alias("edge_type"), F.lit(0.95).alias("weight"))


@R.add("select source_memory_id as id, count(*) as evidence, round(1 / (1 + exp(-(0.5 * ln(1 + count(*)) + 1.2 * avg(coalesce(confidence, 0))))), 6) as confidence from dream_insights where source_memory_id is not null group by 1 having count(*) >= 2 and 1 / (1 + exp(-(0.5 * ln(1 + count(*)) + 1.2 * avg(coalesce(confidence, 0))))) >= 0.5")
def dr14_synthesis_filter(t: Tables) -> DataFrame:
    g = t("dream_insights").where(F.col("source_memory_id").isNotNull()).groupBy(F.col("source_memory_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    conf = S.confidence(F.col("evidence"), F.col("c"), F.lit(0.0))
    return g.where((F.col("evidence") >= 2) & (conf >= 0.5)).select("id", "evidence", F.round(conf, 6).alias("confidence"))


@R.add("select id, salience > 0.3 or access_count >= 3 as transferred from (select * from memories where salience is not null and access_count is not null order by access_count desc, created_at nulls last, id limit 64)")
def dr17_transfer(t: Tables) -> DataFrame:
    """The 64 most used rows and whether they move to long-term memory."""
    top = t("memories").where(F.col("salience").isNotNull() & F.col("access_count").isNotNull()).orderBy(F.desc("access_count"), F.asc_nulls_last("created_at"), "id").limit(64)
    return top.select("id", ((F.col("salience") > 0.3) | (F.col("access_count") >= 3)).alias("transferred"))


@R.add("with " + _SEM + ", g as (select query_id, count(*) filter (score >= 0.5) n from sem group by 1) select coalesce(split_part(m.label, ':', 1), '') as kind, count(*) as queries, sum(case when n > 0 then 1 else 0 end)::bigint as hits from g join memories m on m.id = g.query_id group by 1")
def rt18_diagnose(t: Tables) -> DataFrame:
    """Hits and misses of the queries by kind of label, at a similarity of 0.5."""
    g = semantic(t).groupBy("query_id").agg(F.max("score").alias("top"))
    kind = t("memories").select(F.col("id").alias("query_id"), F.coalesce(F.element_at(F.split("label", ":"), 1), F.lit("")).alias("kind"))
    return g.join(kind, "query_id").groupBy("kind").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("top") >= 0.5).alias("hits"))
