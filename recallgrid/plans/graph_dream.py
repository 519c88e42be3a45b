"""Graph reads and the consolidation cycle over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import text as X
from recallgrid.functions import vectors as V
from recallgrid.operators import dream as D
from recallgrid.operators import edges as E
from recallgrid.operators import graph as G
from recallgrid.operators import search
from recallgrid.operators import sequential as Q
from recallgrid.operators.above import links_above
from recallgrid.operators.components import connected_components
from recallgrid.operators.linking import missing_links
from recallgrid.operators.skew import shared_checkpoint
from recallgrid.plans import ctes as C
from recallgrid.plans.base import Registry, Tables
from recallgrid.plans.relational import st1_union_of_slices
from recallgrid.plans.retrieval import relevant, semantic
from recallgrid.plans.vectors_text import DIM, vecs

R = Registry()
REC = lambda body: "with recursive " + body


def pairs(t: Tables) -> DataFrame:
    return E.pair_weights(E.clean_edges(t("connections")))


def graph(t: Tables) -> DataFrame:
    return E.both_ways(pairs(t))


def hub(t: Tables, g: DataFrame | None = None) -> DataFrame:
    """The node of the highest degree (ties: smallest id) of the graph ``g`` as a one-row table."""
    return (graph(t) if g is None else g).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


_HUB = C.BOTH + ", hub as (select src id from bw group by 1 order by count(*) desc, src limit 1)"


@R.add("with " + C.BOTH + " select src as id, dst as other, w as weight from bw")
def gr1_neighbours(t: Tables) -> DataFrame:
    """Neighbours in both directions; who wants them in order sorts the one node that is asked for."""
    return graph(t).select(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("w").alias("weight"))


@R.add(REC(_HUB + ", r(d, id, act) as (select 0, id, 1.0::double from hub union all select d + 1, id, max(act) from (select r.d d, b.dst id, r.act * b.w * 0.85 act from r join bw b on b.src = r.id where r.d < 3) where act >= 0.01 group by 1, 2) select id, round(max(act), 6) as activation from r where id not in (select id from hub) group by 1"))
def gr2_spreading_activation(t: Tables) -> DataFrame:
    """From the hub over at most three edges; the best path to each node."""
    g = shared_checkpoint(graph(t))
    return G.activation(g, hub(t, g).withColumn("act", F.lit(1.0)), depth=3).select("id", F.round("act", 6).alias("activation"))


_SEEDS = """, sd as (select distinct src id from bw where src % 100 = 0), st as (select src, dst, w / sum(w) over (partition by src) p from bw where src in (select src from bw group by 1 having sum(w) > 0)), ns as (select count(*) n from sd)"""


@R.add(REC(C.BOTH + _SEEDS + """, r(i, id, x) as (select 0, id, 1.0::double / n from sd, ns union all select i + 1, id, sum(x) from (select r.i i, st.dst id, r.x * st.p * 0.85 x from r join st on st.src = r.id where r.i < 10
  union all select z.i, sd.id, 0.15 / ns.n from (select distinct i from r) z, sd, ns where z.i < 10) group by 1, 2) select id, round(x / (select max(x) from r where i = 10), 6) as score from r where i = 10"""))
def gr5_personalised_pagerank(t: Tables) -> DataFrame:
    """Ten rounds over the whole graph, restarting at the nodes whose id is divisible by 100; the best scores 1."""
    g = shared_checkpoint(graph(t))
    seeds = g.where(F.col("src") % 100 == 0).select(F.col("src").alias("id")).distinct()
    n = seeds.agg((1.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("share"))
    return G.pagerank(g, seeds.join(F.broadcast(n)), rounds=10).select("id", F.round("score", 6).alias("score"))


_PATHS = "with " + _HUB + ", l0 as (select id, 0 hop, [id] path from hub)" + "".join(f", l{d} as (select b.dst id, {d} hop, min(list_append(l.path, b.dst)) path from l{d - 1} l join bw b on b.src = l.id where {' and '.join(f'b.dst not in (select id from l{k})' for k in range(d))} group by 1)" for d in (1, 2, 3, 4))


@R.add(_PATHS + " select id, hop::bigint as hop, path from (" + " union all ".join(f"select * from l{d}" for d in range(5)) + ")")
def gr8_shortest_paths(t: Tables) -> DataFrame:
    """A shortest path from the hub to every node within four edges."""
    g = shared_checkpoint(graph(t))
    return G.paths(g, hub(t, g), 4).select("id", F.col("hop").cast("long").alias("hop"), "path")


@R.add(REC(_HUB + ", r(id, hop) as (select id, 0 from hub union select b.dst, r.hop + 1 from r join bw b on b.src = r.id where r.hop < 2), n as (select distinct id from r) select p.a, p.b, p.w as weight from pw p where p.a in (select id from n) and p.b in (select id from n)"))
def gr9_subgraph(t: Tables) -> DataFrame:
    near = G.hops(graph(t), hub(t), 2).select("id").distinct()
    return pairs(t).join(near.select(F.col("id").alias("a")), "a", "left_semi").join(near.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", F.col("w").alias("weight"))


@R.add("with " + C.BOTH + ", " + C.VECTORS + """, dg as (select src, count(*) d from bw group by 1), cn as (select x.dst query_id, y.dst id, count(*) common, sum(case when d > 1 then 1 / ln(d) else 0 end) aa from bw x join bw y on x.src = y.src and x.dst <> y.dst join dg on dg.src = x.src where x.dst % 100 = 0 group by 1, 2),
  pt as (select cn.query_id, cn.id, common, common / least(da.d, db.d)::double cs, aa, coalesce(list_cosine_similarity(u.e, v.e), 0) emb from cn join dg da on da.src = cn.query_id join dg db on db.src = cn.id left join vec u on u.id = cn.query_id left join vec v on v.id = cn.id where not exists (select 1 from bw where bw.src = cn.query_id and bw.dst = cn.id)),
  sc as (select query_id, id, common, round(0.3 * cs + 0.4 * aa + 0.3 * emb, 6) score, case when aa >= cs and aa >= emb then 'adamic_adar' when emb >= cs then 'embedding' else 'common_neighbors' end as method from pt),
  r as (select *, row_number() over (partition by query_id order by score desc, id) rank from sc where score > 0.1) select query_id, id, common, score, method, rank from r where rank <= 10""")
def gr10_link_prediction(t: Tables) -> DataFrame:
    """For each node whose id is divisible by 100 its ten likeliest missing links, by common neighbours, Adamic-Adar and cosine."""
    from pyspark.sql import Window as W

    g = shared_checkpoint(graph(t))
    links = missing_links(g, g.where(F.col("src") % 100 == 0).select(F.col("src").alias("id")), vecs(t), DIM, 10, 0.1)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return links.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= 10)


@R.add("with " + C.BOTH + """, dg as (select src, count(*) d from bw group by 1), cn as (select x.dst a, y.dst b, count(*) common from bw x join bw y on x.src = y.src and x.dst < y.dst group by 1, 2)
  select p.a, p.b, round(coalesce(c.common, 0) / (da.d + db.d - coalesce(c.common, 0))::double, 6) as jaccard from pw p left join cn c on c.a = p.a and c.b = p.b join dg da on da.src = p.a join dg db on db.src = p.b""")
def gr11_neighbourhood_jaccard(t: Tables) -> DataFrame:
    """Jaccard of the neighbourhoods at the ends of every edge."""
    g, p = graph(t), pairs(t)
    deg = g.groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("d"))
    x = p.join(G.shared_by_edge(p), ["a", "b"], "left").join(deg.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    c = F.coalesce("common", F.lit(0))
    return x.select("a", "b", F.round(c / (F.col("da") + F.col("db") - c), 6).alias("jaccard"))


@R.add("with " + C.UPSERTED + " select s, t, edge_type, round(greatest(0, least(1, (weight + 0.1) * 0.999)), 9) as weight from up where (weight + 0.1) * 0.999 >= 0.2")
def gr12_hebbian_decay_prune(t: Tables) -> DataFrame:
    e = E.upsert(E.clean_edges(t("connections")))
    w = (F.col("weight") + 0.1) * 0.999
    return e.where(w >= 0.2).select("s", "t", "edge_type", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)), 9).alias("weight"))


_COMP = REC(C.BOTH + ", r(id, root) as (select distinct src, src from bw union select b.dst, r.root from r join bw b on b.src = r.id where r.root < b.dst)")


@R.add(_COMP + " select id, min(root) as root from r group by 1")
def gr14_components(t: Tables) -> DataFrame:
    return connected_components(pairs(t).select("a", "b"))


@R.add(_COMP + ", c as (select id, min(root) root from r group by 1), l as (select root, count(*) n from c group by 1), m as (select sum(w) m from pw), i as (select c.root, sum(p.w) w from pw p join c on c.id = p.a group by 1), k as (select c.root, sum(b.w) k from bw b join c on c.id = b.src group by 1) select round(sum(i.w / m - (k / (2 * m)) * (k / (2 * m))), 6) as q, count(*) as communities from i join k using (root), m")
def ag20_modularity(t: Tables) -> DataFrame:
    """Modularity of the division into components."""
    p = pairs(t)
    c = connected_components(p.select("a", "b"))
    q = G.modularity(p, c.select("id", F.col("root").alias("label")))
    return c.agg(F.round(F.lit(float(q)), 6).alias("q"), F.count_distinct("root").alias("communities"))


@R.add()
def gr13_louvain(t: Tables) -> DataFrame:
    """One level of Louvain in ascending order within each component."""
    p = pairs(t)
    return Q.louvain(p, connected_components(p.select("a", "b")))


_LP = "with " + C.BOTH + ", l0 as (select distinct src id, src label from bw)" + "".join(f", v{k} as (select b.src id, l.label, round(sum(b.w), 9) v from bw b join l{k - 1} l on l.id = b.dst group by 1, 2), l{k} as (select id, label from (select *, row_number() over (partition by id order by v desc, label) r from v{k}) where r = 1)" for k in range(1, 6))


@R.add(_LP + " select id, label from l5")
def gr16_label_propagation(t: Tables) -> DataFrame:
    return G.label_propagation(graph(t), rounds=5)


_ROLE = C.EDGES + ", lb as (select id, split_part(coalesce(label, ''), ':', 1) l from memories)"


@R.add("with " + _ROLE + ", x as (select s id, t o from ce union all select t, s from ce), y as (select x.id, b.l from x join lb a on a.id = x.id join lb b on b.id = x.o where a.l <> b.l) select id, count(distinct l) as others from y group by 1 having count(distinct l) >= 2")
def gr17_bridge_nodes(t: Tables) -> DataFrame:
    """Nodes that touch at least two other groups; the first segment of the label is the group."""
    labels = t("memories").select("id", F.element_at(F.split(F.coalesce("label", F.lit("")), ":"), 1).alias("label"))
    return D.bridge_nodes(E.clean_edges(t("connections")), labels)


@R.add("with " + C.EDGES + " select c.s, c.t, c.edge_type, c.weight from ce c where exists (select 1 from memories m where m.id = c.s) and exists (select 1 from memories m where m.id = c.t)")
def gr19_canonical_sweep(t: Tables) -> DataFrame:
    ids = t("memories").select("id")
    e = E.clean_edges(t("connections")).select("s", "t", "edge_type", "weight")
    return e.join(ids.select(F.col("id").alias("s")), "s", "left_semi").join(ids.select(F.col("id").alias("t")), "t", "left_semi").select("s", "t", "edge_type", "weight")


# Consolidation -------------------------------------------------------------------------------------------------------

#: What the walks of the sample reach: ac (s, t); after ``ctes.UPSERTED``, in a recursive with.
ACTIVE = C.BOTH[len(C.EDGES) :] + ", " + C.SAMPLE + C.walk("sp") + ", ac as (select distinct least(seed, id) s, greatest(seed, id) t from wk)"
_STRONG = ", sg as (select up.s, up.t, up.edge_type, case when ac.s is not null then least(1.0, weight + 0.05) else weight end weight, up.weight old from up left join ac on ac.s = up.s and ac.t = up.t)"


def sample(t: Tables) -> DataFrame:
    """The ids that a cycle looks at, at most 2,000."""
    return st1_union_of_slices(t).select("id")


def active_pairs(t: Tables) -> DataFrame:
    """The pairs that a cycle has walked: each row of its sample with the twenty best of its personalised PageRank."""
    found = G.walks(graph(t), sample(t))
    return found.select(F.least("seed", "id").alias("s"), F.greatest("seed", "id").alias("t")).distinct()


def start(t: Tables) -> D.State:
    return D.State(t("memories"), E.upsert(E.clean_edges(t("connections"))).select("s", "t", "edge_type", "weight"))


@R.add("with recursive " + C.UPSERTED + ACTIVE + _STRONG + ", wd as (select s, t, edge_type, case when weight > 0.05 then greatest(0, weight - 0.01) else weight end weight from sg) select s, t, edge_type, round(weight, 6) as weight from wd where weight >= 0.05 - 1e-12 or edge_type = 'supersedes'")
def dr3_nrem(t: Tables) -> DataFrame:
    return D.nrem(start(t), active_pairs(t)).edges.select("s", "t", "edge_type", F.round("weight", 6).alias("weight"))


@R.add("with recursive " + C.UPSERTED + ACTIVE + _STRONG + " select s, t, edge_type, round(old, 6) as old_weight, round(weight, 6) as new_weight, 'strengthened' as reason from sg where weight <> old")
def dr4_history(t: Tables) -> DataFrame:
    return D.nrem(start(t), active_pairs(t)).history.select("s", "t", "edge_type", F.round("old_weight", 6).alias("old_weight"), F.round("new_weight", 6).alias("new_weight"), "reason")


@R.add("select i.id from dream_insights i left join dream_sessions s on s.id = i.session_id where s.started_at is null or s.started_at >= timestamp '2025-12-31 00:00:00' - interval 30 days")
def dr6_retention(t: Tables) -> DataFrame:
    """Insights that stay: those of the last 30 days' sessions and those of none."""
    s = t("dream_sessions").select(F.col("id").alias("session_id"), "started_at")
    x = t("dream_insights").select("id", "session_id").join(s, "session_id", "left")
    return x.where(F.col("started_at").isNull() | (F.col("started_at") >= F.lit("2025-12-01 00:00:00").cast("timestamp_ntz"))).select("id")


_TOP = ", " + C.VECTORS + ", sp as (select a.id query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) sim from vec a join vec b on a.id <> b.id where a.id % 100 = 0), sm as (select * from (select *, row_number() over (partition by query_id order by sim desc, id) k from sp) where k <= 50)"


@R.add("with " + C.UPSERTED + _TOP + ", nw as (select least(query_id, id) s, greatest(query_id, id) t, max(round(0.3 * sim, 3)) weight from sm where sim between 0.3 and 0.95 group by 1, 2) select s, t, 'bridge' as edge_type, weight from nw where not exists (select 1 from up where least(up.s, up.t) = nw.s and greatest(up.s, up.t) = nw.t)")
def dr8_rem_bridges(t: Tables) -> DataFrame:
    hits = semantic(t).select("query_id", "id", F.col("score").alias("sim"))
    return D.bridges(hits, start(t).edges)


@R.add("with recursive " + C.VECTORS + ", " + C.SAMPLE + """, sm as (select a.id a, b.id b, round(list_cosine_similarity(a.e, b.e), 6) sim from vec a join vec b on a.id < b.id where a.id in (select id from sp) and b.id in (select id from sp) and round(list_cosine_similarity(a.e, b.e), 6) >= 0.85),
  n as (select id, created_at, list_sort(list_distinct(list_transform(regexp_extract_all(content, '\\$?\\d[\\d,]*(?:\\.\\d+)?'), lambda x: replace(x, ',', '')))) w from memories where content is not null),
  p as (select sm.*, x.created_at ta, y.created_at tb from sm join n x on x.id = a join n y on y.id = b where len(x.w) > 0 and len(y.w) > 0 and x.w <> y.w),
  o as (select case when ta < tb or (coalesce(ta = tb, true) and a < b) then a else b end s, case when ta < tb or (coalesce(ta = tb, true) and a < b) then b else a end t, sim from p) select distinct s, t, sim as weight from o""")
def dr7_supersedes(t: Tables) -> DataFrame:
    """Superseding edges of the pairs of a cycle's sample of 0.85 and more whose numbers differ; sets of numbers are compared by a 64-bit hash."""
    numbers = X.numeric_tokens(F.col("content"))
    rows = t("memories").join(F.broadcast(sample(t)), "id", "left_semi").where(F.size(numbers) > 0)  # at most 2,000 ids
    rows = rows.withColumns({"numbers": F.xxhash64(numbers), "timed": F.col("created_at").isNotNull().cast("long"), "at": F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0))})
    carry = ("numbers", "timed", "at")
    p = search.similar_links(search.usable(rows, "id", "embedding", DIM, *carry), DIM, 0.85, carry).where(F.col("a_numbers") != F.col("b_numbers"))
    at = lambda e: F.when(F.col(f"{e}_timed") == 1, F.col(f"{e}_at"))
    return D.older_to_newer(p.select("a", "b", "sim", at("a").alias("ta"), at("b").alias("tb"))).select("s", "t", "weight")


_BIG = REC(C.EDGES + ", e as (select s, t from ce where weight >= 0.05 and edge_type <> 'derived_from'), bw as (select s src, t dst from e union select t, s from e), r(id, root) as (select distinct src, src from bw union select b.dst, r.root from r join bw b on b.src = r.id where r.root < b.dst), c as (select id, min(root) root from r group by 1)")


def recent_anchors(t: Tables) -> DataFrame:
    """(anchor): what insights of the last six hours are about."""
    return t("dream_insights").where(F.col("created_at") >= F.lit("2025-12-30 18:00:00").cast("timestamp_ntz")).select(F.col("source_memory_id").alias("anchor"))


@R.add(_BIG + """, g as (select min(id) anchor, count(*) size from c group by root having count(*) >= 10) select anchor, size, least(size / 10.0, 1.0)::double as confidence from g
  where anchor not in (select source_memory_id from dream_insights where source_memory_id is not null and created_at >= timestamp '2025-12-30 18:00:00') order by size desc, anchor limit 50""")
def dr9_insights(t: Tables) -> DataFrame:
    """The fifty largest communities of ten and more members, but those that the last six hours' insights are about."""
    return D.insights(D.communities(E.clean_edges(t("connections"))), seen=recent_anchors(t), most=50)


@R.add("""with m as (select id, split_part(label, ':', 1) g, row_number() over (partition by split_part(label, ':', 1) order by id) k, count(*) over (partition by split_part(label, ':', 1)) n from memories where label is not null)
  select g, 'derived:cluster:' || substr(sha256('[' || string_agg(id::varchar, ', ' order by id) || ']'), 1, 12) as label, max(n) as size from m where k <= 20 group by g having max(n) >= 10""")
def dr10_derived_rows(t: Tables) -> DataFrame:
    """Derived rows of groups of at least ten: the label is a fingerprint of the first twenty ids."""
    from pyspark.sql import Window as W

    g = F.element_at(F.split("label", ":"), 1)
    m = t("memories").where(F.col("label").isNotNull()).select("id", g.alias("g"))
    n = m.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 10)
    first = m.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy("id"))).where(F.col("k") <= 20)
    ids = first.groupBy("g").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    text = F.concat(F.lit("["), F.array_join(F.transform("ids", lambda i: i.cast("string")), ", "), F.lit("]"))
    return ids.join(n, "g").select("g", F.concat(F.lit("derived:cluster:"), F.substring(F.sha2(text, 256), 1, 12)).alias("label"), "size")


#: Neighbourhood-smoothed vectors in SQL: mx (id, i, m) and ln (id, l); ws has the ids that have neighbours.
SMOOTHED = "with " + C.BOTH + ", " + C.VECTORS + """, nb as (select b.src id, b.w, v.e, row_number() over (partition by b.src order by b.w desc, b.dst) k from bw b join vec v on v.id = b.dst), tp as (select * from nb where k <= 20),
  ws as (select id, sum(w) s from tp group by 1 having sum(w) > 0), x as (select tp.id, i, sum(w * e[i]) v from tp, (select unnest(range(1, 65)) i) group by 1, 2), mx as (select vec.id, x.i, 0.4 * vec.e[x.i] + 0.6 * x.v / ws.s m from vec join ws using (id) join x using (id)), ln as (select id, sqrt(sum(m * m)) l from mx group by 1)"""


@R.add(SMOOTHED + """ select mx.id, mx.i::bigint as i, round(mx.m / ln.l, 5) as value from mx join ln using (id) union all select id, x.i, round(e[x.i], 5) from vec, (select unnest(range(1, 65)) i) x where id not in (select id from ws)""")
def dr13_smoothed_vectors(t: Tables) -> DataFrame:
    """Neighbourhood-smoothed embeddings, one row per component."""
    rows = vecs(t).select("id", V.doubles(F.col("vec")).alias("vec"))
    return D.smoothed(rows, graph(t)).select("id", F.posexplode("vec").alias("at", "v")).select("id", (F.col("at") + 1).cast("long").alias("i"), F.round("v", 5).alias("value"))


@R.add("select s.id, date_diff('second', s.started_at, s.finished_at) as seconds, count(i.id) as insights, s.finished_at is null as aborted from dream_sessions s left join dream_insights i on i.session_id = s.id group by s.id, s.started_at, s.finished_at")
def dr15_sessions(t: Tables) -> DataFrame:
    n = t("dream_insights").where(F.col("session_id").isNotNull()).groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_timestamp(F.col("finished_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return t("dream_sessions").join(n, "id", "left").select("id", seconds.alias("seconds"), F.coalesce("n", F.lit(0)).alias("insights"), F.col("finished_at").isNull().alias("aborted"))


@R.add("select min(id) as id, content, count(*) as copies, sum(access_count)::bigint as access_count, max(salience) as salience, min(created_at) as created_at from memories where content is not null and trim(content) <> '' group by content having count(*) > 1")
def dr19_merge_copies(t: Tables) -> DataFrame:
    m = t("memories").where(F.trim("content") != "")
    return m.groupBy("content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.sum("access_count").alias("access_count"), F.max("salience").alias("salience"), F.min("created_at").alias("created_at")).where(F.col("copies") > 1)


@R.add("select id from memories order by created_at desc nulls last, id desc limit 500")
def dr20_capacity(t: Tables) -> DataFrame:
    return t("memories").orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(500).select("id")


@R.add("with " + C.UPSERTED + " select s, t, edge_type, round(weight * 0.999, 9) as weight from up where weight * 0.999 >= 0.01")
def dr21_decay(t: Tables) -> DataFrame:
    e = E.upsert(E.clean_edges(t("connections")))
    return e.where(F.col("weight") * 0.999 >= 0.01).select("s", "t", "edge_type", F.round(F.col("weight") * 0.999, 9).alias("weight"))


_CLEAN = "trim(" + "replace(" * len(X.MARKERS) + "{}" + "".join(f", '{m}', '')" for m in X.MARKERS) + ")"


@R.add("with " + C.VECTORS + """, m as (select m.id, label, content c, v.e from memories m left join vec v using (id) where label is not null and content is not null), w as (select label, id as new_id, c nc, e ne, lag(id) over k old_id, lag(c) over k oc, lag(e) over k oe from m window k as (partition by label order by id)),
  x as (select *, """ + _CLEAN.format("oc") + """ cl, case when trim(oc) = trim(nc) then 'existing' when oe is not null and ne is not null and round(list_cosine_similarity(oe, ne), 9) >= 0.85 then 'fused' else 'stored' end act from w where old_id is not null)
  select old_id, new_id, label, act as action, case when act = 'fused' then '[CANONICAL] ' || trim(nc) || chr(10) || '[PREVIOUSLY] ' || case when length(cl) > 1200 then substr(cl, 1, 1200) || ' ...[truncated]' else cl end end as content, case when act = 'fused' then 'conflict_fusion' end as reason from x""")
def dr22_conflict_fusion(t: Tables) -> DataFrame:
    """What a write does to the row of its label before it: returns it if the contents are equal, fuses both where they are similar, else stores a new row."""
    from pyspark.sql import Window as W

    w = W.partitionBy("label").orderBy("id")
    v = vecs(t).select("id", V.doubles(F.col("vec")).alias("vec"))
    m = t("memories").where(F.col("label").isNotNull() & F.col("content").isNotNull()).select("id", "label", "content").join(v, "id", "left")
    x = m.withColumn("old", F.lag(F.struct("id", "content", "vec")).over(w)).where(F.col("old").isNotNull())
    near = F.coalesce(F.round(V.cosine(F.col("old.vec"), F.col("vec")), 9) >= 0.85, F.lit(False))
    action = F.when(F.trim("old.content") == F.trim("content"), "existing").when(near, "fused").otherwise("stored")
    x = x.select(F.col("old.id").alias("old_id"), F.col("id").alias("new_id"), "label", action.alias("action"), X.fuse(F.col("old.content"), F.col("content")).alias("both"))
    fused = F.col("action") == "fused"
    return x.select("old_id", "new_id", "label", "action", F.when(fused, F.col("both")).alias("content"), F.when(fused, "conflict_fusion").alias("reason"))


_AUTO = "with recursive " + C.VECTORS + ", sp as (select a.id a, b.id b, round(list_cosine_similarity(a.e, b.e), 6) sim from vec a join vec b on a.id <> b.id), sm as (select * from (select *, row_number() over (partition by a order by sim desc, b) k from sp) where k <= 64 and sim > 0.7), pr as (select least(a, b) a, greatest(a, b) b, max(sim) sim from sm group by 1, 2)"


@R.add(_AUTO + f""" select a as s, b as t, case when regexp_matches(lower(concat_ws(' ', x.content, y.content)), '{"|".join(X.CAUSAL_WORDS)}') then 'causal' when regexp_matches(lower(concat_ws(' ', x.content, y.content)), '{"|".join(X.SUPERSEDING_WORDS)}') then 'supersedes' else 'similar' end as edge_type,
  sim as weight from pr join memories x on x.id = a join memories y on y.id = b""")
def dr23_auto_connect(t: Tables) -> DataFrame:
    """Edges from every row to those of its 64 nearest with a cosine above 0.7, typed by their words: what writing the rows one by one would connect."""
    words = t("memories").withColumn("words", X.edge_words(F.col("content")))
    p = links_above(search.usable(words, "id", "embedding", DIM, "words"), DIM, 64, 0.7, "words")
    return p.select(F.col("a").alias("s"), F.col("b").alias("t"), X.edge_type_of_words(F.col("a_carried"), F.col("b_carried")).alias("edge_type"), F.col("sim").alias("weight"))


_WEAK = ", wd as (select s, t, edge_type, case when weight > 0.05 then greatest(0, weight - 0.01) else weight end weight from sg), pn as (select * from wd where weight >= 0.05 - 1e-12 or edge_type = 'supersedes')"
_CYCLE = "with recursive " + C.UPSERTED + ACTIVE + _STRONG + _WEAK + _TOP.replace(", sp as", ", tp as").replace("from sp)", "from tp)") + """, nw as (select least(query_id, id) s, greatest(query_id, id) t, max(round(0.3 * sim, 3)) weight from sm where sim between 0.3 and 0.95 group by 1, 2),
  br as (select * from nw where not exists (select 1 from pn where least(pn.s, pn.t) = nw.s and greatest(pn.s, pn.t) = nw.t)),
  e as (select s, t from pn where weight >= 0.05 and edge_type <> 'derived_from' union all select s, t from br where weight >= 0.05), eb as (select s src, t dst from e union select t, s from e),
  rr(id, root) as (select distinct src, src from eb union select b.dst, rr.root from rr join eb b on b.src = rr.id where rr.root < b.dst), cc as (select id, min(root) root from rr group by 1),
  ig as (select min(id) anchor, count(*) size from cc group by root having count(*) >= 10), ix as (select * from ig where anchor not in (select source_memory_id from dream_insights where source_memory_id is not null and created_at >= timestamp '2025-12-30 18:00:00') order by size desc, anchor limit 50)"""


@R.add(_CYCLE + " select 'strengthened' as phase, count(*) as n, round(sum(weight - old), 6) as amount from sg where weight <> old union all select 'edges', count(*), round(sum(weight), 6) from pn union all select 'bridges', count(*), round(sum(weight), 6) from br union all select 'insights', count(*), round(sum(least(size / 10.0, 1.0)), 6) from ix")
def dr25_dream_cycle(t: Tables) -> DataFrame:
    """One whole cycle, phase after phase on the state that the one before left: walks and strengthening, weakening and
    pruning, bridges, insights (at most fifty, none of an anchor of the last six hours)."""
    s = D.nrem(start(t), active_pairs(t))
    edges = s.edges
    hits = semantic(t).select("query_id", "id", F.col("score").alias("sim"))
    new = shared_checkpoint(D.bridges(hits, edges))
    s = D.State(s.memories, edges.unionByName(new, allowMissingColumns=True), s.history)
    found = D.insights(D.communities(s.edges), seen=recent_anchors(t), most=50)
    row = lambda df, phase, amount: df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), 6).alias("amount")).select(F.lit(phase).alias("phase"), "n", "amount")
    parts = (row(s.history, "strengthened", F.col("new_weight") - F.col("old_weight")), row(edges, "edges", F.col("weight")), row(new, "bridges", F.col("weight")), row(found, "insights", F.col("confidence")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Sequential by nature ------------------------------------------------------------------------------------------------


@R.add()
def rt9_diversified(t: Tables) -> DataFrame:
    """Relevant rows in the order of maximal marginal relevance."""
    hits = relevant(t).select("query_id", "id", "relevance").join(vecs(t), "id")
    return Q.mmr(hits, 10, 0.7)


@R.add()
def tx15_sentence_chunks(t: Tables) -> DataFrame:
    return Q.sentence_chunks(t("documents"), "doc_id", "text")


def fact_notes(t: Tables) -> DataFrame:
    """(doc_id, source, note): what is known of each document as a markdown note, one heading and four bullets."""
    d = t("documents").where(F.col("doc_kind").isNotNull() & F.col("n_chars").isNotNull())
    lines = (F.concat(F.lit("## **"), F.col("doc_kind"), F.lit("**")), F.concat(F.lit("- **Size**: "), F.col("n_chars"), F.lit(" KB")), F.lit("- Note: it takes 5 km"), F.concat(F.lit("- Stored Under: Ann Lee "), F.col("doc_id")), F.lit("- **Mood**: plain prose"), F.concat(F.lit("**Source ** - "), F.col("doc_id"), F.lit(" GB; and more")))
    return d.select("doc_id", "source", F.concat_ws("\n", *lines).alias("note"))


FACTS_SQL = """with d as (select doc_id, source, doc_kind k, n_chars n from documents where doc_kind is not null and n_chars is not null),
  f as (select doc_id, source, 0 as no, k entity, 'Size' predicate, n || ' KB' as value, k || ', Size: ' || n || ' KB' as text from d
  union all select doc_id, source, 1, k, 'Stored Under', 'Ann Lee ' || doc_id, k || ', Stored Under: Ann Lee ' || doc_id from d union all select doc_id, source, 2, 'Source', null, doc_id || ' GB', 'Source: ' || doc_id || ' GB' from d)"""


@R.add(FACTS_SQL + " select doc_id, no, entity, predicate, value, text from f")
def tx16_markdown_facts(t: Tables) -> DataFrame:
    """Atomic facts of markdown notes; bullets without a measure or a name and empty keys state nothing."""
    return fact_notes(t).select("doc_id", F.posexplode(Q.markdown_facts(F.col("note"))).alias("no", "f")).select("doc_id", "no", "f.*")
