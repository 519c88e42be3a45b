"""Point reads, keyed vector writes, the facade of recall and further kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import scoring as S
from recallgrid.functions import text as X
from recallgrid.functions import vectors as V
from recallgrid.operators import hopfield
from recallgrid.operators import search
from recallgrid.plans import ctes as C
from recallgrid.plans import retrieval as T
from recallgrid.plans.base import Registry, Tables
from recallgrid.plans.extended import multi_signal
from recallgrid.plans.vectors_text import DIM, asking, now, vecs

R = Registry()


def point_get(t: Tables, ids: list[int], with_vector: bool = False) -> DataFrame:
    """The rows of some ids, pushed down to the scan; the vector is read only if it is asked for."""
    cols = ["id", "label", "content", *(["embedding"] if with_vector else [])]
    return t("memories").where(F.col("id").isin(ids)).select(*cols)


@R.add("select id, label, len(embedding) as dim, round(embedding[1], 5) as first from memories where id in (100, 200, 300, -1)")
def src2_point_get(t: Tables) -> DataFrame:
    return point_get(t, [100, 200, 300, -1], True).select("id", "label", F.size("embedding").cast("long").alias("dim"), F.round(F.get("embedding", F.lit(0)), 5).alias("first")).withColumn("dim", F.when(F.col("dim") >= 0, F.col("dim")))


@R.add("with " + C.VECTORS + """, u as (select vec_id id, embedding::double[] e from embeddings where len(embedding) = 64) select coalesce(u.id, v.id) as id, u.id is not null as replaced, round(list_sum(coalesce(u.e, v.e)), 5) as total, round(coalesce(u.e, v.e)[64], 5) as last from vec v full join u on u.id = v.id""")
def snk9_upsert_vectors(t: Tables) -> DataFrame:
    """A keyed table of vectors after an upsert: vectors of known keys are replaced, others added, the rest stays."""
    old = vecs(t).select("id", V.doubles(F.col("vec")).alias("old"))
    new = t("embeddings").where(F.size("embedding") == DIM).select(F.col("vec_id").cast("long").alias("id"), V.doubles(F.col("embedding")).alias("new"))
    v = old.join(new, "id", "full").select("id", F.col("new").isNotNull().alias("replaced"), F.coalesce("new", "old").alias("v"))
    return v.select("id", "replaced", F.round(V.total(F.col("v")), 5).alias("total"), F.round(F.element_at("v", DIM), 5).alias("last"))


_FACADE = T._REL + T._SUP_NOW + T._ADJUST + """, fac as (select * from (select query_id, id, relevance score, row_number() over (partition by query_id order by relevance desc, id) k from adj) where k <= 30),
  sg as (select s.*, m.last_accessed la, coalesce(m.access_count, 0) n, p.a is not null linked from fac s join memories m on m.id = s.id left join pw p on p.a = least(s.query_id, s.id) and p.b = greatest(s.query_id, s.id)),
  sw as (select *, max(la) over (partition by query_id) ref, max(n) over (partition by query_id) top from sg),
  sx as (select query_id, id, round(0.5 * score + 0.2 * exp(-ln(2) * coalesce((epoch_us(ref) - epoch_us(la)) / 1e6, 0) / 3600 / 24) + 0.15 * case when top > 0 then log2(1 + n) / log2(1 + top) else 0 end + 0.15 * case when linked then 0.5 else 0 end, 9) as score from sw)"""


@R.add(_FACADE + " select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) rank from sx) where rank <= 10")
def rt16_facade_recall(t: Tables) -> DataFrame:
    """The facade: three times as many hits of the whole retrieval, put in order by several signals, the best ten."""
    hits = T.recall(t, 30).select("query_id", "id", F.col("relevance").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return multi_signal(t, hits).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= 10)


@R.add("with " + C.VECTORS + ", s as (select id, list_transform(e[1:4], lambda x: 1 / (1 + exp(-x))) w from vec) select id, round(w[1] / list_sum(w), 6) as semantic, round(w[2] / list_sum(w), 6) as temporal, round(w[3] / list_sum(w), 6) as frequency, round(w[4] / list_sum(w), 6) as graph from s")
def vx11_context_weights(t: Tables) -> DataFrame:
    """Weights of the four signals from a context vector: sigmoids of its first four numbers, scaled to sum 1."""
    w = F.transform(F.slice(V.doubles(F.col("vec")), 1, 4), S.sigmoid)
    x = vecs(t).select("id", w.alias("w")).withColumn("total", V.total(F.col("w")))
    return x.select("id", *[F.round(F.element_at("w", i + 1) / F.col("total"), 6).alias(n) for i, n in enumerate(("semantic", "temporal", "frequency", "graph"))])


@R.add("with e as (select vec_id // 20 as doc, vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) n from embeddings), r as (select *, row_number() over (partition by doc order by n desc, vec_id) p, count(*) over (partition by doc) k from e), i as (select unnest(range(32)) i) select r.doc, i.i as place, r.vec_id from r, i where r.p = i.i % least(r.k, 32) + 1")
def vx5_top_tokens(t: Tables) -> DataFrame:
    """The 32 longest token vectors of each document, short documents repeated from their first token on; twenty vectors stand for one."""
    e = t("embeddings").select(F.floor(F.col("vec_id") / 20).cast("long").alias("doc"), "vec_id", F.round(V.norm(V.doubles(F.col("embedding"))), 6).alias("n"))
    ranked = e.withColumn("p", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("n"), "vec_id"))).where(F.col("p") <= 32)
    sizes = ranked.groupBy("doc").agg(F.max("p").alias("k"))
    places = ranked.join(sizes, "doc").select("doc", "vec_id", F.explode(F.sequence(F.col("p") - 1, F.lit(31), F.col("k"))).alias("place"))
    return places.select("doc", F.col("place").cast("long").alias("place"), "vec_id")


@R.add("""with e as (select vec_id, vec_id // 10 as seq, (vec_id % 10)::int p, embedding::double[] v from embeddings), u as (select *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) n from e),
  r as (select seq, p, list_concat(n[65 - p : 64], n[1 : 64 - p]) r from u), s as (select seq, i, sum(r[i]) x from r, (select unnest(range(1, 65)) i) group by 1, 2), l as (select seq, sqrt(sum(x * x)) l from s group by 1) select s.seq, s.i::bigint as i, round(s.x / l.l, 6) as value from s join l using (seq)""")
def vx9_sequences(t: Tables) -> DataFrame:
    """Sequences of ten vectors each as one: every vector rotated by its place, summed up and scaled to length 1."""
    u = t("embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq"), (F.col("vec_id") % 10).alias("p"), V.normalize(V.doubles(F.col("embedding"))).alias("v"))
    at = F.posexplode("v").alias("j", "x")
    moved = u.select("seq", "p", at).select("seq", (F.pmod(F.col("j") + F.col("p"), F.lit(DIM)) + 1).cast("long").alias("i"), "x")
    s = moved.groupBy("seq", "i").agg(F.sum("x").alias("x"))
    length = s.groupBy("seq").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return s.join(length, "seq").select("seq", "i", F.round(F.col("x") / F.col("l"), 6).alias("value"))


@R.add()
def vx8_associative_recall(t: Tables) -> DataFrame:
    """The stored vector that each asked row settles on, with confidence, entropy and steps."""
    e = search.usable(t("embeddings"), "vec_id", "embedding", DIM).withColumn("id", F.col("id").cast("long"))
    return hopfield.retrieve(e, asking(t), DIM)


@R.add("""with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null), n as (select count(*) n from d), x as (select doc_id, unnest(w) term from d), tf as (select doc_id, term, count(*) tf from x group by all),
  df as (select term, count(*) df from tf group by 1), vo as (select term, ln((n.n + 1.0) / (df + 1.0)) + 1 idf from (select *, row_number() over (order by df desc, term) k from df), n where k <= 10000), v as (select doc_id, term, tf * idf v from tf join vo using (term)),
  l as (select doc_id, sqrt(sum(v * v)) l from v group by 1) select doc_id, term, round(v / l, 6) as value from v join l using (doc_id)""")
def vx15_tfidf_vectors(t: Tables) -> DataFrame:
    """TF-IDF vectors over the 10,000 terms of the most documents, of unit length, in long form."""
    d = t("documents").where(F.col("text").isNotNull())
    tf = d.select("doc_id", F.explode(X.words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    top = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(10_000)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    idf = top.join(F.broadcast(n)).select("term", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))
    v = tf.join(F.broadcast(idf), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("v"))  # at most 10,000 terms
    length = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    return v.join(length, "doc_id").select("doc_id", "term", F.round(F.col("v") / F.col("l"), 6).alias("value"))


_WINDOWS = T._TMP.replace(", tq as", "with tq as", 1).split(",\n  tmp as")[0].replace("select id query_id", "select turn_id query_id").replace("from memories where id % 100 = 0 and content is not null", "from turns where content is not null")


@R.add(_WINDOWS + " select query_id as turn_id, lo, hi from tb")
def tx7_time_windows(t: Tables) -> DataFrame:
    """The time that a text asks for, by its first date or cue."""
    b = t("turns").where(F.col("content").isNotNull()).select("turn_id", X.time_bounds(F.col("content"), now()).alias("b")).where(F.col("b").isNotNull())
    return b.select("turn_id", F.col("b.lo").cast("timestamp_ntz").alias("lo"), F.col("b.hi").cast("timestamp_ntz").alias("hi"))


@R.add(f"select id from memory_revisions where created_at >= {C.NOW} - interval 7 days")
def dr6_history_retention(t: Tables) -> DataFrame:
    """History that stays: that of the last seven days."""
    return t("memory_revisions").where(F.col("created_at") >= F.lit("2025-12-24 00:00:00").cast("timestamp_ntz")).select("id")
