"""Vector kernels, search, text functions and ranking over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import scoring as S
from recallgrid.functions import text as X
from recallgrid.functions import vectors as V
from recallgrid.operators import search
from recallgrid.operators.index import bm25
from recallgrid.plans import ctes as C
from recallgrid.plans.base import Registry, Tables

R = Registry()
DIM = 64


def now():
    return F.lit("2025-12-31 00:00:00").cast("timestamp_ntz")


def vecs(t: Tables) -> DataFrame:
    return search.usable(t("memories"), "id", "embedding", DIM)


def asking(t: Tables) -> DataFrame:
    """The stated query set of searches: the rows whose id is divisible by 100."""
    return vecs(t).where(F.col("id") % 100 == 0)


_HITS = "with " + C.VECTORS + """, p as (select a.id query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) sim from vec a join vec b on a.id <> b.id where a.id % 100 = 0),
  h as (select *, row_number() over (partition by query_id order by sim desc, id) rank from p)"""


@R.add(_HITS + " select query_id, id, sim, rank from h where rank <= 10")
def tk1_cosine_top10(t: Tables) -> DataFrame:
    return search.top_k(asking(t), vecs(t), 10, DIM)


@R.add("with " + C.VECTORS + ", p as (select a.id query_id, round(list_cosine_similarity(a.e, b.e), 6) sim from vec a join vec b on a.id <> b.id) select query_id, count(*) as n, min(sim) as least from p where sim >= 0.3 group by 1")
def jn8_similar_above_threshold(t: Tables) -> DataFrame:
    """How many others each row reaches at a threshold: counted per pair of blocks, no list of pairs."""
    return search.similar_counts(vecs(t), DIM, 0.3).withColumnRenamed("id", "query_id")


@R.add("select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= 0.3")
def jn9_query_corpus_join(t: Tables) -> DataFrame:
    e = search.usable(t("embeddings"), "vec_id", "embedding", DIM)
    return search.top_k(e.where(F.col("id") % 100 == 0), e, 1 << 30, DIM, least=0.3).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "sim")


@R.add(_HITS + ", b as (select query_id, max(sim) m from h where rank <= 5 group by 1) select h.query_id, h.id, h.sim from h join b using (query_id) where rank <= case when b.m < 0.5 then 20 else 5 end")
def tk11_adaptive_k(t: Tables) -> DataFrame:
    """Five hits, or twenty where the best of five is weak."""
    from pyspark.sql import Window as W

    hits = search.top_k(asking(t), vecs(t), 20, DIM)
    best = F.max("sim").over(W.partitionBy("query_id"))
    return hits.withColumn("m", best).where(F.col("rank") <= F.when(F.col("m") < 0.5, 20).otherwise(5)).select("query_id", "id", "sim")


_PAIR = "select m.id, p.e a, m.embedding::double[] b from memories m join (select embedding::double[] e from memories where len(embedding) = 64 and list_dot_product(embedding::double[], embedding::double[]) > 0 order by id limit 1) p on true"


def _with_first(t: Tables) -> DataFrame:
    """Every memory's embedding beside that of the first comparable one (a single row)."""
    first = vecs(t).orderBy("id").limit(1).select(V.doubles(F.col("vec")).alias("a"))
    return t("memories").select("id", V.doubles(F.col("embedding")).alias("b")).join(F.broadcast(first))


@R.add("with x as (" + _PAIR + ") select id, round(case when len(b) <> 64 or list_dot_product(case when len(b) = 64 then b else a end, case when len(b) = 64 then b else a end) = 0 then 0 else list_cosine_similarity(a, case when len(b) = 64 then b else a end) end, 6) as sim from x where b is not null")
def vx1_cosine(t: Tables) -> DataFrame:
    return _with_first(t).where(F.col("b").isNotNull()).select("id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("sim"))


@R.add("with x as (" + _PAIR + " where len(m.embedding) = 64) select id, round(list_dot_product(a, b), 6) as dot, round(sqrt(list_dot_product(b, b)), 6) as norm, list_position(b, list_max(b)) - 1 as argmax from x")
def vx2_kernels(t: Tables) -> DataFrame:
    x = _with_first(t).where(F.size("b") == DIM)
    return x.select("id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(V.norm(F.col("b")), 6).alias("norm"), V.argmax(F.col("b")).alias("argmax"))


@R.add("with x as (" + _PAIR + " where len(m.embedding) = 64), y as (select id, list_transform(list_zip(a, b), lambda z: z[1] * z[2]) h, list_concat(b[64:64], b[1:63]) r from x) select id, round(list_sum(h), 6) as bound, round(r[1], 6) as first, round(r[64], 6) as last from y")
def vx9_bind_and_permute(t: Tables) -> DataFrame:
    x = _with_first(t).where(F.size("b") == DIM)
    r = V.rotate(F.col("b"), 1)
    return x.select("id", F.round(V.total(V.hadamard(F.col("a"), F.col("b"))), 6).alias("bound"), F.round(F.element_at(r, 1), 6).alias("first"), F.round(F.element_at(r, DIM), 6).alias("last"))


@R.add("with e as (select vec_id, embedding::double[] v from embeddings), q as (select v from e order by vec_id limit 1), s as (select vec_id, 20 * list_cosine_similarity(e.v, q.v) z from e join q on true), x as (select vec_id, exp(z - (select max(z) from s)) p from s) select vec_id, round(p / sum(p) over (), 6) as attention from x")
def vx7_hopfield_attention(t: Tables) -> DataFrame:
    """One step of attention of a pattern store: softmax of 20 times the cosine."""
    e = t("embeddings").select("vec_id", "embedding")
    q = F.broadcast(e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")))
    s = e.join(q).select("vec_id", (20 * V.cosine(F.col("embedding"), F.col("q"))).alias("z"))
    top = s.agg(F.max("z")).first()[0]
    p = s.select("vec_id", F.exp(F.col("z") - top).alias("p"))
    total = p.agg(F.sum("p")).first()[0]
    return p.select("vec_id", F.round(F.col("p") / total, 6).alias("attention"))


@R.add("with e as (select label, vec_id, embedding::double[] v from embeddings), d as (select label, array_agg(v order by vec_id) m from e group by label), q as (select m from d where label = 0) select d.label, round(list_avg(list_transform(q.m, lambda x: list_max(list_transform(d.m, lambda y: list_cosine_similarity(x, y))))), 6) as score from d join q on true")
def vx4_late_interaction(t: Tables) -> DataFrame:
    """Max-sim of token matrices: the vectors of a label stand for a document's tokens."""
    d = t("embeddings").groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("m"))
    q = F.broadcast(d.where(F.col("label") == 0).select(F.col("m").alias("q")))
    return d.join(q).select("label", F.round(V.max_sim(F.col("q"), F.col("m")), 6).alias("score"))


@R.add("""with w as (select doc_id, list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: x) w from documents where text is not null),
  x as (select doc_id, unnest(w) tok, unnest(range(len(w))) i from w), p as (select doc_id, (('0x' || substr(md5(tok || ':' || j), 1, 6))::bigint % 64) dim, 1 / (1 + 0.1 * i) v from x, (select unnest(range(3)) j)),
  s as (select doc_id, dim, sum(v) v from p group by all), n as (select doc_id, sqrt(sum(v * v)) l from s group by 1) select s.doc_id, s.dim, round(s.v / n.l, 6) as value from s join n using (doc_id)""")
def vx14_hash_embedding(t: Tables) -> DataFrame:
    """Hash embedding in long form: word i adds 1 / (1 + i / 10) at three hashed places of 64; unit length."""
    toks = t("documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(X.words(F.col("text"))).alias("i", "tok"))
    place = lambda j: F.conv(F.substring(F.md5(F.concat("tok", F.lit(f":{j}"))), 1, 6), 16, 10).cast("long") % DIM
    p = toks.select("doc_id", F.explode(F.array(*[place(j) for j in range(3)])).alias("dim"), (1 / (1 + 0.1 * F.col("i"))).alias("v"))
    s = p.groupBy("doc_id", "dim").agg(F.sum("v").alias("v"))
    n = s.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    return s.join(n, "doc_id").select("doc_id", "dim", F.round(F.col("v") / F.col("l"), 6).alias("value"))


@R.add("""with d as (select doc_id, count(*) over () n, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null), x as (select distinct doc_id, n, unnest(w) term from d)
  select term, count(*) as df, round(ln((max(n) + 1.0) / (count(*) + 1.0)) + 1, 6) as idf from x group by term""")
def vx15_idf(t: Tables) -> DataFrame:
    d = t("documents").where(F.col("text").isNotNull())
    n = d.count()
    x = d.select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))
    return x.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.round(F.log((n + 1.0) / (F.col("df") + 1.0)) + 1, 6))


# Text ----------------------------------------------------------------------------------------------------------------

_STOP = "'" + "','".join(X.STOPWORDS) + "'"


@R.add(f"select item_id, list_filter(regexp_extract_all(lower(item_text), '[a-z0-9_][a-z0-9_/\\-]+')[1:24], lambda t: length(regexp_replace(t, '[^a-z0-9]', '', 'g')) >= 2 and t not in ({_STOP}))[1:12] as tokens from eval_items where item_text is not null")
def tx1_query_tokens(t: Tables) -> DataFrame:
    return t("eval_items").where(F.col("item_text").isNotNull()).select("item_id", X.query_tokens(F.col("item_text")).alias("tokens"))


_BM = """with d as (select doc_id id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null), n as (select count(*)::double n, avg(len(w)) a from d),
  q as (select distinct item_id query_id, unnest(regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+')) term from eval_items where item_text is not null),
  tf as (select id, dl, term, count(*) tf from (select id, len(w) dl, unnest(w) term from d) where term in (select term from q) group by all), df as (select term, count(*) df from tf group by 1),
  sc as (select q.query_id, tf.id, sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / n.a))) score from q join tf using (term) join df using (term), n group by 1, 2)"""


@R.add(_BM + ", r as (select query_id, id, round(score, 6) score, row_number() over (partition by query_id order by round(score, 6) desc, id) rank from sc) select * from r where rank <= 20")
def tx2_bm25(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    terms = t("eval_items").where(F.col("item_text").isNotNull()).select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(X.words(F.col("item_text")))).alias("term"))
    s = bm25(terms, t("documents"), "doc_id", "text").withColumn("score", F.round("score", 6))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= 20)


@R.add(_BM.replace("sum(ln(1", "count(*) k, sum(ln(1") + """, qn as (select query_id, count(*) n from q group by 1), st as (select distinct sc.query_id from sc join qn using (query_id) where k = n), kept as (select sc.* from sc join qn using (query_id) where k = n or query_id not in (select query_id from st)),
  r as (select query_id, id, round(score, 6) score, row_number() over (partition by query_id order by round(score, 6) desc, id) rank from kept) select query_id, id, score, rank from r where rank <= 20""")
def tx2_bm25_all_then_any(t: Tables) -> DataFrame:
    """BM25 over the documents that hold all words of a query, over those that hold any where there are none."""
    from pyspark.sql import Window as W

    terms = t("eval_items").where(F.col("item_text").isNotNull()).select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(X.words(F.col("item_text")))).alias("term"))
    s = bm25(terms, t("documents"), "doc_id", "text", all_first=True).withColumn("score", F.round("score", 6))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= 20)


@R.add("""with q as (select item_id, list_distinct(regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+')) w from eval_items where item_text is not null), a as (select list_distinct(regexp_extract_all(lower(answer), '[\\p{L}\\p{N}]+')) w, item_id from eval_items where answer is not null)
  select item_id, round(len(list_intersect(a.w, q.w)) / len(a.w)::double, 6) as overlap from q join a using (item_id) where len(a.w) > 0""")
def tx3_lexical_overlap(t: Tables) -> DataFrame:
    i = t("eval_items").where(F.col("item_text").isNotNull() & F.col("answer").isNotNull())
    a, q = X.words(F.col("answer")), X.words(F.col("item_text"))
    return i.where(F.size(a) > 0).select("item_id", F.round(X.overlap(a, q), 6).alias("overlap"))


@R.add()
def tx5_entities(t: Tables) -> DataFrame:
    """Without SQL: word borders next to accented letters differ in the two engines; tests hold it against Python's."""
    return t("memories").where(F.col("content").isNotNull()).select("id", X.entities(F.col("content")).alias("entities"))


_CUES = "case " + " ".join(f"when contains(lower(content), '{c}') then {s}" for c, s in X.TIME_CUES) + " end"


@R.add(f"select turn_id, ({_CUES})::bigint as window_s from turns where content is not null")
def tx7_time_cues(t: Tables) -> DataFrame:
    return t("turns").where(F.col("content").isNotNull()).select("turn_id", X.time_window(F.col("content")).alias("window_s"))


_INTENT = "case " + " ".join(f"when regexp_matches(lower(content), '{'|'.join(f'({p})' for p in ps).replace(chr(39), chr(39) * 2)}') then '{n}'" for n, ps in X.INTENTS) + " else 'general' end"


@R.add(f"select turn_id, {_INTENT} as intent from turns where content is not null")
def tx8_intent(t: Tables) -> DataFrame:
    return t("turns").where(F.col("content").isNotNull()).select("turn_id", X.intent(F.col("content")).alias("intent"))


@R.add("select id, case when label is null or label = '' then 0.0::double when contains(label, '::afe::C') or contains(label, '::api::C') or label like 'synthesized:%' or label like 'preference:%' then 1.0 when contains(label, '::afe::A') then 0.8 else 0.7 end::double as affinity from memories")
def tx9_intent_affinity(t: Tables) -> DataFrame:
    return t("memories").select("id", X.intent_affinity(F.lit("preference"), F.col("label")).alias("affinity"))


_RES = "'" + "','".join(X.RESERVED_SEGMENTS) + "'"


@R.add(f"select id, coalesce(list_filter(string_split(label, ':'), lambda s: s <> '' and s not in ({_RES}) and not regexp_full_match(s, '[0-9]+') and not regexp_full_match(s, '[ABC][0-9]'))[1], '') as session from memories")
def tx10_label_session(t: Tables) -> DataFrame:
    return t("memories").select("id", X.label_session(F.col("label")).alias("session"))


@R.add(r"select id, list_sort(list_distinct(list_transform(regexp_extract_all(content, '\$?\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')))) as numbers from memories where content is not null")
def tx11_numeric_tokens(t: Tables) -> DataFrame:
    return t("memories").where(F.col("content").isNotNull()).select("id", X.numeric_tokens(F.col("content")).alias("numbers"))


_MARKED = "trim(" + "replace(" * len(X.MARKERS) + "old_content" + "".join(f", '{m}', '')" for m in X.MARKERS) + ")"
_NEGATED = "list_has_any(regexp_split_to_array(lower({}), '\\s+'), [" + ", ".join("'" + n.replace("'", "''") + "'" for n in X.NEGATIONS) + "])"


@R.add(rf"""with o as (select id, {_MARKED} o, new_content n from memory_revisions where old_content is not null and new_content is not null),
  x as (select id, o, n, list_sort(list_distinct(regexp_extract_all(o, '\d+\.?\d*'))) a, list_sort(list_distinct(regexp_extract_all(n, '\d+\.?\d*'))) b, list_sort(list_distinct(regexp_extract_all(o, '{X.DATE}'))) c, list_sort(list_distinct(regexp_extract_all(n, '{X.DATE}'))) d from o)
  select id, a <> b and len(a) > 0 and len(b) > 0 as numbers, {_NEGATED.format("o")} <> {_NEGATED.format("n")} as negation, c <> d and len(c) > 0 and len(d) > 0 as dates, o <> trim(n) as text from x""")
def tx12_content_differs(t: Tables) -> DataFrame:
    """The four tests of whether a revision says something else; any of them makes it differ."""
    r = t("memory_revisions").where(F.col("old_content").isNotNull() & F.col("new_content").isNotNull())
    return r.select("id", X.difference(F.col("old_content"), F.col("new_content")).alias("d")).select("id", "d.*")


@R.add("select id, case when regexp_matches(lower(concat_ws(' ', old_content, new_content)), '" + "|".join(X.CAUSAL_WORDS) + "') then 'causal' when regexp_matches(lower(concat_ws(' ', old_content, new_content)), '" + "|".join(X.SUPERSEDING_WORDS) + "') then 'supersedes' else 'similar' end as edge_type from memory_revisions")
def tx13_edge_type(t: Tables) -> DataFrame:
    return t("memory_revisions").select("id", X.edge_type(F.col("old_content"), F.col("new_content")).alias("edge_type"))


@R.add(r"""with x as (select id, trim(regexp_replace(old_content, '\[SUPERSEDED\]|\[UPDATED TO\]|\[CANONICAL\]|\[PREVIOUSLY\]', '', 'g')) o, trim(new_content) n from memory_revisions where old_content is not null and new_content is not null)
  select id, '[CANONICAL] ' || n || chr(10) || '[PREVIOUSLY] ' || case when length(o) > 1200 then substr(o, 1, 1200) || ' ...[truncated]' else o end as fused from x""")
def tx14_fuse_conflict(t: Tables) -> DataFrame:
    return t("memory_revisions").where(F.col("old_content").isNotNull() & F.col("new_content").isNotNull()).select("id", X.fuse(F.col("old_content"), F.col("new_content")).alias("fused"))


@R.add("""with u as (select conv_id, seq, turn_id, substr(string_split(trim(content), chr(10))[1], 1, 150) line from turns where lower(trim(role)) in ('user', 'usr', 'human') and length(trim(content)) >= 10 and conv_id is not null and seq is not null),
  k as (select *, row_number() over (partition by conv_id order by seq desc, turn_id desc) k from u) select conv_id, string_agg(line, ' | ' order by seq, turn_id) as summary from k where k <= 8 group by conv_id""")
def tx21_session_summary(t: Tables) -> DataFrame:
    """The first lines of a conversation's last eight user turns."""
    from pyspark.sql import Window as W

    c = F.trim("content")
    u = t("turns").where(F.lower(F.trim("role")).isin("user", "usr", "human") & (F.char_length(c) >= 10) & F.col("conv_id").isNotNull() & F.col("seq").isNotNull())
    u = u.select("conv_id", "seq", "turn_id", F.substring(F.element_at(F.split(c, "\n"), 1), 1, 150).alias("line"))
    last = u.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("turn_id")))).where(F.col("k") <= 8)
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "turn_id", "line"))), lambda x: x["line"]), " | ").alias("summary"))


@R.add("""select turn_id, case lower(trim(role)) when 'user' then 'user-msg' when 'assistant' then 'asst-msg' else 'other-msg' end as label, case lower(trim(role)) when 'user' then 'Q: ' || substr(content, 1, 500) when 'assistant' then 'A: ' || substr(content, 1, 500)
  else substr(content, 1, 2000) end as text from turns where content is not null and length(trim(content)) >= 5""")
def tx22_archive_turns(t: Tables) -> DataFrame:
    role, c = F.lower(F.trim("role")), F.col("content")
    pick = lambda u, a, o: F.when(role == "user", u).when(role == "assistant", a).otherwise(o)
    return t("turns").where(F.char_length(F.trim(c)) >= 5).select("turn_id", pick(F.lit("user-msg"), F.lit("asst-msg"), F.lit("other-msg")).alias("label"), pick(F.concat(F.lit("Q: "), F.substring(c, 1, 500)), F.concat(F.lit("A: "), F.substring(c, 1, 500)), F.substring(c, 1, 2000)).alias("text"))


@R.add("""with p as (select u.conv_id, u.turn_id, u.content uc, a.content ac from turns u join turns a on a.conv_id = u.conv_id and a.seq = u.seq + 1 where lower(trim(u.role)) = 'user' and lower(trim(a.role)) = 'assistant' and length(trim(u.content)) >= 20 and length(trim(a.content)) >= 20)
  select turn_id, 'Topic: ' || trim(substr(trim(substr(uc, 1, 300)), 1, 200)) || chr(10) || 'Result: ' || substr(trim(substr(ac, 1, 500)), 1, 300) as fact from p""")
def tx23_turn_facts(t: Tables) -> DataFrame:
    u, a = (t("turns").where((F.lower(F.trim("role")) == r) & (F.char_length(F.trim("content")) >= 20)) for r in ("user", "assistant"))
    u = u.select("conv_id", (F.col("seq") + 1).alias("seq"), "turn_id", F.col("content").alias("uc"))
    p = u.join(a.select("conv_id", "seq", F.col("content").alias("ac")), ["conv_id", "seq"])
    cut = lambda c, n, m: F.substring(F.trim(F.substring(c, 1, n)), 1, m)
    return p.select("turn_id", F.concat(F.lit("Topic: "), F.trim(cut(F.col("uc"), 300, 200)), F.lit("\nResult: "), cut(F.col("ac"), 500, 300)).alias("fact"))


@R.add("select id, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, md5(label) as key, substr(sha256('[' || id || ']'), 1, 12) as print from memories where label is not null")
def tx24_slugs_and_keys(t: Tables) -> DataFrame:
    c = F.col("label")
    return t("memories").where(c.isNotNull()).select("id", X.slug(c).alias("slug"), F.md5(c).alias("key"), F.substring(F.sha2(F.concat(F.lit("["), F.col("id").cast("string"), F.lit("]")), 256), 1, 12).alias("print"))


# Scores --------------------------------------------------------------------------------------------------------------

_AGE = f"greatest(0.0, coalesce(epoch_us({C.NOW}) - epoch_us(created_at), 0) / 1e6)"


@R.add(f"select id, round(exp(-ln(2) * ({_AGE} / 3600) / 168), 6) as score from memories")
def dt1_temporal_score(t: Tables) -> DataFrame:
    return t("memories").select("id", F.round(S.temporal_score(now(), F.col("created_at")), 6).alias("score"))


@R.add(f"select id, round(greatest(0.1, least(2.0, case when salience is null or salience = 0 then 1 else salience end * exp(-0.03 * {_AGE} / 86400) + ln(1 + coalesce(access_count, 0)) * 0.05)), 6) as salience from memories")
def dt2_effective_salience(t: Tables) -> DataFrame:
    return t("memories").select("id", F.round(S.effective_salience(F.col("salience"), F.col("access_count"), F.col("created_at"), now()), 6).alias("salience"))


@R.add("with " + C.BOTH + f""", d as (select src, count(*) n from bw group by 1) select m.id, access_count + 1 as access_count, round(greatest(0.1, least(3.0, coalesce(salience, 1) * exp(-0.03 * greatest(0.0, coalesce(epoch_us({C.NOW}) - epoch_us(last_accessed), 0) / 1e6) / 86400)
  + 0.04 * ln(2 + access_count) + 0.02 * ln(1 + coalesce(d.n, 0)))), 6) as salience from memories m left join d on d.src = m.id""")
def dt3_touch(t: Tables) -> DataFrame:
    """The memories after one access of each: a new table, the read itself writes nothing."""
    from recallgrid.operators import edges as E

    d = E.both_ways(E.pair_weights(E.clean_edges(t("connections")))).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    m = t("memories").select("id", "salience", "last_accessed", "access_count").join(d, "id", "left")
    idle = F.greatest(F.lit(0.0), F.coalesce(S.seconds_between(now(), F.col("last_accessed")), F.lit(0.0))) / 86400
    return m.select("id", (F.col("access_count") + 1).alias("access_count"), F.round(S.touched_salience(F.col("salience"), F.col("access_count"), idle, F.coalesce("n", F.lit(0))), 6).alias("salience"))


@R.add("select source_memory_id as id, count(*) as n, round(1 / (1 + exp(-(0.5 * ln(1 + count(*)) + 1.2 * avg(confidence)))), 6) as belief from dream_insights where source_memory_id is not null and confidence is not null group by 1")
def mt1_confidence(t: Tables) -> DataFrame:
    g = t("dream_insights").where(F.col("source_memory_id").isNotNull() & F.col("confidence").isNotNull()).groupBy(F.col("source_memory_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"))
    return g.select("id", "n", F.round(S.confidence(F.col("n"), F.col("c"), F.lit(0.0)), 6).alias("belief"))
