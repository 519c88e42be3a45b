"""Multi-channel retrieval: channels, weighted reciprocal-rank fusion, relevance, neighbours, supersession, evaluation.

The queries are the rows of ``memories`` whose id is divisible by 100; every channel answers (query_id, id, rank).
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import scoring as S
from recallgrid.functions import text as X
from recallgrid.operators import edges as E
from recallgrid.operators import graph as G
from recallgrid.operators import search
from recallgrid.operators.index import bm25_top_k, share_top_k
from recallgrid.operators.skew import shared_checkpoint
from recallgrid.plans import ctes as C
from recallgrid.plans.base import Registry, Tables
from recallgrid.plans.vectors_text import DIM, asking, now, vecs

R = Registry()
POOL = 50


def semantic(t: Tables, k: int = POOL) -> DataFrame:
    return search.top_k(asking(t), vecs(t), k, DIM).select("query_id", "id", F.lit("semantic").alias("channel"), "rank", F.col("sim").alias("score"))


def _ranked(scored: DataFrame, channel: str, k: int = POOL) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "id", F.lit(channel).alias("channel"), "rank", "score")


def lexical(t: Tables, k: int = POOL) -> DataFrame:
    """BM25 with the query row's label as text."""
    q = t("memories").where((F.col("id") % 100 == 0) & F.col("label").isNotNull())
    terms = q.select(F.col("id").alias("query_id"), F.array_distinct(X.words(F.col("label"))).alias("terms"))
    docs = t("memories").where(F.col("content").isNotNull()).select("id", X.words(F.col("content")).alias("terms"))
    return _ranked(bm25_top_k(terms, docs, k), "bm25", k)


def recent(t: Tables, k: int = POOL) -> DataFrame:
    """The nearest of the 200 newest rows."""
    pool = search.usable(t("memories").where(F.col("created_at").isNotNull()), "id", "embedding", DIM, "created_at").orderBy(F.desc("created_at"), "id").limit(200).select("id", "vec")
    return search.top_k(asking(t), pool, k, DIM).select("query_id", "id", F.lit("recency").alias("channel"), "rank", F.col("sim").alias("score"))


def entity(t: Tables, k: int = POOL) -> DataFrame:
    """Rows by the share of the names in the query row's content that they hold as words."""
    q = t("memories").where((F.col("id") % 100 == 0) & F.col("content").isNotNull()).select(F.col("id").alias("query_id"), X.search_entities(F.col("content")).alias("terms"))
    text = F.lower(F.concat_ws(" ", "label", "content"))
    held = t("memories").where(F.col("content").isNotNull()).select("id", F.regexp_extract_all(text, F.lit(r"([a-z0-9][a-z0-9_\-]+)"), 1).alias("terms"))
    hits = share_top_k(q, held, k).select("query_id", "id", F.round(F.col("held") / F.col("n"), 6).alias("score"))
    return _ranked(hits, "entity", k)


def temporal(t: Tables, k: int = POOL) -> DataFrame:
    """The newest rows of the time that the query row's content asks for; rows and times meet by day."""
    q = t("memories").where((F.col("id") % 100 == 0) & F.col("content").isNotNull()).select(F.col("id").alias("query_id"), X.time_bounds(F.col("content"), now()).alias("b")).where(F.col("b").isNotNull())
    asked = q.select("query_id", "b", F.explode(F.sequence(F.to_date("b.lo"), F.to_date("b.hi"))).alias("day"))
    rows = t("memories").where(F.col("created_at").isNotNull()).select("id", F.col("created_at").cast("timestamp").alias("at"))
    hits = rows.withColumn("day", F.to_date("at")).join(asked, "day").where(F.col("at").between(F.col("b.lo"), F.col("b.hi")) & (F.col("id") != F.col("query_id")))
    return _ranked(hits.select("query_id", "id", F.unix_micros("at").cast("double").alias("score")), "temporal", k)


def associated(t: Tables, k: int = POOL, near: DataFrame | None = None) -> DataFrame:
    """Rows that walks from a query's five nearest reach, by the best of their personalised PageRank; near: the semantic channel."""
    hit = semantic(t, 5) if near is None else near.where(F.col("rank") <= 5)
    hit = shared_checkpoint(hit.select("query_id", "id"))
    walk = G.walks(E.both_ways(E.pair_weights(E.clean_edges(t("connections")))), hit.select("id").distinct()).select("seed", "id", "score")
    found = hit.select("query_id", F.col("id").alias("seed")).join(walk, "seed").where(F.col("id") != F.col("query_id")).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return _ranked(found, "ppr", k)


def fuse(channels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, fused, channels): the sum of the channels' weighted reciprocal ranks."""
    w = F.create_map(*[F.lit(x) for kv in (weights or S.CHANNEL_WEIGHTS).items() for x in kv])
    part = S.rrf(F.col("rank"), F.element_at(w, F.col("channel")))
    return channels.groupBy("query_id", "id").agg(F.sum(part).alias("fused"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.round(part, 9))))).alias("channels"))


_V = "with recursive " + C.VECTORS
_SEM = """, sp as (select a.id query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) score from vec a join vec b on a.id <> b.id where a.id % 100 = 0),
  sem as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from sp) where rank <= 50)"""
_LEX = """, d as (select id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') w from memories where content is not null), n as (select count(*)::double n, avg(len(w)) a from d),
  q as (select distinct id query_id, unnest(regexp_extract_all(lower(label), '[\\p{L}\\p{N}]+')) term from memories where id % 100 = 0 and label is not null),
  tf as (select id, dl, term, count(*) tf from (select id, len(w) dl, unnest(w) term from d) where term in (select term from q) group by all), df as (select term, count(*) df from tf group by 1),
  lp as (select q.query_id, tf.id, round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / n.a))), 6) score from q join tf using (term) join df using (term), n where q.query_id <> tf.id group by 1, 2),
  lex as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from lp) where rank <= 50)"""
_REC = """, pool as (select m.id, v.e from memories m join vec v using (id) where m.created_at is not null order by m.created_at desc, m.id limit 200),
  rp as (select a.id query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) score from vec a join pool b on a.id <> b.id where a.id % 100 = 0),
  rec as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from rp) where rank <= 50)"""
_ENT = r""", qe as (select id query_id, regexp_extract_all(content, '\b[A-Za-z][A-Za-z0-9_\-]{2,}\b') w, regexp_extract_all(content, '\b[A-Za-z0-9_\-]{6,}\b') l from memories where id % 100 = 0 and content is not null),
  qf as (select query_id, l, list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') or regexp_matches(x, '[0-9]') or regexp_matches(x, '[a-z][A-Z]')) e from qe), qg as (select query_id, l, e, list_transform(e, lambda x: lower(x)) f from qf),
  qh as (select query_id, case when len(e) > 0 then list_slice(list_filter(f, lambda x, i: list_position(f, x) = i), 1, 8) else list_distinct(list_transform(list_slice(l, 1, 5), lambda x: lower(x))) end e from qg),
  qt as (select query_id, len(e) n, unnest(e) term from qh), dt as (select id, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', label, content)), '[a-z0-9][a-z0-9_\-]+'))) term from memories where content is not null),
  eh as (select query_id, id, round(count(*)::double / max(n), 6) score from qt join dt using (term) where query_id <> id group by 1, 2), ent as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from eh) where rank <= 50)"""
_CUES = "case " + " ".join(f"when contains(lower(content), '{c}') then {s}" for c, s in X.TIME_CUES) + " end"
_TMP = rf""", tq as (select id query_id, try_cast(nullif(regexp_extract(content, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1), '') as timestamp) d, {_CUES} s from memories where id % 100 = 0 and content is not null),
  tb as (select query_id, case when d is not null then d - interval 1 day else {C.NOW} - to_seconds(s) end lo, case when d is not null then d + interval 1 day when s = 172800 then {C.NOW} - interval 1 day else {C.NOW} end hi from tq where d is not null or s is not null),
  tmp as (select * from (select query_id, id, created_at score, row_number() over (partition by query_id order by created_at desc, id) rank from tb join memories m on m.created_at between lo and hi where id <> query_id) where rank <= 50)"""
_PPR = ", " + C.BOTH + ", h5 as (select query_id, id from sem where rank <= 5), sd as (select distinct id from h5)" + C.walk("sd") + """,
  pa as (select h5.query_id, wk.id, max(wk.s) score from h5 join wk on wk.seed = h5.id where wk.id <> h5.query_id group by 1, 2), ppr as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from pa) where rank <= 50)"""
#: Each channel's table in SQL and its weight.
_CHANNELS = (("semantic", "sem", 1.0), ("bm25", "lex", 0.9), ("recency", "rec", 1.2), ("entity", "ent", 1.0), ("temporal", "tmp", 0.35), ("ppr", "ppr", 0.55))
_ALL = _V + _SEM + _LEX + _REC + _ENT + _TMP + _PPR
_FUSED = _ALL + ", ch as (" + " union all ".join(f"select query_id, id, '{n}' c, {w} / (60 + rank) p from {c}" for n, c, w in _CHANNELS) + "), fu as (select query_id, id, sum(p) fused, string_agg(c, ',' order by c) channels from ch group by 1, 2)"


def channels(t: Tables) -> DataFrame:
    """The six channels of a query: query_id, id, channel, rank, score."""
    near = shared_checkpoint(semantic(t))  # read twice
    return near.unionByName(lexical(t)).unionByName(recent(t)).unionByName(entity(t)).unionByName(temporal(t)).unionByName(associated(t, near=near))


@R.add(_V + _LEX + " select query_id, id, rank, score from lex")
def rt2_lexical_channel(t: Tables) -> DataFrame:
    return lexical(t).select("query_id", "id", "rank", "score")


@R.add(_V + _REC + " select query_id, id, rank, score from rec")
def rt2_recency_channel(t: Tables) -> DataFrame:
    return recent(t).select("query_id", "id", "rank", "score")


@R.add(_V + _ENT + " select query_id, id, rank, score from ent")
def rt2_entity_channel(t: Tables) -> DataFrame:
    return entity(t).select("query_id", "id", "rank", "score")


@R.add(_V + _TMP + " select query_id, id, rank from tmp")
def rt2_temporal_channel(t: Tables) -> DataFrame:
    return temporal(t).select("query_id", "id", "rank")


@R.add(_V + _SEM + _PPR + " select query_id, id, rank, score from ppr")
def rt2_associated_channel(t: Tables) -> DataFrame:
    return associated(t).select("query_id", "id", "rank", "score")


@R.add(_FUSED + " select query_id, id, round(fused, 9) as fused, channels from fu")
def rt3_weighted_rrf(t: Tables) -> DataFrame:
    """The fused score of each candidate and the channels that found it."""
    return fuse(channels(t)).select("query_id", "id", F.round("fused", 9).alias("fused"), F.array_join(F.map_keys("channels"), ",").alias("channels"))


_REL = _FUSED + f""", re as (select fu.query_id, fu.id, round(fused + 0.2 * 0.1 * exp(-ln(2) * (greatest(0.0, coalesce(epoch_us({C.NOW}) - epoch_us(m.created_at), 0) / 1e6) / 3600) / 168)
  + 0.25 * 0.05 * greatest(0.1, least(2.0, case when m.salience is null or m.salience = 0 then 1 else m.salience end * exp(-0.03 * greatest(0.0, coalesce(epoch_us({C.NOW}) - epoch_us(m.created_at), 0) / 1e6) / 86400) + ln(1 + coalesce(m.access_count, 0)) * 0.05)), 6) relevance, m.label, fu.channels
  from fu join memories m on m.id = fu.id where not coalesce(regexp_matches(m.label, '(^|:)u(:p[0-9]+)?$'), false))"""


def relevant(t: Tables) -> DataFrame:
    """Fused candidates with their relevance: time and salience added, echoes of users left out."""
    m = t("memories").select("id", "label", "salience", "access_count", "created_at")
    x = fuse(channels(t)).join(m, "id").where(~X.is_echo(F.col("label")))
    score = F.col("fused") + 0.2 * 0.1 * S.temporal_score(now(), F.col("created_at")) + 0.25 * 0.05 * S.effective_salience(F.col("salience"), F.col("access_count"), F.col("created_at"), now())
    return x.select("query_id", "id", "label", F.round(score, 6).alias("relevance"), F.array_join(F.map_keys("channels"), ",").alias("channels"))


@R.add(_REL + ", k as (select *, row_number() over (partition by query_id order by relevance desc, id) k, count(*) over (partition by query_id) n from re where relevance >= 0.02) select query_id, id, relevance from k where k <= greatest(1, round_even(n * 0.5, 0))")
def flt8_floor_and_percentile(t: Tables) -> DataFrame:
    """Candidates above a floor, of which the better half by rank stays."""
    w = W.partitionBy("query_id")
    x = relevant(t).where(F.col("relevance") >= 0.02)
    x = x.withColumn("k", F.row_number().over(w.orderBy(F.desc("relevance"), "id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.where(F.col("k") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * 0.5, 0))).select("query_id", "id", "relevance")


_KIND = "lower(trim(edge_type)) = 'supersedes' and source_id <> target_id"
_SUP = f", su as (select distinct source_id o, target_id n from connections where {_KIND})"
_SUP_NOW = f", su as (select distinct source_id o, target_id n from connections where {_KIND} and coalesce(valid_from, event_time, created_at, timestamp '1970-01-01 00:00:00') <= {C.NOW} and (valid_to is null or valid_to >= {C.NOW}))"
_ADJUST = """, old as (select distinct re.query_id, su.o id from re join su on su.o = re.id), hit as (select re.query_id, su.n id, max(re.relevance) r from re join su on su.o = re.id group by 1, 2),
  allr as (select query_id, id, relevance, channels from re union all select h.query_id, h.id, 0, 'supersedes' from hit h where not exists (select 1 from re where re.query_id = h.query_id and re.id = h.id)),
  adj as (select a.query_id, a.id, a.channels, round(greatest(case when o.id is not null then greatest(0, a.relevance - 0.5) else a.relevance end, coalesce(h.r + 0.01, 0)), 6) relevance from allr a left join old o on o.query_id = a.query_id and o.id = a.id left join hit h on h.query_id = a.query_id and h.id = a.id)"""


#: A row that more rows than this replace brings them to each query in lists.
MANY, LIST = 1024, 16_384


def superseded(found: DataFrame, edges: DataFrame, most: int | None = None, many: int = MANY, apart: bool = False):
    """found (query_id, id, relevance, channels) after the superseding ``edges`` (o, n): old rows lose half a point, the
    rows that replace them come right before; missing ones are put in.

    most: put in at least the first that the ``most`` best rows of a query hold, not all.  What replaces the same row comes
    in with the same relevance, so that beyond the first ``most`` of it by id none can be among them; of those, only rows
    that are found anyhow are looked up.  A row that a whole table replaces then doesn't bring it to each query.

    Without it, what replaces a row that more than ``many`` replace is put in from lists, where a query is met by no other
    row of the same id; those rows are neither shuffled nor grouped.  With ``apart`` those lists come beside the other rows,
    as what each query gets (query_id, kind, relevance) and the lists (kind, id), which hold the ids of other rows too.
    """
    found, edges = shared_checkpoint(found), shared_checkpoint(edges)  # read several times
    got = found.select("query_id", F.col("id").alias("o"), F.col("relevance").alias("r"))
    old = got.join(edges.select("o").distinct(), "o", "left_semi").select("query_id", F.col("o").alias("id"), F.lit(True).alias("is_old"))
    listed = None
    if most is None:
        hot = edges.groupBy("o").count().where(F.col("count") > many).select("o")
        hits = got.join(edges.join(hot, "o", "left_anti"), "o").select("query_id", F.col("n").alias("id"), "r")
        hits, kinds, reach, met = _hot_hits(found, got, hits, edges.join(hot, "o", "left_semi"))
        listed = None if apart else _listed(kinds, reach, met)
    else:
        placed = edges.withColumn("k", F.row_number().over(W.partitionBy("o").orderBy("n")))
        hits = got.join(placed.where(F.col("k") <= most), "o").select("query_id", F.col("n").alias("id"), "r")
        beyond = found.select("query_id", F.col("id").alias("n")).join(placed.where(F.col("k") > most), "n")
        hits = hits.unionByName(beyond.join(got, ["query_id", "o"]).select("query_id", F.col("n").alias("id"), "r"))
    hit = hits.groupBy("query_id", "id").agg(F.max("r").alias("r"))
    rows = found.join(hit, ["query_id", "id"], "full").join(old, ["query_id", "id"], "left")
    own = F.coalesce("relevance", F.lit(0.0))
    lowered = F.when(F.col("is_old"), F.greatest(F.lit(0.0), own - 0.5)).otherwise(own)
    score = lambda own, r: F.round(F.greatest(own, F.coalesce(r + 0.01, F.lit(0.0))), 6).alias("relevance")
    out = rows.select("query_id", "id", score(lowered, F.col("r")), F.coalesce("channels", F.lit("supersedes")).alias("channels"))
    if apart:
        kind = F.xxhash64("os").alias("kind")
        return out, reach.select("query_id", kind, score(F.lit(0.0), F.col("r"))), kinds.select(kind, F.col("n").alias("id"))
    return out if listed is None else out.unionByName(listed.select("query_id", "id", score(F.lit(0.0), F.col("r")), F.lit("supersedes").alias("channels")))


def _hot_hits(found: DataFrame, got: DataFrame, hits: DataFrame, edges: DataFrame) -> tuple[DataFrame, ...]:
    """``hits`` (query_id, id, r) with those of the ``edges`` (o, n) of hot rows that meet a row found or hit; of the others
    the hot rows that each row replaces (n, os), what each query gets of them (query_id, os, r) and what met (query_id, os, n, r)."""
    kinds = shared_checkpoint(edges.groupBy("n").agg(F.array_sort(F.collect_list("o")).alias("os")))
    sets = kinds.select("os").distinct()
    reach = shared_checkpoint(got.join(sets.select("os", F.explode("os").alias("o")), "o").groupBy("query_id", "os").agg(F.max("r").alias("r")))
    met = found.select("query_id", F.col("id").alias("n")).unionByName(hits.select("query_id", F.col("id").alias("n"))).join(kinds, "n").distinct()
    met = shared_checkpoint(met.join(reach, ["query_id", "os"]))
    return hits.unionByName(met.select("query_id", F.col("n").alias("id"), "r")), kinds, reach, met


def _listed(kinds: DataFrame, reach: DataFrame, met: DataFrame) -> DataFrame:
    """(query_id, r, id): rows that replace the same hot rows form lists; a query gets whole lists, less what met."""
    spread = max(64, int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = kinds.groupBy("os", F.pmod(F.xxhash64("n"), F.lit(kinds.count() // LIST + 1)).alias("part")).agg(F.collect_list("n").alias("ns"))
    lists = lists.select("os", "ns", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt")).repartition(spread, "os", "salt")
    less = met.groupBy("query_id", "os").agg(F.collect_list("n").alias("less"))
    asked = reach.join(less, ["query_id", "os"], "left").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(spread)).cast("int"))
    none = F.array().cast("array<bigint>")
    return asked.repartition(spread, "os", "salt").join(lists, ["os", "salt"]).select("query_id", "r", F.explode(F.array_except("ns", F.coalesce("less", none))).alias("id"))


def superseding_edges(t: Tables, at=None) -> DataFrame:
    """(o, n): what superseded what; with ``at`` only by edges that are valid then."""
    c = t("connections").where((F.lower(F.trim("edge_type")) == "supersedes") & (F.col("source_id") != F.col("target_id")))
    c = c if at is None else c.where(E.valid_at(at))
    return c.select(F.col("source_id").alias("o"), F.col("target_id").alias("n")).distinct()


@R.add(_REL + _SUP + _ADJUST + " select query_id, id, relevance from adj")
def rt10_supersession(t: Tables) -> DataFrame:
    """Superseded rows lose half a point, the rows that replace them come right before; missing ones are put in."""
    return superseded(relevant(t).drop("label"), superseding_edges(t)).select("query_id", "id", "relevance")


def rerank(hits: DataFrame, scorer, head: int = 12) -> DataFrame:
    """The first ``head`` hits (query_id, id, rank, score and what ``scorer`` reads) with 0.65 of a model's score and 0.35 of their own.

    scorer: a Column of the rows' columns, for instance of an Arrow function around a cross-encoder.
    """
    top = F.max("score").over(W.partitionBy("query_id"))
    return hits.where(F.col("rank") <= head).withColumn("score", 0.35 * F.col("score") / top + 0.65 * S.sigmoid(scorer))


def recall(t: Tables, k: int = 10, at=None, floor: float | None = None, keep: float | None = None, lam: float | None = None, scorer=None) -> DataFrame:
    """(query_id, id, relevance, channels, rank): the whole retrieval.

    Six channels are fused, time and salience added, users' echoes left out and superseded rows lowered, by edges that are
    valid at ``at``.  Then, where they are given: only rows of at least ``floor``, the better part ``keep`` of them, a
    model's ``scorer`` (a Column over id, label and content) blended into the head, and an order of maximal marginal
    relevance with ``lam``.
    """
    head = min(POOL, max(3 * k, k, 12))
    most = k if scorer is None else head
    if keep is not None:  # so many that the better part of them has ``most`` rows
        most = ceil((most + 1) / keep) + 1 if keep > 0 else most
    first, edges = relevant(t).drop("label"), superseding_edges(t, now() if at is None else at)
    if lam is not None and keep is None and scorer is None:
        return _diverse(t, *superseded(first, edges, apart=True), k, lam, floor)
    found = superseded(first, edges, most if lam is None else None)
    if floor is not None:
        found = found.where(F.col("relevance") >= floor)
    w = W.partitionBy("query_id")
    order = w.orderBy(F.desc("relevance"), "id")
    if keep is not None:
        found = found.withColumn("k", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(w))
        found = found.where(F.col("k") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * keep, 0))).drop("k", "n")
    if scorer is not None:
        ranked = found.withColumn("rank", F.row_number().over(order)).withColumnRenamed("relevance", "score")
        texts = t("memories").select("id", "label", "content")
        found = rerank(ranked.join(texts, "id"), scorer, head).select("query_id", "id", F.round("score", 6).alias("relevance"), "channels")
    if lam is not None:
        from recallgrid.operators.sequential import mmr

        picked = mmr(found.select("query_id", "id", "relevance").join(vecs(t), "id"), k, lam).where(F.col("rank") <= k)
        return picked.join(found, ["query_id", "id"]).select("query_id", "id", "relevance", "channels", "rank")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "id", "relevance", "channels", "rank")


def _diverse(t: Tables, found: DataFrame, reach: DataFrame, lists: DataFrame, k: int, lam: float, floor: float | None) -> DataFrame:
    from recallgrid.operators.sequential import mmr_of_lists

    found = shared_checkpoint(found)
    fine = F.lit(True) if floor is None else F.col("relevance") >= floor
    picked = mmr_of_lists(found.where(fine).select("query_id", "id", "relevance"), reach.where(fine), lists, vecs(t), k, lam)
    known = found.select("query_id", "id", "channels")
    return picked.join(known, ["query_id", "id"], "left").select("query_id", "id", "relevance", F.coalesce("channels", F.lit("supersedes")).alias("channels"), "rank")


@R.add(_REL + _SUP_NOW + _ADJUST + """, fl as (select *, row_number() over (partition by query_id order by relevance desc, id) k, count(*) over (partition by query_id) n from adj where relevance >= 0.01)
  select query_id, id, relevance, channels, k as rank from fl where k <= greatest(1, round_even(n * 0.75, 0)) and k <= 10""")
def rt1_recall(t: Tables) -> DataFrame:
    """The whole retrieval with a floor and the better three quarters, ten rows a query."""
    return recall(t, 10, floor=0.01, keep=0.75)


@R.add()
def rt1_recall_diverse(t: Tables) -> DataFrame:
    """The whole retrieval in the order of maximal marginal relevance."""
    return recall(t, 10, lam=0.7)


@R.add(_V + _SEM + ", f as (select (query_id // 1000) as grp, id, sum(1.0 / (60 + rank - 1)) s, min(rank) r from sem where rank <= 20 group by 1, 2) select grp, id, round(s, 9) as score, r as best_rank from f")
def rt12_multi_query(t: Tables) -> DataFrame:
    """Several queries as one: ranks count from 0 in the sum; queries of one thousand of ids belong together."""
    x = semantic(t, 20).withColumn("grp", F.floor(F.col("query_id") / 1000))
    return x.groupBy("grp", "id").agg(F.round(F.sum(S.rrf(F.col("rank"), first=0)), 9).alias("score"), F.min("rank").alias("best_rank"))


_BW = C.BOTH


@R.add(_V + _SEM + ", " + C.BOTH + """, h0 as (select query_id, id, score from sem where rank <= 10), h1 as (select h.query_id, b.dst id, max(0.3 * h.score * b.w) score from h0 h join bw b on b.src = h.id where not exists (select 1 from h0 z where z.query_id = h.query_id and z.id = b.dst) group by 1, 2),
  k as (select query_id, id from h0 union all select query_id, id from h1), h2 as (select h.query_id, b.dst id, max(0.3 * h.score * b.w) score from h1 h join bw b on b.src = h.id where not exists (select 1 from k z where z.query_id = h.query_id and z.id = b.dst) group by 1, 2),
  al as (select *, 'direct' via from h0 union all select *, 'neighbor:hop1' from h1 union all select *, 'neighbor:hop2' from h2), rk as (select *, row_number() over (partition by query_id order by round(score, 8) desc, id) rank from al)
  select query_id, id, round(score, 8) as score, via, rank from rk where rank <= 20""")
def rt13_with_neighbours(t: Tables) -> DataFrame:
    """Seeds and the rows one and two edges away, at 0.3 of the score before times the weight, the best over all parents; twenty a query."""
    return with_neighbours(semantic(t, 10).select("query_id", "id", "score"), E.both_ways(E.pair_weights(E.clean_edges(t("connections")))))


def with_neighbours(seeds: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, id, score, via, rank): the best ``most`` of seeds (query_id, id, score) and the rows one and two ``edges`` away.

    A second step that ends below the ``most``-th best of seeds and first steps can't be among the best; it isn't taken,
    so that a hub one edge away doesn't bring all its neighbours to each query.
    """
    seeds, e = shared_checkpoint(seeds), shared_checkpoint(edges)  # read several times
    score = 0.3 * F.col("score") * F.col("w")

    def beyond(front: DataFrame, known: DataFrame) -> DataFrame:
        step = front.withColumnRenamed("id", "src").join(e, "src").where(score >= F.col("least") - 1e-8).groupBy("query_id", F.col("dst").alias("id")).agg(F.max(score).alias("score"))
        return shared_checkpoint(step.join(known.select("query_id", "id"), ["query_id", "id"], "left_anti"))

    one = beyond(seeds.withColumn("least", F.lit(float("-inf"))), seeds)
    known = seeds.unionByName(one)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))
    least = known.withColumn("k", place).where(F.col("k") <= most).where(F.col("k") == most).select("query_id", F.col("score").alias("least"))
    front = one.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    two = beyond(front.where(0.3 * F.greatest("score", F.lit(0.0)) >= F.col("least") - 1e-8), known)
    found = seeds.withColumn("via", F.lit("direct")).unionByName(one.withColumn("via", F.lit("neighbor:hop1"))).unionByName(two.withColumn("via", F.lit("neighbor:hop2")))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("score", F.round("score", 8)).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).select("query_id", "id", "score", "via", "rank")


_CONFIGS = {"all": {n: w for n, _, w in _CHANNELS}, **{f"no_{left}": {n: w for n, _, w in _CHANNELS if n != left} for left, _, _ in _CHANNELS}}


@R.add(_ALL + ", a as (" + " union all ".join(f"select '{cfg}' cfg, query_id, id, {ws[n]} / (60 + rank) p from {c}" for cfg, ws in _CONFIGS.items() for n, c, _ in _CHANNELS if n in ws) + """),
  g as (select cfg, query_id, id, round(sum(p), 9) f from a group by 1, 2, 3), k as (select *, row_number() over (partition by cfg, query_id order by f desc, id) k from g) select cfg, query_id, id, k as rank from k where k <= 5""")
def rt17_ablation(t: Tables) -> DataFrame:
    """The fused top five with each channel left out in turn: the channels are read once."""
    configs = _CONFIGS
    rows = [(cfg, c, w) for cfg, ws in configs.items() for c, w in ws.items() if w > 0]
    table_of = F.broadcast(t.spark.createDataFrame(rows, "cfg string, channel string, weight double"))
    x = channels(t).join(table_of, "channel").groupBy("cfg", "query_id", "id").agg(F.round(F.sum(S.rrf(F.col("rank"), F.col("weight"))), 9).alias("f"))
    w = W.partitionBy("cfg", "query_id").orderBy(F.desc("f"), "id")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= 5).select("cfg", "query_id", "id", "rank")


@R.add("with i as (select item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') w from eval_items where item_text is not null), d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) w from documents where text is not null) select i.item_id, max(round(len(list_intersect(list_distinct(i.w), d.w)) / len(list_distinct(i.w))::double, 6)) as leak from i join d on true where len(i.w) > 0 group by 1")
def tx26_token_leak(t: Tables) -> DataFrame:
    """The largest share of an item's words that one document holds: by shared words, no product of the tables."""
    w = lambda name, key, col: t(name).where(F.col(col).isNotNull()).select(F.col(key), F.array_distinct(X.words(F.col(col))).alias("w"))
    i = w("eval_items", "item_id", "item_text").select("item_id", F.size("w").alias("n"), F.explode("w").alias("term"))
    d = w("documents", "doc_id", "text").select("doc_id", F.explode("w").alias("term"))
    both = d.join(i, "term").groupBy("item_id", "n", "doc_id").agg((F.count(F.lit(1)) / F.col("n")).alias("s"))
    best = both.groupBy("item_id").agg(F.max(F.round("s", 6)).alias("leak"))
    return i.select("item_id").distinct().join(best, "item_id", "left").select("item_id", F.coalesce("leak", F.lit(0.0)).alias("leak"))


_EVAL = _V + _SEM + ", g as (select s.query_id, min(s.rank) r from sem s join vec q on q.id = s.query_id join vec x on x.id = s.id where list_cosine_similarity(q.e, x.e) >= 0.8 group by 1)"


@R.add(_EVAL + ", a as (select v.id query_id, g.r from vec v left join g on g.query_id = v.id where v.id % 100 = 0) select count(*) as queries, round(avg(case when r <= 1 then 1.0 else 0 end), 6) as r_at_1, round(avg(case when r <= 5 then 1.0 else 0 end), 6) as r_at_5, round(avg(coalesce(1.0 / r, 0)), 6) as mrr from a")
def ag17_retrieval_quality(t: Tables) -> DataFrame:
    """Recall at 1 and 5 and mean reciprocal rank; relevant is a cosine of 0.8 or more."""
    best = semantic(t).where(F.col("score") >= 0.8).groupBy("query_id").agg(F.min("rank").alias("r"))
    a = asking(t).select(F.col("id").alias("query_id")).join(best, "query_id", "left")
    at = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6)
    return a.agg(F.count(F.lit(1)).alias("queries"), at(1).alias("r_at_1"), at(5).alias("r_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


@R.add("select id, label, content from memories where label like '%::afe::%' order by created_at desc nulls last, id limit 200")
def rt19_recent_facts(t: Tables) -> DataFrame:
    return t("memories").where(F.col("label").contains("::afe::")).orderBy(F.desc_nulls_last("created_at"), "id").limit(200).select("id", "label", "content")


@R.add("select r.id, r.memory_id, r.reason, m.label from memory_revisions r left join memories m on m.id = r.memory_id")
def rt19_supersedes_log(t: Tables) -> DataFrame:
    r = t("memory_revisions").select("id", "memory_id", "reason")
    return r.join(t("memories").select(F.col("id").alias("memory_id"), "label"), "memory_id", "left").select("id", "memory_id", "reason", "label")


@R.add("with " + C.EDGES + " select m.id, m.label, c.s as fact, c.weight from ce c join memories m on m.id = c.t where c.edge_type = 'derived_from' union all select m.id, m.label, c.t, c.weight from ce c join memories m on m.id = c.s where c.edge_type = 'derived_from'")
def rt19_lineage(t: Tables) -> DataFrame:
    e = E.symmetric(E.clean_edges(t("connections")).where(F.col("edge_type") == "derived_from"))
    return e.join(t("memories").select(F.col("id").alias("src"), "label"), "src").select(F.col("src").alias("id"), "label", F.col("dst").alias("fact"), "weight")
