"""Streaming queries, each against the SQL of its batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.plans.base import Registry, Tables
from recallgrid.streaming import operators as S
from recallgrid.streaming.runs import settle, stream

R = Registry()


def events(t: Tables) -> DataFrame:
    return S.zoned(stream(t.spark, t.root, "events"))


def _start(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("w.start").cast("timestamp_ntz")).drop("w")


@R.add("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def sm_tumbling_windows(t: Tables) -> DataFrame:
    return _start(settle(S.windowed(events(t), "1 hour"))).withColumn("total", F.round("total", 4))


@R.add("with x as (select unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as start, event_type, value from events) select start, event_type, count(*) as n, round(sum(value), 4) as total from x group by 1, 2")
def sm_sliding_windows(t: Tables) -> DataFrame:
    return _start(settle(S.windowed(events(t), "1 hour", "30 minutes"))).withColumn("total", F.round("total", 4))


@R.add("""with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end b from events), y as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) s from x)
  select user_id, min(ts) as start, count(*) as n from y group by user_id, s""")
def sm_session_windows(t: Tables) -> DataFrame:
    return _start(settle(S.sessions(events(t), "30 minutes")))


@R.add("select distinct user_id, event_type, ts from events")
def sm_distinct_events(t: Tables) -> DataFrame:
    x = S.distinct_events(events(t), ["user_id", "event_type", "ts"], late="3650 days").select("user_id", "event_type", "ts")
    return settle(x, "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@R.add("select user_id, (count(*) // 50)::bigint as fired from events where user_id is not null group by 1")
def sm3_counting_trigger(t: Tables) -> DataFrame:
    fired = settle(S.every_nth(events(t).where(F.col("user_id").isNotNull()).select("user_id"), 50), "append")
    return fired.groupBy("user_id").agg(F.sum("fired").alias("fired"))


_SAID = "md5(trim(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', ' ', 'g')))"


@R.add(f"select distinct case when lower(trim(role)) = 'user' then 'user-msg' else 'asst-msg' end as label, {_SAID} as said from turns where length(trim(content)) >= 20")
def sm1_absorb_turns(t: Tables) -> DataFrame:
    """What an ingest has taken in; which of several equal turns it was depends on their arrival, so the check compares what was said."""
    return settle(S.absorbed(stream(t.spark, t.root, "turns")), "append").select("label", "said")


@R.add("select user_id, ts + interval 6 hours as run_at from (select user_id, ts, lead(ts) over (partition by user_id order by ts) nx from events) where nx is null or nx - ts >= interval 6 hours")
def sm3_idle_trigger(t: Tables) -> DataFrame:
    """When a cycle may run: six hours after the last event of a burst."""
    x = settle(S.idle_runs(events(t), "6 hours", "3650 days"))
    return x.select("user_id", F.col("run_at").cast("timestamp_ntz").alias("run_at"))


@R.add("select 'memories' as tab, id as row_id, 'memory.added' as kind, created_at as at from memories union all select 'connections', id, 'edge.changed', ingestion_time from connections union all select 'dream_sessions', id, case when finished_at is null then 'phase.started' else 'phase.finished' end, started_at from dream_sessions")
def sm2_event_feed(t: Tables) -> DataFrame:
    """Three tables as one feed of events, each row once; the offsets in the query's checkpoint are the high-water marks."""
    of = lambda name: stream(t.spark, t.root, name)
    feed = S.changes(of("memories"), "memories", F.lit("memory.added"), "created_at").unionByName(S.changes(of("connections"), "connections", F.lit("edge.changed"), "ingestion_time"))
    feed = feed.unionByName(S.changes(of("dream_sessions"), "dream_sessions", F.when(F.col("finished_at").isNull(), "phase.started").otherwise("phase.finished"), "started_at"))
    return settle(feed, "append").withColumn("at", F.col("at").cast("timestamp_ntz"))


@R.add("select 'memory.added' as kind, count(*) as n from memories union all select 'edge.changed', count(*) from connections union all select 'phase.' || case when finished_at is null then 'started' else 'finished' end, count(*) from dream_sessions group by finished_at is null")
def sm2_change_feed(t: Tables) -> DataFrame:
    """Three tables as one feed of changes, counted by kind; offsets live in the query's checkpoint."""
    feed = stream(t.spark, t.root, "memories").select(F.lit("memory.added").alias("kind"))
    feed = feed.unionByName(stream(t.spark, t.root, "connections").select(F.lit("edge.changed").alias("kind")))
    feed = feed.unionByName(stream(t.spark, t.root, "dream_sessions").select(F.when(F.col("finished_at").isNull(), "phase.started").otherwise("phase.finished").alias("kind")))
    return settle(feed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


@R.add("select event_type, max(ts) as last_at from events group by 1")
def sm5_state_with_ttl(t: Tables) -> DataFrame:
    """The last event of each type, out of a state that expires seven days after it."""
    x = settle(S.last_seen(events(t), 7 * 86_400_000), "append")
    return x.groupBy("event_type").agg(F.max("last_at").alias("at")).select("event_type", F.col("at").cast("timestamp_ntz").alias("last_at"))


@R.add("select greatest((select max(id) from memories), 0) as memories, greatest((select max(id) from connections), 0) as connections, (select count(*) from memories) as n_memories, (select count(*) from connections) as n_connections")
def sm6_drift_marks(t: Tables) -> DataFrame:
    """What a process compares to see that another has written: the largest id and the number of rows of each table."""
    mark = lambda name: t(name).agg(F.greatest(F.max("id"), F.lit(0)).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    return mark("memories").join(mark("connections")).select("memories", "connections", "n_memories", "n_connections")  # one row each
