from datetime import datetime as D
from datetime import timedelta

from recallgrid.plans.base import Tables
from recallgrid.plans import streams as P

T0 = D(2024, 1, 1)


def tables(spark, tmp_path, **named):
    for name, (rows, schema) in named.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return Tables(spark, str(tmp_path))


def test_equal_turns_are_taken_in_once(spark, tmp_path):
    said = ["The cache was moved to disk.", "the CACHE was moved -- to disk", "The cache was moved to tape.", "short", None]
    rows = [(i, "user" if i < 6 else "assistant", said[i % 5], T0 + timedelta(seconds=i)) for i in range(10)]
    t = tables(spark, tmp_path, turns=(rows, "turn_id long, role string, content string, created_at timestamp_ntz"))
    got = P.sm1_absorb_turns(t).collect()
    assert len(got) == 4 and {r.label for r in got} == {"user-msg", "asst-msg"}  # two texts for either speaker


def test_idle_trigger_and_expiring_state(spark, tmp_path):
    at = [0, 1, 2, 30, 31, 100]
    rows = [(i, 1, "click" if i < 3 else "view", T0 + timedelta(hours=h), 1.0) for i, h in enumerate(at)]
    t = tables(spark, tmp_path, events=(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"))
    assert sorted(r.run_at for r in P.sm3_idle_trigger(t).collect()) == [T0 + timedelta(hours=h + 6) for h in (2, 31, 100)]
    assert {r.event_type: r.last_at for r in P.sm5_state_with_ttl(t).collect()} == {"click": T0 + timedelta(hours=2), "view": T0 + timedelta(hours=100)}
