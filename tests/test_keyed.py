import datetime as dt
import random

from pyspark.sql import functions as F

from newsflow.streaming import incremental, keyed

FINDS = "url string, seq long, found_at timestamp, body string"
AT = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def replayed(rows, horizon):
    states, out = {}, []
    for url, _, at, body in sorted(rows, key=lambda r: (r[2], r[1])):
        body, state = body or "", states.get(url)
        if state and at >= state[0] + horizon:
            out.append((url, "expired", state[0] + horizon, *state))
            state = None
        if state is None:
            states[url] = state = (at, body)
            out.append((url, "new", at, *state))
        elif len(body) > len(state[1]):
            states[url] = state = (state[0], body)
            out.append((url, "longer", at, *state))
    return out, states


def test_equals_a_replay_over_restarts_and_drops_late_finds(spark, tmp_path):
    rng, rows, horizon = random.Random(5), [], 5 * HOUR
    for n in range(3):
        # finds of a batch are in any order; none is older than the batch before it
        batch = [(rng.choice([None, "a", "b", "c", f"only{n}"]), n * 100 + i, AT + n * 10 * HOUR + rng.random() * 9 * HOUR, rng.choice([None, "x" * rng.randint(0, 6)])) for i in range(25)]
        rows += batch
        late = [("late", 999, AT - 1000 * HOUR, "late")] if n else []
        spark.createDataFrame(batch + late, FINDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.item_stream(spark, f"{tmp_path}/in", FINDS)
        keyed.run_events(keyed.article_events(stream, horizon, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/c")  # every run starts from the checkpoint
    events = spark.read.parquet(f"{tmp_path}/out")
    got = sorted([tuple(r) for r in events.select("url", "event", "at", "first_seen", "body").collect()], key=str)
    want, states = replayed(rows, horizon)
    # timers end all that the watermark has passed
    passed = max(r[2] for r in rows) - dt.timedelta(minutes=10)
    want += [(u, "expired", s[0] + horizon, *s) for u, s in states.items() if s[0] + horizon <= passed]
    assert got == sorted(want, key=str) and any(r[0] == "only0" and r[1] == "expired" for r in got)
    lives = {(r["url"], r["first_seen"]): (r["body"], r["gone"]) for r in keyed.lives(events).collect()}
    assert {k for k, v in lives.items() if not v[1]} == {(u, s[0]) for u, s in states.items() if s[0] + horizon > passed}
    assert events.where(F.col("url") == "late").count() == 0
