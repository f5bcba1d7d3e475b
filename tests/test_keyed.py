"""Limits and fire-once keys by keyed state: against a plain loop, over restarts and rows that arrive out of order."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

from millrace.streaming import keyed
from millrace.streaming.events import stream

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"
START = dt.datetime(2024, 1, 1)


def log(first: int, n: int, seed: int, days: tuple[float, float]) -> list[tuple]:
    draw = random.Random(seed)
    at = lambda: START + dt.timedelta(seconds=int(draw.uniform(*days) * 86_400) // 3600 * 3600 + draw.randrange(150))
    return [(first + i, 7 if i % 3 == 0 else draw.randrange(5), at(), draw.choice(("call", "mail")), float(draw.randrange(4))) for i in range(n)]


def judged(rows: list[tuple], seen: list[tuple], spend: int, minute: int, day: int) -> dict:
    until = max(r[2] for r in seen) - dt.timedelta(days=1)
    out, led = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if r[2] >= until:
            continue
        past = [o for o in led.get(r[1], []) if o[2] >= r[2] - dt.timedelta(days=1)]
        same = [o for o in past if o[3] == r[3]]
        if sum(o[4] * 100 for o in past) >= spend:
            out[r[0]] = "spend"
        elif sum(o[2] >= r[2] - dt.timedelta(minutes=1) for o in same) >= minute:
            out[r[0]] = "minute"
        elif len(same) >= day:
            out[r[0]] = "day"
        else:
            out[r[0]] = "admitted"
            led.setdefault(r[1], []).append(r)
    return out


def test_limits_over_a_restart(spark):
    """The second run reads new files only and goes on from the state; late files within the delay change nothing."""
    base = tempfile.mkdtemp(prefix="spark-test-")
    first, second = log(0, 300, 1, (0, 6)), log(1000, 300, 2, (5.2, 9))
    write = lambda rows, name: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/{name}.parquet")
    write([*first, (5000, None, START, "call", 1.0), (5001, 1, None, "call", 1.0)], "events")
    go = lambda: keyed.run(keyed.decided(stream(spark, base, "events"), keyed.Limiter(900, 1, 4)), f"{base}/out")
    read = lambda rows: {r.event_id: r.verdict for r in rows.collect()}
    assert read(go()) == judged(first, first, 900, 1, 4)
    assert read(go()) == judged(first, first, 900, 1, 4)  # nothing new, nothing twice
    write(second, "events")
    want = judged([*first, *second], [*first, *second], 900, 1, 4)
    assert set(want.values()) == {"spend", "minute", "day", "admitted"}
    rows = go()
    assert read(rows) == want and rows.count() == len(want)


def test_keys_fire_again_only_when_forgotten(spark):
    base = tempfile.mkdtemp(prefix="spark-test-")
    kinds = ["a", "b", "a", None, "c", "a", "b", "a", "c", None]
    rows = [(i, 1, START + dt.timedelta(minutes=i // 2), k, None) for i, k in enumerate(kinds)] + [(99, 2, START + dt.timedelta(days=3), "a", 0.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{base}/events.parquet")
    got = keyed.run(keyed.decided(stream(spark, base, "events"), keyed.FireOnce(2)), f"{base}/out")
    kept, want = [], {}
    for i, k in enumerate(kinds):
        want[i] = "silent" if k in kept else "fired"
        kept = kept if k in kept else [*kept, k][-2:]
    assert {r.event_id: r.verdict for r in got.collect()} == want  # the last event is behind no watermark yet


class State:
    """A key's state with a watermark; counts how often it is written."""

    def __init__(self):
        self.kept, self.timeout, self.mark, self.writes = None, None, 0, 0

    exists = property(lambda self: self.kept is not None)
    get = property(lambda self: self.kept)

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.kept, self.timeout, self.writes = value, None, self.writes + 1

    def setTimeoutTimestamp(self, at):
        assert at >= self.mark
        self.timeout = at


def test_a_key_is_one_state_row_a_batch():
    import pandas as pd

    state, fire = State(), keyed.FireOnce(2)
    frame = lambda *rows: pd.DataFrame(rows, columns=["us", "event_id", "kind", "cost"])
    go = lambda *chunks: [tuple(r) for out in fire((7,), iter(chunks), state) for r in out.itertuples(index=False)]
    assert go(frame((5_000_000, 2, "a", 0), (1_000_000, 1, "a", 0)), frame((9_000_999, 3, "b", 0))) == [] and state.timeout == 1000
    state.mark = 5000
    assert go() == [(7, 1, "fired")] and state.timeout == 5000  # a row at the mark isn't passed yet
    state.mark = 9000
    assert go(frame((9_500_000, 4, "c", 0))) == [(7, 2, "silent")] and state.timeout == 9000
    state.mark = 10_000
    assert go() == [(7, 3, "fired"), (7, 4, "fired")] and state.timeout is None and state.writes == 4
