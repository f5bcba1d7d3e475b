"""Windows and order statistics where one user holds a third of all rows, against plain Python."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import hotkeys

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"
START = dt.datetime(2024, 1, 1)


def log(n: int = 1500, seed: int = 3) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(seconds=draw.choice((draw.randrange(86_400 * 9), 86_400 * draw.randrange(9), draw.randrange(300))))
        rows.append((i, 7 if i % 3 == 0 else draw.randrange(40), at, draw.choice(("view", "view", "view", "purchase")), float(draw.randrange(100))))
    return rows


def by_user(rows: list[tuple]) -> dict:
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_usage_counts_look_backs_over_slices_of_any_width(spark):
    rows = log()
    want = {}
    for mine in by_user(rows).values():
        for r in mine:
            day = [o for o in mine if dt.timedelta(0) <= r[2] - o[2] <= dt.timedelta(days=1)]
            want[r[0]] = (sum(o[4] for o in day), sum(r[2] - o[2] <= dt.timedelta(seconds=60) for o in day), len(day))
    frame = spark.createDataFrame(rows, SCHEMA)
    for width in (hotkeys.DAY, hotkeys.DAY // 5):
        assert {r.event_id: (r.spend_24h, r.calls_60s, r.calls_24h) for r in hotkeys.usage(frame, width).collect()} == want


def test_no_slice_of_a_hot_user_holds_much(spark):
    frame = spark.createDataFrame([(i, -1 if i % 3 == 0 else i, START + dt.timedelta(minutes=i), "view", 1.0) for i in range(60_000)], SCHEMA)
    sliced = hotkeys.with_look_back(frame.select("user_id", hotkeys.micros("ts").alias("_at")), "_at", hotkeys.DAY)
    largest = sliced.groupBy("user_id", "_slice").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 480  # a day of one event in three minutes, and the day before


def test_gaps_and_runs_cross_slices(spark):
    rows = log() + [(9000, 99, START, "view", 1.0)]
    gaps, empty = {}, {}
    for user, mine in by_user(rows).items():
        steps = [(b[2] - a[2]).total_seconds() for a, b in zip(mine, mine[1:])]
        gaps[user] = (round(max(steps), 3), round(sum(steps) / len(steps), 3)) if steps else (None, None)
        run = 0
        for r in mine:
            run = 0 if r[3] == "purchase" else run + 1
            empty[r[0]] = run
    frame = spark.createDataFrame(rows, SCHEMA)
    for width in (hotkeys.DAY, 3600 * hotkeys.SECOND):
        got = {r.user_id: (r.longest, r.mean) for r in hotkeys.gaps(frame, width).collect()}
        assert set(got) == set(gaps)
        for user, (longest, mean) in gaps.items():
            assert got[user][0] == longest and (got[user][1] == mean or abs(got[user][1] - mean) < 0.0011)  # ties of the rounding
        assert {r.event_id: r.empty_scans for r in hotkeys.since_yield(frame, F.col("event_type") == "purchase", width).collect()} == empty


def test_rows_without_a_moment_or_user_and_empty_logs(spark):
    rows = [(1, 1, None, "view", 2.0), (2, 1, START, "view", 1.0), (3, None, START, "view", 1.0), (4, None, START, "view", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r.event_id: r.calls_24h for r in hotkeys.usage(frame).collect()} == {1: 1, 2: 1, 3: 2, 4: 2}
    assert {r.event_id: r.empty_scans for r in hotkeys.since_yield(frame, F.col("event_type") == "purchase").collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
    assert sorted((r.user_id or 0, r.longest) for r in hotkeys.gaps(frame).collect()) == [(0, 0.0), (1, None)]
    assert {r.user_id: (r.read_to, r.processed_to, r.left) for r in hotkeys.two_cursors(frame, 1).collect()} == {1: (2, 1, 1), None: (4, 3, 1)}
    none = frame.filter("false")
    for out in (hotkeys.usage(none), hotkeys.gaps(none), hotkeys.two_cursors(none), hotkeys.since_yield(none, F.lit(True))):
        assert out.count() == 0


def test_quantiles_by_refinement_are_exact(spark):
    draw = random.Random(5)
    values = {"normal": [draw.gauss(0, 1) for _ in range(4000)], "wide": [10.0 ** draw.uniform(-200, 200) for _ in range(3000)], "equal": [4.0] * 2000, "two": [1.0] * 999 + [2.0] * 1001, "one": [3.5], None: [float(i % 37) for i in range(900)]}
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())]))
    for most in (1_000_000, 60, 1):
        got = {r.k: r for r in hotkeys.quantiles(frame, ["k"], "v", {"p90": 0.9, "p50": 0.5, "p0": 0.0}, {"d99": 0.99, "d100": 1.0}, most).collect()}
        assert set(got) == set(values)
        for k, vs in values.items():
            s, n = sorted(vs), len(vs)
            for name, q in (("p90", 0.9), ("p50", 0.5), ("p0", 0.0)):
                at = (n - 1) * q
                i = int(at)
                want = s[i] * (1 - (at - i)) + s[min(i + 1, n - 1)] * (at - i)
                assert abs(got[k][name] - want) <= 1e-9 * max(1.0, abs(want))
            assert (got[k].d99, got[k].d100) == (s[-(-n * 99 // 100) - 1], s[-1])
    assert hotkeys.quantiles(frame.filter("false"), ["k"], "v", {"p": 0.5}, {}).count() == 0
