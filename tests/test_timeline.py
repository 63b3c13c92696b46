"""Sliced operators against plain loops on random rows, with slices much narrower than the data."""

import random

import pytest
from pyspark.sql import functions as F

from zonewatch.operators import timeline as T
from zonewatch.operators.throttle import throttle
from zonewatch.operators.tracking import track
from zonewatch.operators.steps import OpenTracks

S = 1_000_000


def rows(seed, n=400, keys=3, span=300, unique=True):
    r = random.Random(seed)
    seen, out = set(), []
    while len(out) < n:
        # Key 0 holds most rows.
        k = 0 if r.random() < 0.6 else r.randrange(keys)
        t = r.randrange(span * 10) * S // 10 + (r.randrange(1000) if unique else 0)
        if unique and (k, t) in seen:
            continue
        seen.add((k, t))
        out.append((f"k{k}", t, r.randrange(100)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k string, us bigint, v bigint").repartition(5)


def by_key(data):
    out = {}
    for row in sorted(data, key=lambda x: (x[0], x[1])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("seed,gap,width", [(1, 2 * S, 7 * S), (2, 5 * S, 3 * S), (3, 0, 20 * S)])
def test_sessions(spark, seed, gap, width):
    data = rows(seed)
    got = {(r.k, r.us): r.first_us for r in T.sessions(frame(spark, data), ["k"], "us", gap, width=width).collect()}
    for k, group in by_key(data).items():
        start = last = None
        for _, t, _ in group:
            if last is None or t - last > gap:
                start = t
            last = t
            assert got[(k, t)] == start


def test_previous_and_running_sum(spark):
    data = rows(4)
    df = T.previous(frame(spark, data), ["k"], "us", {"v": "before"}, width=5 * S)
    df = T.previous(df, ["k"], "us", {"v": "after"}, width=5 * S, descending=True)
    df = T.running_sum(df, ["k"], "us", F.col("v"), "total", width=5 * S)
    got = {(r.k, r.us): (r.before, r.after, r.total) for r in df.collect()}
    for k, group in by_key(data).items():
        total = 0
        for i, (_, t, x) in enumerate(group):
            total += x
            before = group[i - 1][2] if i else None
            after = group[i + 1][2] if i + 1 < len(group) else None
            assert got[(k, t)] == (before, after, total)


@pytest.mark.parametrize("forward,inclusive", [(False, True), (False, False), (True, True), (True, False)])
def test_asof(spark, forward, inclusive):
    left, right = rows(5, 200, unique=False), {(k, t): v for k, t, v in rows(6, 60, unique=False)}
    l = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "i bigint, k string, us bigint, v bigint")
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k string, rt bigint, rv bigint")
    got = {x.i: x.found for x in T.asof(l, r, ["k"], "us", "rt", {"rt": "found"}, forward, inclusive, width=4 * S).collect()}
    for i, (k, t, _) in enumerate(left):
        times = [rt for (rk, rt) in right if rk == k]
        if forward:
            fits = [x for x in times if x > t or (inclusive and x == t)]
            assert got[i] == (min(fits) if fits else None)
        else:
            fits = [x for x in times if x < t or (inclusive and x == t)]
            assert got[i] == (max(fits) if fits else None)


def test_interval_join(spark):
    left, right = rows(7, 80), rows(8, 120)
    l = spark.createDataFrame([(i, k, t - 3 * S, t + 2 * S) for i, (k, t, _) in enumerate(left)], "i bigint, k string, lo bigint, hi bigint")
    got = sorted((x.i, x.us) for x in T.interval_join(l, frame(spark, right), ["k"], "lo", "hi", "us", 5 * S).collect())
    want = sorted((i, rt) for i, (k, t, _) in enumerate(left) for rk, rt, _ in right if rk == k and t - 3 * S <= rt <= t + 2 * S)
    assert got == want


@pytest.mark.parametrize("n", [2, 3, 5])
def test_last_n_all(spark, n):
    data = rows(9, 300)
    df = T.last_n_all(frame(spark, data), ["k"], "us", F.col("v") < 75, n, "ok", width=2 * S)
    got = {(r.k, r.us): r.ok for r in df.collect()}
    for k, group in by_key(data).items():
        for i, (_, t, _) in enumerate(group):
            last = group[max(0, i - n + 1): i + 1]
            assert got[(k, t)] == (len(last) == n and all(v < 75 for _, _, v in last))


@pytest.mark.parametrize("seed,interval,width,seeded", [
    (11, 1.0, 3 * S, False), (12, 0.5, 10 * S, False), (13, 4.0, 5 * S, False), (14, 7.0, 2 * S, False),
    (15, 3.0, 4 * S, True), (16, 0.3, 60 * S, True), (17, 2.0, 1000 * S, False),
])
def test_throttle(spark, seed, interval, width, seeded):
    data = rows(seed, 600)
    before = {f"k{i}": 5 * S for i in range(2)} if seeded else {}
    data = [d for d in data if not seeded or d[1] >= 5 * S]
    df = spark.createDataFrame([(*d, before.get(d[0])) for d in data], "k string, us bigint, v bigint, last bigint").repartition(3)
    got = sorted((r.k, r.us) for r in throttle(df, ["k"], "us", interval, width=width, seed="last" if seeded else None).collect())
    want = []
    for k, group in by_key(data).items():
        last = before.get(k)
        for _, t, _ in group:
            if last is None or t - last >= round(interval * S):
                want.append((k, t))
                last = t
    assert got == sorted(want)


def model_tracks(data, min_iou, max_missing):
    """One camera at a time, frame by frame, all classes in one book."""
    out = {}
    for cam in {d[0] for d in data}:
        books, ids, made = {}, {}, 0
        for d in sorted((d for d in data if d[0] == cam), key=lambda d: (d[1], -d[4], d[2])):
            n, new = books.setdefault(d[3], OpenTracks(min_iou, max_missing)).see(d[1], d[5])
            if new:
                made += 1
                ids[(d[3], n)] = made
            out[(cam, d[1], d[2])] = ids[(d[3], n)]
    return out


def test_track(spark):
    r = random.Random(3)
    data = []
    for cam in ("a", "b"):
        for seq in sorted(r.sample(range(400), 150)):
            for i in range(r.randrange(1, 5)):
                x, y = r.randrange(0, 120), r.randrange(100, 140)
                data.append((cam, seq, i, r.choice(["person", "car"]), r.randrange(10) / 10, (float(x), float(y - 100), float(x + 40), float(y))))
    df = spark.createDataFrame([(*d[:5], d[5]) for d in data],
                               "camera_id string, seq bigint, det_index int, class_name string, confidence double, "
                               "bbox struct<x1:double,y1:double,x2:double,y2:double>").repartition(4)
    got = {(x.camera_id, x.seq, x.det_index): x.track_id for x in track(df, 0.3, 6).collect()}
    assert got == model_tracks(data, 0.3, 6)


def test_open_tracks_rules():
    t = OpenTracks(0.3, 45)
    box = (0.0, 0.0, 10.0, 10.0)
    assert t.see(1, box) == (1, True)
    assert t.see(1, box) == (2, True)  # a track begun in this frame is taken
    assert t.see(2, box) == (1, False)  # lowest id on ties
    assert t.see(47, box) == (1, False)  # 45 frames missing is still open
    assert t.see(93, box) == (3, True)  # 46 are not


def test_epochs_of_few_and_of_many_steps_back(spark, monkeypatch):
    """What goes back seldom is found from order and time alone; the numbers are those of rows put in order."""
    import random

    from zonewatch.operators import timeline

    r = random.Random(7)
    rows, want = [], {}
    for key in ("a", "b", None):
        t, epoch, before = 0, 0, None
        for n in range(-40, 160):
            t = None if r.random() < 0.03 else (0 if t is None else t) + (r.choice([0, 1, 2]) if r.random() < 0.9 else -5)
            epoch += before is not None and t is not None and t < before
            before = t
            rows.append((key, n, t, "load"))
            want[key, n] = epoch
    df = spark.createDataFrame(rows, "k string, n bigint, t bigint, load string").repartition(5)
    for most in (10_000, 3):
        monkeypatch.setattr(timeline, "MOST_ABLE", most)
        for width in (3, 50, 1000):
            got = timeline.epochs(df, ["k"], "n", "t", width=width)
            assert got.columns == ["k", "n", "t", "load", "epoch"]
            assert {(x.k, x.n): x.epoch for x in got.collect()} == want
    monkeypatch.undo()
    still = timeline.epochs(df.withColumn("t", F.col("n")), ["k"], "n", "t", width=50)
    assert "Exchange" not in still.drop("k")._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "").split("Exchange Round")[0]
    assert still.where("epoch <> 0").count() == 0


def test_motion_shuffles_its_rows_once_and_boxes_only_where_they_are_asked_for(spark):
    from zonewatch.operators import motion

    df = spark.range(300).select(
        F.lit("c").alias("camera_id"), (F.col("id") % 3).cast("string").alias("track_key"), "id", F.col("id").alias("seq"), (F.col("id") * 100_000).alias("us"),
        F.lit(640).alias("frame_w"), F.struct(*[(F.col("id") * k).cast("double").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]).alias("bbox"))
    out = motion.estimate_motion(df)
    assert out.columns == [*df.columns, "motion"] and out.count() == 300
    text = out.select("seq", "motion")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "bbox" not in text.split("Exchange")[0]
