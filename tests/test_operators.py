"""Operators against plain loops: chunks against whole channels, extremes kept, streams against batches."""

import itertools
import math
import random
import statistics
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import alarms as A
from chronoloom.operators import detect as D
from chronoloom.operators import downsample as L
from chronoloom.operators import filters as H
from chronoloom.operators import grid as G
from chronoloom.operators import ingest as I
from chronoloom.operators import ml as ML
from chronoloom.operators import models as MO
from chronoloom.operators import prefix as P
from chronoloom.params import ChannelParams, Grid
from chronoloom.plans import catalog
from chronoloom.sources import archive as AR
from chronoloom.sources import files as FI
from chronoloom.streaming import levels as SV
from chronoloom.streaming import run as SR
from chronoloom.streaming import stateful as SF

S = 1_000_000


def signal(n, seed=1):
    rng = random.Random(seed)
    x = [math.sin(i / 50) + 0.05 * rng.gauss(0, 1) for i in range(n)]
    for i in range(200, n, 173):
        x[i] += 2.5
    return x


@pytest.fixture(scope="module")
def wave(spark):
    rng, rows = random.Random(3), []
    for c in ("a", "b"):
        t = 0
        for x in signal(900, 1 if c == "a" else 2):
            t += rng.choice((1, 1, 1, 40)) * S
            rows.append((c, t, x))
    return spark.createDataFrame(rows, "channel string, ts long, val double").repartition(4).cache()


def test_hampel_chunks_equal_whole(spark, wave):
    whole = ChannelParams(hampel_window=7, chunk=10**15)
    for chunk in (5 * S, 60 * S, 1000 * S):
        got = H.hampel_filter(wave, ChannelParams(hampel_window=7, chunk=chunk))
        assert got.exceptAll(H.hampel_filter(wave, whole)).isEmpty() and got.count() == 1800


def test_hampel_against_loop(spark, wave):
    rows = sorted(wave.where("channel = 'a'").collect(), key=lambda r: r.ts)
    got = {r.ts: r for r in H.hampel_filter(wave.where("channel = 'a'"), ChannelParams(hampel_window=7, chunk=50 * S)).collect()}
    x = [r.val for r in rows]
    for i, r in enumerate(rows):
        w = x[max(0, i - 6) : i + 1]
        med = statistics.median(w)
        sigma = 1.4826 * statistics.median([abs(v - med) for v in w])
        hit = len(w) == 7 and sigma > 0 and abs(x[i] - med) > 3 * sigma
        assert got[r.ts].substituted == hit and abs(got[r.ts].median - med) < 1e-12


def test_constant_signal_and_slope(spark):
    flat = spark.createDataFrame([("c", i * S, 1.0001 if i == 50 else 1.0) for i in range(100)], "channel string, ts long, val double")
    assert H.hampel_filter(flat).where("substituted").count() == 0
    line = spark.createDataFrame([("c", i * S, 2.0 * i) for i in range(500)], "channel string, ts long, val_f double")
    slopes = H.window_features(line, ChannelParams(feature_window=10, chunk=37 * S)).where("slope is not null").select("slope").collect()
    assert len(slopes) == 491 and all(abs(s[0] - 2) < 1e-9 for s in slopes)


def test_rollup_equals_direct(spark, wave):
    direct = G.bucket_aggregate(wave, 64 * S).withColumn("vsum", F.round("vsum", 9))
    rolled = G.rollup_buckets(G.bucket_aggregate(wave, 16 * S), 64 * S).withColumn("vsum", F.round("vsum", 9))
    assert direct.exceptAll(rolled).isEmpty() and rolled.exceptAll(direct).isEmpty()


def test_late_points(spark):
    rows = [("c", i, i * S, 1.0) for i in range(500)] + [("c", 500, i * S, 1.0) for i in range(10)]
    late = G.late_points(spark.createDataFrame(rows, "channel string, pkt long, ts long, val double"), Grid(S, 4, 1, 16), 30 * S)
    assert late.first().dropped == 10


def test_extremes_survive(spark, wave):
    got = {(r.channel, r.val) for r in G.minmax_preselect(wave, 20).collect()}
    for r in wave.groupBy("channel").agg(F.min("val").alias("lo"), F.max("val").alias("hi")).collect():
        assert (r.channel, r.lo) in got and (r.channel, r.hi) in got


def naive_lttb(t, x, m):
    n, every, kept = len(t), (len(t) - 2) / (m - 2), [0]
    for i in range(m - 2):
        lo, hi = int(i * every) + 1, int((i + 1) * every) + 1
        nxt = range(hi, min(int((i + 2) * every) + 1, n)) or [n - 1]
        ct, cx = sum(t[j] for j in nxt) / len(nxt), sum(x[j] for j in nxt) / len(nxt)
        a = kept[-1]
        kept.append(max(range(lo, hi), key=lambda j: abs((t[a] - ct) * (x[j] - x[a]) - (t[a] - t[j]) * (cx - x[a]))))
    return [*kept, n - 1]


def test_lttb_against_loop():
    x = signal(997)
    t = list(range(997))
    assert L.lttb_rows(np.array(t), np.array(x), 77).tolist() == naive_lttb(t, x, 77)
    assert L.lttb_rows(np.array(t[:2]), np.array(x[:2]), 1).tolist() == [0, 1] and len(L.lttb_rows(np.array(t), np.array(x), 2)) == 2


def naive_cells(t, x, width):
    """Final points and tail of chart cells, point by point."""
    cells, pick, out = {}, None, []
    for u, v in zip(t, x, strict=True):
        cells.setdefault(u // width, []).append((u, v))
    order = sorted(cells)
    for c, after in zip(order[:-2], order[1:], strict=False):
        own, rest = cells[c], cells[after]
        ct, cx = statistics.mean(u - own[0][0] for u, _ in rest), statistics.mean(v for _, v in rest)
        size = lambda p: abs((pick[0] - own[0][0] - ct) * (p[1] - pick[1]) - (pick[0] - p[0]) * (cx - pick[1]))  # noqa: E731,B023
        pick = own[0] if pick is None else max(own, key=size)
        out.append((*pick, True))
    for c in order[-2:]:
        own = cells[c]
        out += [(*p, False) for p in sorted({min(own, key=lambda p: (p[1], p[0])), min(own, key=lambda p: (-p[1], p[0])), own[-1]})]
    return out


def shapes(n):
    """Noise, an even slope with plateaus, an arc that ends in a spike, a constant."""
    rng = random.Random(8)
    arc = [math.sqrt(max(0.0, 1 - (2 * (i % 500) / 500 - 1) ** 2)) + (9.0 if i % 500 == 499 else 0.0) for i in range(n)]
    return {"noise": [rng.gauss(0, 1) for _ in range(n)], "steps": [float(i // 30) for i in range(n)], "arc": arc, "still": [2.5] * n}


@pytest.mark.parametrize("width", [37, 400, 10**6])
def test_grid_lttb_against_loop(spark, width):
    """From hulls, in any order of rows and in small batches, as point by point."""
    n = 3000
    rows = [(c, 3 * i + (i * 7) % 3, v) for c, x in shapes(n).items() for i, v in enumerate(x)]
    want = sorted((c, *p) for c in shapes(1) for p in naive_cells(*zip(*[r[1:] for r in rows if r[0] == c], strict=True), width))
    table = spark.createDataFrame([*rows, ("none", 5, None), ("none", 6, float("nan"))], "channel string, ts long, val double").orderBy(F.xxhash64("ts", "channel")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert sorted(map(tuple, L.grid_lttb(table, width).collect())) == want
        held = L.cell_hulls(table, width)
        assert held.agg(F.sum("n")).first()[0] == 4 * n and held.count() == held.select("channel", "cell").distinct().count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    if width == 10**6:
        assert held.agg(F.max(F.size("t"))).first()[0] < n / 5  # hulls, not points


def test_hull_has_the_corner_of_every_largest_triangle():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 1000):
        t, x = rng.integers(0, 400, n), np.round(rng.normal(size=n), 1)
        order = np.lexsort((x, t))
        t, x = t[order], x[order]
        keep = L.hulls(np.zeros(n, int), t, x)
        for _ in range(50):
            pick, center = rng.normal(size=2) * 300, rng.normal(size=2) * 300
            size = L.areas(t.astype(float), x, tuple(pick), tuple(center))
            assert np.isclose(size[keep].max(), size.max(), rtol=1e-9)
        assert {int(x.argmin()), int(x.argmax()), 0} <= {int(np.flatnonzero((t == t[i]) & (x == x[i]))[0]) for i in keep} | {int(i) for i in keep}


def test_cells_do_not_depend_on_batches():
    x = np.array(signal(300))
    t = np.arange(300) * S
    whole = L.Cells(10 * S)
    one = list(whole.push(t, x))
    state, parts = None, []
    for start in range(0, 300, 7):
        cells = L.Cells(10 * S, state)
        parts += cells.push(t[start : start + 7], x[start : start + 7])
        state = (cells.pick, cells.done, cells.open)
    assert one == parts and len(one) == 28 and len({t // (10 * S) for t, _ in one}) == 28


def test_live_tail_equals_batch(spark):
    rows = [(c, 5 * i, v) for c, x in shapes(900).items() for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "channel string, ts long, val double")
    path, files = SR.arrived_in_parts(table, "ts", 5)
    out = SR.collected(SF.stream_grid_lttb(SR.stream_source(spark, path, table.schema, files), 200)).cache()
    assert sorted(map(tuple, L.live_points(out).collect())) == sorted(map(tuple, L.grid_lttb(table, 200).collect()))
    assert out.where("final").groupBy("channel", "ts").count().where("count > 1").isEmpty()
    assert out.where("not final").select("channel", "generation").distinct().count() == 4 * 5  # a tail for each batch


def naive_spread(residuals, k, warm_up):
    seen, mean, limits = 0, 0.0, []
    for r in residuals:
        if math.isnan(r):
            limits.append(math.nan)
            continue
        limit = k * math.sqrt(math.pi / 2) * mean if seen >= warm_up else math.nan
        limits.append(limit)
        if not r > limit > 0:
            seen += 1
            mean += max(0.01, 1 / seen) * (r - mean)
    return limits


@pytest.mark.parametrize("warm_up", [0, 3, 100, 700])
def test_spread_against_loop(warm_up):
    rng = np.random.default_rng(warm_up)
    n = 9000
    r = np.abs(rng.normal(size=n)) * np.where(np.arange(n) % 3000 < 1500, 1, 20)  # sudden changes: long flagged runs
    r[rng.random(n) < 0.02] = np.nan
    r[4000:4300] = 0.0
    r[6000:6010] = 1e6
    want = np.array(naive_spread(r.tolist(), 3.0, warm_up))
    spread, got, flags = D.Spread(warm_up), [], []
    for a, b in zip((0, 1, 50, 4100, 4101, n), (1, 50, 4100, 4101, n, n), strict=True):  # any batches
        limits, hit = spread.judge(r[a:b], 3.0)
        got.append(limits), flags.append(hit)
    got, flags = np.concatenate(got), np.concatenate(flags)
    with np.errstate(invalid="ignore"):
        assert (flags == ((want > 0) & (r > want))).all() and flags.sum() > 500 * (warm_up < 700)
    assert (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want) / np.maximum(want, 1e-9)) < 1e-9


def test_spike_becomes_episode(spark, wave):
    p = ChannelParams(episode_gap=5 * S, chunk=500 * S)
    found = D.channel_pipeline(wave, p)
    episodes = D.build_episodes(D.scored_flags(found), p.episode_gap)
    assert {r.kind for r in episodes.collect()} == {"anomaly", "outlier"}
    islands = D.flag_islands(D.scored_flags(found), p.episode_gap).select("channel", "kind", "island").distinct().count()
    assert islands == episodes.count()


def test_stream_equals_batch(spark, wave):
    p = ChannelParams(chunk=300 * S)
    path, files = SR.arrived_in_parts(wave, "ts", 5)
    stream = SR.collected(SF.stream_diagnostics(SR.stream_source(spark, path, wave.schema, files), p=p)).drop("batch_id", "median", *H.FEATURES)
    batch = D.channel_pipeline(wave, p).drop("median").select(stream.columns)
    doubles = [c for c, t in batch.dtypes if t == "double"]
    a, b = (df.withColumns({c: F.round(c, 9) for c in doubles}) for df in (stream, batch))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


RULE = {"rule_id": 1, "channel": "c", "kind": "hihi", "limit": 40.0, "deadband": 0.0, "on_delay": 0, "off_delay": 0, "min_repeat": 0, "anomaly": False, "user": None}


def alarm_log(steps, batches=1, **kw):
    """Transitions and states of one rule over (ts, value or 'ack')."""
    rows = pd.DataFrame([RULE | kw | {"ts": t, "value": None if v == "ack" else v, "is_ack": int(v == "ack"), "user": "me" if v == "ack" else None} for t, v in steps])
    alarm, out = A.Alarm(), []
    for part in np.array_split(np.arange(len(rows)), batches):
        out += A.walk(alarm, rows.iloc[part]) if len(part) else []
    return [(t, what, after) for _, _, t, what, _, after, _, _ in out]


@pytest.mark.parametrize("batches", [1, 3, 20])
def test_alarm_life_cycle(batches):
    steps = [(0, 39.0), (4, 44.0), (6, 37.5), (7, None), (9, 36.0), (11, "ack"), (12, 41.0), (15, "ack"), (20, 30.0), (21, "ack")]
    assert alarm_log(steps, batches, deadband=3.0) == [
        (4, "activated", "unack_active"), (9, "returned", "unack_rtn"), (11, "acknowledged", "normal"), (12, "activated", "unack_active"),
        (15, "acknowledged", "ack_active"), (20, "returned", "normal"),
    ]


@pytest.mark.parametrize("batches", [1, 4])
def test_alarm_delays_and_repeat(batches):
    low = {"kind": "lolo", "limit": -5.0, "on_delay": 6, "off_delay": 2, "min_repeat": 30}
    steps = [(0, -7.0), (3, -4.0), (5, -8.0), (9, -8.0), (11, -9.0), (12, 0.0), (14, 0.0), (20, -9.0), (30, -9.0), (40, -9.0), (41, -9.0)]
    assert alarm_log(steps, batches, **low) == [(11, "activated", "unack_active"), (14, "returned", "unack_rtn"), (41, "activated", "unack_active")]


def test_alarm_machine_against_loop():
    """The jumps over runs against one reading at a time."""
    rng = random.Random(9)
    for _ in range(300):
        times = list(itertools.accumulate(rng.choice((1, 2, 7)) for _ in range(30)))
        steps = [(t, rng.choice((None, 36.0, 38.0, 40.0, 42.0))) for t in times]
        kw = {"deadband": rng.choice((0.0, 3.0)), "on_delay": rng.choice((0, 4)), "off_delay": rng.choice((0, 5)), "min_repeat": rng.choice((0, 20))}
        on, called, last, want = False, None, None, []
        for t, v in steps:
            aim = on if v is None else v > 40.0 - (kw["deadband"] if on else 0)
            called = None if aim == on else t if called is None else called
            if called is None or t - called < kw["on_delay" if aim else "off_delay"] or (aim and last is not None and t - last < kw["min_repeat"]):
                continue
            on, called, last = aim, None, t if aim else last
            want.append((t, aim))
        rows = pd.DataFrame([RULE | kw | {"ts": t, "value": v} for t, v in steps])
        found = A.Debounce().turns(rows.ts.to_numpy(), A.calls_of(rows), {True: kw["on_delay"], False: kw["off_delay"]}, kw["min_repeat"])
        assert [(times[i], c) for i, c in found] == want


def test_packet_vector(spark):
    # fixed values: the times' order and the counts of one packet that the survey prescribes (ts 2, 0, 1, 1: 3, 1, 4)
    t0 = 1_577_836_800_000_000
    body = '{"seq":1,"source":"s","sent_at":0,"channels":[{"id":"flow","ts":[%d,%d,%d,%d],"val":[7,null,8,9],"nd":[false,false,true,false],"otkl":null}]}' % (t0 + 2 * S, t0, t0 + S, t0 + S)
    lines = spark.createDataFrame([(body,), ("{",), ('{"seq":2,"source":"s","sent_at":0,"channels":[{"id":"flow","ts":[5,6],"val":[1]}]}',)], "body string")
    good, bad = FI.parse_packet_json(lines)
    rows, rejected = FI.explode_packets(good)
    assert bad.count() == 1 and rejected.first().seq == 2
    rows = rows.withColumnRenamed("seq", "pkt")
    again = rows.unionByName(rows.withColumn("pkt", F.lit(5).cast("long"))).unionByName(rows.withColumn("pkt", F.lit(9).cast("long")).withColumn("ts", F.lit(77).cast("long")))
    acks = {r.pkt: (r.accepted, r.rejected, r.reordered, r.errors, r.new_channels) for r in I.packet_ack(again, spark.createDataFrame([], "channel string")).collect()}
    assert acks == {1: (3, 1, 4, [], ["flow"]), 5: (3, 1, 4, [], []), 9: (0, 4, 0, ["flow: times out of range"], [])}
    known = I.packet_ack(rows, spark.createDataFrame([("flow",)], "channel string")).first()
    assert known.new_channels == []


def test_last_value_is_of_the_last_packet(spark):
    rows = spark.createDataFrame([("c", 1, 0, 50, 1.0), ("c", 2, 1, 40, 2.0), ("c", 2, 2, 30, 3.0), ("c", 2, 3, 40, 4.0)], "channel string, pkt long, arrival long, ts long, val double")
    row = I.last_values(rows.withColumn("quality", F.lit("good"))).first()
    assert (row.ts, row.val) == (40, 4.0)


def test_late_cell_between_open_ones_is_kept():
    cells = L.Cells(10)
    push = lambda t, x: list(cells.push(np.array([t]), np.array([x])))
    assert not push(5, 1.0) and not push(25, 2.0)
    assert push(15, 3.0) == [(5, 1.0)] and push(7, 9.0) == []
    assert [c.number for c in cells.open] == [1, 2]


def test_periods(spark):
    rows = spark.range(0, 200).select((F.col("id") * S).alias("ts"))
    assert AR.last_period(rows, "30s").count() == 30 and AR.last_period(rows, "1.5m").count() == 90 and AR.last_period(rows, "1w").count() == 200


def test_prefix_windows_do_not_depend_on_chunks(spark, wave):
    rows = wave.withColumn("value", F.when(F.col("ts") % 7 != 0, F.round("val", 1)))
    for chunk in (20 * S, 10**15):
        part = P.chunked(rows, F.col("ts"), chunk)
        out = P.number(part, ("channel",), "ts", "n")
        out = P.largest_before(out, ("channel",), "ts", "val", "top")
        out = P.last_known(P.sum_so_far(out, ("channel",), "ts", "n", "total"), ("channel",), "ts", "value", "known")
        out = P.following(P.preceding(out, ("channel",), "ts", "value", "before"), ("channel",), "ts", "value", "after").cache()
        for c in ("a", "b"):
            found = sorted(out.where(F.col("channel") == c).collect(), key=lambda r: r.ts)
            known = None
            for i, r in enumerate(found):
                known = r.value if r.value is not None else known
                assert (r.n, r.total, r.known) == (i, i * (i + 1) // 2, known)
                assert r.top == (max(x.val for x in found[:i]) if i else None)
                assert (r.before is None) == (i == 0) and (i == 0 or r.before.value == found[i - 1].value)
                assert r.after == (found[i + 1].value if i + 1 < len(found) else None)


def test_stream_lateness_is_the_channels_own(spark):
    fast = [("fast", p, 1000 * S + p * S, 1.0) for p in range(20)]
    slow = [("slow", p, p * S, 1.0) for p in range(20)] + [("slow", 20, 500 * S, 1.0), ("slow", 21, 3 * S, 1.0)]
    rows = spark.createDataFrame(fast + slow, "channel string, pkt long, ts long, val double")
    path, files = SR.arrived_in_parts(rows, "pkt", 5)
    out = SR.collected(SV.stream_aggregate(SR.stream_source(spark, path, rows.schema, files), Grid(S, 4, 2, 16), 30 * S))
    dropped = {(r.channel, r.lvl): r.dropped for r in SR.newest(out.where("bucket is null"), "channel", "lvl").collect()}
    assert dropped == {("fast", 0): 0, ("fast", 1): 0, ("slow", 0): 1, ("slow", 1): 1}
    kept = SR.newest(out.where("bucket is not null and lvl = 0"), "channel", "bucket").groupBy("channel").agg(F.sum("cnt").alias("n")).collect()
    assert {r.channel: r.n for r in kept} == {"fast": 20, "slow": 21}


def naive_levels(packets, widths, late):
    """Buckets and drops of one channel, point by point; packets: (ts, val) lists in order."""
    newest, done, dropped = None, {}, [0] * len(widths)
    for packet in packets:
        for t, v in packet:
            for lvl, w in enumerate(widths):
                b = t // w * w
                if newest is not None and b < newest - late - w:
                    dropped[lvl] += 1
                elif v is not None:
                    done.setdefault((lvl, b), []).append((t, v))
        newest = max([t for t, _ in packet] + ([] if newest is None else [newest]))
    return done, dropped


def test_stream_aggregate_against_loop(spark):
    """Packets out of order, nulls, late points for closed and open buckets, several batches and channels."""
    rng, rows, want, lost = random.Random(12), [], {}, {}
    grid, late = Grid(10, 4, 3, 16), 60
    for c in ("a", "b"):
        packets, at = [], 0
        for pkt in range(60):
            at += rng.randrange(0, 60)
            packet = [(max(0, at + rng.randrange(-400 if rng.random() < 0.1 else -30, 40)), None if rng.random() < 0.1 else round(rng.gauss(0, 1), 1)) for _ in range(rng.randrange(1, 12))]
            packet = list({t: (t, v) for t, v in packet}.values())
            packets.append(packet)
            rows += [(c, t, v, pkt) for t, v in packet]
        done, dropped = naive_levels(packets, [grid.width(i) for i in range(3)], late)
        for (lvl, b), points in done.items():
            low, high = min(points, key=lambda p: (p[1], p[0])), min(points, key=lambda p: (-p[1], p[0]))
            want[c, lvl, b] = (low[1], low[0], high[1], high[0], min(points)[0], max(points)[0], round(sum(v for _, v in points), 9), len(points))
        lost |= {(c, lvl): n for lvl, n in enumerate(dropped)}
    table = spark.createDataFrame(rows, "channel string, ts long, val double, pkt long").repartition(3)
    path, files = SR.arrived_in_parts(table, "pkt", 6)
    out = SR.collected(SV.stream_aggregate(SR.stream_source(spark, path, table.schema, files), grid, late)).cache()
    got = {(r.channel, r.lvl, r.bucket): (r.vmin, r.tmin, r.vmax, r.tmax, r.tfirst, r.tlast, round(r.vsum, 9), r.cnt) for r in SR.newest(out.where("bucket is not null"), "channel", "lvl", "bucket").collect()}
    assert got == want and min(lost.values()) > 0
    assert {(r.channel, r.lvl): r.dropped for r in SR.newest(out.where("bucket is null"), "channel", "lvl").collect()} == lost


def test_stream_aggregate_of_a_busy_channel(spark):
    """100,000 rows of one channel in a batch."""
    import time

    table = spark.range(100_000).select(F.lit("c").alias("channel"), (F.col("id") * (S // 10)).alias("ts"), F.rand(1).alias("val"), F.floor(F.col("id") / 500).alias("pkt"))
    path = SR.scratch(spark)
    table.repartition(4).write.parquet(path)
    stream = SV.stream_aggregate(SR.stream_source(spark, path, spark.read.parquet(path).schema, 10), Grid(S, 4, 4, 1024), 30 * S)
    began = time.time()
    out = SR.collected(stream)
    took = time.time() - began
    assert out.where("lvl = 0").agg(F.sum("cnt")).first()[0] == 100_000 and took < 60, took


def stubs():
    """A fixed linear forecaster and a fixed classifier; nested, so that workers needn't import this file."""

    def half_way(x):
        return 0.5 * x[:, 0] + 0.5 * x[:, 1]

    def odds(x):
        return 1 / (1 + np.exp(-4 * x[:, 2]))

    return half_way, odds


def test_models_in_the_pipeline_against_loop(spark, wave):
    """A fixed linear forecaster and a classifier, one row at a time."""
    p = ChannelParams(hampel_window=5, feature_window=6, chunk=90 * S)
    model = MO.ChannelModel(stubs()[0], 0.08, stubs()[1], 0.6, "stub")
    got = {(r.channel, r.ts): r for r in D.channel_pipeline(wave, p, MO.model_rows(spark, {"a": model})).collect()}
    naive = {(r.channel, r.ts): r for r in D.channel_pipeline(wave, p).collect()}
    rows = sorted(wave.where("channel = 'a'").collect(), key=lambda r: r.ts)
    x, x_f = [r.val for r in rows], []
    ahead, ratios = None, 0
    for i, r in enumerate(rows):
        w = x[max(0, i - 4) : i + 1]
        median = statistics.median(w)
        sigma = 1.4826 * statistics.median([abs(v - median) for v in w])
        x_f.append(median if len(w) == 5 and sigma > 0 and abs(x[i] - median) > 3 * sigma else x[i])
        found, prob = got["a", r.ts], None
        flag = ahead is not None and abs(x[i] - ahead) > 3 * 0.08
        assert (found.pred is None) == (ahead is None) and (ahead is None or abs(found.pred - ahead) < 1e-9)
        ahead = None
        if i >= 5:
            frame = x_f[i - 5 :]
            ahead = 0.5 * x_f[i] + 0.5 * statistics.mean(frame)
            prob = 1 / (1 + math.exp(-4 * statistics.pstdev(frame)))
            assert abs(found.prob - prob) < 1e-9
        assert found.anomaly == (flag or (prob is not None and prob > 0.6))
        ratios += found.prob_ratio is not None
    assert ratios > 0 and all(got[k] == naive[k] for k in naive if k[0] == "b")


def test_model_change_keeps_filters_and_resets_residuals(spark, wave):
    p = ChannelParams(hampel_window=5, feature_window=6, warm_up=50)
    model = MO.ChannelModel(stubs()[0], 0.08, version="stub")
    cut = 600 * S
    rows = wave.withColumn("version", (F.col("ts") >= cut).cast("int"))
    path, files = SR.arrived_in_parts(rows, "ts", 5)
    setups = lambda c, v: (p, model if c == "a" and v else MO.NAIVE)
    out = {(r.channel, r.ts): r for r in SR.collected(SF.stream_diagnostics(SR.stream_source(spark, path, rows.schema, files), setups, p)).collect()}
    before, after = ({(r.channel, r.ts): r for r in D.channel_pipeline(wave, p, m).collect()} for m in (None, MO.model_rows(spark, {"a": model})))
    first = min(t for c, t in out if c == "a" and t >= cut)
    for (c, t), r in out.items():
        want = after[c, t] if c == "a" and t >= cut else before[c, t]
        assert (r.val_f, r.substituted) == (want.val_f, want.substituted)
        assert r.pred is None if (c, t) == ("a", first) else r.pred == want.pred and r.anomaly == want.anomaly


def test_models_of_each_channel(spark, wave):
    p = ChannelParams(hampel_window=5, feature_window=6)
    two = wave.withColumn("val", F.when(F.col("channel") == "b", 9 * F.col("val") + 100).otherwise(F.col("val")))
    rows = H.diagnosed(two, p).cache()
    models, metrics = ML.train_forecasters(rows, p, trees=20, depth=3)
    found = {r.channel: r for r in metrics.collect()}
    sigma = {r.channel: r.sigma for r in models.collect()}
    assert set(sigma) == set(found) == {"a", "b"} and 0 < sigma["a"] < sigma["b"]
    gains = [r.gain for r in found.values()]
    assert min(gains) > 0 and all(r.n_train > 2 * r.n_val > 0 for r in found.values()), gains  # better than no change
    # the spread is that of raw next values, a channel at a time
    split = H.chronological_split(H.increment_target(rows, p), 6).where("part = 'val' and channel = 'a'")
    r = [x.next_val - x.pred_next for x in ML.predict_forecasters(split, models).collect()]
    m = statistics.median(r)
    assert abs(sigma["a"] - 1.4826 * statistics.median([abs(v - m) for v in r])) < 1e-9
    got = ML.predict_forecasters(rows, models).groupBy("channel").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.where("mean is not null").groupBy("channel").count().collect()))
    flagged = H.residual_fixed_sigma(rows, 0.2, 3.0).withColumnRenamed("anomaly", "residual_flag").drop("prob")
    flagged = flagged.withColumn("label", (F.col("std") > F.when(F.col("channel") == "a", 0.4).otherwise(3.6)).cast("double")).cache()
    judged = ML.predict_classifiers(flagged, ML.train_classifiers(flagged.where("ts < 4000000000"), "label", 0.5)).where("mean is not null and ts >= 4000000000")
    right = judged.agg(F.avg(((F.col("prob") > 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    assert right > 0.97 and judged.where("anomaly and score is null").isEmpty()


def grown(x, y, trees, depth, rate, logistic):
    """Boosted trees row by row and split by split: predictions for the rows they were grown on."""
    limits = [[float(q) for q in np.quantile(c, np.linspace(0, 1, ML.BINS + 1)[1:-1])] for c in x.T]
    share = min(max(float(np.mean(y)), 1e-6), 1 - 1e-6)
    score = [math.log(share / (1 - share)) if logistic else float(np.mean(y))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score] if logistic else score
        g, h = [a - b for a, b in zip(y, p, strict=True)], [max(a * (1 - a), 1e-9) for a in p] if logistic else [1.0] * len(y)
        worth = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1e-3)  # noqa: E731,B023
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best, parts = 1e-12, (rows, [])
                for f, cuts in enumerate(limits):
                    for cut in cuts:
                        left, right = [i for i in rows if x[i, f] <= cut], [i for i in rows if x[i, f] > cut]
                        if min(len(left), len(right)) >= ML.LEAF and (gain := worth(left) + worth(right) - worth(rows)) > best + 1e-9:
                            best, parts = gain, (left, right)
                below += parts
            nodes = below
        for rows in nodes:
            if rows:
                step = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1e-3)
                for i in rows:
                    score[i] += step
    return score


@pytest.mark.parametrize("logistic", [False, True])
def test_boosted_trees_against_loop(logistic):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] + 0.1 * rng.normal(size=200)
    y = (y + 3 * rng.normal(size=200) > 0).astype(float) if logistic else y  # mixed leaves: no ties between splits
    trees, depth = (3, 2) if logistic else (4, 3)
    want = grown(x, y.tolist(), trees, depth, 0.3, logistic)
    assert np.abs(ML.boosted(x, y, trees, depth, 0.3, logistic)(x) - want).max() < 1e-6


def test_plans_do_not_grow_with_channels(spark, wave):
    """Models reach tasks as rows: a plan says nothing about them, however many channels have one."""
    p = ChannelParams(hampel_window=5, feature_window=6)
    sizes = []
    for n in (1, 300):
        models = MO.model_rows(spark, {f"c{i}": MO.ChannelModel(stubs()[0], 0.1, stubs()[1], 0.5, "s") for i in range(n)})
        path = SR.scratch(spark)
        models.write.parquet(path)
        models = spark.read.parquet(path)
        rows = H.diagnosed(wave, p, models).drop("prob")
        judged = ML.predict_classifiers(rows.withColumns({"thr": F.lit(0.1), "residual_flag": F.lit(False)}), models)
        plan = judged._jdf.queryExecution().optimizedPlan().toString() + ML.predict_forecasters(rows, models)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert abs(sizes[0] - sizes[1]) < 0.05 * sizes[0], sizes


def test_model_table(spark, wave):
    """The version that sorts last holds, the registry names active ones, channels without a model pass or go."""
    p = ChannelParams(hampel_window=5, feature_window=6)
    old, new = (MO.ChannelModel(stubs()[0], s, None, version=v) for s, v in ((0.5, "m/1"), (0.08, "m/2")))
    table = MO.model_rows(spark, {"a": old}).unionByName(MO.model_rows(spark, {"a": new}))
    registry = spark.createDataFrame([(1, "a", "forecaster", "m/1", True), (2, "a", "forecaster", "m/2", False), (3, "x", "forecaster", "m/3", True)], "model_id int, channel string, kind string, path string, active boolean")
    assert [(r.channel, r.m_sigma, r.m_classify) for r in MO.by_channel(table).collect()] == [("a", 0.08, None)]
    active = MO.active_only(table, registry)
    assert [(r.version, r.sigma) for r in active.collect()] == [("m/1", 0.5)]
    thr = {r.thr for r in D.channel_pipeline(wave, p, active).where("channel = 'a' and thr is not null").collect()}
    assert thr == {p.residual_k * 0.5}
    rows = H.diagnosed(wave, p).drop("prob").withColumns({"thr": F.lit(0.1), "residual_flag": F.lit(False)})
    assert {r.channel for r in ML.predict_forecasters(rows, active).select("channel").distinct().collect()} == {"a"}
    judged = ML.predict_classifiers(rows, MO.model_rows(spark, {"b": MO.ChannelModel(classify=stubs()[1], gamma=0.6)}))
    counts = {r.channel: (r.n, r.k, r.a) for r in judged.groupBy("channel").agg(F.count("*").alias("n"), F.count("prob").alias("k"), F.count_if("anomaly").alias("a")).collect()}
    n = {r.channel: r["count"] for r in wave.groupBy("channel").count().collect()}
    assert counts["a"] == (n["a"], 0, 0) and counts["b"][:2] == (n["b"], n["b"] - p.feature_window + 1) and counts["b"][2] == judged.where("prob > 0.6").count()


def test_no_models(spark, wave):
    none = H.diagnosed(wave.limit(3))
    models, metrics = ML.train_forecasters(none, trees=2, depth=2)
    assert models.count() == 0 and metrics.count() == 0 and ML.predict_forecasters(none, models).count() == 0


def test_entry_without_corpus_subpackage(monkeypatch):
    import __spark_entry__ as entry

    whole = set(entry.queries())
    monkeypatch.setitem(sys.modules, "chronoloom.llm", None)
    assert set(entry.queries()) == set(catalog.QUERIES) <= whole and set(entry.oracle_sql()) == set(catalog.SQL)
