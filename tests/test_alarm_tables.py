"""Stored alarm tables against a loop over the log, and streams that go on from them."""

import random

import pandas as pd
import pytest

from chronoloom.operators import alarms as A
from chronoloom.sources import alarm_tables as AT
from chronoloom.storage import scratch

RULE = {"kind": "hi", "limit": 10.0, "deadband": 2.0, "on_delay": 30, "off_delay": 20, "min_repeat": 40}
KINDS = {1: {}, 2: {"kind": "lolo", "limit": 4.0}, 3: {"kind": "anomaly", "limit": None, "on_delay": 0}, 4: {"on_delay": 0, "off_delay": 0, "min_repeat": 0}}
INPUTS = "rule_id int, channel string, kind string, limit double, deadband double, on_delay long, off_delay long, min_repeat long, ts long, value double, anomaly boolean, is_ack int, user string"


def steps(seed, n=400):
    """Readings that stay on a side for a while, some null, and acknowledgements, of several rules."""
    rng, out = random.Random(seed), []
    for rule, other in KINDS.items():
        level = 5.0
        for i in range(n):
            if rng.random() < 0.08:
                level = rng.choice([3.0, 5.0, 9.0, 11.0])
            value = None if rng.random() < 0.03 else float("nan") if rng.random() < 0.02 else level + rng.random()
            own = RULE | other
            row = [rule, f"c{rule}", own["kind"], own["limit"], own["deadband"], own["on_delay"], own["off_delay"], own["min_repeat"], 7 * i, value, level > 8, 0, None]
            out.append(tuple(row))
            if rng.random() < 0.05:
                out.append((*row[:8], 7 * i + 3, None, False, 1, rng.choice(["ann", "bo"])))
    return out


def walked(rows, opened=None):
    """The log of all rules over rows in order."""
    out = []
    pdf = pd.DataFrame(rows, columns=[x.split()[0] for x in INPUTS.split(", ")])
    for rule, own in pdf.groupby("rule_id"):
        alarm = (opened or {}).get(rule, A.Alarm())
        out += A.walk(alarm, own.sort_values(["ts", "is_ack"], kind="stable"))
    return sorted(out, key=lambda r: (r[0], r[2], r[3] == "acknowledged"))


def folded(log):
    """Occurrences of a log, one row at a time."""
    table, number = {}, {}
    for rule, channel, ts, what, before, after, value, user in log:
        if (what == "activated" and before == A.NORMAL) or rule not in number:
            number[rule] = number.get(rule, 0) + 1
            table[rule, number[rule]] = {"channel": channel, "ts_active": ts, "value": value, "ts_on": None, "ts_return": None, "ts_ack": None, "acked_by": None}
        row = table[rule, number[rule]]
        row["state"] = after
        if what == "activated":
            row |= {"ts_return": None, "ts_on": ts}
        elif what == "returned":
            row["ts_return"] = ts
        else:
            row |= {"ts_ack": ts, "acked_by": user}
    return table


@pytest.mark.parametrize("seed", [1, 2])
def test_tables_by_batches_equal_the_whole_log(spark, seed):
    log, path = walked(steps(seed)), scratch(spark)
    assert len({r[3] for r in log}) == 3 and len(log) > 30
    borders = [0, 300, 301, 900, 1700, 10_000]
    for batch, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
        part = spark.createDataFrame([r for r in log if a <= r[2] < b], A.LOG)
        for _ in range(1 + batch % 2):  # some batches are repeated
            AT.write_alarm_tables(part, path, batch)
    AT.write_alarm_tables(part, path, batch)  # the last one, once more
    got = {(r.rule_id, r.occurrence): {k: v for k, v in r.asDict().items() if k not in ("rule_id", "occurrence")} for r in AT.occurrences(spark, path).collect()}
    assert got == folded(log)
    stored = AT.alarm_log(spark, path)
    assert sorted(map(repr, (tuple(r)[:8] for r in stored.collect()))) == sorted(map(repr, log))
    assert {(r.rule_id, r.occurrence) for r in stored.collect()} == set(got)
    # compacted up to a batch, then the later ones again
    target = scratch(spark)
    AT.compact(spark, path, target, 2)
    for batch in (3, 4):
        AT.write_alarm_tables(spark.createDataFrame([r for r in log if borders[batch] <= r[2] < borders[batch + 1]], A.LOG), target, batch)
    assert AT.occurrences(spark, target).exceptAll(AT.occurrences(spark, path)).isEmpty() and AT.occurrences(spark, target).count() == len(got)


@pytest.mark.parametrize("chunk", [50, 10**6])
def test_life_cycle_from_run_borders_equals_all_readings(spark, chunk):
    rows = steps(7, 1500)
    inputs = spark.createDataFrame(rows, INPUTS).repartition(3)
    assert sorted(map(repr, map(tuple, A.alarm_lifecycle(inputs, chunk).collect()))) == sorted(map(repr, walked(rows)))
    few = A.run_borders(inputs.where("is_ack = 0"), chunk)
    runs = 0
    for rule in KINDS:
        own = pd.DataFrame([r for r in rows if r[0] == rule and not r[11]], columns=[x.split()[0] for x in INPUTS.split(", ")])
        calls = A.calls_of(own)
        goal = calls[True].astype(int) - calls[False]
        runs += 1 + int((goal[1:] != goal[:-1]).sum())
    repeats = few.where("goal and min_repeat > 0 and ts > since + on_delay + 7").count()
    assert few.count() <= runs + repeats and few.count() < len(rows) / 5


@pytest.mark.parametrize("cut", [140, 701, 1407, 2100])
def test_restart_from_tables_equals_one_run(spark, cut):
    """Wherever the first run stops: also within a delay that is running."""
    rows, path = steps(5), scratch(spark)
    first, rest = [r for r in rows if r[8] < cut], [r for r in rows if r[8] >= cut]
    before = walked(first)
    AT.write_alarm_tables(spark.createDataFrame(before, A.LOG), path, 0)
    readings = spark.createDataFrame([r for r in first if r[11] == 0], INPUTS)
    opened = {}
    for r in AT.initial_state(AT.occurrences(spark, path), readings).collect():
        opened[r.rule_id] = A.Alarm(r.state, A.Debounce(r.condition, r.called, r.last_on))
    assert sorted(map(repr, before + walked(rest, opened))) == sorted(map(repr, walked(rows)))


def test_state_without_readings_starts_delays_anew(spark):
    path = scratch(spark)
    log = [(1, "c", 100, "activated", A.NORMAL, A.UNACK_ACTIVE, 1.0, None), (2, "c", 90, "activated", A.NORMAL, A.UNACK_ACTIVE, 1.0, None), (2, "c", 95, "acknowledged", A.UNACK_ACTIVE, A.ACK_ACTIVE, None, "x"), (2, "c", 99, "returned", A.ACK_ACTIVE, A.NORMAL, 0.0, None)]
    AT.write_alarm_tables(spark.createDataFrame(log, A.LOG), path, 0)
    assert sorted(map(tuple, AT.initial_state(AT.occurrences(spark, path)).collect())) == [(1, A.UNACK_ACTIVE, True, 100, None), (2, A.NORMAL, False, 90, None)]


def test_no_tables_yet(spark):
    path = scratch(spark)
    assert AT.occurrences(spark, path).count() == 0 and AT.alarm_log(spark, path).count() == 0
    AT.write_alarm_tables(spark.createDataFrame([], A.LOG), path, 0)
    assert AT.occurrences(spark, path).count() == 0
