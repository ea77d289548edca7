"""Rows that are costly to make are made once, or a fixed number of times, by what writes and reads them."""

import random

import pytest

from chronoloom.operators import alarms as A
from chronoloom.operators import filters as H
from chronoloom.operators import ml as ML
from chronoloom.params import ChannelParams
from chronoloom.sources import alarm_tables as AT
from chronoloom.storage import scratch, written
from chronoloom.streaming import run as SR


@pytest.fixture
def counted(spark):
    """A frame whose rows are counted as they are made, and the count."""

    def of(df):
        seen = spark.sparkContext.accumulator(0)

        def count(frames):
            for pdf in frames:
                seen.add(len(pdf))
                yield pdf

        return df.mapInPandas(count, df.schema), seen

    return of


def test_alarm_tables_read_a_batch_once(spark, counted):
    path = scratch(spark)
    rows = [(r, "c", t, "activated", "normal", "unack_active", 1.0, None) for r in (1, 2) for t in range(5)]
    for batch in range(2):
        log, seen = counted(spark.createDataFrame([(r, c, t + 10 * batch, *rest) for r, c, t, *rest in rows], A.LOG))
        AT.write_alarm_tables(log, path, batch)
        assert seen.value == len(rows)
    assert sorted(AT.occurrences(spark, path).select("rule_id", "occurrence", "ts_active").collect()) == sorted((r, 1 + i, t) for r in (1, 2) for i, t in enumerate([*range(5), *range(10, 15)]))


def test_arrived_rows_are_made_once(spark, counted):
    rows, seen = counted(spark.createDataFrame([(t, str(t)) for t in (0, 1, 2, 3, 4, 97, 98, 99)], "t long, x string"))
    path, files = SR.arrived_in_parts(rows, "t")  # two of the four parts are empty
    assert seen.value == 8 and files == 1
    assert sorted(SR.collected(SR.stream_source(spark, path, rows.schema, files)).select("t", "batch_id").collect()) == [(t, int(t > 50)) for t in (0, 1, 2, 3, 4, 97, 98, 99)]


def test_training_reads_its_rows_a_few_times(spark, counted):
    rng, p = random.Random(3), ChannelParams()
    valid = spark.createDataFrame([(c, 60_000_000 * i, rng.random()) for c in "ab" for i in range(400)], "channel string, ts long, val double")
    rows, seen = counted(written(H.diagnosed(valid, p)))
    metrics = {r.channel: (r.n_train, r.n_val > 30, r.n_test > 30) for r in ML.train_forecasters(rows, p, trees=2, depth=2)[1].collect()}
    assert metrics == dict.fromkeys("ab", (222, True, True)) and seen.value <= 2 * 800
