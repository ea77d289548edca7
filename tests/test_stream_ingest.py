"""Ingest of packets: order, repeats and bad times in packets, acks, registration, repeated batches."""

import json

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import ingest as I
from chronoloom.sources.files import explode_packets, parse_packet_json
from chronoloom.storage import scratch
from chronoloom.streaming import ingest as SI

T = 1_700_000_000_000_000


def packet(seq, **channels):
    return json.dumps({"seq": seq, "source": "s", "sent_at": 0, "channels": [{"id": c, "ts": t, "val": v} for c, (t, v) in channels.items()]})


BATCHES = [
    [packet(1, a=([T + 3, T + 1, T + 3], [1.0, 2.0, 3.0]), b=([T], [5.0])), packet(2, c=([5], [1.0])), "no packet", packet(1, a=([T + 3, T + 1, T + 3], [1.0, 2.0, 3.0]), b=([T], [5.0]))],
    [packet(3, c=([T], [None]), d=([], [])), packet(4, a=([T + 9], [1.0, 2.0])), packet(5)],
    [packet(6, d=([T + 1], [7.0]), e=([T + 1, T + 2], [99.0, 1.0]))],
]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("a", 0.0, 2.5, True), ("e", None, 50.0, False)], "channel string, x_min double, x_max double, analytics_enabled boolean")


@pytest.fixture(scope="module")
def path(spark, registry):
    out = scratch(spark)
    for number, lines in enumerate(BATCHES):
        for _ in range(2):  # every batch is repeated
            SI.ingest_batch(spark.createDataFrame([(x,) for x in lines], "body string"), registry, out, number, F.lit(7).cast("long"))
    return out


def test_rows_and_acks(spark, path):
    rows = sorted(tuple(r) for r in SI.stored(spark, path, "rows").select("seq", "channel", "ts", "val", "quality", "batch_id").collect())
    assert rows == [(1, "a", T + 1, 2.0, "good", 0), (1, "a", T + 3, 3.0, "uncertain", 0), (1, "b", T, 5.0, "good", 0), (3, "c", T, None, "bad", 1), (6, "d", T + 1, 7.0, "good", 2), (6, "e", T + 1, 99.0, "uncertain", 2), (6, "e", T + 2, 1.0, "good", 2)]
    acks = {r.pkt: tuple(r)[1:6] for r in SI.stored(spark, path, "acks").collect()}
    assert acks == {
        1: (3, 1, 3, [], ["b"]), 2: (0, 1, 0, ["c: times out of range"], ["c"]), 3: (1, 0, 0, [], ["d"]), 5: (0, 0, 0, [], []), 6: (3, 0, 0, [], []),
    }
    assert sorted((r.line, r.error) for r in SI.stored(spark, path, "broken").collect()) == [("4", "lengths of arrays differ"), ("no packet", "not a packet")]


def test_channels_are_new_once(spark, path, registry):
    found = sorted((r.channel, r.batch_id) for r in SI.stored(spark, path, "channels").collect())
    assert found == [("b", 0), ("c", 0), ("d", 1)]
    all_of_them = {r.channel: r.analytics_enabled for r in SI.registered(registry, path).collect()}
    assert all_of_them == {"a": True, "b": True, "c": True, "d": True, "e": False}


def test_acks_equal_those_of_one_batch(spark, path, registry):
    lines = spark.createDataFrame([(x,) for batch in BATCHES for x in batch], "body string").distinct()
    rows, _ = explode_packets(parse_packet_json(lines)[0])
    whole = {r.pkt: tuple(r)[1:5] for r in I.packet_ack(rows.withColumnRenamed("seq", "pkt"), registry).collect()}
    acks = {r.pkt: tuple(r)[1:5] for r in SI.stored(spark, path, "acks").collect()}
    assert whole == {p: a for p, a in acks.items() if p in whole} and set(acks) - set(whole) == {5}
