"""Stored tables: partitions, upserts, compaction, retention; events of a run."""

import json
import random
from datetime import date

from pyspark.sql import functions as F

from chronoloom.operators import models as MO
from chronoloom.params import DAY, ChannelParams
from chronoloom.sources import archive as AR
from chronoloom.sources import stored as ST
from chronoloom.storage import scratch

FIRST = 19_700 * DAY  # 2023-12-09
ROWS = "channel string, ts long, val double, run string, arrival long"


def some(spark, n, days, seed):
    rng = random.Random(seed)
    return [(rng.choice("ab"), FIRST + rng.randrange(days) * DAY + rng.randrange(40), float(i), "online", i) for i in range(n)]


def test_compaction_keeps_the_last_of_each_key(spark):
    table, want, batches = ST.telemetry(scratch(spark)), {}, {}
    for batch in range(3):
        rows = some(spark, 120, 6 if batch < 2 else 2, batch)
        AR.upsert_telemetry(spark.createDataFrame(rows, ROWS), table, batch)
        for c, t, v, *_ in rows:
            want[c, t] = v
            batches.setdefault(t // DAY, set()).add(batch)
    AR.upsert_telemetry(spark.createDataFrame(rows, ROWS), table, 2)  # repeated
    seen = lambda: {(r.channel, r.ts): r.val for r in table.scan(spark).collect()}
    assert seen() == want
    assert table.compact(spark) == sum(len(b) > 1 for b in batches.values())
    assert seen() == want
    stored = spark.read.parquet(table.path)
    assert stored.count() == len(want) and stored.groupBy("day").agg(F.countDistinct("batch_id").alias("n")).count() == 6
    table.upsert(spark.createDataFrame([("a", FIRST, -1.0, "online", 0)], ROWS), 7)  # goes on after compaction
    assert seen() == want | {("a", FIRST): -1.0}
    again = table.compact(spark)
    assert again in (1, sum(len(b) > 1 for b in batches.values())) and seen() == want | {("a", FIRST): -1.0}


def test_ranges_prune_partitions(spark):
    day, month = ST.flags(scratch(spark)), ST.aggregates(scratch(spark))
    rows = [(c, FIRST + i * DAY, 1.0, "online", 0) for i in range(60) for c in "ab"]
    day.upsert(spark.createDataFrame(rows, ROWS), 0)
    month.upsert(spark.createDataFrame([(c, i % 2, t) for i, (c, t, *_) in enumerate(rows)], "channel string, lvl int, bucket long"), 0)
    lo, hi = FIRST + 10 * DAY, FIRST + 12 * DAY + 1
    found = day.scan(spark, lo, hi)
    assert found.count() == 6 and "run" in found.columns and "day" not in found.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    part = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in part and ">=" in part and "<=" in part
    files = {f.split("day=")[1][:10] for f in spark.read.parquet(day.path).where(day.within(lo, hi)).inputFiles()}
    assert len(files) == 60 or files == {"2023-12-19", "2023-12-20", "2023-12-21"}
    assert [n for n, _ in month.partitions(spark)] == sorted(2 * ["2023-12", "2024-01", "2024-02"])
    assert month.scan(spark, lo, hi).count() == 6


def test_retention_drops_whole_partitions_of_each_table(spark):
    import os

    raw, agg = ST.telemetry(scratch(spark)), ST.aggregates(scratch(spark))
    rows = [("a", FIRST + i * DAY + 5, 1.0, "online", 0) for i in range(80)]
    raw.upsert(spark.createDataFrame(rows, ROWS), 0)
    agg.upsert(spark.createDataFrame([("a", i % 2, t) for i, (_, t, *_) in enumerate(rows)], "channel string, lvl int, bucket long"), 0)
    cut = raw.retain(spark, 7 * DAY)
    assert cut == rows[-1][1] - 7 * DAY
    names = [n for n, _ in raw.partitions(spark)]
    assert len(names) == 8 and names[0] == date.fromordinal(date(1970, 1, 1).toordinal() + cut // DAY).isoformat()
    assert sorted(x for x in os.listdir(raw.path.removeprefix("file://")) if x.startswith("day=")) == ["day=" + n for n in names]
    assert raw.scan(spark, cut).count() == 8 and len(agg.partitions(spark)) == 6  # a table of its own
    agg.retain(spark, 40 * DAY)
    assert sorted({n for n, _ in agg.partitions(spark)}) == ["2024-01", "2024-02"]
    assert ST.flags(scratch(spark)).retain(spark, DAY) is None


def test_events_tell_what_made_them(spark):
    episode = "channel string, kind string, ts_start long, ts_end long, n_points long, peak_ts long, peak_value double, score double"
    rows = spark.createDataFrame([(c, "anomaly", 1, 2, 2, 1, 0.5, 1.5) for c in "ab"], episode)
    p = ChannelParams(hampel_window=7, residual_k=4.5)
    events = {r.channel: r for r in AR.event_rows(rows, "rerun", p, MO.model_rows(spark, {"a": MO.ChannelModel(sigma=1.0, version="m/3")})).collect()}
    details = {c: json.loads(r.details) for c, r in events.items()}
    assert [events[c].model_version for c in "ab"] == [details[c]["model"] for c in "ab"] == ["m/3", "naive"]
    assert details["a"]["params"]["hampel_window"] == 7 and details["a"]["params"]["residual_k"] == 4.5 and details["a"]["n_points"] == 2 and "chunk" not in details["a"]["params"]
