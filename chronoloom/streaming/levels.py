"""Buckets of all levels on a stream, with the open ones as a state by level and bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.grid import FIELDS
from ..params import Grid
from .run import prepare

KINDS = {c: "long" if c[0] == "t" or c == "cnt" else "double" for c in FIELDS}
LEVELS = "channel string, lvl int, bucket long, " + ", ".join(f"{c} {k}" for c, k in KINDS.items()) + ", dropped long"
PART = "channel string, pkt long, bucket long, points long, top long, " + ", ".join(f"{c} {k}" for c, k in KINDS.items())
NONE = -(2**62)

Columns = dict[str, np.ndarray]


def reduced(key: np.ndarray, parts: Columns) -> tuple[np.ndarray, Columns]:
    """Partial buckets with one key joined, in order of keys: of equal extremes the earliest, of equal times at the ends
    the part that came first."""
    came = np.arange(len(key))
    first = lambda *by: np.lexsort((*by[::-1], key))
    low, high = first(parts["vmin"], parts["tmin"]), first(-parts["vmax"], parts["tmax"])
    begin, end = first(parts["tfirst"], came), first(-parts["tlast"], came)
    ordered = key[low]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(key)])
    order = np.argsort(key, kind="stable")
    out = {c: parts[c][i[at]] for i, names in ((low, ("vmin", "tmin")), (high, ("vmax", "tmax")), (begin, ("vfirst", "tfirst")), (end, ("vlast", "tlast"))) for c in names}
    out |= {c: np.add.reduceat(parts[c][order], at) if len(at) else parts[c] for c in ("vsum", "cnt")}
    return ordered[at], out


def _of_rows(ts: np.ndarray, x: np.ndarray) -> Columns:
    """Rows as buckets of one point."""
    one = {c: x for c in FIELDS if c[0] == "v"} | {c: ts for c in FIELDS if c[0] == "t"}
    return one | {"cnt": np.ones(len(ts), np.int64)}


def _partials(width: int):
    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("channel").dictionary_encode()
            ts, pkt = batch.column("ts").to_numpy(), batch.column("pkt").to_numpy()
            x = batch.column("val").to_numpy(zero_copy_only=False).astype(float)
            bucket = ts // width * width
            where = pd.MultiIndex.from_arrays([names.indices.to_numpy(), pkt, bucket])
            key, groups = pd.factorize(where, sort=False)
            points, top = np.bincount(key, minlength=len(groups)), np.full(len(groups), NONE)
            np.maximum.at(top, key, ts)
            fine = ~np.isnan(x)
            own, found = reduced(key[fine], _of_rows(ts[fine], x[fine]))
            # groups without a value have points, but no bucket
            columns = {c: np.zeros(len(groups), float if KINDS[c] == "double" else np.int64) for c in FIELDS}
            for c, v in found.items():
                columns[c][own] = v
            code, packet, begin = (groups.get_level_values(i).to_numpy() for i in range(3))
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code)), pa.array(packet), pa.array(begin), pa.array(points), pa.array(top), *(pa.array(columns[c]) for c in FIELDS)], [c.split()[0] for c in PART.split(", ")])

    return partials


class Levels(StatefulProcessor):
    """head: newest time, and per level the points that came too late. opened: buckets that may still change."""

    def __init__(self, widths: list[int], late: int):
        self.widths, self.late = widths, late

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", "newest long, dropped array<long>")
        self.opened = handle.getMapState("opened", "lvl int, bucket long", ", ".join(f"{c} {k}" for c, k in KINDS.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("pkt", kind="stable")
        newest, dropped = self.head.get() if self.head.exists() else (NONE, [0] * len(self.widths))
        packet, top, bucket, points, cnt = (pdf[c].to_numpy(np.int64) for c in ("pkt", "top", "bucket", "points", "cnt"))
        # what was the newest time when a packet came: that of all before it
        first = np.flatnonzero(np.append(True, packet[1:] != packet[:-1]))
        tops = np.maximum.accumulate(np.append(newest, np.maximum.reduceat(top, first)))
        seen = np.repeat(tops[:-1], np.diff(np.append(first, len(packet))))
        parts = {c: pdf[c].to_numpy(np.int64 if KINDS[c] == "long" else float) for c in FIELDS}
        out, lost, horizon = [], [], int(tops[-1]) - self.late
        for lvl, width in enumerate(self.widths):
            own = bucket // width * width
            fine = own >= np.where(seen == NONE, NONE, seen - self.late - width)
            lost.append(int(dropped[lvl]) + int(points[~fine].sum()))
            use = fine & (cnt > 0)
            touched = np.unique(own[use])
            held = [(b, self.opened.getValue((lvl, int(b)))) for b in touched.tolist() if b >= newest - self.late - width and self.opened.containsKey((lvl, int(b)))] if newest != NONE else []
            keys = np.append(np.array([b for b, _ in held], np.int64), own[use])
            both = {c: np.append(np.array([v[i] for _, v in held], parts[c].dtype), parts[c][use]) for i, c in enumerate(FIELDS)}
            buckets, joined = reduced(keys, both)
            for i in np.flatnonzero(buckets >= horizon - width).tolist():
                self.opened.updateValue((lvl, int(buckets[i])), tuple(joined[c][i].item() for c in FIELDS))
            out.append(pd.DataFrame({"lvl": lvl, "bucket": buckets} | {c: joined[c] for c in FIELDS}))
        for lvl, b in [k for k in self.opened.keys() if k[1] < horizon - self.widths[k[0]]]:
            self.opened.removeKey((lvl, b))
        self.head.update((int(tops[-1]), lost))
        out.append(pd.DataFrame({"lvl": range(len(self.widths)), "dropped": lost}))
        whole = pd.concat(out, ignore_index=True)
        yield whole.assign(channel=key[0], **{c: whole[c].astype("Int64") for c in ("bucket", "dropped", *(c for c, k in KINDS.items() if k == "long"))})[[c.split()[0] for c in LEVELS.split(", ")]]

    def close(self) -> None:
        pass


def stream_aggregate(rows: DataFrame, grid: Grid, late: int) -> DataFrame:
    """Buckets of all levels of a stream of rows (channel, ts, val, pkt), as they are after each batch (update mode),
    and of each level a row with a null bucket and ``dropped``, the points so far that came too late for it.

    Rows become partial buckets of the finest level where they are read; a channel's partial buckets of one micro-batch
    are handled together. With each packet, buckets that end ``late`` before the newest time of the channel's packets
    before it are closed: a point for a closed bucket is dropped and counted. The state holds the open buckets only.
    Lateness is the channel's own."""
    prepare(rows.sparkSession)
    widths = [grid.width(i) for i in range(grid.levels)]
    parts = rows.select("channel", F.col("ts").cast("long").alias("ts"), F.col("val").cast("double").alias("val"), F.col("pkt").cast("long").alias("pkt")).mapInArrow(_partials(grid.width(0)), PART)
    return parts.groupBy("channel").transformWithStateInPandas(Levels(widths, late), outputStructType=LEVELS, outputMode="Append", timeMode="None")
