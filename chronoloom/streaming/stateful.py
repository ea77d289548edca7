"""Streams with a state for each channel or rule: diagnostics, episodes, chart cells, alarms.

The states are the same objects that the batch operators walk with, so a stream of batches and one large batch give
the same rows. Rows of a key are put in time order inside a micro-batch, so a key's rows of one micro-batch (which
``files`` in stream_source bounds) are held at once; they are handled in steps of bounded size. Closing goes by the
key's own newest time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.alarms import LOG, LOG_NAMES, Alarm, Debounce, walk
from ..operators.detect import Spread, judged
from ..operators.downsample import POINT, Cells
from ..operators.filters import FEATURES, diagnosis
from ..operators.models import NAIVE, ChannelModel
from ..params import ChannelParams
from .run import prepare

STEP = 20_000  # rows of a key that a step handles

Step = Callable[[tuple, Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


class Folding(StatefulProcessor):
    """step(key, state, rows) -> (state, output) for each key and batch; a state is any value that can be pickled."""

    def __init__(self, step: Step, order: list[str], opening: Callable[[pd.DataFrame], Any] | None = None):
        self.step, self.order, self.opening = step, order, opening

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.held.get()[0]) if self.held.exists() else None
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        for at in range(0, len(pdf), STEP):
            state, out = self.step(key, state, pdf.iloc[at : at + STEP])
            if len(out):
                yield out
        self.held.update((pickle.dumps(state),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if self.opening is not None and len(initialState):
            self.held.update((pickle.dumps(self.opening(initialState)),))

    def close(self) -> None:
        pass


def folded(rows: DataFrame, key: str, step: Step, order: list[str], schema: str, initial: DataFrame | None = None, opening=None) -> DataFrame:
    prepare(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(
        Folding(step, order, opening), outputStructType=schema, outputMode="Append", timeMode="None", initialState=initial.groupBy(key) if initial is not None else None
    )


DIAGNOSIS = (
    "channel string, ts long, val double, val_f double, median double, substituted boolean, " + ", ".join(f"{c} double" for c in FEATURES)
    + ", pred double, resid double, prob double, thr double, anomaly boolean, prob_ratio double"
)
#: Parameters and model of a channel, as one version; a higher version replaces them while a stream runs.
Setup = tuple[ChannelParams, ChannelModel]


def stream_diagnostics(valid: DataFrame, setups: Callable[[str], Setup] | None = None, p: ChannelParams = ChannelParams()) -> DataFrame:
    """The channel pipeline on a stream of valid rows (channel, ts, val, and maybe ``version``).

    ``setups`` gives what holds for a channel and, if rows have a version, is called with (channel, version); the
    version of the newest row of a step holds for the whole step. Where a channel's parameters changed since its last
    step, it starts anew. Where only its model changed, filter and features go on, and the spread of residuals starts
    anew, without a forecast for the first row. Other channels go on. Rows not newer than a channel's last are left
    out."""
    versioned = "version" in valid.columns
    reach = lambda q: q.hampel_window - 1 + q.feature_window

    def one(key, state, pdf, version):
        own, model = (p, NAIVE) if setups is None else setups(key[0], version) if versioned else setups(key[0])
        seen_t, seen_x, spread, used, name = state or (np.empty(0, np.int64), np.empty(0), Spread(own.warm_up), own, model.version)
        restarted = False
        if used != own:
            seen_t, seen_x, spread = np.empty(0, np.int64), np.empty(0), Spread(own.warm_up)
        elif name != model.version:
            spread, restarted = Spread(own.warm_up), True
        pdf = pdf[pdf.ts > (seen_t[-1] if len(seen_t) else -(2**62))]
        t, x = np.concatenate([seen_t, pdf.ts.to_numpy(np.int64)]), np.concatenate([seen_x, pdf.val.to_numpy(float)])
        found = {k: v[len(seen_t) :] for k, v in diagnosis(t, x, own, model).items() if k != "sigma"}
        if restarted and len(pdf):
            found["pred"][0] = found["resid"][0] = np.nan
        found |= judged(found, spread, own, model)
        out = pd.DataFrame({"channel": key[0], "ts": t[len(seen_t) :], "val": x[len(seen_t) :]} | {c: a if a.dtype == bool else pd.array(a, "Float64") for c, a in found.items()})
        keep = reach(own)
        return (t[-keep:], x[-keep:], spread, own, model.version), out

    def step(key, state, pdf):
        if not versioned:
            return one(key, state, pdf, 0)
        outs = []
        for version, part in pdf.groupby(pdf.version.cummax(), sort=True):
            state, out = one(key, state, part, int(version))
            outs.append(out)
        return state, pd.concat(outs)

    columns = ["channel", "ts", "val", *(["version"] if versioned else [])]
    return folded(valid.select(*columns), "channel", step, ["ts"], DIAGNOSIS)


EPISODE = "channel string, kind string, ts_start long, ts_end long, n_points long, peak_ts long, peak_value double, score double"


def stream_episodes(flags: DataFrame, gap: int) -> DataFrame:
    """Closed episodes of a stream of points (channel, ts, and kind, val, score where flagged, else null kind). An
    episode is closed by a point of its channel more than ``gap`` after its last flag. A flag that comes after its
    episode was closed begins a new one."""

    def step(key, state, pdf):
        opened, out = state or {}, []
        for kind, ts, val, score in zip(pdf.kind, pdf.ts.tolist(), pdf.val, pdf.score, strict=True):
            for k in [k for k, e in opened.items() if ts - e[1] > gap]:
                out.append((key[0], k, *opened.pop(k)))
            if kind is None or kind != kind:
                continue
            held = opened.get(kind)
            if held is None:
                opened[kind] = (ts, ts, 1, ts, val, score)
            else:
                peak = held[3:] if score <= held[5] else (ts, val, score)
                opened[kind] = (held[0], ts, held[2] + 1, *peak)
        return opened, pd.DataFrame(out, columns=[x.split()[0] for x in EPISODE.split(", ")])

    return folded(flags.select("channel", "ts", "kind", "val", "score"), "channel", step, ["ts"], EPISODE)


def stream_grid_lttb(rows: DataFrame, width: int) -> DataFrame:
    """channel, ts, val, final, generation: finished points of chart cells, each once, and after each step of a channel
    the tail of its open cells under a new generation, which replaces the tail before (see downsample.live_points)."""

    def step(key, state, pdf):
        held, generation = state or (None, 0)
        cells = Cells(width, held)
        done = list(cells.push(pdf.ts.to_numpy(np.int64), pdf.val.to_numpy(float)))
        tail = list(cells.tail())
        out = pd.DataFrame({"channel": key[0], "ts": [t for t, _ in done + tail], "val": [x for _, x in done + tail], "final": [True] * len(done) + [False] * len(tail), "generation": generation + 1})
        return ((cells.pick, cells.done, cells.open), generation + 1), out

    return folded(rows.where(F.col("val").isNotNull()).select("channel", "ts", "val"), "channel", step, ["ts"], POINT + ", final boolean, generation long")


def stream_alarms(inputs: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """The alarm log of a stream of readings and acknowledgements (see alarm_inputs). ``opened`` (rule_id, state,
    condition, last_on, called) is what holds when the stream is first started; alarm_tables.initial_state makes it from
    stored occurrences."""

    def step(key, state, pdf):
        alarm = state or Alarm()
        return alarm, pd.DataFrame(walk(alarm, pdf), columns=LOG_NAMES)

    def opening(pdf):
        row = pdf.iloc[0]
        number = lambda c: None if pd.isna(row[c]) else int(row[c])
        return Alarm(row.state, Debounce(bool(row.condition), number("called"), number("last_on")))

    return folded(inputs, "rule_id", step, ["ts", "is_ack", "user"], LOG, opened, opening)
