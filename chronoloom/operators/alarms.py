"""Alarm states of rules: closed forms in windows, and the whole life cycle row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import ChannelParams
from . import prefix

NORMAL, UNACK_ACTIVE, ACK_ACTIVE, UNACK_RTN = "normal", "unack_active", "ack_active", "unack_rtn"
HIGH, LOW = ("hi", "hihi"), ("lo", "lolo")


def readings_x_rules(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """Every reading with every enabled rule of its channel; a rule of another kind than anomaly needs a limit."""
    fine = rules.where(F.col("enabled") & ((F.col("kind") == "anomaly") | F.col("limit").isNotNull()))
    return readings.join(fine, "channel")


def beyond(v: Column, shift: Column) -> Column:
    """Whether a value is past the limit, moved back by ``shift``; null for a null value."""
    return F.when(F.col("kind").isin(*HIGH), v > F.col("limit") - shift).when(F.col("kind").isin(*LOW), v < F.col("limit") + shift)


RULE = ("rule_id",)


def alarm_hysteresis(pairs: DataFrame, chunk: int = ChannelParams().chunk) -> DataFrame:
    """condition of rules without delays: set past the limit, cleared when back by the deadband, else as before."""
    v = F.col("value")
    mark = F.when(beyond(v, F.lit(0.0)), True).when(~beyond(v, F.col("deadband")), False)
    rows = prefix.last_known(prefix.chunked(pairs.withColumn("a_mark", mark), F.col("ts"), chunk), RULE, "ts", "a_mark", "condition")
    return rows.withColumn("condition", F.coalesce("condition", F.lit(False))).drop("a_mark", "c_chunk")


def alarm_debounce(pairs: DataFrame, chunk: int = ChannelParams().chunk) -> DataFrame:
    """condition of rules without a deadband: changes once the raw condition has lasted for its delay."""
    rows = prefix.chunked(pairs.withColumn("a_raw", beyond(F.col("value"), F.lit(0.0))), F.col("ts"), chunk)
    rows = prefix.preceding(rows, RULE, "ts", "a_raw", "a_last")
    goes_on = F.col("a_last").isNotNull() & F.col("a_raw").eqNullSafe(F.col("a_last.a_raw"))
    rows = prefix.last_known(rows.withColumn("a_start", F.when(~goes_on, F.col("ts"))), RULE, "ts", "a_start", "a_since")
    delay = F.when(F.col("a_raw"), F.col("on_delay")).otherwise(F.col("off_delay"))
    rows = rows.withColumn("a_mark", F.when(F.col("a_raw").isNotNull() & (F.col("ts") - F.col("a_since") >= delay), F.col("a_raw")))
    rows = prefix.last_known(rows, RULE, "ts", "a_mark", "condition")
    return rows.withColumn("condition", F.coalesce("condition", F.lit(False))).select(*pairs.columns, "condition")


#: What a change of the condition ("on", "off") or an acknowledgement ("ack") does to an alarm: next state, transition.
#: What isn't here changes nothing.
TRANSITIONS = {
    (NORMAL, "on"): (UNACK_ACTIVE, "activated"),
    (UNACK_RTN, "on"): (UNACK_ACTIVE, "activated"),
    (UNACK_ACTIVE, "off"): (UNACK_RTN, "returned"),
    (ACK_ACTIVE, "off"): (NORMAL, "returned"),
    (UNACK_ACTIVE, "ack"): (ACK_ACTIVE, "acknowledged"),
    (UNACK_RTN, "ack"): (NORMAL, "acknowledged"),
}


@dataclass
class Debounce:
    """A rule's condition: it turns once readings have called for that for a delay, and on only some time after it
    turned on last."""

    condition: bool = False
    called: int | None = None  # since when readings have called for a change
    last_on: int | None = None

    def turns(self, ts: np.ndarray, calls: dict[bool, np.ndarray], delay: dict[bool, int], min_repeat: int) -> Iterator[tuple[int, bool]]:
        """(place, condition) of each change over readings in order; calls[c] tells which of them want it to be c
        while it isn't. Goes from run to run of such readings, not from reading to reading."""
        at = 0
        while at < len(ts):
            goal = not self.condition
            here = calls[goal]
            if not here[at]:
                self.called = None
                rest = here[at:].argmax()
                if not here[at + rest]:
                    return
                at += int(rest)
            quiet = ~here[at:]
            end = at + int(quiet.argmax()) if quiet.any() else len(ts)
            self.called = int(ts[at]) if self.called is None else self.called
            due = self.called + delay[goal]
            if goal and self.last_on is not None:
                due = max(due, self.last_on + min_repeat)
            turn = at + int(np.searchsorted(ts[at:end], due))
            if turn == end:
                at = end
                continue
            self.condition, self.called = goal, None
            if goal:
                self.last_on = int(ts[turn])
            yield turn, goal
            at = turn + 1


@dataclass
class Alarm:
    """All that is known of a rule between rows."""

    state: str = NORMAL
    debounce: Debounce = field(default_factory=Debounce)


def calls_of(pdf: pd.DataFrame) -> dict[bool, np.ndarray]:
    """Which readings of a rule want its condition on while it is off, and off while it is on."""
    rule = pdf.iloc[0]
    if rule["kind"] == "anomaly":
        on = pdf["anomaly"].to_numpy(bool)
        return {True: on, False: ~on}
    number = lambda c: float("nan") if rule[c] is None else float(rule[c])
    v, limit, back = pd.to_numeric(pdf["value"]).to_numpy(float, na_value=np.nan), number("limit"), number("deadband")
    back = 0.0 if back != back else back
    # a value that isn't a number calls for nothing
    return {True: v > limit, False: v <= limit - back} if rule["kind"] in HIGH else {True: v < limit, False: v >= limit + back}


LOG = "rule_id int, channel string, ts long, transition string, state_from string, state_to string, value double, user string"


def alarm_inputs(pairs: DataFrame, acks: DataFrame, rules: DataFrame) -> DataFrame:
    """Readings (rule_id, ts, value, anomaly and the rule's columns) and acknowledgements in one table; at equal times
    readings come first."""
    keep = ["rule_id", "channel", "kind", "limit", "deadband", "on_delay", "off_delay", "min_repeat"]
    read = pairs.select(*keep, "ts", "value", "anomaly", F.lit(0).alias("is_ack"), F.lit(None).cast("string").alias("user"))
    asked = acks.join(rules.where("enabled").select(*keep), "rule_id")
    ack = asked.select(*keep, "ts", F.lit(None).cast("double").alias("value"), F.lit(False).alias("anomaly"), F.lit(1).alias("is_ack"), "user")
    return read.unionByName(ack)


def walk(alarm: Alarm, pdf: pd.DataFrame) -> list[tuple]:
    """Transitions of one rule over its rows in order."""
    pdf = pdf.reset_index(drop=True)
    asked = pdf["is_ack"].to_numpy() == 1
    read = np.flatnonzero(~asked)
    events = [(int(i), "ack") for i in np.flatnonzero(asked)]
    if len(read):
        rows = pdf.iloc[read]
        delay = {True: int(rows["on_delay"].iloc[0]), False: int(rows["off_delay"].iloc[0])}
        turns = alarm.debounce.turns(rows["ts"].to_numpy(np.int64), calls_of(rows), delay, int(rows["min_repeat"].iloc[0]))
        events += [(int(read[i]), "on" if on else "off") for i, on in turns]
    out = []
    for i, event in sorted(events):
        before = alarm.state
        alarm.state, what = TRANSITIONS.get((before, event), (before, None))
        if what:
            ack, value = event == "ack", pdf["value"].iloc[i]
            out.append((int(pdf["rule_id"].iloc[i]), pdf["channel"].iloc[i], int(pdf["ts"].iloc[i]), what, before, alarm.state, None if ack or pd.isna(value) else float(value), pdf["user"].iloc[i] if ack else None))
    return out


LOG_NAMES = [x.split()[0] for x in LOG.split(", ")]


def calling(goal: Column) -> Column:
    """Whether a reading calls for its rule's condition to be what ``goal`` says; false where its value is missing."""
    v, back = F.col("value"), F.coalesce("deadband", F.lit(0.0))
    over, under = v > F.col("limit"), v < F.col("limit")
    high = F.when(goal, over).otherwise(v <= F.col("limit") - back)
    low = F.when(goal, under).otherwise(v >= F.col("limit") + back)
    of_value = F.when(~F.isnan(v), F.when(F.col("kind").isin(*HIGH), high).otherwise(low))
    return F.coalesce(F.when(F.col("kind") == "anomaly", F.col("anomaly") == goal).otherwise(of_value), F.lit(False))


def run_borders(readings: DataFrame, chunk: int = ChannelParams().chunk) -> DataFrame:
    """Those readings of a rule at which its condition may turn, with ``goal`` (what they call for) and ``since`` (the
    first reading of their run).

    Readings in a row that call for the same (on, off or nothing) are a run. A run can only turn the condition at its
    first reading past its delay or, where a rule has a time between two activations, at one up to the first reading
    that is this time past the run before that called for the same. All others are left out."""
    goal = F.when(calling(F.lit(True)), 1).when(calling(F.lit(False)), -1).otherwise(0)
    rows = prefix.chunked(readings.withColumn("r_goal", goal), F.col("ts"), chunk).withColumn("r_set", F.when(F.col("r_goal") == 1, F.col("ts")))
    rows = prefix.last_known(rows, RULE, "ts", "r_set", "r_last")
    rows = prefix.preceding(rows.withColumn("r_row", F.struct("ts", "r_goal", "r_last")), RULE, "ts", "r_row", "r_prev")
    before = F.col("r_prev.r_row")
    starts = before.isNull() | (before["r_goal"] != F.col("r_goal"))
    rows = rows.withColumn("r_start", F.when(starts, F.struct(F.col("ts").alias("since"), before["r_last"].alias("last"))))
    rows = prefix.last_known(rows, RULE, "ts", "r_start", "r_run")
    since = F.col("r_run.since")
    due = since + F.when(F.col("r_goal") == 1, F.col("on_delay")).otherwise(F.col("off_delay"))
    first = (since == F.col("ts")) | (before["ts"] < due)
    repeats = (F.col("r_goal") == 1) & (F.col("min_repeat") > 0) & (before["ts"] < F.col("r_run.last") + F.col("min_repeat"))
    kept = rows.where((F.col("r_goal") != 0) & (F.col("ts") >= due) & (first | F.coalesce(repeats, F.lit(False))))
    return kept.select(*readings.columns, (F.col("r_goal") == 1).alias("goal"), since.alias("since"))


def alarm_lifecycle(inputs: DataFrame, chunk: int = ChannelParams().chunk) -> DataFrame:
    """The log of state changes. Readings are cut down to those at which a condition may turn (run_borders) before a
    rule's rows are walked in order, batch by batch: a recurrence, which keeps one task busy for each rule. Reads its
    inputs several times: hand in stored rows."""
    acks = inputs.where("is_ack = 1").withColumns({"goal": F.lit(None).cast("boolean"), "since": F.lit(None).cast("long")})
    few = run_borders(inputs.where("is_ack = 0"), chunk).unionByName(acks)
    few = few.select("rule_id", "channel", "on_delay", "off_delay", "min_repeat", "ts", "value", "is_ack", "user", "goal", "since")

    def lives(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alarm = Alarm()
        for pdf in frames:
            if log := walk_borders(alarm, pdf):
                yield pd.DataFrame(log, columns=LOG_NAMES)

    ordered = few.repartition("rule_id").sortWithinPartitions("rule_id", "ts", "is_ack", "user")
    return ordered.groupBy("rule_id").applyInPandas(lives, LOG)


def walk_borders(alarm: Alarm, pdf: pd.DataFrame) -> list[tuple]:
    """Transitions of one rule over its run borders and acknowledgements in order."""
    out, d = [], alarm.debounce
    columns = (pdf[c].tolist() for c in ("rule_id", "channel", "ts", "value", "user", "is_ack", "goal", "since", "on_delay", "off_delay", "min_repeat"))
    for rule, channel, ts, value, user, ack, goal, since, on_delay, off_delay, min_repeat in zip(*columns, strict=True):
        event = "ack"
        if not ack:
            goal = bool(goal)
            due = since + (on_delay if goal else off_delay)
            if goal and d.last_on is not None:
                due = max(due, d.last_on + min_repeat)
            if goal == d.condition or ts < due:
                continue
            d.condition, event = goal, "on" if goal else "off"
            d.last_on = ts if goal else d.last_on
        before = alarm.state
        alarm.state, what = TRANSITIONS.get((before, event), (before, None))
        if what:
            out.append((rule, channel, ts, what, before, alarm.state, None if ack or pd.isna(value) else float(value), user if ack else None))
    return out


def fold_alarm_log(log: DataFrame) -> DataFrame:
    """Occurrences: rule_id, occurrence, state, ts_active, ts_return, ts_ack, acked_by, value.

    An occurrence begins with an activation from normal (or with a rule's first row). A re-activation stays in it and
    clears its return."""
    so_far = Window.partitionBy("rule_id").orderBy("ts", "o_rank").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.when(F.col("transition") == "acknowledged", 1).otherwise(0)
    opens = F.when((F.col("transition") == "activated") & (F.col("state_from") == NORMAL), 1).otherwise(0)
    rows = log.withColumn("o_rank", rank).withColumn("o_open", opens)
    rows = rows.withColumn("occurrence", F.greatest(F.sum("o_open").over(so_far), F.lit(1)))
    at = F.struct("ts", "o_rank")
    turn = F.when(F.col("transition") == "returned", F.col("ts"))
    moves = F.col("transition") != "acknowledged"
    acked = F.col("transition") == "acknowledged"
    return rows.groupBy("rule_id", "occurrence").agg(
        F.max_by("state_to", at).alias("state"), F.min("ts").alias("ts_active"), F.max_by(F.struct(turn.alias("t")), F.when(moves, at))["t"].alias("ts_return"),
        F.max(F.when(acked, F.col("ts"))).alias("ts_ack"), F.max_by("user", F.when(acked, at)).alias("acked_by"), F.min_by(F.struct("value"), at)["value"].alias("value"),
    )
