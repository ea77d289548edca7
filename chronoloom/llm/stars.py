"""Components of similar sets from groups of candidates, without pairs within a group.

A group (a band, a prefix token) says that its members may be similar. In a first round each member is held against its
group's leader; what is confirmed makes components. In a second round those members of a group that aren't in its largest
component are held against all its members, in blocks of rows that meet in one task; pairs inside a component are never
made, and pairs across leave the task only as links that join components. A group of one component takes no part,
however large it is. Groups with very many members are joined by broadcasting the few rows about them, and a leader with
very many partners stands in several tasks, each with a share of these, so no task gets all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import components

BLOCK = 1024  # members of a group, or partners of a leader, that one task holds on a side
HOT = 500  # members from which on a group is joined by broadcast; in a large corpus more, so that HOT_GROUPS is the most
HOT_GROUPS = 100_000

#: Of many, what tells for one whether each of the many may be similar to it. With the key of a group that they all
#: belong to, pairs may be left out that another group has.
Likely = Callable[[list[bytes], int | None], Callable[[bytes], np.ndarray]]
SetsOf = Callable[[DataFrame], DataFrame]


def with_groups(rows: DataFrame, groups: DataFrame, hot: int) -> DataFrame:
    """rows(key, ...) with what is known of their groups(key, members, ...); other rows go. Groups of more than ``hot``
    members are broadcast; the caller bounds their number."""
    few = F.broadcast(groups.where(F.col("members") > hot))
    many = rows.join(few, "key")
    return many.unionByName(rows.join(few.select("key"), "key", "left_anti").join(groups.where(F.col("members") <= hot), "key"))


def _sizes(percent: int, n: np.ndarray, one: int) -> np.ndarray:
    return 100 * np.minimum(n, one) >= percent * np.maximum(n, one)


def _starred(check: Callable[[int, bytes, np.ndarray, list[bytes]], np.ndarray]):
    """check(n, data of a leader, n and data of its partners) for rows that come sorted by key, task and side."""

    def starred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple = (None, None, 0, b"")
        for pdf in frames:
            key, task, side, c, n, data = (pdf[x].to_numpy() for x in ("key", "task", "side", "c", "n", "data"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (task[1:] != task[:-1])) + 1 if len(pdf) else []
            out = []
            for x, y in zip([0, *new], [*new, len(pdf)], strict=True) if len(pdf) else ():
                if side[x] == 0:
                    held, x = (key[x], task[x], int(n[x]), data[x]), x + 1
                if x < y and held[:2] == (key[x], task[x]):
                    fine = c[x:y][check(held[2], held[3], n[x:y], list(data[x:y]))]
                    out.append(pd.DataFrame({"a": held[0], "b": fine}))
            yield pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return starred


def _overlapping(percent: int):
    def overlapping(n: int, leader: bytes, sizes: np.ndarray, sets: list[bytes]) -> np.ndarray:
        own, flat = np.frombuffer(leader, np.uint64), np.frombuffer(b"".join(sets), np.uint64)
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        size = np.array([len(s) // 8 for s in sets])
        both = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        return 100 * both >= percent * (size + len(own) - both)

    return overlapping


def star(pairs: DataFrame, facts: DataFrame, check: Callable[[int, bytes, np.ndarray, list[bytes]], np.ndarray]) -> DataFrame:
    """Those of pairs(a, b) that a check on facts(c, n, data) accepts. A leader's data moves once for ``BLOCK`` partners."""
    most = max(BLOCK, pairs.count() // HOT_GROUPS)
    many = pairs.groupBy("a").count().where(F.col("count") > most).select("a", F.ceil(F.col("count") / BLOCK).cast("int").alias("tasks"))
    dealt = pairs.join(F.broadcast(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("tasks", F.lit(1))).cast("int").alias("task"))
    partners = dealt.select(F.col("a").alias("key"), "task", F.lit(1).alias("side"), F.col("b").alias("c")).join(facts, "c")
    leaders = dealt.select("a", "task").distinct().select(F.col("a").alias("key"), "task", F.lit(0).alias("side"), F.col("a").alias("c")).join(facts, "c")
    names = ("key", "task", "side", "c", "n", "data")
    both = leaders.select(*names).unionByName(partners.select(*names))
    return both.repartition("key", "task").sortWithinPartitions("key", "task", "side").mapInPandas(_starred(check), "a long, b long")


def _by_task(frames: Iterator[pd.DataFrame], each) -> Iterator[pd.DataFrame]:
    """each(rows of a task) for rows that come sorted by key and task, a few thousand to a task."""
    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = ((pdf.key == pdf.key.iloc[-1]) & (pdf.task == pdf.task.iloc[-1])).to_numpy()
        rest = pdf[last]
        if not last.all():
            done = pdf[~last]
            for _, group in done.groupby(["key", "task"], sort=False):
                yield each(group)
    if rest is not None and len(rest):
        yield each(rest)


def _crossing(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Each left row with the right rows of other components."""
    comp = right.comp.to_numpy()
    for i, own in enumerate(left.comp.tolist()):
        if len(at := np.flatnonzero(comp != own)):
            yield i, at


def _open_members(likely: Likely, percent: int):
    """Members of a group that are likely similar to a member of another component."""

    def members(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(left) or not len(right):
            return pdf.iloc[:0][["key", "task", "side", "c", "comp"]]
        similar, data = likely(right.data.tolist(), int(right.key.iloc[0])), left.data.tolist()
        n_l, n_r = left.n.to_numpy(), right.n.to_numpy()
        hit_l, hit_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for i, at in _crossing(left, right):
            at = at[_sizes(percent, n_r[at], n_l[i])]
            if len(at):
                at = at[similar(data[i])[at]]
            hit_l[i] = len(at) > 0
            hit_r[at] = True
        return pd.concat([left[hit_l], right[hit_r]])[["key", "task", "side", "c", "comp"]]

    return lambda frames: _by_task(frames, members)


def _joining(percent: int):
    """Confirmed links between components, as many as join them; full sets of a task's open members are held."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets_l, sets_r = ([np.frombuffer(m, np.uint64) for m in x.data] for x in (left, right))
            flat = np.concatenate(sets_r)
            known, place = np.unique(flat, return_inverse=True)
            size = np.array([len(m) for m in sets_r])
            begin = np.cumsum(size) - size
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            c, comp = right.c.to_numpy(), right.comp.to_numpy()
            for i, at in _crossing(left, right):
                mark = np.zeros(len(known) + 1, bool)
                spot = np.searchsorted(known, sets_l[i])
                spot[known[np.minimum(spot, len(known) - 1)] != sets_l[i]] = len(known)
                mark[spot] = True
                mark[len(known)] = False
                both = np.add.reduceat(mark[place], begin, dtype=np.int64)[at]
                fine = at[100 * both >= percent * (size[at] + len(sets_l[i]) - both)]
                x, own = int(left.c.iloc[i]), int(left.comp.iloc[i])
                for y, other in zip(c[fine].tolist(), comp[fine].tolist(), strict=True):
                    a, b = find(own), find(other)
                    if a != b:
                        root[a] = b
                        out.append((min(x, y), max(x, y)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return lambda frames: _by_task(frames, links)


def roots(keys: DataFrame, facts: DataFrame, sets_of: SetsOf, likely: Likely, percent: int) -> DataFrame:
    """node, root of every set that is linked with another one, but the roots themselves.

    keys(key, c): groups of sets; facts(c, n, data): sizes, and what ``likely`` judges by; sets_of(c) gives (c, n, data)
    with the full sets as sorted 64-bit hashes. Sets are linked if 100 * |intersection| >= percent * |union|."""
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("members"), F.min("c").alias("leader")).where(F.col("members") > 1))
    hot = max(HOT, keys.count() // HOT_GROUPS)
    members = materialize(with_groups(keys, shared, hot))
    release(shared)

    # first round: each against the leaders of its groups
    def near(n: int, leader: bytes, sizes: np.ndarray, data: list[bytes]) -> np.ndarray:
        fine = np.flatnonzero(_sizes(percent, sizes, n))
        return fine[likely([data[i] for i in fine], None)(leader)] if len(fine) else fine

    pairs = materialize(members.where(F.col("c") != F.col("leader")).select(F.col("leader").alias("a"), F.col("c").alias("b")).distinct())
    close = materialize(star(pairs, facts, near))
    release(pairs)
    sets = sets_of(close.select(F.col("a").alias("c")).union(close.select("b")).distinct())
    links = materialize(star(close, sets, _overlapping(percent)))
    release(close)
    found = components(links)

    # second round: members of a group outside its largest component (askers) against all its members
    placed = members.where((F.col("members") > 2) & (F.col("c") != F.col("leader"))).join(found.withColumnRenamed("node", "c"), "c", "left")
    placed = materialize(placed.select("key", "c", "members", F.coalesce("root", "c").alias("comp")))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("size"), F.first("members").alias("members"))
    largest = parts.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"), F.first("members").alias("members"))
    open_groups = largest.where(F.col("top.size") < F.col("all")).select(
        "key", "members", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("ask_blocks"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")
    )
    release(members)
    groups = materialize(open_groups)
    askers = with_groups(placed.drop("members"), groups, hot).join(facts, "c")
    # a task for each block of askers and block of members: side 0 asks, side 1 is asked
    block = lambda n, salt: F.pmod(F.xxhash64("c", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda ask, asked: (ask * F.col("blocks") + asked).cast("int")
    asked = F.transform(upto("ask_blocks"), lambda a: F.struct(cell(a, block("blocks", 1)).alias("task"), F.lit(1).alias("side")))
    asks = F.transform(upto("blocks"), lambda m: F.struct(cell(block("ask_blocks", 2), m).alias("task"), F.lit(0).alias("side")))
    tasks = askers.select("key", "c", "comp", "n", "data", F.explode(F.when(F.col("comp") != F.col("main"), F.concat(asks, asked)).otherwise(asked)).alias("t"))
    tasks = tasks.select("key", "c", "comp", "n", "data", "t.task", "t.side")
    in_order = lambda df: df.repartition("key", "task").sortWithinPartitions("key", "task")
    open_members = materialize(in_order(tasks).mapInPandas(_open_members(likely, percent), "key long, task int, side int, c long, comp long"))
    release(placed, groups)
    if not open_members.isEmpty():
        lacking = open_members.select("c").distinct().join(sets.select("c"), "c", "left_anti")
        more = sets_of(lacking)
        held = in_order(open_members.join(sets.unionByName(more), "c"))
        every = materialize(links.unionByName(held.mapInPandas(_joining(percent), "a long, b long")))
        release(more, found)
        found = components(every)
        release(every)
    release(open_members, sets, links)
    return found


def named(every: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row (doc_id, n, c): classes(c, first) by their roots.

    A row without shingles is its own component. A null doc_id never names a group that has another; alone, its
    component is null and it is kept."""
    own = classes.select("c", "first").join(found.withColumnRenamed("node", "c"), "c", "left").select("c", "first", F.coalesce("root", "c").alias("root"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    out = every.select("doc_id", "n", "c").join(own.join(least, "root").select("c", "component_id"), "c", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
