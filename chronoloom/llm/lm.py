"""Language-model scores: a Katz back-off n-gram model with Good-Turing discounts, of any order.

P_k(w | h) = D_k(c) c / c(h) where the gram (h, w) was seen c times in training, else alpha(h) P_{k-1}(w | h'), with h'
the history without its first word; P_1(w) = D_1(c) c / N for known words, and what its discounts leave over goes to
one class of unknown words. alpha(h) is the mass that the seen followers of h leave, divided by the mass that
P_{k-1}( . | h') gives to all other words, so P_k( . | h) sums to 1. After a history that training never had,
P_{k-1}( . | h') is used. Of a token of order k the history is the gram of order k - 1 that ends at the token before.

Documents are encoded once, into units of numbered words (see units.py). Orders are counted one after another: grams
of an order meet by their history's bucket, which is a table of its counts, and come back to the units with numbers,
which name the next order's histories. A gram whose history or whose shorter gram occurs once in the whole corpus
occurs once itself; it isn't sent, only added to its history's sums.

A history of more than ``share`` tokens is dealt over several buckets by follower; what its alpha needs is summed in
each and then over the buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import units as U
from .common import crc_mod, deltas, materialize, mix, pack, read, slim, unpack

ORDER = 3
K = 5  # counts up to K are discounted by Good-Turing
FREQUENT = 1 - 1e-7  # the discount above K: a history always leaves a mass to words it never had
END = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word holds a space
SHARE = 200_000  # tokens of a history for each bucket that it is dealt over
WIDE = 1_000_000  # such histories at most, in a very large corpus by a larger share: their sums go through the driver
UNIT_TEXT = (4 << 20, 12 << 20)  # text of a unit or bucket: least and most


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


@dataclass
class Discounts:
    """D(c) for c = 1..K from counts of counts n[0..K] (n[r - 1] things seen r times)."""

    by_count: np.ndarray

    @classmethod
    def good_turing(cls, n: list[int]) -> Discounts:
        d = np.full(K + 1, FREQUENT)
        for k in range(K, 0, -1):  # the largest k whose discounts all make sense
            if not all(n[: k + 1]):
                continue
            cut = (k + 1) * n[k] / n[0]
            if cut >= 1:
                continue
            found = [((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in found):
                d[1 : k + 1] = np.minimum(found, FREQUENT)
                break
        return cls(d)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        """D(c) c"""
        return np.where(c > K, FREQUENT, self.by_count[np.minimum(c, K)]) * c


@dataclass
class Stream:
    """A unit's tokens: of each document its words and one end."""

    doc_id: np.ndarray
    no_id: np.ndarray
    held: np.ndarray
    sizes: np.ndarray  # tokens of each document
    words: np.ndarray  # distinct, sorted
    at: np.ndarray  # of each token, its place in words

    def __post_init__(self):
        self.first = np.cumsum(self.sizes) - self.sizes
        self.trains = np.repeat(self.held == 0, self.sizes)


def encoded(held: list[pa.RecordBatch]) -> bytes:
    """Documents (doc_id, held_out, text) as a packed Stream; a null text is an empty one."""
    rows = pa.Table.from_batches(held)
    parts = []
    for text in rows.column("text").cast(pa.binary()).to_pylist():
        words = (text or b"").lower().split()
        part = np.empty(len(words) + 1, np.uint64)
        part[:-1] = list(map(_words.__getitem__, words))
        part[-1] = END
        parts.append(part)
    words, at = np.unique(np.concatenate(parts), return_inverse=True)
    ids = rows.column("doc_id")
    return pack(
        ids.fill_null(0).to_numpy().astype("<i8"), ids.is_null().to_numpy().astype("u1"), rows.column("held_out").to_numpy().astype("u1"),
        np.array([len(p) for p in parts], "<u4"), np.diff(words, prepend=np.uint64(0)), slim(at),
    )


def stream_of(blob: bytes) -> Stream:
    doc_id, no_id, held, sizes, words, at = unpack(blob)
    return Stream(doc_id, no_id > 0, held, sizes.astype(np.int64), np.cumsum(words, dtype=np.uint64), at.astype(np.int32))


@dataclass
class Grams:
    """A unit's different grams of an order, and what is known of them over the corpus."""

    token: np.ndarray  # of each token, its gram
    history: np.ndarray  # of each gram, the gram one order below that it follows; one more stands for a document's start
    word: np.ndarray
    shorter: np.ndarray  # of each gram, the gram one order below without its first word
    count: np.ndarray  # training count
    alone: np.ndarray  # whether it occurs once in the whole corpus
    number: np.ndarray  # from 1 on; 0 is the start of a document
    alpha: np.ndarray = field(default_factory=lambda: np.empty(0))  # of each history one order below


@dataclass
class Plan:
    """What all tasks of a job know."""

    buckets: int
    share: int
    n_tokens: int = 0
    n_words: int = 0
    left: float = 1.0  # mass of unknown words
    discounts: list[Discounts] = field(default_factory=list)  # by order
    wide: list[tuple] = field(default_factory=list)  # by order from 2: sums of the histories dealt over several buckets


def _base(s: Stream, words: np.ndarray, got: dict, plan: Plan) -> Grams:
    """Order 1: words with what came back of them."""
    n = len(words)
    count, alone, number = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
    order, bounds = U.split((words % np.uint64(plan.buckets)).astype(np.int64), plan.buckets)
    for b in range(plan.buckets):
        if (1, b) in got:
            place, seen, once = unpack(got[1, b])
            o = order[bounds[b] : bounds[b + 1]]
            number[o], count[o], alone[o] = place.astype(np.int64) * plan.buckets + b + 1, seen, once > 0
    none = np.empty(0, np.int64)
    return Grams(s.at, none, np.arange(n), none, count, alone, number)


def _started(level: Grams, starts: int, n_first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, alone and number of a level's grams as histories, with the start of a document behind the others."""
    return np.append(level.count, starts), np.append(level.alone, False), np.append(level.number, n_first)


def _next(s: Stream, k: int, below: Grams, n_words: int) -> Grams:
    """The grams of order k from those of order k - 1."""
    start = int(np.searchsorted(s.words, END)) if k == 2 else len(below.count)
    history = np.roll(below.token, 1)
    history[s.first] = start
    grams, token = np.unique(history.astype(np.int64) * n_words + s.at, return_inverse=True)
    token = token.astype(np.int32)
    shorter = np.empty(len(grams), np.int32)
    shorter[token] = below.token
    n = len(grams)
    return Grams(token, grams // n_words, grams % n_words, shorter, np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64))


def _bucket(number: np.ndarray, word: np.ndarray, fan: np.ndarray, buckets: int) -> np.ndarray:
    """The history's bucket or, dealt by follower, one of the ``fan`` buckets from there on."""
    spread = (mix(word.astype(np.uint64)) >> np.uint64(16)) % fan.astype(np.uint64)
    return ((mix(number.astype(np.uint64)) + spread) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Request:
    """What a unit sends of an order: for each bucket, entries (grams) in order of history and word, and its histories."""

    entry: np.ndarray  # grams that are sent, by bucket, history and word
    bounds: np.ndarray  # of each bucket, its first entry
    heads: np.ndarray  # histories, by bucket and number
    head_bounds: np.ndarray
    sizes: np.ndarray  # entries of each
    quiet: np.ndarray  # of each head, training grams that aren't sent
    asks: np.ndarray  # whether a held-out gram that isn't sent needs its alpha
    n_quiet: int  # training grams that aren't sent
    fan: np.ndarray  # of each history, the number of buckets it is dealt over


def _request(s: Stream, k: int, below: Grams, level: Grams, base: Grams, plan: Plan) -> Request:
    """Sets the counts of the grams that need not be sent."""
    docs = int(base.count[np.searchsorted(s.words, END)])
    count, alone, number = _started(below, docs, 0)
    fan = np.minimum(1 + count // plan.share, plan.buckets)
    live = count[level.history] > 0  # else training has no such gram
    known = live & (alone[level.history] | below.alone[level.shorter])
    level.count[known] = np.bincount(level.token, s.trains, len(level.count)).astype(np.int64)[known]
    level.alone |= known
    rest = known & ~alone[level.history]
    quiet = np.bincount(level.history[rest], level.count[rest] > 0, len(count)).astype(np.int64)
    asks = np.bincount(level.history[rest], level.count[rest] == 0, len(count)) > 0
    sent = np.flatnonzero(live & ~known)
    h, w = number[level.history[sent]], base.number[level.word[sent]]
    bucket = _bucket(h, w, fan[level.history[sent]], plan.buckets)
    w_top = int(w.max(initial=0)) + 1
    order = np.argsort(h * w_top + w) if int(h.max(initial=0)) < (1 << 62) // w_top else np.lexsort((w, h))
    order = order[np.argsort(bucket[order].astype(np.min_scalar_type(plan.buckets)), kind="stable")]
    entry, bucket = sent[order], bucket[order]
    bounds = np.searchsorted(bucket, np.arange(plan.buckets + 1))
    # histories of entries, and those that only have something to add or to ask, which is sent to their first bucket
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (bucket[1:] != bucket[:-1]))[: len(entry)]
    first = np.flatnonzero(new)
    head, home = level.history[entry[first]], bucket[first]
    sizes = np.diff(first, append=len(entry))
    one = np.zeros(1, np.int64)
    own = _bucket(number, one, np.ones(1, np.int64), plan.buckets)
    at_home = home == own[head]
    extra = (quiet > 0) | asks
    extra[head[at_home]] = False
    extra = np.flatnonzero(extra)
    at_home = np.append(at_home, np.ones(len(extra), bool))
    head, home, sizes = np.append(head, extra), np.append(home, own[extra]), np.append(sizes, np.zeros(len(extra), np.int64))
    order = np.lexsort((number[head], home))
    head, home, sizes, at_home = head[order], home[order], sizes[order], at_home[order]
    return Request(entry, bounds, head, np.searchsorted(home, np.arange(plan.buckets + 1)), sizes, quiet[head] * at_home, asks[head] & at_home, int((level.count[known] > 0).sum()), fan)


def _levels(s: Stream, got: dict, upto: int, plan: Plan) -> tuple[list[Grams], list[Request]]:
    """Orders 1 to ``upto``: all but the last with their counts, or the last, too, where its answers are there."""
    levels, requests = [_base(s, s.words, got, plan)], []
    docs = int(levels[0].count[np.searchsorted(s.words, END)])
    for k in range(2, upto + 1):
        below, level = levels[-1], _next(s, k, levels[-1], len(s.words))
        r = _request(s, k, below, level, levels[0], plan)
        level.alpha = np.ones(len(below.count) + 1)
        # of each history, what P_{k-1} divides by: the training count of the history without its first word
        over = np.full(len(below.count) + 1, plan.n_tokens, np.int64) if k == 2 else np.append(levels[-2].count[below.shorter], docs)
        count = np.append(below.count, docs)

        def back_off(h: np.ndarray, by_count: np.ndarray, often: np.ndarray, followed: np.ndarray) -> None:
            used = sum(plan.discounts[k - 1].by_count[r] * r * by_count[r - 1] for r in range(1, K + 1)) + FREQUENT * often
            level.alpha[h] = (1 - used / np.maximum(count[h], 1)) / (1 - followed / np.maximum(over[h], 1))

        for b in range(plan.buckets):
            if (k, b) not in got:
                continue
            mine, once, place, lacks, by_count, often, followed = unpack(got[k, b])
            e = r.entry[r.bounds[b] : r.bounds[b + 1]]
            level.count[e], level.alone[e] = mine, once > 0
            level.number[e] = np.cumsum(place, dtype=np.int64) * plan.buckets + b + 1
            if len(lacks):
                back_off(r.heads[r.head_bounds[b] : r.head_bounds[b + 1]][np.cumsum(lacks, dtype=np.int64)], by_count.reshape(K, -1).astype(np.int64), often, followed)
        if len(plan.wide) > k - 2:
            numbers, *sums = plan.wide[k - 2]
            h = np.flatnonzero(r.fan > 1)
            number = np.append(below.number, 0)[h]
            at = np.searchsorted(numbers, number)
            fine = at < len(numbers)
            fine[fine] = numbers[at[fine]] == number[fine]
            h, at = h[fine], at[fine]
            back_off(h, sums[0][:, at], sums[1][at], sums[2][at])
        levels.append(level)
        requests.append(r)
    return levels, requests


def _word_parcels(buckets: int):
    def parcels(unit: int, s: Stream) -> Iterator[tuple[int, bytes]]:
        count, every = np.bincount(s.at, s.trains, len(s.words)).astype("<u4"), np.bincount(s.at, minlength=len(s.words))
        order, bounds = U.split((s.words % np.uint64(buckets)).astype(np.int64), buckets)
        for b in range(buckets):
            if len(o := order[bounds[b] : bounds[b + 1]]):
                yield b, pack(np.diff(s.words[o], prepend=np.uint64(0)), slim(count[o]), slim(every[o] - count[o]))

    return parcels


def _word_counts(blobs: list[bytes]) -> tuple[list[bytes | None], list[int]]:
    """Answers: each word's number in the bucket (frequent words first), its training count, and whether it occurs once."""
    got = [unpack(b) for b in blobs]
    words, back = np.unique(np.concatenate([np.cumsum(w, dtype=np.uint64) for w, *_ in got]), return_inverse=True)
    count, held = (np.bincount(back, np.concatenate([x[i] for x in got]), len(words)).astype(np.int64) for i in (1, 2))
    place = np.empty(len(words), np.int64)
    place[np.argsort(-count - held, kind="stable")] = np.arange(len(words))
    ends = np.cumsum([len(w) for w, *_ in got])
    answers: list[bytes | None] = [pack(slim(place[x]), slim(count[x]), (count + held == 1)[x].astype("u1")) for x in np.split(back, ends[:-1])]
    return answers, [int(count.sum()), int((count > 0).sum()), *(int((count == r).sum()) for r in range(1, K + 2))]


def _gram_parcels(k: int, plan: Plan):
    """Of each bucket: its histories (numbers), how many entries each has here, grams of each that aren't sent, whether
    its alpha is asked for, whether it is dealt over several buckets; and of the entries the words' numbers, training
    counts, training counts of the shorter grams, and whether the unit has it once."""

    def parcels(unit: int, s: Stream, got: dict) -> pa.Table:
        levels, requests = _levels(s, got, k, plan)
        below, level, r = levels[-2], levels[-1], requests[-1]
        number = np.append(below.number, 0)
        seen, every = np.bincount(level.token, s.trains, len(level.count)).astype(np.int64), np.bincount(level.token, minlength=len(level.count))

        def found() -> Iterator[tuple[int, bytes]]:
            quiet = r.n_quiet
            for b in range(plan.buckets):
                e, i = r.entry[r.bounds[b] : r.bounds[b + 1]], slice(r.head_bounds[b], r.head_bounds[b + 1])
                h = r.heads[i]
                if len(h) or quiet:
                    yield b, pack(
                        deltas(number[h]), slim(r.sizes[i]), slim(r.quiet[i]), r.asks[i].astype("u1"), (r.fan[h] > 1).astype("u1"),
                        slim(levels[0].number[level.word[e]]), slim(seen[e]), slim(below.count[level.shorter[e]]), (every[e] == 1).astype("u1"), slim(np.array([quiet])),
                    )
                    quiet = 0

        return U.parcels_table(unit, found())

    return parcels


def _gram_counts(shorter: Discounts):
    """Answers: each entry's training count, whether it occurs once, its number in the bucket; and of each history here
    that has a gram without a count (its place in the parcel), what its alpha needs: followers seen 1..K times, tokens
    of the others, and the sum of D(c) c of the followers' shorter grams. Of histories that are dealt over several
    buckets, that is this bucket's part and goes to the sums instead."""

    def counts(blobs: list[bytes]) -> tuple[list[bytes | None], list[int], bytes]:
        got = [unpack(b) for b in blobs]
        own = [np.cumsum(x[0], dtype=np.int64) for x in got]
        join = lambda i: np.concatenate([x[i] for x in got])
        head = np.concatenate([np.repeat(h, x[1]) for h, x in zip(own, got, strict=True)])
        word, seen, low, once = join(5).astype(np.int64), join(6).astype(np.int64), join(7).astype(np.int64), join(8)
        order = np.lexsort((word, head))
        h, w = head[order], word[order]
        new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))[: len(h)]
        at = np.flatnonzero(new)
        count = np.add.reduceat(seen[order], at) if len(at) else np.empty(0, np.int64)
        alone = (np.diff(at, append=len(h)) == 1) & (once[order][at] > 0)
        gram = np.empty(len(h), np.int64)
        gram[order] = np.cumsum(new) - 1
        heads, place = np.unique(np.concatenate(own), return_inverse=True)
        owner = np.searchsorted(heads, h[at])
        n = len(heads)
        quiet = np.bincount(place, join(2), n).astype(np.int64)
        by_count = np.stack([np.bincount(owner[count == r], minlength=n) for r in range(1, K + 1)])
        by_count[0] += quiet
        often = np.bincount(owner[count > K], count[count > K], n).astype("<i8")
        followed = np.bincount(owner[count > 0], shorter(low[order][at])[count > 0], n) + quiet * float(shorter(np.array(1)))
        dealt = np.bincount(place, join(4), n) > 0
        answers: list[bytes | None] = []
        a = b = 0
        for mine, x in zip(own, got, strict=True):
            g, p = gram[a : a + len(x[5])], place[b : b + len(mine)]
            a, b = a + len(x[5]), b + len(mine)
            lacks = (x[3] > 0) | (np.bincount(np.repeat(np.arange(len(mine)), x[1]), count[g] == 0, len(mine)) > 0)
            k = np.flatnonzero(lacks & ~dealt[p])
            answers.append(pack(slim(count[g]), alone[g].astype("u1"), deltas(g), deltas(k), slim(by_count[:, p[k]].ravel()), slim(often[p[k]]), followed[p[k]]))
        parts = pack(heads[dealt], by_count[:, dealt].astype("<i8").ravel(), often[dealt], followed[dealt])
        of_count = [int((count == r).sum()) for r in range(1, K + 2)]
        of_count[0] += int(join(9).sum())
        return answers, of_count, parts

    return counts


SUMS = [*(f"n{r}" for r in range(1, K + 1)), "often"]


def _wide_sums(grams: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the histories dealt over several buckets, by number: followers seen 1..K times, tokens of the others, and the
    sum over followers. There are at most WIDE."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                heads, by_count, often, followed = unpack(blob)
                yield pa.RecordBatch.from_pydict({"history": heads, **dict(zip(SUMS, [*by_count.reshape(K, -1), often], strict=True)), "followed": followed})

    schema = "history long, " + ", ".join(f"{c} long" for c in SUMS) + ", followed double"
    found = grams.where(F.col("unit").isNull()).select("blob").mapInArrow(parts, schema)
    # added up in order of size: the same bits in every run
    followed = F.aggregate(F.array_sort(F.collect_list("followed")), F.lit(0.0), lambda acc, x: acc + x).alias("followed")
    table = found.groupBy("history").agg(*(F.sum(c).alias(c) for c in SUMS), followed).toArrow().sort_by("history")
    column = lambda c: table.column(c).to_numpy()
    return column("history"), np.stack([column(c) for c in SUMS[:K]]), column("often"), column("followed")


def _scores(order: int, plan: Plan):
    def scores(unit: int, s: Stream, got: dict) -> pa.Table:
        levels, _ = _levels(s, got, order, plan)
        count = levels[0].count
        docs = int(count[np.searchsorted(s.words, END)])
        p = np.where(count > 0, plan.discounts[0](count) / max(plan.n_tokens, 1), plan.left)[s.at]
        for k, level in enumerate(levels[1:], 2):  # P_k of every token, from P_{k-1}
            c = level.count[level.token]
            h = level.history[level.token]
            of_history = np.append(levels[k - 2].count, docs)[h]
            p = np.where(c > 0, plan.discounts[k - 1](c) / np.maximum(of_history, 1), np.where(of_history > 0, level.alpha[h], 1.0) * p)
        known, base = (count > 0).astype(np.int64), np.log10((count + 1) / (plan.n_tokens + plan.n_words + 1))
        total = lambda x: np.add.reduceat(x, s.first)
        return pa.table({
            "doc_id": pa.array(s.doc_id, pa.int64(), mask=s.no_id), "held_out": pa.array(s.held > 0),
            "n_tokens": pa.array(s.sizes), "n_known": pa.array(total(known[s.at])), "train_tokens": pa.array(np.full(len(s.first), plan.n_tokens)),
            "base_score": pa.array(total(base[s.at])), "score": pa.array(total(np.log10(p))),
        })

    return scores


def katz_scores(docs: DataFrame, held_out, order: int = ORDER, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    The model learns from the rows that aren't held out. A null text is an empty one: its only token is the end.
    Every repeated row counts. Without training rows, unknown words have all the mass, so scores are 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    text = U.text_of(docs)
    size = U.side(text, *UNIT_TEXT)
    made = U.units(rows, most=size, encode=encoded)
    plan = Plan(U.buckets_for(text, size), share)
    words = materialize(U.meet(U.send(made, _word_parcels(plan.buckets), stream_of), _word_counts, K + 3))
    plan.n_tokens, plan.n_words, *of_count = U.total(words, K + 3)
    plan.share = max(share, plan.n_tokens // WIDE)
    plan.discounts.append(Discounts.good_turing(of_count))
    # what the discounts leave to unknown words: exact from counts of counts, all others at FREQUENT
    used = sum(plan.discounts[0].by_count[r] * r * of_count[r - 1] for r in range(1, K + 1))
    often = plan.n_tokens - sum(r * of_count[r - 1] for r in range(1, K + 1))
    plan.left = 1 - (used + FREQUENT * often) / plan.n_tokens if plan.n_tokens else 1.0
    answers = words.withColumn("kind", F.lit(1))
    for k in range(2, order + 1):
        parcels = U.back(made, answers, _gram_parcels(k, plan), U.PARCEL, stream_of)
        grams = materialize(U.meet(parcels, _gram_counts(plan.discounts[-1]), K + 1))
        plan.discounts.append(Discounts.good_turing(U.total(grams, K + 1)))
        plan.wide.append(_wide_sums(grams))
        answers = answers.unionByName(grams.withColumn("kind", F.lit(k)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return U.back(made, answers, _scores(order, plan), schema, stream_of)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return katz_scores(docs, F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)))
