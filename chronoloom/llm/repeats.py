"""Removal of repeated passages by an enhanced suffix array and its tree of common-prefix intervals.

Every window of ``WINDOW`` bytes is given to the smallest hash of its ``GRAM``-byte strings (its anchor), so equal
windows have equal anchors wherever they are; neighbouring windows of one anchor form a segment of at most 84 bytes.
Anchors are counted over all units, and only segments whose anchor more than one document has are looked at further.

A unit sends each different text of its shared segments once, with the smallest doc_id that has it, however many
documents do. Texts of one anchor meet: the suffixes whose first WINDOW bytes recur are sorted, and the array is
scanned with a stack. An interval of suffixes with a common prefix of WINDOW bytes or more, whose occurrences have
different bytes before them, is a maximal repeat with all its occurrences; a text that several documents have is an
interval of its own (a leaf). Ranges of texts and the smallest doc_id of their group go back to the units, which cut
them out of every place of the text in a document with a larger doc_id.

An anchor with very many different texts (a frequent phrase in ever new surroundings) doesn't meet in one task: its
segments are dealt window by window, by a hash of all WINDOW bytes, so equal windows still meet and coverage is the same.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import units as U
from .common import deltas, kept_names, materialize, mix, pack, read, slim, unpack

WINDOW, GRAM = 50, 16
CHUNK = 1 << 18  # windows handled at a time
SCAN = 10 << 20  # bytes of suffixes sorted at a time
HOT = 20_000  # an anchor's different texts in units, beyond one in each, from which on it is dealt by window
UNIT_TEXT = (4 << 20, 24 << 20)  # text of a unit or bucket: least and most
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: no document is smaller because of it


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of all segments of all texts, in portions: text, first window, end (of the last window's bytes), anchor."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - WINDOW + 1, CHUNK):  # portions of long texts overlap by a window less a byte
            held.append((i, at, text[at : at + CHUNK + WINDOW - 1]))
            size += len(held[-1][2])
            if size >= CHUNK:
                yield _segments(held)
                held, size = [], 0
    if held:
        yield _segments(held)


def _segments(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = b"".join(x for _, _, x in held) + b"\0" * (GRAM + WINDOW)
    sizes = np.array([len(x) for _, _, x in held])
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    h = eight[: n + WINDOW - 8] * np.uint64(0x9E3779B97F4A7C15)
    h += eight[8 : n + WINDOW] * np.uint64(0xC2B2AE3D27D4EB4F)
    mix(h)
    least, width = h, 1
    grams = WINDOW - GRAM + 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n + 1], least[grams - width : n + 1 + grams - width])[:n]
    flag = np.zeros(n + 1, np.int8)
    flag[begin] += 1
    np.add.at(flag, begin + sizes - WINDOW + 1, -1)
    valid = np.cumsum(flag[:n]) > 0
    same = np.append(False, least[1:] == least[:-1])
    first = np.flatnonzero(valid & ~(same & np.append(False, valid[:-1])))
    last = np.flatnonzero(valid & ~np.append(same[1:] & valid[1:], False))
    # an anchor that repeats (as in 'ha ha ha') makes a long segment: in pieces of a window's reach, its few phases recur
    pieces = (last - first) // grams + 1
    anchor = np.repeat(least[first], pieces)
    step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * grams
    first, last = np.repeat(first, pieces) + step, np.minimum(np.repeat(first, pieces) + step + grams - 1, np.repeat(last, pieces))
    owner = np.searchsorted(begin, first, "right") - 1
    text, shift = np.array([i for i, _, _ in held]), np.array([a for _, a, _ in held])
    return text[owner], first - begin[owner] + shift[owner], last + WINDOW - begin[owner] + shift[owner], anchor


def maximal_repeats(texts: list[bytes], least: int = WINDOW, copied: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, texts, offsets) of every maximal repeat of different texts: strings of at least ``least`` bytes with
    two or more occurrences, which can't be extended on either side in all of them. A text that is ``copied`` occurs
    more than once as a whole. For short texts: the longest sets the bytes a suffix takes."""
    copied = np.zeros(len(texts), bool) if copied is None else copied.copy()
    sizes = np.array([len(t) for t in texts], np.int64)
    depth = int(sizes.max(initial=least))
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts) + b"\0" * (depth + 8), np.uint8)
    count = np.maximum(0, sizes - least + 1)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), count)
    offset = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
    # only suffixes whose first ``least`` bytes recur can be in an interval; they are sorted in slices by those bytes
    head = _hash(data, begin[owner] + offset, least)
    order = np.argsort(head, kind="stable")
    same = np.append(False, head[order][1:] == head[order][:-1])[: len(order)]
    again = order[same | np.append(same[1:], False)[: len(order)]]
    slices = 1 + len(again) * depth // SCAN
    bounds = [0, *(np.searchsorted(head[again], head[again[len(again) * i // slices]]) for i in range(1, slices)), len(again)] if len(again) else [0]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = again[lo:hi]
        for length, who in _scan(data, begin[owner[part]] + offset[part], sizes[owner[part]] - offset[part], offset[part], depth, least):
            own, where = owner[part[who]], offset[part[who]]
            copied[own[(where == 0) & (sizes[own] == length)]] = False  # its copies are in this interval, too
            yield length, own, where
    for k in np.flatnonzero(copied & (sizes >= least)).tolist():
        yield int(sizes[k]), np.array([k]), np.array([0])


def _hash(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes from each place on; chance collisions cost work, not correctness."""
    h = np.zeros(len(at), np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    for i in [*range(0, size - 7, 8), max(0, size - 8)] if size >= 8 else []:
        h = mix((h + eight[at + i]) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(size if size < 8 else 0):
        h = mix((h + data[at + i]) * np.uint64(0x9E3779B97F4A7C15))
    return h


def _scan(data: np.ndarray, at: np.ndarray, room: np.ndarray, offset: np.ndarray, depth: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, members of ``at``) of every interval of the sorted suffixes that is diverse on the left."""
    if len(at) < 2:
        return
    suffix = np.lib.stride_tricks.sliding_window_view(data, depth)[at]
    suffix[np.arange(depth) >= room[:, None]] = 0
    order = suffix.view(f"S{depth}").ravel().argsort(kind="stable")
    suffix, room = suffix[order], room[order]
    differ = suffix[1:] != suffix[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    common = np.minimum(common, np.minimum(room[1:], room[:-1]))
    before = np.where(offset[order] > 0, data[np.maximum(at[order] - 1, 0)].astype(np.int16), -1)
    starts = np.flatnonzero(~np.append(False, common >= least))
    high, low = np.maximum.reduceat(before, starts), np.minimum.reduceat(before, starts)
    ends = np.append(starts[1:], len(at))
    some = (ends - starts > 1) & ((high != low) | (low == -1))
    for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
        for length, lo, hi in intervals(common[a : b - 1].tolist()) if b - a > 2 else ((int(common[a]), 0, 1),):
            own = before[a + lo : a + hi + 1]
            if own.min() == -1 or own.min() != own.max():
                yield length, order[a + lo : a + hi + 1]


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (length, first, last) of an array, inner ones first; common[i] is what suffixes i
    and i + 1 share. Stack scan: an interval stays open while what neighbours share doesn't get shorter."""
    stack: list[tuple[int, int]] = []
    for i, c in enumerate([*common, 0]):
        lo = i
        while stack and stack[-1][0] > c:
            length, lo = stack.pop()
            yield length, lo, i
        if c and (not stack or stack[-1][0] < c):
            stack.append((c, lo))


def _numbered(rows: pa.Table) -> np.ndarray:
    return np.array([LAST if d is None else d for d in rows.column("doc_id").to_pylist()], np.int64)


def _texts(rows: pa.Table) -> list[bytes]:
    return [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]


def _anchor_parcels(buckets: int):
    """Of each bucket, the unit's anchors that one document has, then those that several have, then those that have
    different texts, and how many beyond the first."""

    def parcels(unit: int, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        doc_id, texts = _numbered(rows), _texts(rows)
        found = [(mix(anchor), text, first, end) for text, first, end, anchor in segments(texts)]
        if not found:
            return
        key, text, first, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")
        key, text = key[order], text[order]
        doc = doc_id[text]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        more = _different(texts, at, text, first[order], end[order]) - 1
        key = key[at]
        bucket, low = _key(key, buckets)
        order, bounds = U.split(bucket, buckets)
        for b in range(buckets):
            if len(o := order[bounds[b] : bounds[b + 1]]):
                many = o[more[o] > 0]
                yield b, pack(deltas(np.unique(low[o][~several[o]])), deltas(np.unique(low[o][several[o]])), low[many], slim(more[many]))

    return parcels


def _different(texts: list[bytes], at: np.ndarray, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of different texts of each anchor, whose segments begin at ``at``."""
    count = np.diff(at, append=len(text))
    owner = np.repeat(np.arange(len(at)), count)
    again = np.flatnonzero(count[owner] > 1)
    same = xxhash.xxh3_64_intdigest
    kind = np.array([same(texts[t][a:b]) for t, a, b in zip(text[again].tolist(), first[again].tolist(), end[again].tolist(), strict=True)], np.uint64)
    owner = owner[again]
    order = np.lexsort((kind, owner))
    owner, kind = owner[order], kind[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]))[: len(owner)]
    return np.maximum(np.bincount(owner[new], minlength=len(at)), 1)


def _key(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and a 32-bit rest; keys that agree in both by chance cost work, not correctness."""
    return (key % np.uint64(buckets)).astype(np.int64), (key // np.uint64(buckets)).astype("<u4")


def _summed(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.uint32)


def _shared_anchors(hot_from: int):
    """Answers: the unit's anchors that more than one document has, and which of them are dealt by window."""

    def shared_anchors(blobs: list[bytes]) -> tuple[list[bytes | None], list[int]]:
        got = [(_summed(one), _summed(several), many, more) for one, several, many, more in map(unpack, blobs)]
        every, count = np.unique(np.concatenate([x for parts in got for x in parts[:2]]), return_counts=True)
        several = np.unique(np.concatenate([s for _, s, _, _ in got]))
        count[np.searchsorted(every, several)] = 2
        shared = every[count > 1]
        many, back = np.unique(np.concatenate([m for _, _, m, _ in got]), return_inverse=True)
        hot = many[np.bincount(back, np.concatenate([n for *_, n in got]), len(many)) >= hot_from]
        answers: list[bytes | None] = []
        for parts in got:
            mine = np.unique(np.concatenate(parts[:2]))
            mine = mine[np.isin(mine, shared, assume_unique=True)]
            answers.append(pack(deltas(mine), np.isin(mine, hot, assume_unique=True).astype("u1")) if len(mine) else None)
        return answers, []

    return shared_anchors


def _shared_texts(texts: list[bytes], got: dict, anchor_buckets: int, buckets: int) -> tuple[dict[int, list[bytes]], dict[int, np.ndarray]]:
    """By bucket: the different texts of the unit's shared segments, and a row (text, document, start) for each segment."""
    parts = [(b, *unpack(x)) for (kind, b), x in sorted(got.items()) if kind == 1]
    shared = np.concatenate([_summed(x).astype(np.uint64) * np.uint64(anchor_buckets) + np.uint64(b) for b, x, _ in parts] or [np.empty(0, np.uint64)])
    hot = np.concatenate([x > 0 for *_, x in parts] or [np.empty(0, bool)])
    order = np.argsort(shared)
    shared, hot = shared[order], hot[order]
    places: dict[int, dict[bytes, int]] = defaultdict(dict)
    hits: dict[int, array] = defaultdict(lambda: array("q"))
    for text, first, end, anchor in segments(texts) if len(shared) else ():
        bucket, low = _key(mix(anchor), anchor_buckets)
        full = low.astype("<u8") * np.uint64(anchor_buckets) + bucket.astype(np.uint64)
        at = np.minimum(np.searchsorted(shared, full), len(shared) - 1)
        keep = shared[at] == full
        wide = np.flatnonzero(keep & hot[at])
        for t, a, b in zip(text[wide].tolist(), first[wide].tolist(), end[wide].tolist(), strict=True):
            for i in range(a, b - WINDOW + 1):
                window = texts[t][i : i + WINDOW]
                k = xxhash.xxh3_64_intdigest(window) % buckets
                own = places[k]
                hits[k].extend((own.setdefault(window, len(own)), t, i))
        keep = np.flatnonzero(keep & ~hot[at])
        for t, a, b, k in zip(text[keep].tolist(), first[keep].tolist(), end[keep].tolist(), (full[keep] % np.uint64(buckets)).tolist(), strict=True):
            own = places[k]
            hits[k].extend((own.setdefault(texts[t][a:b], len(own)), t, a))
    return {k: list(x) for k, x in places.items()}, {k: np.array(x, np.int64).reshape(-1, 3) for k, x in hits.items()}


def _segment_parcels(anchor_buckets: int, buckets: int):
    """Of each bucket, the unit's different texts of shared segments (length, bytes), the smallest doc_id that has
    each, and whether several have it."""

    def parcels(unit: int, rows: pa.Table, got: dict) -> pa.Table:
        doc_id = _numbered(rows)
        kinds, hits = _shared_texts(_texts(rows), got, anchor_buckets, buckets)

        def found() -> Iterator[tuple[int, bytes]]:
            for b, own in sorted(kinds.items()):
                place, doc = hits[b][:, 0], doc_id[hits[b][:, 1]]
                low, high = np.full(len(own), LAST, np.int64), np.full(len(own), np.iinfo(np.int64).min, np.int64)
                np.minimum.at(low, place, doc)
                np.maximum.at(high, place, doc)
                yield b, pack(slim(np.array([len(x) for x in own])), np.frombuffer(b"".join(own), np.uint8), low, (low != high).astype("u1"))

        return U.parcels_table(unit, found())

    return parcels


def _repeated(blobs: list[bytes]) -> tuple[list[bytes | None], list[int]]:
    """Answers: of the unit's texts, ranges (text, start, end) and the smallest doc_id of the group that has them."""
    number: dict[bytes, int] = {}
    local, lows, manys = [], [], []
    for blob in blobs:
        length, data, low, many = unpack(blob)
        raw, ends = data.tobytes(), np.cumsum(length, dtype=np.int64)
        local.append(np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)], np.int64))
        lows.append(low)
        manys.append(many > 0)
    kinds = list(number)
    least, most = np.full(len(kinds), LAST, np.int64), np.full(len(kinds), np.iinfo(np.int64).min, np.int64)
    several = np.zeros(len(kinds), bool)
    for own, low, many in zip(local, lows, manys, strict=True):
        np.minimum.at(least, own, low)
        np.maximum.at(most, own, low)
        several[own] |= many
    several |= least != most
    found = array("q")  # text, start, end and smallest doc_id of each range, one after another
    for length, owner, offset in maximal_repeats(kinds, WINDOW, several):
        smallest = least[owner].min()
        later = several[owner] | (least[owner] > smallest)
        owner, offset = owner[later], offset[later]
        found.frombytes(np.stack([owner, offset, offset + length, np.full(len(owner), smallest)], axis=1).astype(np.int64).tobytes())
    kind, start, end, smallest = np.frombuffer(found, np.int64).reshape(-1, 4).T if len(found) else np.empty((4, 0), np.int64)
    order = np.argsort(kind, kind="stable")
    start, end, smallest = start[order], end[order], smallest[order]
    bounds = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
    answers: list[bytes | None] = []
    for own in local:
        count = bounds[own + 1] - bounds[own]
        at = np.repeat(bounds[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        answers.append(pack(deltas(np.repeat(np.arange(len(own)), count)), slim(start[at]), slim(end[at]), smallest[at]) if len(at) else None)
    return answers, []


def _cut(anchor_buckets: int, buckets: int):
    """Adds r_spans (removed byte ranges, apart from each other) and r_kept (the other bytes) to the rows."""

    def cut(unit: int, rows: pa.Table, got: dict) -> pa.Table:
        texts, doc_id = _texts(rows), _numbered(rows)
        ranges = [np.empty((3, 0), np.int64)]
        if any(kind == 2 for kind, _ in got):
            for b, hits in _shared_texts(texts, got, anchor_buckets, buckets)[1].items():
                if (2, b) in got:
                    ranges.append(_ranges(hits, doc_id, *unpack(got[2, b])))
        doc, start, end = np.concatenate(ranges, axis=1)
        spans, kept = _apart(texts, doc, start, end)
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return rows.drop_columns(["text"]).append_column("r_spans", pa.array(spans, span)).append_column("r_kept", pa.array(kept, pa.binary()))

    return cut


def _ranges(hits: np.ndarray, doc_id: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """document, start and end of the ranges at every place of their texts in a document that isn't the smallest."""
    kind = np.cumsum(kind, dtype=np.int64)
    place, doc, at = hits.T
    low, high = np.searchsorted(kind, place, "left"), np.searchsorted(kind, place, "right")
    count = high - low
    which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    doc, at = np.repeat(doc, count), np.repeat(at, count)
    later = doc_id[doc] > smallest[which]
    return np.stack([doc[later], (at + start[which])[later], (at + end[which])[later]])


def _apart(texts: list[bytes], doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[list[dict]], list[bytes]]:
    """Each text's ranges put together, and what they leave of it."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    spans, kept = [], []
    for i, text in enumerate(texts):
        s, e = start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]]
        if not len(s):
            spans.append([]), kept.append(text)
            continue
        reach = np.maximum.accumulate(e)
        new = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
        first, last = s[new].tolist(), reach[np.append(new[1:], len(s)) - 1].tolist()
        spans.append([{"first": a, "end": b} for a, b in zip(first, last, strict=True)])
        kept.append(b"".join(text[a:b] for a, b in zip([0, *last], [*first, len(text)], strict=True)))
    return spans, kept


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """All columns of docs (doc_id, text and any others) but text, then r_spans and r_kept, for every row; they replace
    columns of docs with those names.

    A byte is removed if a string of WINDOW bytes that covers it also starts in a document with a smaller doc_id, as
    the input has it. A null text is an empty one and loses nothing; so does a text below WINDOW bytes. Rows with equal
    doc_ids don't count against each other; a null doc_id counts as larger than all others. Texts are bytes of UTF-8;
    a removed range may begin or end inside a character.
    """
    schema = docs.select("text", *kept_names(docs, "r_spans", "r_kept")).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = U.text_of(docs)
    size = U.side(total, *UNIT_TEXT)
    made = U.units(schema, most=size)
    anchor_buckets, buckets = U.buckets_for(total, 2 * size), U.buckets_for(total, size)
    shared = materialize(U.meet(U.send(made, _anchor_parcels(anchor_buckets)), _shared_anchors(hot), 0).withColumn("kind", F.lit(1)))
    parcels = U.back(made, shared, _segment_parcels(anchor_buckets, buckets), U.PARCEL)
    ranges = materialize(U.meet(parcels, _repeated, 0).withColumn("kind", F.lit(2)))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema.schema if f.name != "text")
    return U.back(made, shared.unionByName(ranges), _cut(anchor_buckets, buckets), kept + "r_spans array<struct<first: long, end: long>>, r_kept binary")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("r_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    return found.select(
        "doc_id", (F.length("r_kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("r_spans").cast("long").alias("n_spans"), F.sha2("r_kept", 256).alias("kept_sha256"),
    )


SQL = {
    "op8_repeats": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.lo < w.doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM r),
x AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)"""
}
