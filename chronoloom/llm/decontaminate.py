"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are the items' windows of words, written as ' w1 w2 ... wn '. For patterns of similar length, ``m`` is
the shortest length and ``B`` the block length; the shift table tells for the block that ends at a position how far
the search may move on. Where the shift is 0, the suffix bucket of the block gives the patterns, whose first bytes
and then all bytes are compared. Many positions of a text are walked in step, so each step is one numpy pass.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, read, tune

#: Lower-case and map every byte that is no part of a word to a space: 0-9, a-z and bytes from 0x80 stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LANE, CHUNK = 256, 4 << 20
#: Shift entries for each block of a pattern, and the bits of the largest table.
ROOM, MOST_BITS = 8, 25
#: Bytes of patterns and item names that are broadcast at a time; more are searched in as many passes.
PATTERN_BYTES = 64 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class _Class:
    """Patterns between two lengths."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.m = min(map(len, patterns))
        self.block = min(8, max(2, self.m // 2))
        self.drop = np.uint64(8 * (8 - self.block))
        blocks = len(patterns) * (self.m - self.block + 1)
        self.bits = min(MOST_BITS, max(12, (ROOM * blocks).bit_length()))
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.uint16 if self.m < 60_000 else np.uint32)
        ends = []
        for p in patterns:
            head = b"\0" * 8 + p[: self.m]
            view = np.frombuffer(b"".join(head[j : j + 8] for j in range(self.block, self.m + 1)), "<u8")
            h = self.hashed(view)
            np.minimum.at(self.shift, h, np.arange(self.m - self.block, -1, -1).astype(self.shift.dtype))
            ends.append(int(h[-1]))
        order = np.argsort(ends, kind="stable")
        self.ends = np.array(ends)[order]
        self.patterns = [patterns[i] for i in order]
        self.numbers = np.array(numbers)[order]
        self.heads = np.frombuffer(b"".join((p[: min(8, self.m)]).ljust(8, b"\0") for p in self.patterns), "<u8")

    def hashed(self, words: np.ndarray) -> np.ndarray:
        return (((words >> self.drop) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence in text, which begins and ends with 8 spare bytes."""
        n = len(text) - 16
        if n < self.m:
            return
        at_byte = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))  # the 8 bytes from each position on
        starts = np.arange(8, 8 + n, LANE)
        limit = np.minimum(starts + LANE, 8 + n - self.m + 1)  # of a window's start
        at = starts[starts < limit]
        limit = limit[: len(at)]
        zero = []
        while len(at):
            shift = self.shift[self.hashed(at_byte[at + (self.m - 8)])]
            if len(stop := at[shift == 0]):
                zero.append(stop)
            at = at + np.maximum(shift, 1)
            on = at < limit
            at, limit = at[on], limit[on]
        if not zero:
            return
        at = np.concatenate(zero)
        h = self.hashed(at_byte[at + (self.m - 8)])
        low, high = np.searchsorted(self.ends, h, "left"), np.searchsorted(self.ends, h, "right")
        count = high - low
        where = np.repeat(at, count)
        which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        mask = np.uint64(2 ** (8 * min(8, self.m)) - 1)
        same = (at_byte[where] & mask) == self.heads[which]
        for a, p in zip(where[same].tolist(), which[same].tolist(), strict=True):
            if text.startswith(self.patterns[p], a):
                yield a, int(self.numbers[p])


class WuManber:
    """Search for many byte strings of at least 3 bytes."""

    def __init__(self, patterns: list[bytes]):
        by_length = defaultdict(list)
        for number, p in enumerate(patterns):
            by_length[len(p).bit_length()].append((p, number))
        self.classes = [_Class([p for p, _ in x], [i for _, i in x]) for x in by_length.values()]

    def find(self, text: bytes) -> list[tuple[int, int]]:
        text = b"\n" * 8 + text + b"\n" * 8
        return sorted((a - 8, p) for c in self.classes for a, p in c.occurrences(text))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """w_pattern, w_items: each distinct window and the ids (as strings, sorted) of the items that have it."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(word), 0)
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("w_item"), words.alias("w_words"))
    items = items.where(F.size("w_words") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w_words") - size + 1, F.lit(1))), lambda i: F.slice("w_words", i, size))
    each = items.select("w_item", F.explode(cut).alias("w_window"))
    each = each.select("w_item", F.concat(F.lit(" "), F.array_join("w_window", " "), F.lit(" ")).alias("w_pattern"))
    return each.groupBy("w_pattern").agg(F.sort_array(F.collect_set("w_item")).alias("w_items"))


_held: dict[str, tuple[WuManber, np.ndarray]] = {}


def _search(name: str, patterns: list[str]) -> tuple[WuManber, np.ndarray]:
    """The search tables of a block of patterns and the patterns' numbers of words: made once in a Python worker, which
    keeps the last."""
    if name not in _held:
        _held.clear()
        _held[name] = WuManber([p.encode() for p in patterns]), np.array([p.count(" ") - 1 for p in patterns], np.int64)
    return _held[name]


def _scan(table, first: bool):
    """Adds to d_spans and d_items what occurs of a table's patterns; the first pass also counts words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, patterns, items = table.value
        search, words_in = _search(name, patterns)
        for batch in batches:
            texts, counts, held, size = batch.column("d_text").to_pylist(), [], [], 0
            spans, names = batch.column("d_spans").to_pylist(), batch.column("d_items").to_pylist()
            done = 0

            def flush() -> None:
                nonlocal size, done
                if not held:
                    return
                joined = b"".join(held)
                starts = np.cumsum([0, *map(len, held)])
                found = search.find(joined)
                at, which = np.array(found, np.int64).reshape(-1, 2).T
                docs = np.searchsorted(starts, at, "right") - 1
                blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if found else at
                before = np.searchsorted(blanks, at) - np.searchsorted(blanks, starts[docs])  # words of the document before a hit
                rows = defaultdict(list)
                for d, first, end, p in zip(docs.tolist(), before.tolist(), (before + words_in[which]).tolist(), which.tolist(), strict=True):
                    rows[d].append((first, end, p))
                for d, hits in rows.items():
                    spans[done + d] = _joined([*((x["first"], x["end"]) for x in spans[done + d]), *((a, b) for a, b, _ in hits)])
                    names[done + d] = sorted({*names[done + d], *(n for p in {p for _, _, p in hits} for n in items[p])})
                done += len(held)
                held.clear()
                size = 0

            for text in texts:
                words = words_of(text)
                counts.append(len(words))
                held.append(b"\n " + b" ".join(words) + b" \n" if words else b"\n")
                size += len(held[-1])
                if size >= CHUNK:
                    flush()
            flush()
            out = {n: batch.column(n) for n in batch.schema.names}
            out["d_n"] = pa.array(counts, pa.int64()) if first else batch.column("d_n")
            out["d_spans"] = pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            out["d_items"] = pa.array(names, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(out)

    return scan


def _joined(ranges: list[tuple[int, int]]) -> list[dict]:
    """Ranges as ranges apart from each other."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"first": a, "end": b} for a, b in out]


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, d_n (words), d_spans (hit word ranges) and d_items (items found), for every row.

    Without a shuffle of docs. The patterns are a written table; of at most PATTERN_BYTES they are broadcast and docs
    are read once. More patterns are searched block by block, one pass over docs for each, so neither the driver nor a
    worker ever holds more than a block. Null or wordless texts have no words; an item without words, or with a null
    id or text, has no windows; repeated items count once. The names d_n, d_spans, d_items and d_text are the
    operator's own: of ``keep``, columns with these names are left out.
    """
    spark = docs.sparkSession
    tune(spark)
    found = materialize(windows(benchmark, size))
    bytes_of = F.octet_length("w_pattern") + 64 + F.aggregate("w_items", F.lit(0), lambda acc, x: acc + F.octet_length(x) + 16)
    total = found.agg(F.coalesce(F.sum(bytes_of), F.lit(0))).first()[0]
    blocks = max(1, -(-total // PATTERN_BYTES))
    span = "array<struct<first: long, end: long>>"
    own = ("d_n", "d_spans", "d_items", "d_text")
    out = docs.select(
        *(docs[c] for c in keep if c.lower() not in own), docs["text"].cast("binary").alias("d_text"), F.lit(0).cast("long").alias("d_n"),
        F.array().cast(span).alias("d_spans"), F.array().cast("array<string>").alias("d_items"),
    )
    for b in range(blocks):
        rows = found.where(F.pmod(F.xxhash64("w_pattern"), F.lit(blocks)) == b).orderBy("w_pattern").collect()
        table = spark.sparkContext.broadcast((uuid.uuid4().hex, [r.w_pattern for r in rows], [r.w_items for r in rows]))
        out = out.mapInArrow(_scan(table, b == 0), out.schema)
        if b < blocks - 1:
            out = materialize(out)
            table.unpersist()
    return out.drop("d_text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("d_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    return found.select(
        "doc_id", F.col("d_n").alias("n_words"), hit.alias("n_hit"), F.size("d_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("d_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


SQL = {
    "op6_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bp AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM bp),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k),
ds AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s FROM dp),
hit AS (SELECT doc_id, k, i, item_id FROM ds JOIN win USING (k, s)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
