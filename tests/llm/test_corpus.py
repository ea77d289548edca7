"""Corpus operators against brute force on small tables, and their edge cases."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import components as C
from chronoloom.llm import decontaminate, language, lm, neardup, packing, quality, repeats, stars, token_files, tokens, topk, url_filter
from chronoloom.llm.common import pack, slim, unpack

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int"
WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Prose, near copies of each other, exact copies, shared passages, nulls, empties, a long text, a repeated row."""
    rng, texts = random.Random(5), []
    base = prose(rng, 120)
    passage = "This passage of well over fifty bytes stands in several documents, word for word."
    for i in range(40):
        words = base.split()
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [prose(rng, 60) for _ in range(20)] + [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(5)]
    texts += [texts[41]] * 6 + [None, "", " \t\n", "one", "ONE", "...", "Ünïcödé größe ßtraße " * 12, "Ünïcödé größe ßtraße " * 12, "x" * 70, "x" * 90, prose(rng, 30_000)]
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[7], (None, prose(rng, 10), "en", None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_pack_round_trip():
    parts = [np.array([1, 2**40], "<u8"), np.array([], "<i4"), slim(np.array([0, 300])), np.array([0.5])]
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(parts, unpack(pack(*parts)), strict=True))


# ---- near duplicates


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def groups(plain, width):
    """Component of each row's text, by all pairs."""
    sets = {t: frozenset(shingle_set(t, width)) for _, t in plain}
    kinds = [s for s in set(sets.values()) if s]
    root = {s: s for s in kinds}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for d, t in plain:
        if sets[t] and d is not None:
            least[find(sets[t])] = min(d, least.get(find(sets[t]), d))
    return sets, lambda d, t: least.get(find(sets[t])) if sets[t] else d


@pytest.mark.parametrize("block", [1024, 7])
@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, plain, width, block, monkeypatch):
    monkeypatch.setattr(stars, "BLOCK", block)
    sets, component = groups(plain, width)
    want = sorted((str(d), len(sets[t]), str(component(d, t)), component(d, t) == d) for d, t in plain)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(docs, width).collect())
    assert got == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**63, 900, np.uint64), rng.integers(0, 2**63, (2, 50), np.uint64)
    a, b = (neardup.signature(neardup.minima(np.concatenate([shared, x]))) for x in own)
    found = neardup.estimate(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))
    assert abs(found - 0.9) < 0.12


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 200: 100, 300: 100}


# ---- tokens: packing and files


@pytest.fixture(scope="module")
def ids(plain):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    return {t: whole.encode(t or "", add_special_tokens=False).ids for _, t in plain}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    for t in ["", "Don't we'LL 12,3", "a\x1cb\x85c\xa0d e", "é é É ẞ ß ſ K", "<|endoftext|> x <|", "日本 语 ١٢", "ª²½ µ×÷", "!!--__''s", "I'm İ ǅ", "a" * 500]:
        assert list(fast(t)) == whole.encode(t, add_special_tokens=False).ids, t


def test_encoder_on_generated_texts():
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    rng = random.Random(6)
    signs = [*"abzABZ019'.,!-_ \t\n\r\x0b\x0c\x1c\x85\xa0ÄÖßéÿÀÞ×÷µªſK中語🙂\u0301\u200b<|>", "'s", "'LL", " don't", "<|endoftext|>", "  ", "...", "The ", "größe"]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 40)))
        assert list(fast(t)) == whole.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, plain, ids):
    rows = packing.pack_documents(docs.select("doc_id", "text"), 64).collect()
    want = collections.Counter()
    for d, t in plain:
        x = [*ids[t], 0]
        for p in range(-(-len(x) // 64)):
            want[(d, p, 64 * p, len(x[64 * p : 64 * p + 64]), crc(x[64 * p : 64 * p + 64]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 64 + 2


def test_packing_in_several_groups(docs, ids, plain, monkeypatch):
    """Groups of few pieces: sequences of one group never meet those of another, and all stay within the capacity."""
    monkeypatch.setattr(packing, "GROUP", 40)
    rows = packing.pack_documents(docs.select("doc_id", "text"), 64).collect()
    assert sum(r.length for r in rows) == sum(len(ids[t]) + 1 for _, t in plain)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 64
    assert len(bins) > 10


def test_sum_of_squares_is_tight():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.geometric(1 / 400, 8000), 2048)
    number, offset = packing.sum_of_squares(lengths)
    assert number.max() + 1 <= 1.005 * lengths.sum() / 2048 + 1
    for s in range(0, number.max() + 1, 97):
        o = np.argsort(offset[number == s])
        assert (np.cumsum(lengths[number == s][o]) - lengths[number == s][o] == offset[number == s][o]).all()


def test_token_files(spark, docs, plain, ids, tmp_path):
    token_files.write_tokens(docs, f"file://{tmp_path}/t")
    got = token_files.with_crc(token_files.read_tokens(spark, f"file://{tmp_path}/t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in plain), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = collections.Counter((d, len(ids[t]) + 1, crc([*ids[t], 2])) for d, t in plain)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    one = token_files.read_tokens(spark, f"file://{tmp_path}/t").where("doc_id = 3").collect()
    assert [r.ids for r in one] == [[*ids[dict((d, t) for d, t in plain)[3]], 2]]
    plan = spark.read.schema(token_files.ROWS).orc(f"file://{tmp_path}/t").where("doc_id = 3")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,3)" in plan.split("PushedFilters")[1]


def test_token_files_are_pruned(spark, tmp_path):
    """Bloom filters and row indexes are in the files; a look-up reads a row group, not the file."""
    path = f"file://{tmp_path}/t"
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    token_files.write_tokens(docs.coalesce(2), path, row_group=1000)
    orc, hadoop = spark._jvm.org.apache.orc, spark._jvm.org.apache.hadoop
    names, rows, groups = [f for f in (tmp_path / "t").iterdir() if f.suffix == ".orc"], 0, 0
    for f in names:
        conf = spark._jsc.hadoopConfiguration()
        reader = orc.OrcFile.createReader(hadoop.fs.Path(str(f)), orc.OrcFile.readerOptions(conf))
        rows += reader.getNumberOfRows()
        assert reader.getRowIndexStride() == 1000
        column = reader.getSchema().findSubtype("doc_id").getId()
        kinds = set()
        for stripe in reader.getStripes():
            footer = reader.rows().readStripeFooter(stripe) if hasattr(reader.rows(), "readStripeFooter") else None
            if footer is not None:
                kinds |= {str(x.getKind()) for x in footer.getStreamsList() if x.getColumn() == column}
            groups += -(-stripe.getNumberOfRows() // 1000)
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds, kinds
    assert rows == 20_000 and groups >= 20
    for doc_id, found in ((20_002, 1), (20_003, 0), (50_000, 0)):
        df = spark.read.schema(token_files.ROWS).orc(path).where(F.col("doc_id") == doc_id)
        assert df.count() == found
        # what the reader hands out before the filter
        scanned = spark.read.schema(token_files.ROWS).orc(path).where(F.col("doc_id") == doc_id).select("doc_id", "ids")
        plan = scanned._jdf.queryExecution()
        plan.executedPlan().executeCollect()
        nodes, counts = [plan.executedPlan()], []
        while nodes:
            node = nodes.pop()
            if node.nodeName().startswith("Scan orc"):
                counts.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
        assert counts and max(counts) <= 2000, counts


# ---- classifiers


def test_language_held_out(spark, sf):
    rows = {r.doc_id: r for r in language.op2_language(spark, sf.replace("0.001", "0.01")).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d, r in rows.items() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in rows.items())
    assert sum(rows[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)


def test_language_edges(spark, docs):
    model = language.train(["the cat and the dog", "der Hund und die Katze"] * 20, ["en", "de"] * 20)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 .,"), (4, "the dog"), (5, "und die Katze " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.predict(rows, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"] and got[1][1]
    assert language.predict(rows, None).where("lang_pred <> 'und'").count() == 0
    assert language.fit(docs.where("lang is null").select("doc_id", "text", "lang")) is None
    # numerals that aren't decimal digits are no letters either
    odd = spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "٣ 7"), (3, "_ ª")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.predict(odd, model).orderBy("doc_id").collect()] == [True, True, False]
    # columns with the names of results are replaced
    out = language.predict(docs.withColumn("Lang_Pred", F.lit(7)), model)
    assert sorted(out.columns) == sorted(["doc_id", "lang", "source", "n_chars", "kept", "lang_pred", "score", "rejected"]) and dict(out.dtypes)["score"] == "double"
    assert out.count() == docs.count()


def test_language_model_does_not_depend_on_file_order(spark, docs):
    labelled = docs.select("doc_id", "text", "lang")
    one, other = (language.fit(d, sample=12) for d in (labelled.repartition(1), labelled.repartition(7, "text")))
    assert np.array_equal(one.table, other.table) and one.temperature == other.temperature


def test_gram_means_against_loop():
    """Log-odds of a text: the mean over all its 2-, 3- and 4-grams, with blanks around it."""
    model = language.train(["the cat and the dog", "der Hund und die Katze"] * 20, ["en", "de"] * 20)
    for text in ("Katze", "the dog's kennel, ten of them", "a"):
        padded = list(b" " + language.prepared(text) + b"    ")
        total, n = np.zeros(2), len(language.prepared(text)) + 2
        for at in range(n):
            h = padded[at]
            for k in (1, 2, 3):
                h = (h * 0x01000193 + padded[at + k]) % 2**32
                total += model.table[((h + k) * 0x9E3779B1 % 2**32) >> 17]
        assert np.allclose(model.logits([language.prepared(text)])[0], total / (3 * n) + model.bias, atol=1e-4)


def test_quality_held_out(spark, sf):
    folder = sf.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in quality.op5_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(folder + "/labels.parquet").collect()}
    held = [(rows[d], y) for d, y in labels.items() if d in rows and rows[d].held_out]
    for y in (0, 1):
        own = [r.predicted == y for r, z in held if z == y]
        assert sum(own) >= 0.8 * len(own)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    unary, pair = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, log_z = quality.marginals(unary, pair, counts)
    start = 0
    for i, n in enumerate(counts):
        weight = {}
        for path in np.ndindex(*[2] * n):
            weight[path] = math.exp(sum(unary[start + k, s] for k, s in enumerate(path)) + sum(pair[path[k], path[k + 1]] for k in range(n - 1)))
        z = sum(weight.values())
        assert abs(log_z[start] - math.log(z)) < 1e-9
        for k in range(n):
            assert abs(math.exp(got[start + k, 1]) - sum(w for p, w in weight.items() if p[k] == 1) / z) < 1e-9
        start += n


def test_quality_edges(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None and quality.score(docs.select("doc_id", "text"), None).where("predicted = 0").count() == 0
    one = spark.createDataFrame([(i, 1, 0) for i in range(5)], none.schema)
    field = quality.fit(docs, one)
    out = quality.score(docs.withColumn("Predicted", F.lit("x")), field)
    assert out.count() == docs.count() and dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["predicted"] == "int" and len(out.columns) == len(docs.columns)
    assert quality.score(docs.select("doc_id", "text"), field).count() == docs.count() and quality.score(nothing.select("doc_id", "text"), field).count() == 0


def test_line_features_against_loop():
    texts = [b"One line, here!\n\nAAA bbb bbb | {x} 12\n", b"", b"word word word\nlast \xc3\xa9"]
    x, size, counts = quality.features(texts)
    lines = [t.split(b"\n") for t in texts]
    assert counts.tolist() == [len(n) for n in lines] and size.tolist() == [len(n) for own in lines for n in own]

    def own(n):
        words = n.split()
        chars = max(len(n), 1)
        repeat = sum(a == b for a, b in zip(words, words[1:], strict=False))
        upper, lower = sum(65 <= c <= 90 for c in n), sum(97 <= c <= 122 for c in n)
        return [
            repeat / max(len(words), 1), min(repeat, 3) / 3, lower / chars, upper / chars, sum(48 <= c <= 57 for c in n) / chars, len(words), n.count(b"|") / chars,
            sum(c >= 128 for c in n) / chars, n.count(b"!") / max(len(words), 1), float(not n), min(upper / max(upper + lower, 1), 1),
        ]

    width = (x.shape[1] - 1) // 3
    at = 0
    for doc in lines:
        for i, n in enumerate(doc):
            mine = x[at + i, :width]
            picked = [*mine[:5], np.expm1(3 * mine[-3]), mine[7], mine[10], mine[-4], mine[-2], mine[-1]]
            assert np.allclose(picked, own(n)), (n, picked, own(n))
            assert np.array_equal(x[at + i, width : 2 * width], x[at + i - 1, :width] if i else np.zeros(width))
            assert np.array_equal(x[at + i, 2 * width : 3 * width], x[at + i + 1, :width] if i + 1 < len(doc) else np.zeros(width))
        at += len(doc)


# ---- search


def test_wu_manber_against_find():
    rng = random.Random(1)
    for size in (3, 5, 12, 40):
        patterns = list({bytes(rng.choice(b"ab ") for _ in range(rng.randrange(3, size + 1))) for _ in range(60)})
        text = bytes(rng.choice(b"ab ") for _ in range(3000))
        want = sorted((i, p) for p, x in enumerate(patterns) for i in range(len(text)) if text.startswith(x, i))
        assert decontaminate.WuManber(patterns).find(text) == want


def test_decontamination(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa LAMBDA mu"
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, ""), (None, item), (5, item), (1, item)], "item_id long, text string")
    texts = [None, "", "...", f"x {item.upper()} y", "a short-one here and a short ONE", " ".join(item.split()[:9]), "alpha beta gamma delta epsilon zeta eta theta iota kappa", "shortone", "é" + item]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    got = {r.doc_id: (r.d_n, [tuple(s) for s in r.d_spans], r.d_items) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got[0] == got[1] == got[2] == (0, [], [])
    assert got[3] == (14, [(1, 13)], ["1", "5"]) and got[4] == (8, [(1, 3), (6, 8)], ["2"])
    assert got[5][1:] == ([], []) and got[6] == (10, [(0, 10)], ["1", "5"]) and got[7] == (1, [], []) and got[8] == (12, [(1, 12)], ["1", "5"])


def test_pattern_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"word{i} again{i} more{i}") for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(0, "Word3 again3 more3 word11 again11 more11 word1", "x"), (1, None, "x"), (0, "so word5 again5 more5", "x")], "doc_id long, text string, d_n string")
    found = []
    for size in (200, 64 << 20):
        monkeypatch.setattr(decontaminate, "PATTERN_BYTES", size)
        out = decontaminate.find_leaks(docs, bench, keep=("doc_id", "d_n"))
        assert out.columns == ["doc_id", "d_n", "d_spans", "d_items"]
        found.append(sorted((r.doc_id, r.d_n, [tuple(s) for s in r.d_spans], r.d_items) for r in out.collect()))
    assert found[0] == found[1] == [(0, 4, [(1, 4)], ["5"]), (0, 7, [(0, 6)], ["11", "3"]), (1, 0, [], [])]


@pytest.mark.parametrize("small", [False, True])
def test_topk(spark, small, monkeypatch):
    if small:  # several shards and blocks of queries
        for name, value in (("SHARD", 64), ("QUERIES", 8), ("PRIME", 16), ("BLOCK", 16)):
            monkeypatch.setattr(topk, name, value)
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.25, 0.7, rng.random())) for _ in range(9)]) for i in range(600)] + [(i, [0.3] * 9) for i in range(600, 700)]
    rows += [rows[40], rows[41]]  # repeated rows: a candidate each, a query once
    odd = [(700, None), (720, [1.0, None]), (740, [float("nan")] * 9), (760, [float("inf")] * 9), (None, [1.0] * 9)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in topk.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = {i: [math.floor(64 * float(np.float32(x))) for x in e] for i, e in rows}
    for q in range(0, 700, 20):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i, _ in rows if i != q)[:20]
        assert got[q] == [(i, -s) for s, i in best]
    assert set(got) == set(range(0, 700, 20))


def test_bars_leave_out_only_rows_below_them():
    rng = np.random.default_rng(5)
    rows, queries = rng.integers(-60, 60, (500, 8)), rng.integers(-60, 60, (6, 8))
    ids, names = np.arange(500), np.array([-1] * 6)
    plain = topk.maxscore(ids, rows, names, queries, 10)
    exact = np.sort(queries @ rows.T, axis=1)[:, ::-1]
    bars = np.array([exact[0, 9], exact[1, 4], exact[2, 30], topk.NO_BAR, exact[4, 0] + 1, -(10**6)])
    for i, ((s, n), (b, m)) in enumerate(zip(plain, topk.maxscore(ids, rows, names, queries, 10, bars), strict=True)):
        keep = s >= bars[i]
        assert b.tolist() == s[keep].tolist() and m.tolist() == n[keep].tolist()


@pytest.mark.parametrize("size", [2.0**10, 2.0**20, 2.0**24, 2.0**40])
def test_topk_scores_are_exact(spark, size):
    """In doubles, longs or beyond: whole numbers of any size."""
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-size, size))) for _ in range(5)]) for i in range(80)]
    got = collections.defaultdict(list)
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows}
    for q in range(0, 80, 20):
        score = {i: min(max(sum(a * b for a, b in zip(v[q], v[i], strict=True)), -(2**63)), 2**63 - 1) for i in v if i != q}
        assert got[q] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:7]


# ---- repeats


def cut(plain, window=50):
    """Removed flags of every text, by looking at all windows of all smaller documents."""
    out, seen = [], collections.defaultdict(set)
    number = lambda d: math.inf if d is None else d
    for d, t in plain:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]].add(number(d))
    least = {w: min(x) for w, x in seen.items()}
    for d, t in plain:
        b, gone = (t or "").encode(), bytearray(len(t.encode()) if t else 0)
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < number(d):
                gone[i : i + window] = b"\1" * window
        out.append((d, sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def test_repeats(docs, plain):
    got = repeats.remove_repeats(docs)
    assert [c for c in docs.columns if c != "text"] == got.columns[:-2]
    found = collections.Counter((r.doc_id, sum(s["end"] - s["first"] for s in r.r_spans), bytes(r.r_kept)) for r in got.collect())
    assert found == collections.Counter(cut(plain))


def test_hot_anchor_is_dealt_by_window():
    rng = random.Random(6)
    phrase = " a frequent phrase, in ever new surroundings "
    texts = ["".join(rng.choice("abcdefgh") for _ in range(60)) + phrase + "".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(300)]
    rows = pa.table({"doc_id": list(range(300)), "text": texts})
    sent = dict(repeats._anchor_parcels(4)(0, rows))
    most = {}
    for hot in (100, 10**9):
        answers = {(1, b): repeats._shared_anchors(hot)([x])[0][0] for b, x in sent.items()}
        kinds, hits = repeats._shared_texts([t.encode() for t in texts], {k: x for k, x in answers.items() if x}, 4, 64)
        most[hot] = max(sum(len(x) > repeats.WINDOW for x in own) for own in kinds.values())
        for b, own in kinds.items():
            assert all(texts[t].encode()[at : at + len(own[k])] == own[k] for k, t, at in hits[b].tolist())
    assert most[10**9] > 250 > 150 > most[100]


def test_repeats_with_hot_anchors(docs, plain):
    found = collections.Counter((r.doc_id, sum(s["end"] - s["first"] for s in r.r_spans), bytes(r.r_kept)) for r in repeats.remove_repeats(docs, hot=1).collect())
    assert found == collections.Counter(cut(plain))


@pytest.mark.parametrize("scan", [10 << 20, 500])
def test_maximal_repeats_against_loop(scan, monkeypatch):
    monkeypatch.setattr(repeats, "SCAN", scan)
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice((8, 40)))) for _ in range(6)]
    texts.append(texts[0][3:17])
    copies = np.array([2, 1, 1, 3, 1, 1, 2])
    got = collections.Counter((n, tuple(sorted(zip(o.tolist(), a.tolist(), strict=True)))) for n, o, a in repeats.maximal_repeats(texts, 5, copies > 1))
    where = collections.defaultdict(set)
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + 5, len(x) + 1):
                where[x[i:j]].update((t, i, c) for c in range(copies[t]))
    want = collections.Counter()
    for s, at in where.items():
        left = {texts[t][i - 1] if i else ("start", t, c) for t, i, c in at}
        right = {texts[t][i + len(s)] if i + len(s) < len(texts[t]) else ("end", t, c) for t, i, c in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want[len(s), tuple(sorted({(t, i) for t, i, _ in at}))] += 1
    assert want == got


# ---- language model


@pytest.mark.parametrize(("order", "share"), [(1, lm.SHARE), (2, lm.SHARE), (3, lm.SHARE), (3, 3), (4, lm.SHARE)])
def test_katz_against_dictionaries(docs, plain, order, share):
    def words(t):
        return [w.decode() for w in (t or "").encode().lower().split()] + [" "]

    def grams(t, k):
        padded = ["<s>"] * (k - 2) + [" "] * (k > 1) + words(t)
        return [tuple(padded[i : i + k]) for i in range(len(padded) - k + 1)]

    held = [lm.held_out(d) for d, _ in plain]
    count = [collections.Counter(g for (_, t), h in zip(plain, held, strict=True) if not h for g in grams(t, k)) for k in range(1, order + 1)]
    c, n, v = count[0], sum(count[0].values()), len(count[0])
    d = [lm.Discounts.good_turing([sum(x == r for x in k.values()) for r in range(1, lm.K + 2)]) for k in count]
    value = lambda k, x: float(d[k - 1](np.array(x)))
    left = 1 - sum(value(1, x) for x in c.values()) / n
    history = [collections.Counter() for _ in range(order + 1)]
    used, followed = [collections.Counter() for _ in range(order + 1)], [collections.Counter() for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, x in count[k - 1].items():
            history[k][g[:-1]] += x

    def prob(g):
        k = len(g)
        if k == 1:
            return value(1, c[g]) / n if c[g] else left
        h = g[:-1]
        if count[k - 1][g]:
            return value(k, count[k - 1][g]) / history[k][h]
        return prob(g[1:]) * ((1 - used[k][h]) / (1 - followed[k][h]) if history[k][h] else 1)

    for k in range(2, order + 1):
        for g, x in count[k - 1].items():
            used[k][g[:-1]] += value(k, x) / history[k][g[:-1]]
            followed[k][g[:-1]] += prob(g[1:])
    for h in list(history[order])[:4] + [("<s>",) * (order - 2) + (" ",) * (order > 1)]:
        assert abs(sum(prob((*h, *w)) for w in [*c, ("never seen",)]) - 1) < 1e-9
    got = collections.Counter()
    rows = lm.katz_scores(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)), order, share).collect()
    for r in rows:
        got[(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))] += 1
    want = collections.Counter()
    for (i, t), h in zip(plain, held, strict=True):
        w = words(t)
        base, score = sum(math.log10((c[x,] + 1) / (n + v + 1)) for x in w), sum(math.log10(prob(g)) for g in grams(t, order))
        want[(i, h, len(w), sum(c[x,] > 0 for x in w), n, round(base, 6), round(score, 6))] += 1
    assert got == want


def test_hot_history_is_dealt_over_buckets(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for i in range(60):
        rows.append((i, " ".join(w for _ in range(40) for w in ("hot", f"{rng.choice(WORDS)}{rng.randrange(9)}"))))
    met = lm._bucket(np.full(3000, 7), np.arange(3000), np.full(3000, 6), 8)
    share = np.bincount(met, minlength=8)
    assert (share > 0).sum() == 6 and share.max() < 2 * 3000 / 6
    # the same scores, whether or not histories are dealt, in many small units
    monkeypatch.setattr(lm, "UNIT_TEXT", (2000, 2000))
    docs = spark.createDataFrame(rows + [(70, "hot unseen hot hot"), (71, None)], "doc_id long, text string")
    held = F.col("doc_id") % 7 == 0
    got, want = (sorted((r.doc_id, r.n_known, round(r.score, 8)) for r in lm.katz_scores(docs, held, share=share).collect()) for share in (5, 10**9))
    assert got == want


# ---- urls


def test_url_rules(spark):
    urls = {
        None: ("", "", None), "no scheme.com/": ("", "", None), "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/"), "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "http://m.www.example.com/en/1": ("m.www.example.com", "/en/1", "www.example.com/en/"), "https://com/": ("com", "/", "com/"), "https://x.com": ("x.com", "", None), "https://x.com?q=/": ("x.com", "", None),
        "https://a.net/fr/": ("a.net", "/fr/", "net/fr/"), "https://anet/fr/": ("anet", "/fr/", None), "https://notexample.com/en/": ("notexample.com", "/en/", "com/"), "http://É.com/a": ("É.com", "/a", "com/"), "://": ("", "", None),
    }
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    verdicts = {r.name: r.verdict for r in url_filter.RULES}
    for i, (host, path, rule) in enumerate(urls.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdicts[rule] if rule else got[i].verdict in ("allow", "block")
    few = url_filter.judge(pages.where("url is null")).collect()
    assert [r.verdict for r in few] == ["allow", "allow"] and url_filter.judge(pages.limit(0)).count() == 0


def test_url_features_against_loop(spark):
    urls = ["http://Www.shop-a.example.com/a/b-c//d?x=1&y=22#top", "https://x.net", "no scheme at all", "", None, "http://h.org/?&&q"]
    base = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, u_url string")
    host, path = url_filter.host_and_path(F.col("u_url"))
    got = {r.page_id: r for r in url_filter.lexical(base.select("*", host.alias("u_host"), path.alias("u_path"))).collect()}
    for i, u in enumerate(urls):
        u, r = u or "", got[i]
        share = [u.count(c) / len(u) for c in set(u)]
        query = u.split("#")[0].partition("?")[2]
        assert (r.u_length, r.u_host_length, r.u_hyphens) == (len(u), len(r.u_host), u.count("-"))
        assert r.u_depth == len([p for p in r.u_path.split("/") if p]) and r.u_parameters == len([p for p in query.split("&") if p])
        assert math.isclose(r.u_digit_ratio, sum(c.isdigit() for c in u) / max(len(u), 1)) and math.isclose(r.u_entropy, -sum(p * math.log2(p) for p in share), abs_tol=1e-9)
        assert r.u_labels == len(r.u_host.split(".")) and r.u_suffix == r.u_host.split(".")[-1] and r.u_domain == ".".join(r.u_host.split(".")[-2:] if "." in r.u_host else [""])


def test_url_rates_leave_out_their_own_row(spark):
    rows = spark.createDataFrame([("net", 1.0), ("net", 1.0), ("com", 0.0), ("org", 1.0)], "u_suffix string, u_label double")
    tables = {"u_suffix": url_filter.tallies(rows, "u_suffix")}
    rates = lambda learning: sorted((r.u_suffix, round(r.u_suffix_rate, 6)) for r in url_filter.with_rates(rows, tables, learning).collect())
    assert rates(True) == [("com", 0.5), ("net", round(3.5 / 6, 6)), ("net", round(3.5 / 6, 6)), ("org", 0.5)]
    assert rates(False) == [("com", round(2.5 / 6, 6)), ("net", round(4.5 / 7, 6)), ("net", round(4.5 / 7, 6)), ("org", round(3.5 / 6, 6))]


def test_url_verdicts_of_urls_without_a_rule(spark):
    """Learned from urls that a rule decides: under net all that is labelled is blocked, with long queries; under com
    nothing is."""
    rng = random.Random(5)
    path = lambda n: "/".join(rng.choice(WORDS) for _ in range(n))
    urls = [f"http://s{i}.{rng.choice(WORDS)}.net/{rng.choice(('es', 'fr'))}/{path(6)}?id={rng.randrange(10**9)}&u={rng.randrange(10**9)}" for i in range(150)]
    urls += [f"http://www.{rng.choice(WORDS)}.com/{path(1)}" for i in range(150)]
    bad = [f"http://t{i}.{rng.choice(WORDS)}.net/de/{path(6)}?id={rng.randrange(10**9)}&u={rng.randrange(10**9)}" for i in range(50)]
    good = [f"http://www.{rng.choice(WORDS)}.org/{path(1)}" for i in range(50)]
    pages = spark.createDataFrame(list(enumerate(urls + bad + good)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert all(got[i].rule is None for i in range(300, 400))
    assert [got[i].verdict for i in range(300, 350)].count("block") >= 48 and [got[i].verdict for i in range(350, 400)].count("allow") >= 48


# ---- empty tables, pipeline


def test_empty_tables(spark, nothing):
    two = nothing.select("doc_id", "text")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert neardup.near_duplicates(two).count() == 0 and packing.pack_documents(two).count() == 0 and decontaminate.find_leaks(two, bench).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert repeats.remove_repeats(nothing).count() == 0 and lm.katz_scores(two, F.lit(False)).count() == 0
    assert language.predict(two, language.fit(nothing.select("doc_id", "text", "lang"))).count() == 0


def test_empty_token_files(spark, nothing, tmp_path):
    token_files.write_tokens(nothing, f"file://{tmp_path}/t")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/t").count() == 0


def test_pipeline(spark, docs, plain, tmp_path):
    import corpus_pipeline as P

    folder = f"file://{tmp_path}"
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    leak = " ".join(plain[0][1].split()[:12]) if plain[0][1] else ""
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    at = spark.read.parquet(folder + "/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        before = at
        at = P.materialize(stage(spark, at, folder))
        assert at.columns == docs.columns, name
        assert at.count() <= before.count()
    rows = P.STAGES[-1][1](spark, at, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()


def shingle_sets(texts, width=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def test_pipeline_stages_against_brute_force(spark, docs, tmp_path):
    """Each stage's rows, from a table with nulls, repeated rows and ids, and columns that clash with the operators'."""
    import corpus_pipeline as P

    clash = docs.select("*", F.lit(1).alias("d_n"), F.lit("x").alias("predicted"), F.lit(2.0).alias("d_spans"), F.lit(0).alias("r_kept"))
    folder = f"file://{tmp_path}"
    clash.write.parquet(folder + "/documents.parquet")
    table = spark.read.parquet(folder + "/documents.parquet")
    rows = table.collect()
    item = " ".join(rows[0].text.split()[3:15])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    number = lambda r: math.inf if r.doc_id is None else r.doc_id
    bag = lambda found: collections.Counter(map(str, found))

    judged = quality.score(table.select("doc_id", "text"), quality.learned(table, spark.read.parquet(folder + "/labels.parquet"))).where("predicted = 1")
    good = P.good_quality(spark, table, folder)
    assert good.columns == table.columns and collections.Counter(r.doc_id for r in good.collect()) == collections.Counter(r.doc_id for r in judged.collect())

    sets, group = shingle_sets([r.text for r in rows]), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    best = {g: min(number(rows[i]) for i in range(len(rows)) if group[i] == g) for g in set(group)}
    kept = P.without_near_duplicates(spark, table, folder).collect()
    assert sorted(map(number, kept)) == sorted(best.values()) and not bag(kept) - bag(rows)

    texts = collections.Counter((d, x.decode("utf-8", "replace")) for d, _, x in cut([(r.doc_id, r.text) for r in rows]))
    less = P.without_repeats(spark, table, folder)
    assert less.columns == table.columns and collections.Counter((r.doc_id, r.text) for r in less.collect()) == texts

    clean = P.without_leaks(spark, table, folder).collect()
    words = lambda t: " " + " ".join(w.decode() for w in decontaminate.words_of((t or "").encode())) + " "
    windows = [" " + " ".join(item.split()[i : i + 10]) + " " for i in range(3)]
    want = [r for r in rows if not any(w in words(r.text) for w in windows)]
    assert bag(clean) == bag(want) and 0 < len(want) < len(rows)


def test_near_duplicate_stage_when_the_cluster_changes(spark, docs, tmp_path, monkeypatch):
    """Executors come or go between the jobs: the scan's splits change, the rows kept don't."""
    import corpus_pipeline as P

    rows = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    rows.repartition(6).write.parquet(str(tmp_path / "d"))
    stage = lambda: sorted(map(repr, P.without_near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()))
    want, find = stage(), neardup.near_duplicates

    def changed(*a, **k):
        out = find(*a, **k)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return out

    monkeypatch.setattr(neardup, "near_duplicates", changed)
    try:
        assert stage() == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_near_duplicates_in_small_blocks(spark, docs, monkeypatch):
    """Broadcast bands, leaders in several tasks and blocks of two rows change nothing."""
    want = sorted(map(repr, neardup.near_duplicates(docs, 2).collect()))
    monkeypatch.setattr(stars, "HOT", 2)
    monkeypatch.setattr(stars, "BLOCK", 2)
    assert sorted(map(repr, neardup.near_duplicates(docs, 2).collect())) == want


def test_quality_sample_does_not_depend_on_files(spark, monkeypatch):
    """Repeated doc_ids and two labels of one: the same training texts whatever the layout."""
    rows = [(i % 7, f"text {i} " * (i % 5 + 1)) for i in range(200)]
    labels = [(i, i % 2, 0) for i in range(7)] + [(3, 0, 1), (3, 1, 0)]
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, y: seen.append((texts, y)))
    for parts in (1, 5):
        docs = spark.createDataFrame(rows if parts == 1 else rows[::-1], "doc_id long, text string").repartition(parts)
        quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(parts), 4)
    assert seen[0] == seen[1] and len(seen[0][0]) == 8


def test_many_hits_in_one_text(spark):
    """Word numbers are found for all hits at once."""
    import time

    text = " ".join(["aa bb cc dd ee ff gg hh ii jj"] * 30_000)
    search = decontaminate.WuManber([b" aa bb cc dd ee ff gg hh ii jj "])
    began = time.time()
    assert len(search.find(b" " + text.encode() + b" ")) == 30_000
    docs = spark.createDataFrame([(1, text), (2, "x aa bb cc dd ee ff gg hh ii jj y")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "aa bb cc dd ee ff gg hh ii jj")], "item_id long, text string")
    got = {r.doc_id: [(x["first"], x["end"]) for x in r.d_spans] for r in decontaminate.find_leaks(docs, items).collect()}
    assert got[2] == [(1, 11)] and got[1][0][0] == 0 and got[1][-1][1] == 300_000 and time.time() - began < 60


def test_shift_table_grows_with_patterns():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)).encode()
    mean = []
    for n in (200, 20_000):
        search = decontaminate.WuManber([b" " + b" ".join(word() for _ in range(10)) + b" " for _ in range(n)])
        mean.append(max(float(c.shift.mean()) / (c.m - c.block + 1) for c in search.classes))
    assert mean[1] > 0.85 and mean[0] > 0.85


def test_pipeline_of_empty_tables(spark, nothing, tmp_path):
    import corpus_pipeline as P

    folder = f"file://{tmp_path}"
    nothing.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    assert P.run(spark, folder).count() == 0
