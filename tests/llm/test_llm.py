"""The operators of the training-data pipeline: against brute force, an exact round trip or
held-out accuracy; and on nulls, empty and long texts, repeats, empty tables and columns
with clashing names."""

import collections
import fractions
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideq.llm import bpe, jaccard_join, language_id, lm_score, packing, quality_mil, quality_rules, substring_dedup, text_arrays, topk, toxicity
from strideq.llm.common import fold
from strideq.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double, ids string, text_ string, sig string, kept string, `a b` string, `c.d` int"
WORDS = "that onesen erblest hein inenan eranenes whou therouou thon heoron eratsh therin blees esheon erstlyat eronthwh reer anat tisher therble eresan thesened heention".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) + r.choice(["", "", "", ".", ","]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def edges(spark):
    long_ = prose(5, 30_000)
    texts = [None, "", "   ", "one", long_, prose(1, 300), prose(1, 300), prose(1, 300) + " more", "Ünïcode Σς 中文 <|endoftext|> x", prose(2, 80)]
    rows = [(i, t, "en" if i % 2 else None, None if i == 5 else "s", None, "r", 1.0, "i", "t", "s", "k", "ab", 4) for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(1, 300), "en", "s", 1, "r", 1.0, "i", "t", "s", "k", "ab", 4), (None,) * 13]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").sort_index()


def in_duckdb(sql):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c.sql(sql).df()


def same(a, b):
    a, b = ([d[sorted(d)].sort_values(sorted(d)).reset_index(drop=True)] for d in (a, b))
    pd.testing.assert_frame_equal(a[0], b[0], check_dtype=False)


# 1 ---------------------------------------------------------------------------
def test_rules(spark, edges, nothing):
    same(quality_rules.op1_quality_rules(spark, SF).toPandas(), in_duckdb(quality_rules.OP1_SQL))
    got = quality_rules.cascade(edges)
    assert got.count() == edges.count() and quality_rules.cascade(nothing).count() == 0
    r = {x["doc_id"]: x for x in got.collect()}
    assert r[0]["base_failed"] and not r[0]["kept"] and r[0]["n_words"] == 0 and r[9]["kept"]
    order = quality_rules.order_rules(quality_rules.base_counts(edges))
    assert sorted(x.name for x in order) == sorted(x.name for x in quality_rules.RULES)


# 2, 8 ------------------------------------------------------------------------
def area(pos, neg):
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


@pytest.mark.parametrize("op,label,n,held,sf,least", [(toxicity.op2_toxicity, "toxic", 3, 1, "sf0.1", 0.95), (quality_mil.op8_quality_mil, "quality", 5, 0, "sf0.01", 0.9)])
def test_classifiers(spark, op, label, n, held, sf, least):
    sf = f"/root/testdata/{sf}"
    out, docs = op(spark, sf).toPandas(), pd.read_parquet(f"{sf}/documents.parquet")
    assert sorted(out.doc_id) == sorted(docs.doc_id) and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % n == held for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= (0.7 if label == "toxic" else 0.3))).all()
    own = pd.read_parquet(f"{sf}/labels.parquet").merge(out[out.held_out], on="doc_id").merge(docs[["doc_id", "lang"]], on="doc_id")
    bad = own[label] == 1
    assert area(own[bad].score.to_numpy(), own[~bad].score.to_numpy()) > least
    if label == "toxic":
        for _, part in own.groupby("lang"):  # thresholds hold in every language
            assert part[part.toxic == 1].predicted.mean() >= 0.5 and part[part.toxic == 0].predicted.mean() <= 0.02


def test_toxicity_of_long_texts_and_neighbours(monkeypatch):
    r = random.Random(2)
    net = toxicity.Cnn()
    texts = [prose(k, 40).encode() for k in range(5)] + [prose(9, 900).encode(), b"", None]
    alone = np.concatenate([net.logits([t])[0] for t in texts])
    assert np.allclose(net.logits(texts)[0], alone, atol=1e-5)
    r.shuffle(texts)
    monkeypatch.setattr(text_arrays, "PART", 500)
    monkeypatch.setattr(toxicity, "PART", 500)
    whole = {t: v for t, v in zip(texts, net.logits(texts)[0], strict=True)}
    monkeypatch.undo()
    assert np.allclose([whole[t] for t in texts], net.logits(texts)[0], atol=1e-5)


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Counts, network and thresholds are of all labelled rows, however many."""
    docs = spark.range(4700).selectExpr("id as doc_id", "concat('word', id % 7, if(id % 3 = 0, ' bad', ' good'), ' w', id) as text")
    labels = spark.range(4700).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    fitted, judged = [], []
    monkeypatch.setattr(toxicity.Cnn, "fit", lambda net, d, y, *a, own=toxicity.Cnn.fit: fitted.append(len(d)) or own(net, d, y, *a))
    monkeypatch.setattr(toxicity.Cnn, "calibrate", lambda net, z, g, y, *a, own=toxicity.Cnn.calibrate: judged.append((len(y), y.sum())) or own(net, z, g, y, *a))
    out = toxicity.score(docs, labels, F.lit(True), epochs=1).toPandas().sort_values("doc_id")
    assert max(fitted) == 4700 and judged == [(4700, 1567)]
    assert ((out.score >= 0.7).to_numpy() == (out.doc_id % 3 == 0).to_numpy()).mean() > 0.99


def test_toxicity_trains_in_tasks(spark, monkeypatch):
    """Beyond two shards the driver trains nothing; counts are of all rows, each fold is judged
    by a network that hasn't seen it, and how rows came makes no difference."""
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 500 = 1, if(id % 1000 = 1, '', null), concat('word', id % 7, if(id % 3 = 0, ' bad', ' good'), ' w', id)) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 600, raising=False)
    monkeypatch.setattr(toxicity.Cnn, "fit", lambda *a: pytest.fail("the driver trains alone"))
    begun, judged, scores = [], [], []
    monkeypatch.setattr(toxicity.Cnn, "begin", lambda net, seen, n, rate, own=toxicity.Cnn.begin: begun.append((n.tolist(), seen[0][:-1].sum())) or own(net, seen, n, rate))
    monkeypatch.setattr(toxicity.Cnn, "calibrate", lambda net, z, g, y, *a, own=toxicity.Cnn.calibrate: judged.append((z, y)) or own(net, z, g, y, *a))
    for df in (docs, docs.repartition(3)):
        scores.append(toxicity.score(df, labels, F.lit(True), epochs=2).toPandas().set_index("doc_id").score.sort_index())
    n, words = zip(*begun[:4], strict=True)
    assert n[0] == [2000, 1000] and words[0] == 3 * 2994 and len(begun) == 8
    assert np.array_equal(np.sum(n[1:], axis=0), [4000, 2000]) and sum(words[1:]) == 2 * words[0]
    assert all(len(z) == 3000 and y.sum() == 1000 and area(z[y == 1], z[y == 0]) > 0.99 for z, y in judged)
    assert np.allclose(*scores, atol=1e-6) and ((scores[0] >= 0.7) == (scores[0].index % 3 == 0)).mean() > 0.99


def test_toxicity_finds_the_first_place_of_each_maximum():
    """Gradients go to the first place of a region's maximum, whatever is beside the region."""
    net, r = toxicity.Cnn(), np.random.default_rng(5)
    texts = [r.integers(0, 9, (toxicity.TABLES, n)).astype(np.int32) for n in (1, 5, 40, 8, 2, 300)]
    _, first, sizes, x = net.inputs(texts)
    z, place = net.pooled(x, first, sizes, train=True)
    z = z.reshape(len(texts), toxicity.KEPT, len(toxicity.WIDTHS), toxicity.FILTERS)
    for w, a in enumerate(net.convolved(x)):
        for i, (lo, n) in enumerate(zip(first, sizes, strict=True)):
            for f in range(toxicity.FILTERS):
                edges = lo + n * np.arange(toxicity.REGIONS + 1) // toxicity.REGIONS
                tops = [b + int(a[f, b:e].argmax()) for b, e in zip(edges[:-1], edges[1:], strict=True) if e > b]
                tops = sorted((t for t in tops if a[f, t] > 0), key=lambda t: -a[f, t])[: toxicity.KEPT]
                on = z[i, :, w, f] > 0
                assert place[w][i, on, f].tolist() == tops and np.allclose(z[i, on, w, f], a[f, tops])


def test_classifiers_on_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(None, 1, None), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    for df in (edges, nothing):
        got = toxicity.score(df, labels, F.lit(True)).collect()
        assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
        got = quality_mil.score(df, labels, F.lit(True)).collect()
        assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.score(edges, labels.limit(0), F.lit(True)).collect()} == {0.0}
    assert {r["score"] for r in quality_mil.score(edges, labels.limit(0), F.lit(True)).collect()} == {1.0}


# 3 ---------------------------------------------------------------------------
def test_lm_base_and_lattice(spark, docs):
    got = lm_score.op3_lm_score(spark, SF).toPandas().set_index("doc_id").sort_index()
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + ["<end>"] for i, t in docs.text.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    assert set(got.train_tokens) == {n}
    for i, t in tokens.items():
        assert got.n_tokens[i] == len(t) and got.n_known[i] == sum(c[w] > 0 for w in t) and got.held_out[i] == held[i]
        assert math.isclose(got.base_score[i], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    assert got.score.max() < 0 and np.isfinite(got.score).all()
    pieces, log_p = lm_score.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    lattice, at = lm_score.Lattice(pieces, log_p), {p: i for i, p in enumerate(pieces)}

    def brute(word):
        word = b" " + word
        f = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            f[j] = sum(f[i] * math.exp(log_p[at[word[i:j]]]) for i in range(j) if word[i:j] in at)
        return math.log(f[-1])

    words = [w.encode() for w in sorted(c)[:200]] + ["Ünï中".encode()]
    assert np.allclose(lattice.log_prob(words), [brute(w) for w in words])
    # Expected uses: the difference of the log sum in a weight's logarithm.
    e = lattice.expected(words[:20])
    k = int(e.argmax())
    up = log_p.copy()
    up[k] += 1e-5
    slope = (lm_score.Lattice(pieces, up).log_prob(words[:20]).sum() - lattice.log_prob(words[:20]).sum()) / 1e-5
    assert math.isclose(slope, e[k], rel_tol=1e-3)


def test_lm_score_by_brute_force(spark):
    """The score of whole texts from its definition, in each weighting."""
    r = random.Random(6)
    words_ = ["the", "cat", "sat", "on", "mats", "Ünï", "zq9"]
    texts = [(i, " ".join(r.choice(words_) for _ in range(r.randint(0, 12)))) for i in range(40)] + [(40, None), (41, "unseenword the")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, log_p = lm_score.vocabulary(path)
    is_train = {i: i % 4 != 0 and i != 41 for i, _ in texts}
    tokens = {i: (t or "").encode().lower().split() for i, t in texts}
    c = collections.Counter(w for i, ws in tokens.items() if is_train[i] for w in ws)
    ends = sum(is_train.values())
    n = sum(c.values()) + ends
    train = (F.col("doc_id") % 4 != 0) & (F.col("doc_id") != 41)
    for rounds, whole in ((0, False), (0, True), (1, True)):
        weights = log_p if not rounds else lm_score.fit_pieces(spark.createDataFrame([(bytearray(w),) for w in c], "word binary"), pieces, log_p, rounds, 1000.0)
        lattice = lm_score.Lattice(pieces, weights)
        share = min(max(sum(v == 1 for v in c.values()), 1) / n, 0.5) if whole else 1.0
        ending = (ends + 1) / (n + 2)

        def log10_of(word):
            p = math.exp(lattice.log_prob([word])[0]) * share * (1 - ending)  # noqa: B023
            return math.log10(p + ((1 - share) * c[word] / n if whole else 0))  # noqa: B023

        end = math.log10(((1 - share) * ends / n if whole else 0) + share * ending)
        for hot in (3, 1000):
            got = {x["doc_id"]: x for x in lm_score.score(df, path, train, rounds=rounds, whole_words=whole, hot_words=hot).collect()}
            for i, ws in tokens.items():
                assert math.isclose(got[i]["score"], sum(map(log10_of, ws)) + end, rel_tol=1e-9)
                assert got[i]["n_known"] == sum(c[w] > 0 for w in ws) + 1


def test_lm_on_edges(edges, nothing):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    for train in (fold("doc_id", 7) != 2, F.lit(False)):
        for df in (edges, nothing):
            got = lm_score.score(df, vocabulary, train, hot_words=50).collect()
            assert len(got) == df.count() and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
            assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (0, 1, 2))


# 4 ---------------------------------------------------------------------------
def test_packing_is_best_fit_decreasing():
    r = random.Random(4)
    for n, most in ((1, 5), (40, 2047), (2000, 2047), (5000, 300)):
        counts = collections.Counter(r.randint(1, most) for _ in range(n))
        plan = packing.best_fit_decreasing(dict(counts), 2048)
        left = []
        for size in sorted(counts.elements(), reverse=True):
            fits = [x for x in left if x >= size]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - size)
            else:
                left.append(2048 - size)
        fill = collections.Counter()
        for size, _, k, each, first, at in plan:
            for x in range(k):
                assert fill[first + x // each] == at + x % each * size
                fill[first + x // each] += size
        assert sorted(2048 - v for v in fill.values()) == sorted(left)


def test_packing(spark, docs, edges, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    small = [(r["doc_id"], r["text"]) for r in edges.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    cases = [(packing.op4_packing(spark, SF).toPandas(), list(docs.text.items())), (packing.packed(edges.filter("doc_id is not null").dropDuplicates(["doc_id"])).toPandas(), small)]
    for got, texts in cases:
        for i, text in texts:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            own = got[got.doc_id == i].sort_values("start")
            assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
            for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True):
                assert zlib.crc32(ids[s : s + n].tobytes()) == c
        at = got.sort_values(["sequence_id", "offset"])
        assert (at.groupby("sequence_id").length.cumsum() - at.length == at.offset).all()
        assert at.groupby("sequence_id").length.sum().max() <= 2048
        assert sorted(set(got.sequence_id)) == list(range(got.sequence_id.nunique()))
    assert packing.packed(nothing).count() == 0
    assert packing.packed(edges).select("doc_id").filter("doc_id is null").count() == 2


def test_packing_encodes_a_text_at_once(monkeypatch):
    """One call per text however many words are new, and pieces of a long text give its ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder, asked = packing.encoder(path, "<|endoftext|>", 50256), []
    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(20)]
    monkeypatch.setattr(coder, "_plain", lambda t, own=coder._plain: asked.append(t) or own(t))
    assert all(len(coder.encode(t)) > 1200 for t in texts) and asked == texts
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(8)
    odd = ["don't", "a", "Ünï", "\n\n", "  ", "it's", "9", "...", "\u3000", "z\u0301", "\U0001f600", "<|endoftext|>", "the", "cat"]
    monkeypatch.setattr(packing, "_LONG", 40)
    for _ in range(200):
        text = r.choice([" ", ""]).join(r.choice(odd) + r.choice([" ", "", " of", " the cat"]) for _ in range(60))
        assert coder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    packing.encoder.cache_clear()


# 5 ---------------------------------------------------------------------------
def test_bpe_round_trip(spark, docs, edges, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def want(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        shown = tokenizer.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()

    got = bpe.op5_bpe(spark, SF).toPandas().set_index("doc_id")
    for i, text in docs.text.items():
        assert tuple(got.loc[i, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == want(text)
    own = bpe.PrefixBpe(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    alphabet = "abcdeéßÀİΣςσ \t\n\x0b\x1c\x85　'stvemld0123½²٣·.,!?-_—…中文字あ漢👍🏽́̀ȩǄﬁ<|>₞"
    fuzz = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["a<|endoftext|>b", "<|startoftext|>", "it's we'll"]
    for text in [*fuzz, *[x["text"] or "" for x in edges.collect()]]:
        ids = own.encode(text)
        e = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == e, text
        assert own.decode(ids) == tokenizer.decode(e, skip_special_tokens=False)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.encode(edges, vocabulary).count() == edges.count() and bpe.encode(nothing, vocabulary).count() == 0


# 6 ---------------------------------------------------------------------------
def best_of(rows, query, q, k=10):
    """The k best by exact whole numbers."""
    whole = lambda x: [math.floor(1024 * fractions.Fraction(c)) for c in x]
    own = whole(query)
    cut = lambda n: max(-(2**63) + 1, min(2**63 - 1, n))
    scored = sorted((-cut(sum(a * b for a, b in zip(own, whole(x), strict=True))), i) for i, x in rows if i is not None and i != q and x and len(x) == len(query) and all(math.isfinite(c) for c in x))
    return [(-s, i) for s, i in scored[:k]]


def test_top_k(spark):
    same(topk.op6_topk(spark, SF).toPandas(), in_duckdb(topk.OP6_SQL))
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.normal(size=6)]) for i in range(120)] + [(7, None), (8, []), (9, [1.0, float("nan")]), (None, [1.0] * 6), (200, [1.0, 2.0])]
    rows += [(300 + i, [0.5] * 6) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(0)).withColumn("a b", F.lit(1))
    for bytes_ in (1, 1 << 20):
        got = topk.top_k(df, query_bytes=bytes_, sample=40).toPandas()
        for q in (0, 100, 300):
            own = got[got.query_id == q].sort_values("rank")
            assert list(zip(own.score, own.vec_id, strict=True)) == best_of(rows, dict(rows)[q], q)
        assert (got.query_id == 200).sum() == 0
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_huge_components_and_repeated_ids(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=3) * 10.0 ** r.choice([0, 7, 12, 17, 300])]) for i in range(150)]
    rows += [(200, [1.0, 2.0, 3.0]), (200, [-1.0, 0.5, 1e17]), (200, [1.0, 2.0, 3.0]), (201, [1e308, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, sample=20).toPandas()
    for q in (0, 100):
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.score, own.vec_id, strict=True)) == best_of(rows, dict(rows)[q], q)
    # Two different query rows with one id: two rankings.
    own = got[got.query_id == 200]
    assert sorted(own["rank"]) == sorted([*range(1, 11)] * 2)
    both = best_of(rows, [1.0, 2.0, 3.0], 200) + best_of(rows, [-1.0, 0.5, 1e17], 200)
    assert sorted(zip(own.score, own.vec_id, strict=True)) == sorted(both)


def test_top_k_prunes(spark):
    r = np.random.default_rng(3)
    middles = r.normal(size=(40, 64))
    x = middles[r.integers(0, 40, 6000)] + 0.1 * r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, at = np.arange(6000), np.arange(0, 6000, 100)
    turn, seen = topk._turn(topk.whole(x[:500], 1024)), collections.Counter()
    blocks = lambda: ((ids[lo : lo + 1000], x[lo : lo + 1000]) for lo in range(0, 6000, 1000))
    floor = topk.search(at, topk.Side(x[at], 1024, turn), iter([(ids[:500], x[:500])]), 10, turn, np.full(60, -(2**63)))[0][:, -1]
    scores, kept = topk.search(at, topk.Side(x[at], 1024, turn), blocks(), 10, turn, floor, seen)
    v = np.floor(1024 * x)
    for i, q in enumerate(at):
        want = sorted((-int(s), int(j)) for j, s in enumerate(v @ v[q]) if j != q)[:10]
        assert [(-int(s), int(j)) for s, j in zip(scores[i], kept[i], strict=True)] == want
    assert seen["scored"] < 0.1 * seen["pairs"]


def test_bounds_hold():
    r = np.random.default_rng(2)
    a, b = np.floor(1024 * r.normal(size=(50, 64))), np.floor(1024 * r.normal(size=(60, 64)))
    for dim in (1, 3, 5, 13, 40, 64):
        for edges in topk.resolutions(dim):
            assert edges[0] == 0 and edges[-1] == dim and (np.diff(edges) > 0).all()
            assert (topk.summary(a[:, :dim], edges) @ topk.summary(b[:, :dim], edges).T >= a[:, :dim] @ b[:, :dim].T - 1e-3).all()


# 7 ---------------------------------------------------------------------------
def brute_classes(texts, t=0.8):
    sets = {}
    for i, text in texts:
        w = (text or "").split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s if s else i, i)
    own = {i: first[s if s else i] for i, s in sets.items()}
    names = sorted(set(own.values()))
    root, links = {i: i for i in names}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, a in enumerate(names):
        for b in names[p + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= t * (len(sets[a]) + len(sets[b]) - both) - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(c), links[c]) for i, c in own.items()}


def test_jaccard_join(spark, docs, edges, nothing):
    r = random.Random(9)
    passage = prose(77, 60)
    texts = list(docs.text.items())
    for g in range(6):  # near copies, and texts that share a passage
        base = prose(100 + g, 120).split()
        for k in range(8):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = "changed" + str(r.random())
            texts.append((10_000 + 10 * g + k, " ".join(own)))
    texts += [(20_000 + k, passage + " " + prose(500 + k, 30)) for k in range(25)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = brute_classes(texts)
    for small, depth in ((512, 4), (4, 3)):
        got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard_join.join(df, small=small, depth=depth, recall=0.9999).collect()}
        assert got == want
    got = jaccard_join.join(edges).collect()
    assert len(got) == edges.count() and jaccard_join.join(nothing).count() == 0
    by = {x["doc_id"]: x for x in got}
    assert by[6]["class_id"] == by[5]["class_id"] == by[7]["class_id"] == 5 and by[5]["n_links"] == 1 and by[5]["n_copies"] == 4
    assert by[0]["class_id"] == 0 and by[1]["class_id"] == 1 and by[0]["n_links"] == 0


def test_many_near_copies_at_the_default_recall(spark):
    """5,000 near copies in one group, and pairs elsewhere, at the default settings."""
    r = random.Random(12)
    base, texts = prose(300, 130).split(), []
    for i in range(5000):
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = f"x{i}y{r.random()}"
        texts.append((i, " ".join(own)))
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in texts)]
    count = collections.Counter(x for own in shingles for x in own)
    place = {x: k for k, x in enumerate(x for x, n in count.items() if n > 1)}
    m = np.zeros((5000, len(place)), np.float32)
    for i, own in enumerate(shingles):
        m[i, [place[x] for x in own if x in place]] = 1
    size = np.array([len(own) for own in shingles])
    first = {}
    names = np.array([first.setdefault(frozenset(own), i) for i, own in enumerate(shingles)])
    one = np.unique(names)
    both = (m[one] @ m[one].T).astype(int)
    linked = 5 * both >= 4 * (size[one][:, None] + size[one][None, :] - both)
    np.fill_diagonal(linked, False)
    links = linked.sum(axis=1)
    want = dict(zip(one.tolist(), links.tolist(), strict=True))
    pairs = []
    for k in range(300):
        own = prose(1000 + k, 60).split()
        other = list(own)
        other[30] = f"z{k}"
        pairs += [(10_000 + 2 * k, " ".join(own)), (10_001 + 2 * k, " ".join(other))]
    got = {x["doc_id"]: x for x in jaccard_join.join(spark.createDataFrame(texts + pairs, "doc_id bigint, text string")).collect()}
    assert len(got) == 5600
    assert all(got[i]["n_links"] <= want[int(names[i])] for i in range(5000))
    assert sum(got[int(i)]["n_links"] for i in one) >= 0.99 * links.sum()
    assert sum(got[i]["class_id"] == 0 for i in range(5000)) >= 0.99 * sum(want[int(names[i])] > 0 for i in range(5000))
    found = sum(got[10_000 + 2 * k]["class_id"] == got[10_001 + 2 * k]["class_id"] for k in range(300))
    assert found >= 0.95 * 300


def test_components_settle_or_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a bigint, b bigint")
    assert {(x["node"] < 1000, x["root"]) for x in components(chain).collect()} == {(True, 0), (False, 1000)}
    with pytest.raises(RuntimeError, match="settle"):
        components(chain, rounds=1)


# 9 ---------------------------------------------------------------------------
def own_sentences(text):
    """Another reading of what a sentence is: (start, end, words), by one character after
    another."""
    cuts, i = [0], 0
    while i < len(text):
        white = i
        while white < len(text) and text[white].isspace():
            white += 1
        if white > i and "\n" in text[i:white]:
            after_end = i > 0 and text[i - 1] in ".!?"
            cuts.append(white if not after_end else white)
        elif white > i and i > 0 and text[i - 1] in ".!?":
            cuts.append(white)
        i = max(white, i + 1)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        if len(text[a:b].split()) <= 24:
            pieces = [(a, b)]
        else:
            pieces, lo, k = [], a, a
            while k < b:
                white = k
                while white < b and text[white].isspace():
                    white += 1
                if white > k and k > a and text[k - 1] in ",;:" and len(text[lo:white].split()) >= 12:
                    pieces.append((lo, white))
                    lo = white
                k = max(white, k + 1)
            pieces.append((lo, b))
        out += [(x, y, tuple(text[x:y].lower().split())) for x, y in pieces if text[x:y].split()]
    return out


def brute_dedup(texts, least_sentences=2, least_words=20):
    """Every sentence covered by a run that an earlier place holds too, runs compared as
    words: {id: the sentences that go}."""
    own = {i: own_sentences(t) for i, t in texts}
    seen = collections.defaultdict(set)
    for i, parts_ in own.items():
        n = len(parts_)
        words = [len(p[2]) for p in parts_]
        for a in range(n):
            for b in range(a + least_sentences - 1, n):
                if sum(words[a : b + 1]) >= least_words:
                    seen[tuple(p[2] for p in parts_[a : b + 1])].add((i, a, b))
                    break
        for b in range(n):
            for a in range(b - least_sentences + 1, -1, -1):
                if sum(words[a : b + 1]) >= least_words:
                    seen[tuple(p[2] for p in parts_[a : b + 1])].add((i, a, b))
                    break
    gone = collections.defaultdict(set)
    for where in seen.values():
        for i, a, b in sorted(where)[1:]:
            gone[i] |= set(range(a, b + 1))
    clean = {}
    for i, t in texts:
        at, kept = 0, []
        for k, (a, b, _) in enumerate(own[i]):
            if k in gone[i]:
                kept.append(t[at:a])
                at = b
        clean[i] = "".join([*kept, t[at:]])
    return clean


def test_substring_dedup(spark, docs, edges, nothing):
    passage = prose(31, 70)
    texts = [*docs.text.items(), (5000, prose(1, 40) + "\n" + passage + "\n" + prose(2, 40)), (5001, passage + "\n" + prose(3, 40)), (5002, prose(4, 60))]
    texts += [(6000 + k, ("A b. " * 30) + prose(40, 30) + "\n\n" + prose(41 + k % 2, 25)) for k in range(6)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r["row"]["doc_id"]: r["clean_text"] for r in substring_dedup.dedup(df).collect()}
    assert got == brute_dedup(texts)
    assert got[5000] == dict(texts)[5000] and passage[10:-10] not in got[5001] and got[5001].endswith(prose(3, 40)) and got[5002] == prose(4, 60)
    out = substring_dedup.dedup(edges).collect()
    assert len(out) == edges.count() and substring_dedup.dedup(nothing).count() == 0
    assert [r["clean_text"] for r in out if r["row"]["doc_id"] == 0] == [None]
    firsts = [r["clean_text"] for r in out if r["row"]["doc_id"] == 5]
    assert firsts and all(t == prose(1, 300) for t in firsts)
    for t in (prose(1, 50), "A b. C d! E\n\nF? g", "", " x", "no end, but commas, " * 30):
        assert [(a, b) for a, b, _ in substring_dedup.sentences(t)] == [(a, b) for a, b, _ in own_sentences(t)]


# 10 --------------------------------------------------------------------------
def test_language_id(spark, docs, edges, nothing):
    out = language_id.op10_language_id(spark, SF).toPandas()
    assert len(out) == len(docs) + spark.read.parquet(f"{SF}/pages.parquet").count()
    own = out[out.doc_id.notna()].set_index("doc_id").language
    assert (own.reindex(docs.index) == docs.lang).mean() > 0.97
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), "lang")
    for df in (edges, nothing):
        got = language_id.of_documents(df, model)
        assert got.count() == df.count() and language_id.kept(df, model).columns == df.columns
    none = language_id.of_documents(edges, language_id.fit(nothing, "lang"))
    assert {r["language"] for r in none.collect()} == {"und"}
    assert language_id.kept(edges, language_id.fit(nothing, "lang")).count() == 0
    web = [(1, "https://u@a.b.example.fr:80/x", '<HTML class=x lang="FR-be"><script>var the</script><p>le la les des et</p>'), (2, None, None), (3, "nonsense", "<p>the of and to in is that it for was"), (4, "", "")]
    pages = spark.createDataFrame(web, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in language_id.of_pages(pages, model).collect()}
    assert got[1]["language"] == "fr" and got[3]["language"] == "en" and len(got) == 4


def test_language_by_text_alone(spark):
    """Rows outside the sample, with their declared language and source withheld."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 2 = 0"), "lang", most=60)
    rest = docs.filter("doc_id % 2 = 1")
    got = language_id.identify(rest, model, F.col("text"), F.lit(None), carry={"lang": F.col("lang")}).collect()
    assert np.mean([r["lang"] == r["language"] for r in got]) > 0.97 and len(got) == rest.count()


def test_language_evidence_by_brute_force(spark, monkeypatch):
    """The fused posterior, by its definition, with and without tables that can be broadcast."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language_id.fit(docs.limit(60), "lang", most=5)
    rows = docs.collect()
    ll = model.log_likelihood([(r["text"] or "").encode() for r in rows])
    own = np.exp(ll - ll.max(axis=1, keepdims=True))
    own /= own.sum(axis=1, keepdims=True)
    n = len(model.languages)

    def others(i, column):
        same_ = np.array([r[column] == rows[i][column] for r in rows])
        return own[same_].sum(axis=0) - own[i]

    want = {}
    for i, r in enumerate(rows):
        every = own.sum(axis=0) - own[i] + 1
        share = every / every.sum()
        log = ll[i] + np.log((others(i, "lang") + 10 * share) / every)
        prior = others(i, "source") + 10 * share
        log += np.log(prior / prior.sum())
        p = np.exp(log - log.max())
        want[r["doc_id"]] = (model.languages[p.argmax()], (p / p.sum()).max())
    for small in (True, False):
        monkeypatch.setattr(language_id, "is_small", lambda df, small=small: small)
        got = {r["doc_id"]: r for r in language_id.identify(docs, model, F.col("text"), F.col("source"), language_id.primary(F.col("lang")), carry={"doc_id": F.col("doc_id")}, hot=1).collect()}
        assert len(got) == len(want) and n > 2
        for i, (name, p) in want.items():
            assert got[i]["language"] == name and math.isclose(got[i]["probability"], p, rel_tol=1e-9)


def test_repeated_rows_are_one_in_the_sample(spark):
    same_ = [(1, "guten tag und auf wiedersehen", "de")] * 10_000 + [(i, f"hello there {i}", "en") for i in range(2, 300)]
    model = language_id.fit(spark.createDataFrame(same_, "doc_id bigint, text string, lang string"), "lang", most=50)
    assert model.languages == ["de", "en", "und"]
    assert model.log_likelihood([b"guten tag"])[0].argmax() == 0


# texts as arrays ---------------------------------------------------------------
def test_parts_cut_no_word(monkeypatch):
    monkeypatch.setattr(text_arrays, "PART", 64)
    r = random.Random(8)
    texts = [b"\t".join(f"w{r.randint(0, 9) * 10 ** r.randint(0, 3)}".encode() for _ in range(500)), b"x" * 300 + b" y", b"", None, b"a\vb\fc\rd\ne" * 40]
    for every in (0, 7):
        table = text_arrays.raw_words()
        found = collections.defaultdict(list)
        for buffer, of, begin in text_arrays.parts(texts, every, table):
            start, end, _ = text_arrays.words(buffer, table)
            first = np.append(np.searchsorted(start, begin), len(start))
            for k, i in enumerate(of):
                found[i] += [bytes(buffer[a:b]) for a, b in zip(start[first[k] : first[k + 1]], end[first[k] : first[k + 1]], strict=True)]
        assert all(found[i] == (t or b"").split() for i, t in enumerate(texts))
    whole, cut = quality_mil.passages([texts[0]]), None
    monkeypatch.setattr(text_arrays, "PART", 1 << 20)
    cut = quality_mil.passages([texts[0]])
    assert np.allclose(whole[0], cut[0])
    sets = list(jaccard_join.shingle_sets(texts, 5))
    monkeypatch.setattr(text_arrays, "PART", 64)
    assert all((a == b).all() for a, b in zip(sets, jaccard_join.shingle_sets(texts, 5), strict=True))
