"""The pipeline: every stage against what it should keep, and the whole."""

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from strideq.llm import language_id, packing, quality_mil
from strideq.llm.common import BATCH, fold, saved
from tests.llm.test_llm import SF, brute_classes, brute_dedup, edges  # noqa: F401


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    found["documents"] = docs
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(at / name))
        docs = found[name] = spark.read.parquet(str(at / name))
    return found


def test_stages(steps):
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "quality", "near_duplicates", "substrings", "packing"]
    columns = steps["documents"].columns
    for n in names[:-1]:
        assert steps[n].columns == columns
    texts = lambda name: {r["doc_id"]: r["text"] for r in steps[name].collect()}
    # Language: what is accepted stays, unchanged.
    docs, model = steps["documents"], language_id.fit(steps["documents"], "lang")
    accepted = {r["doc_id"] for r in language_id.of_documents(docs, model).filter("accepted").collect()}
    assert texts("language") == {i: t for i, t in texts("documents").items() if i in accepted} and accepted
    # Quality: by the same network, text by text.
    net = quality_mil.train(steps["language"], steps["language"].sparkSession.read.parquet(f"{SF}/labels.parquet"), fold("doc_id", 5) != 0, 0.3, {0: 1500, 1: 1500}, 30, 0.005)
    assert texts("quality") == {i: t for i, t in texts("language").items() if net.scores([t.encode()])[0] >= 0.3}
    before = texts("quality")
    classes = brute_classes(before.items())
    kept = {r["doc_id"] for r in steps["near_duplicates"].collect()}
    assert kept == {i for i in before if classes[i][0] == i}
    clean = brute_dedup(sorted(texts("near_duplicates").items()))
    gone = {i for i, t in texts("near_duplicates").items() if clean[i] != t and not clean[i].strip()}
    assert texts("substrings") == {i: t for i, t in clean.items() if i not in gone}
    assert steps["substrings"].filter("n_chars <> length(text)").count() == 0
    packed = steps["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in steps["substrings"].collect()} and all(r["n"] == r["m"] for r in packed)


def test_run_is_its_stages(spark, steps):
    got = P.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, steps["packing"].select(*key).collect()))


def test_edges(spark, edges):  # noqa: F811
    """Nulls, empty and long texts, repeats, clashing names; and empty tables."""
    n = edges.count()
    for name, stage in P.STAGES:
        none = stage(spark, edges.limit(0), SF)
        assert none.count() == 0
        out = stage(spark, edges, SF)
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in edges.collect()}
            assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_id"] in (0, 1)) == 2
            continue
        assert none.columns == out.columns == edges.columns and 0 < len(rows) <= n
        same = [tuple(r) for r in edges.collect()]
        if name != "substrings":
            assert all(tuple(r) in same for r in rows)
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in rows]
            assert 6 not in ids and 7 not in ids and {0, 1, 2, 3, 5} <= set(ids)
        if name == "substrings":
            got = {r["doc_id"]: r["text"] for r in rows}
            assert got[0] is None and got[1] == "" and got[5] == dict((r["doc_id"], r["text"]) for r in edges.collect())[5]


def test_batches_of_texts_are_bounded_in_bytes(spark):
    """Python gets texts a few megabytes at a time, however many rows a batch may have."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    got = saved(docs.mapInArrow(sizes, "size bigint, n bigint"), "sizes")[0].collect()
    assert sum(r["n"] for r in got) == 4000 and max(r["size"] for r in got) <= 1.5 * BATCH
    assert spark.conf.get(key) == before


def test_words_kept_are_bounded(monkeypatch):
    """Generations of words: ids stay the same, words that come again stay known."""
    coder = packing.WordCache(public_tokenizers.path("byte_bpe_50k.tiktoken"), "<|endoftext|>", 50256)
    monkeypatch.setattr(packing, "_CACHED", 50)
    asked = []
    monkeypatch.setattr(coder, "_plain", lambda t, own=coder._plain: asked.append(t) or own(t))
    for i in range(400):
        text = f"a common w{i}"
        assert coder.encode(text) == packing.np.array(coder._bpe.encode_ordinary(text), "<u4").tobytes()
    assert asked.count(" common") == 1 and len(coder._of) + len(coder._old) <= 100
