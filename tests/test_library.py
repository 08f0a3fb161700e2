"""Functions, sources, validation, explanation and streaming."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideq import Corpus, CorpusSpec, Engine
from strideq.errors import CorpusError
from strideq.functions import text as T
from strideq.functions.stemming import english
from strideq.functions.times import magnitude_us, text_us
from strideq.operators.profile import context, profile
from strideq.operators.search import scout, similar
from strideq.plans.explain import explain, slots
from strideq.plans.validate import validate
from strideq.sources import ingest, outcomes


def test_tokens(spark):
    df = spark.createDataFrame([("Mail me@site.org about C++ at HTTPS://x.y/z?q=1 don't wait",)], "t string")
    got = df.select(T.tokens(F.col("t")).alias("w"), T.ngrams(T.tokens(F.col("t"), "word"), 2).alias("n")).first()
    assert got["w"] == ["mail", "me@site.org", "about", "c++", "at", "https://x.y/z?q=1", "don't", "wait"]
    assert got["w"] == T.tokens_of("Mail me@site.org about C++ at HTTPS://x.y/z?q=1 don't wait")
    assert got["n"][:2] == ["mail me", "me site"]


@pytest.mark.parametrize("word,stem", [("running", "run"), ("happiness", "happi"), ("relational", "relat"), ("cries", "cri"), ("flies", "fli"), ("national", "nation"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("dying", "die"), ("skies", "sky"), ("agreed", "agre"), ("consistency", "consist"), ("kindness", "kind"), ("easily", "easili"), ("youth", "youth"), ("boy", "boy")])
def test_stems(word, stem):
    assert english(word) == stem


@pytest.mark.parametrize(
    "language,pairs",
    [
        ("german", "aufeinander aufeinand|kategorischen kategor|häuser haus|kategorie kategori|aufgeblasen aufgeblas|verschiedenheit verschied|größe gross|bedürfnisse bedurfnis|spielst spiel"),
        ("french", "continuation continu|continuellement continuel|majestueusement majestu|chevaux cheval|mangeait mang|nationalité national|finissons fin|heureuse heureux|quand quand|maintenant mainten|rapidement rapid"),
        ("spanish", "chicas chic|torneos torne|cheques chequ|toreado tor|naciones nacion|rápidamente rapid|comprándoselo compr|lugares lugar|posibilidades posibil|paguen pag|cantábamos cant"),
    ],
)
def test_stems_of_other_languages(language, pairs):
    stem = T.stem_words(language)
    for pair in pairs.split("|"):
        word, want = pair.split()
        assert stem(word) == want


def test_text_modes(spark):
    rows = [(0, 1, "he keeps Running fast"), (1, 2, "a runner ran"), (2, 3, "run"), (3, 4, "xrunx is it?"), (4, 5, "is this it"), (5, 6, None)]
    df = spark.createDataFrame(rows, "position bigint, id int, text string")
    ask = lambda mode, q="contains(r)": [g[0] for g in Engine(Corpus(df, CorpusSpec(text_match=mode, dictionaries={"r": ["run"], "p": ["keeps running"]}))).execute(q).groups]
    assert ask("stem") == [1, 3]
    assert ask("token") == [3]
    assert ask("substring") == [1, 2, 3, 4]
    assert ask("stem", "contains(p)") == [1]
    assert ask("stem", "is_question()") == [4, 5]
    assert ask("stem", "not field(text,*)") == [6]


def test_times(spark):
    df = spark.createDataFrame([("2024-01-15T10:30:00Z",), ("2024-01-15",), ("1705314600",), ("nope",), (None,)], "t string")
    got = [r[0] for r in df.select(text_us(F.col("t"))).collect()]
    assert got == [1705314600000000, 1705276800000000, 1705314600000000, None, None]
    df = spark.createDataFrame([(1705314600,), (1705314600000,), (1705314600000000,), (1705314600000000000,)], "t bigint")
    assert {r[0] for r in df.select(magnitude_us(F.col("t"))).collect()} == {1705314600000000}


def test_ingest(spark, tmp_path):
    a = spark.createDataFrame([(1, 3000, "x"), (2, None, "y?"), (3, 1000, "see http://a.b")], "k int, at bigint, text string")
    a.write.parquet(str(tmp_path / "a.parquet"))
    spark.createDataFrame([(1, 500, "z", True)], "k int, at bigint, text string, extra boolean").write.parquet(str(tmp_path / "b.parquet"))
    both = ingest.read_sources(spark, [f"one={tmp_path}/a.parquet", f"{tmp_path}/b.parquet"], "k", "src")
    out = ingest.normalize(both, "k", "at", sort="at")
    rows = out.orderBy("position").collect()
    assert [r["id"] for r in rows] == ["b:1", "one:3", "one:1", "one:2"]
    assert [r["position"] for r in rows] == [0, 1, 2, 3] and rows[3]["time"] is None
    assert ingest.describe(out)["no_time"] == 1
    marked = ingest.annotate(out, ["questions", "links"], ["text"])
    ingest.write(marked, str(tmp_path / "out.parquet"))
    back = spark.read.parquet(str(tmp_path / "out.parquet"))
    assert set(ingest.stamped(back)) == {"is_question", "has_link"}
    e = Engine(Corpus(back, CorpusSpec(time="time"), check=True))
    assert [g[0] for g in e.execute("is_question() or contains_link()").groups] == ["one:3", "one:2"]
    with pytest.raises(CorpusError):
        ingest.normalize(a.unionByName(a), "k", "at")
    with pytest.raises(CorpusError):
        Corpus(spark.createDataFrame([(1, 0), (2, 2)], "id int, position int"), CorpusSpec(), check=True)
    vec = ingest.embed(a, lambda texts: [[3.0, 4.0] for _ in texts]).first()["emb"]
    assert [round(x, 3) for x in vec] == [0.6, 0.8]


def test_outcomes(spark):
    rows = [("s", 1, "tool_use", "c", 0, None, None), ("s", 2, "tool_result", "c", 2, False, 10), ("s", 3, "tool_result", "c", 3, True, 5), ("s", 4, "tool_use", "c", 4, None, None), ("s", 5, "tool_result", "c", 90, True, 0), ("s", 6, "tool_use", "d", 91, None, None)]
    df = spark.createDataFrame(rows, "session string, line int, kind string, call string, s int, error boolean, output_chars bigint").withColumn("time", F.timestamp_seconds("s"))
    got = {r["line"]: r for r in outcomes.attach_outcomes(df).collect()}
    assert (got[1]["outcome"], got[1]["duration_bucket"], got[1]["output_bucket"]) == ("ok", "short", "small")
    assert (got[4]["outcome"], got[4]["duration_ms"], got[4]["output_bucket"]) == ("error", 86000, "empty")
    assert got[6]["outcome"] == "none"


def test_findings(spark):
    df = spark.createDataFrame([(0, 1, "a")], "position bigint, id int, user string")
    e = Engine(Corpus(df))
    codes = lambda q: {f.code for f in validate(q, e)}
    assert "SYNTAX_ERROR" in codes("SELECT (")
    assert "MISSING_WINDOW_CONSTRAINT" in codes("SELECT from(a) FOLLOWED_BY from(b)")
    assert "UNDEFINED_DICTIONARY" in codes("SELECT contains(x)")
    assert "OPEN_QUANTIFIER" in codes("SELECT from(a){2,}")
    assert "UNBOUND_NEGATED_VARIABLE" in codes("SELECT from(!$a)")
    assert "DEPRECATED_SYNTAX" in codes("SELECT byuser(a)")
    assert "NEGATION_ONLY" in codes("SELECT NOT from(a)")
    assert "RUN_WITHOUT_STEP" in codes("SELECT RUN(from(a)){2,}")
    assert "SEQUENCE_UNDER_BOOLEAN" in codes("SELECT NOT (from(a) FOLLOWED_BY from(b) INWINDOW 2)")
    assert validate("SELECT from(a) FOLLOWED_BY from(b) INWINDOW 2", e) == []


def test_looking_around(spark):
    rows = [(i, i, "ab"[i % 2], f"word{i} the idiot", [1.0, float(i)]) for i in range(6)]
    df = spark.createDataFrame(rows, "position bigint, id int, user string, text string, emb array<float>")
    spec = CorpusSpec(text_match="token", dictionaries={"d": ["idiot"]}, embedder=lambda ts: [[1.0, 0.0] for _ in ts])
    e = Engine(Corpus(df, spec))
    assert [r["position"] for r in context(e.corpus, 3, 1, 1).collect()] == [2, 3, 4]
    assert [r["position"] for r in context(e.corpus, 3, 1, 1, same="user").collect()] == [1, 3, 5]
    assert [r["position"] for r in scout(e.corpus, "word4 idiot", 1).collect()] == [4]
    assert [r["position"] for r in similar(e.corpus, "x", 2).collect()] == [0, 1]
    p = {r["field"]: r for r in profile(e.corpus.df.select("user", "id")).collect()}
    assert (p["user"]["n_distinct"], p["user"]["top"], p["id"]["coverage"]) == (2, "a=3,b=3", 1.0)
    why = explain(e, "contains(d) ~> from(b) |> within(1)", [0])
    assert why[0].predicate.kind == "contains" and why[0].spans == (("text", 10, 15),)
    assert slots(e.to_ir("from(a) ~> from(b) <~ from(c) |> within(2)")) == [2, 0, 1]


def test_configuration(spark, tmp_path):
    spark.createDataFrame([("1", "a"), ("2", "b")], "id string, user string").coalesce(1).write.option("header", True).csv(str(tmp_path / "c.csv"))
    e = Engine.from_config(spark, {"corpus": str(tmp_path / "c.csv"), "time": None, "dictionaries": {"x": ["y"]}})
    assert e.execute("from(a) ~> from(b) |> within(1)").groups == [[1, 2]]
    e.add_dictionary("z", ["w"], "token")
    assert set(e.get_dictionaries()) == {"x", "z"}
    e.remove_dictionary("z")


def test_streaming(spark, tmp_path):
    from strideq import streaming

    rows = [(1, "a", "X", 0), (2, "a", "Y", 5), (3, "b", "X", 8), (4, "a", "Y", 9), (5, "a", "X", 100)]
    df = spark.createDataFrame(rows, "id int, user string, kind string, s int").withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def ran(stream, name):
        stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / ("ck" + name))).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    assert sorted(r["id"] for r in ran(streaming.matching(source(), "field(kind,X)", CorpusSpec()), "m").collect()) == [1, 3, 5]
    linked = streaming.link(source().filter("kind = 'X'"), source().filter("kind = 'Y'"), 10, keys=("user",))
    got = ran(linked, "l")
    assert sorted((r["left_id"], r["right_id"]) for r in streaming.nearest(got).collect()) == [(1, 2)]


def test_stems_of_a_batch_as_of_each_word():
    words = pa.array([["x"], ["running", "runs", "flies"], None, [], ["running", None, "kindness"]], pa.list_(pa.string())).slice(1)
    asked = []
    got = T._stemmed(words, lambda w: asked.append(w) or english(w))
    assert got.to_pylist() == [["run", "run", "fli"], [], [], ["run", None, "kind"]] and got.type == words.type
    assert sorted(asked) == ["flies", "kindness", "running", "runs"]  # each distinct word once
    assert T._stemmed(words.slice(0, 0), english).to_pylist() == []


def test_texts_are_indexed_in_batches_bounded_in_bytes(spark, monkeypatch):
    """Stemming gets a few megabytes of tokens at a time, however many rows there are."""
    from strideq.sources.corpus import numbered
    from strideq.sources.storage import BATCH

    def sizes(words, language):
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield pa.array([[str(b.nbytes)]] * len(b), pa.list_(pa.string()))

        return F.arrow_udf(run, "array<string>")(words)

    monkeypatch.setattr(T, "stems", sizes)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('word ', 1000) AS text")
    rows = numbered(ingest.indexed(docs)).select("text_stems").collect()
    assert len(rows) == 4000 and max(int(r[0][0]) for r in rows) <= 1.5 * BATCH


def test_what_comes_after_numbering_is_not_sorted(spark):
    from strideq.sources.corpus import numbered

    df = spark.createDataFrame([(i, f"runs {i}") for i in (3, 1, 2, 0)], "id int, text string").repartition(3)
    counted = spark.sparkContext.accumulator(0)

    def then(df):
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                counted.add(len(b))
                yield b

        return ingest.indexed(df.withColumn("text", F.arrow_udf(run, "string")("text")))

    got = numbered(df, [F.col("id")], then=then).orderBy("position").collect()
    assert [(r["position"], r["id"], r["text_stems"]) for r in got] == [(i, i, ["run", str(i)]) for i in range(4)]
    assert counted.value == 4  # not again for the sample of the ranges
