"""Order of files, zones of sessions, names that clash, and what plans do first."""

import datetime as dt

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strideq import Corpus, CorpusSpec, Engine
from strideq.errors import ConfigError, CorpusError, QueryError
from strideq.functions.times import bucket, micros
from strideq.operators.search import similar
from strideq.sources import ingest


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["parquet", "csv", "jsonl"])
def test_positions_are_row_numbers_over_files_and_splits(spark, tmp_path, small_splits, kind):
    folder = tmp_path / f"table.{kind}"
    folder.mkdir()
    at = 0
    for name, n in (("a", 7), ("b", 9000), ("c", 25_000), ("d", 300)):
        df = pd.DataFrame({"id": range(at, at + n), "user": "u"})
        at += n
        if kind == "parquet":
            pq.write_table(pa.Table.from_pandas(df), folder / f"{name}.parquet", row_group_size=1000, compression="none", use_dictionary=False)
        elif kind == "csv":
            df.to_csv(folder / f"{name}.csv", index=False)
        else:
            df.to_json(folder / f"{name}.jsonl", orient="records", lines=True)
    corpus = ingest.load_table(spark, str(folder), CorpusSpec(time=None))
    got = corpus.df.agg(F.count(F.lit(1)), F.sum((F.col("position") != F.col("id").cast("long")).cast("int"))).first()
    assert tuple(got) == (at, 0)
    # Ties of a sort keep this order, and missing values come last.
    made = ingest.read_source(spark, str(folder)).withColumn("id", F.col("id").cast("long")).withColumn("at", F.when(F.col("id") % 5 != 0, F.col("id") % 3))
    out = ingest.normalize(made, "id", "at", sort="at").orderBy("position").select("id").toPandas()["id"].tolist()
    assert out == sorted(range(at), key=lambda i: (i % 5 == 0, i % 3 if i % 5 else 0, i))


def test_sources_in_the_order_given(spark, tmp_path):
    for name, ids in (("z", [3, 1]), ("a", [2, 9])):
        pd.DataFrame({"k": ids, "at": 5}).to_parquet(tmp_path / f"{name}.parquet")
    both = ingest.read_sources(spark, [f"{tmp_path}/z.parquet", f"{tmp_path}/a.parquet"], "k", "src")
    for sort in (None, "at"):
        rows = ingest.normalize(both, "k", "at", sort=sort).orderBy("position").collect()
        assert [r["id"] for r in rows] == ["z:3", "z:1", "a:2", "a:9"]
        assert rows[0].asDict().keys() == {"position", "id", "time", "src"}


def test_any_session_zone_gives_utc(spark):
    moments = [dt.datetime(2024, 1, 15, 2), dt.datetime(2024, 3, 10, 2, 30, 0, 250_001), dt.datetime(2024, 12, 30, 23, 59), dt.datetime(1969, 12, 31, 23, 30), dt.datetime(2018, 11, 4, 0, 15)]
    rows = [(i, i, m, m.date(), m.isoformat(), m.isoformat() + "+02:00") for i, m in enumerate(moments)]
    want, old = None, spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame(rows, "position bigint, id int, ts timestamp_ntz, day date, text string, zoned string")
            us = [micros(F.col(c), df.schema[c].dataType) for c in ("ts", "day", "text", "zoned")]
            got = [tuple(r) for r in df.orderBy("id").select(*us, *[bucket(us[0], b) for b in ("hours", "days", "weeks", "months", "years")]).collect()]
            e = Engine(Corpus(df, CorpusSpec(time="ts")))
            got.append(e.execute("SELECT field(id,*) GROUP BY HOURS(ts) AGGREGATE count()").by_key)
            got.append(e.execute('SELECT field(id,*) AFTER("2024-03-10T02:00:00")').groups)
            want = want or got
            assert got == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    epoch = dt.datetime(1970, 1, 1)
    for m, r in zip(moments, want, strict=False):
        assert r[0] == r[2] == (m - epoch) // dt.timedelta(microseconds=1) == r[3] + 7_200_000_000
        assert r[1] == (m.date() - epoch.date()).days * 86_400_000_000
        iso = m.isocalendar()
        assert r[4:] == (m.strftime("%Y-%m-%d %H:00"), m.strftime("%Y-%m-%d"), f"{iso[0]}-W{iso[1]:02d}", m.strftime("%Y-%m"), m.strftime("%Y"))
    assert want[-1] == [[1], [2]]


def test_columns_that_only_have_a_name(spark):
    rows = [(0, 1, "one two?", 7, True, False, "x", [1]), (1, 2, "https://a.b two", 8, True, False, "y", [2])]
    df = spark.createDataFrame(rows, "position bigint, id int, text string, text_tokens int, is_question boolean, has_link boolean, mentions string, entities array<int>")
    e = Engine(Corpus(df, CorpusSpec(time=None, user="mentions", text_match="token", dictionaries={"d": ["two"], "s": {"terms": ["one"], "match": "stem"}})))
    assert e.execute("contains(d)").groups == [[1], [2]]
    assert e.execute("contains(s)").groups == [[1]]
    assert e.execute("is_question()").groups == [[1]]
    assert e.execute("contains_link()").groups == [[2]]
    assert e.execute("mentions_user(x)").groups == []
    assert e.execute("field(mentions,$y) ~> field(mentions,!$y) |> within(1)").groups == [[1, 2]]
    with pytest.raises(QueryError, match="entities"):
        e.execute("mentions_org()")
    with pytest.raises(CorpusError, match="wrong type"):
        ingest.stamp(df, "entities")


def test_indexed_columns_are_used_only_for_their_tokenizer(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "Runners run C++")], "position bigint, id int, text string")
    ingest.write(ingest.indexed(df), str(tmp_path / "i.parquet"))
    made = spark.read.parquet(str(tmp_path / "i.parquet"))
    plain = dict(time=None, dictionaries={"d": ["running"], "c": {"terms": ["c++"], "match": "token"}})
    for frame in (df, made):
        for tokenizer, c in (("unicode", 1), ("word", 0)):
            e = Engine(Corpus(frame, CorpusSpec(tokenizer=tokenizer, **plain)))
            assert len(e.execute("contains(d)").groups) == 1
            if c:
                assert len(e.execute("contains(c)").groups) == 1
    e = Engine(Corpus(made, CorpusSpec(**plain)))
    text = e.plan("contains(d)")._jdf.queryExecution().optimizedPlan().toString()
    assert "text_stems" in text and "ArrowEval" not in text


def test_own_tokenizer(spark):
    df = spark.createDataFrame([(0, 1, "a-b c"), (1, 2, "a b-c"), (2, 3, None)], "position bigint, id int, text string")
    e = Engine(Corpus(df, CorpusSpec(time=None, tokenizer=lambda t: t.lower().split("-"), dictionaries={"d": {"terms": ["b c"], "match": "token"}, "x": {"terms": ["a"], "match": "token"}})))
    assert e.execute("contains_tokens(x)").groups == [[1]]
    assert e.execute("contains_tokens(d)").groups == [[1]]
    assert e.execute('contains_phrase("a-b c")').groups == [[1]]
    with pytest.raises(ConfigError):
        Engine(Corpus(df, CorpusSpec(time=None, tokenizer="other", dictionaries={"x": {"terms": ["a"], "match": "token"}}))).execute("contains(x)")


def test_pages_and_ranked_similarity(spark):
    rows = [(i, i, "ab"[i % 2], [1.0, float(i)]) for i in range(6)]
    df = spark.createDataFrame(rows, "position bigint, id int, user string, emb array<float>")
    e = Engine(Corpus(df, CorpusSpec(time=None, embedder=lambda ts: [[1.0, 0.0] for _ in ts])))
    q = "SELECT from(a){1,2} INWINDOW 2"
    assert e.page(q, 0, 2) == [[0], [0, 2]]
    assert e.page(q, 1, 3, "size") == [[2, 4], [0], [2]]
    assert e.page(q, 0, 2, "size", reverse=True) == [[4], [2]]
    assert e.page("SELECT from(a) ORDER BY id DESC", 0, 2) == [[4], [2]]
    got = similar(e.corpus, "x", 2, 0.4).collect()
    assert [(r["position"], r["total"]) for r in got] == [(0, 3), (1, 3)]


def test_stamp_of_the_embedding_model(spark, tmp_path):
    df = ingest.embed(spark.createDataFrame([(0, 1, "x")], "position bigint, id int, text string"), lambda ts: [[1.0] for _ in ts], model="m1")
    ingest.write(df, str(tmp_path / "e.parquet"))
    back = spark.read.parquet(str(tmp_path / "e.parquet"))
    Corpus(back, CorpusSpec(time=None, embedding_model="m1"))
    with pytest.raises(CorpusError, match="m1"):
        Corpus(back, CorpusSpec(time=None, embedding_model="m2"))


def test_questions_to_a_model(spark):
    df = spark.createDataFrame([(1, "good", "user"), (2, "bad and long", "user"), (3, "x", "tool")], "id int, text string, role string")
    questions = [
        ingest.Question("polite", "yes_no", "Is it polite?", least=0.5),
        ingest.Question("mood", "choice", "Which mood?", {"up": "glad", "down": "sad"}, {"role": "user"}),
        ingest.Question("size", "score", "How long?", ["short", "long"], least=0.6),
    ]

    def ask(rows, asked):
        assert [q.name for q in asked] == ["polite", "mood", "size"] and all(len(r["text"]) <= 5 for r in rows)
        return [{"polite": {"p": 0.9 if "good" in r["text"] else 0.4}, "mood": {"label": "up", "p": 0.7}, "size": {"p": [0.2, 0.8] if len(r["text"]) > 4 else [0.5, 0.5]}} for r in rows]

    got = [tuple(r) for r in ingest.judged(df, questions, ask, clip=5).orderBy("id").select("polite", "polite_p", "mood", "mood_p", "size", "size_p").collect()]
    assert got == [("yes", 0.9, "up", 0.7, "unsure", 0.5), ("unsure", 0.4, "up", 0.7, "long", 0.8), ("unsure", 0.4, None, None, "unsure", 0.5)]
    with pytest.raises(CorpusError):
        ingest.Question("q", "choice", "?", ["a"])
    with pytest.raises(CorpusError):
        ingest.judged(df, [ingest.Question("text", "yes_no", "?")], ask)


# -- plans --------------------------------------------------------------------
def plan_of(e, query):
    return e.plan(query)._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(i, i, "ab"[i % 2], "xyz"[i % 3], i) for i in range(30)]
    return Engine(Corpus(spark.createDataFrame(rows, "position bigint, id int, user string, kind string, timestamp bigint")))


def test_runs_are_measured_before_they_are_collected(keyed):
    lines = plan_of(keyed, "SELECT RUN(field(kind,x)){2,4} INWINDOW 3").split("\n")
    collect = next(i for i, x in enumerate(lines) if "collect_list" in x)
    length = [i for i, x in enumerate(lines) if "Filter" in x and "length" in x]
    assert length and min(length) > collect  # deeper in the tree


@pytest.mark.parametrize(
    "q",
    [
        "SELECT field(kind,x) AND field(user,$u), field(kind,y) AND field(user,$u) DURING 1 minute",
        "SELECT RUN(field(kind,x) AND field(user,$u), INWINDOW 6){1,} FOLLOWED_BY field(kind,y) AND field(user,$u) INWINDOW 5",
        "SELECT field(kind,x) AND field(user,$u) NOT_FOLLOWED_BY field(kind,y) AND field(user,$u) AND field(id,!$i) AND field(id,$i) INWINDOW 5",
    ],
)
def test_variables_are_join_keys(keyed, q):
    try:
        keyed.plan(q)
    except QueryError:
        q = q.replace(" AND field(id,!$i) AND field(id,$i)", "")
    joins = [x for x in plan_of(keyed, q).split("\n") if "Join" in x]
    if joins:
        assert any(x.count(" = ") >= 2 for x in joins), joins


def test_one_inequality_needs_no_join(keyed):
    assert "Join" not in plan_of(keyed, "SELECT field(kind,x) AND field(user,$u) FOLLOWED_BY field(kind,y) AND field(user,!$u) INWINDOW 5")
