"""Queries over the driver's tables, each with SQL that says the same.

Results are wide (a position per slot), so they compare without group numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideq.engine import Engine
from strideq.sources import ingest
from strideq.sources.corpus import Corpus, CorpusSpec, numbered

DICTIONARIES = {"articles": ["the", "la", "der"], "insults": {"terms": ["idiot", "moron"], "match": "token"}, "parts": {"terms": ["tion", "licensed"], "match": "substring"}, "wordy": {"terms": ["stupid", "loser"], "match": "stem"}}
_engines: dict[tuple[str, str, str], Engine] = {}


def _cached(name: str, make: Callable[[SparkSession, str], Engine]) -> Callable[[SparkSession, str], Engine]:
    """One engine per session, folder and corpus: positions are assigned once."""

    def of(spark: SparkSession, sf: str) -> Engine:
        key = (spark.sparkContext.applicationId, sf, name)
        if key not in _engines:
            _engines[key] = make(spark, sf)
        return _engines[key]

    return of


def _events(spark: SparkSession, sf: str) -> Engine:
    df = spark.read.parquet(f"{sf}/events.parquet")
    spec = CorpusSpec(id="event_id", time="ts", user="user_id", text_fields=("props",), quantifier_ceiling=3)
    return Engine(Corpus(numbered(df, [F.col("ts"), F.col("event_id")]), spec))


def _orders(spark: SparkSession, sf: str) -> Engine:
    df = spark.read.parquet(f"{sf}/orders.parquet")
    spec = CorpusSpec(id="o_orderkey", time="o_orderdate", user="o_custkey", text_fields=())
    return Engine(Corpus(numbered(df, [F.col("o_orderdate"), F.col("o_orderkey")]), spec))


def _documents(spark: SparkSession, sf: str) -> Engine:
    df = spark.read.parquet(f"{sf}/documents.parquet")
    spec = CorpusSpec(id="doc_id", time=None, user="source", text_match="token", dictionaries=DICTIONARIES)
    entities = F.array(F.when(F.contains("text", F.lit("Apache")), "ORG"), F.when(F.col("text").rlike(r"\d{4}-\d{2}-\d{2}"), "DATE"))
    df = df.withColumn("entities", F.coalesce(F.filter(entities, lambda x: x.isNotNull()), F.array().cast("array<string>")))
    return Engine(Corpus(numbered(ingest.stamp(df, "entities"), [F.col("doc_id")], then=ingest.indexed), spec))


def _pages(spark: SparkSession, sf: str) -> Engine:
    df = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("see "), "url")).otherwise(F.col("html")))
    return Engine(Corpus(numbered(df, [F.col("page_id")]), CorpusSpec(id="page_id", time=None)))


def _addressed(spark: SparkSession, sf: str) -> Engine:
    df = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    to = F.element_at(F.array(F.lit("user"), F.lit("Assistant"), F.lit("userx")), (F.pmod(F.col("turn"), F.lit(3)) + 1).cast("int"))
    df = df.withColumn("text", F.concat(F.lit("to @"), to, F.lit(": well?")))
    return Engine(Corpus(numbered(df, [F.col("conv_id"), F.col("turn")]), CorpusSpec(time=None, user="role")))


def _turns(spark: SparkSession, sf: str) -> Engine:
    df = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    spec = CorpusSpec(time=None, user="role", text_match="token", dictionaries=DICTIONARIES)
    return Engine(Corpus(numbered(df, [F.col("conv_id"), F.col("turn")]), spec))


def _labelled(spark: SparkSession, sf: str) -> Engine:
    docs = _documents_engine(spark, sf).corpus
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    named = labels.select(F.col("doc_id").alias("id"), F.explode(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good"))).alias("feature")).filter("feature is not null")
    return Engine(docs.with_features(named))


def _vectors(spark: SparkSession, sf: str) -> Engine:
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    first = [float(x) for x in df.filter("vec_id = 0").select("embedding").first()[0]]
    spec = CorpusSpec(id="vec_id", time=None, user="label", embedding="embedding", embedder=lambda texts: [first for _ in texts])
    return Engine(Corpus(numbered(df, [F.col("vec_id")]), spec))


_events_engine = _cached("events", _events)
_orders_engine = _cached("orders", _orders)
_documents_engine = _cached("documents", _documents)
_turns_engine = _cached("turns", _turns)
_pages_engine = _cached("pages", _pages)
_addressed_engine = _cached("addressed", _addressed)
_labelled_engine = _cached("labelled", _labelled)
_vectors_engine = _cached("vectors", _vectors)

_EV = "ev AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events)"
_OR = "od AS (SELECT *, epoch_us(o_orderdate) AS us, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders)"
_MIN = 60_000_000


def _kind(alias: str, value: str) -> str:
    return f"{alias}.event_type = '{value}'"


def _near(left: str, right: str, axis: str, window: int, forward: bool = True, more: str = "TRUE", anchor: str = "l", table: str = "ev", key: str = "l.p") -> str:
    """A CTE body: each left row's nearest right row as ``np``. ``left`` is a table of
    left rows whose anchor has columns us and p."""
    a = f"r.{axis} > {anchor}.{axis} AND r.{axis} <= {anchor}.{axis} + {window}" if forward else f"r.{axis} < {anchor}.{axis} AND r.{axis} >= {anchor}.{axis} - {window}"
    order = f"r.{axis}, r.p" if forward else f"r.{axis} DESC, r.p DESC"
    return f"SELECT * EXCLUDE (k) FROM (SELECT l.*, r.p AS np, r.us AS nus, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {left} l JOIN {table} r ON {a} AND {right} AND {more}) WHERE k = 1"


def _link(a: str, b: str, axis: str, window: int, forward: bool = True, more: str = "TRUE") -> str:
    own = f"(SELECT * FROM ev WHERE {_kind('ev', a)})"
    columns = "p AS p0, np AS p1" if forward else "np AS p0, p AS p1"
    return f"WITH {_EV}, n AS ({_near(own, _kind('r', b), axis, window, forward, more)}) SELECT {columns} FROM n"


def _absent(a: str, b: str, axis: str, window: int, forward: bool = True, more: str = "TRUE") -> str:
    reach = f"r.{axis} > l.{axis} AND r.{axis} <= l.{axis} + {window}" if forward else f"r.{axis} < l.{axis} AND r.{axis} >= l.{axis} - {window}"
    return f"WITH {_EV} SELECT l.p AS p0 FROM ev l WHERE {_kind('l', a)} AND NOT EXISTS (SELECT 1 FROM ev r WHERE {_kind('r', b)} AND {reach} AND {more})"


def _pairs(a: str, b: str, axis: str, window: int) -> str:
    return f"WITH {_EV} SELECT DISTINCT least(l.p, r.p) AS p0, greatest(l.p, r.p) AS p1 FROM ev l JOIN ev r ON {_kind('l', a)} AND {_kind('r', b)} AND l.p <> r.p AND abs(l.{axis} - r.{axis}) <= {window}"


def _runs(keys: str, kind: str, axis: str, step: int, having: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    more = f", {keys}" if keys else ""
    return f"""WITH {_EV}, x AS (SELECT *, CASE WHEN {axis} - lag({axis}) OVER ({part}ORDER BY {axis}, p) <= {step} THEN 0 ELSE 1 END AS s FROM ev WHERE event_type = '{kind}'),
    y AS (SELECT *, sum(s) OVER ({part}ORDER BY {axis}, p) AS g FROM x)
    SELECT min(p) AS first, max(p) AS last, count(*) AS n FROM y GROUP BY g{more} HAVING {having}"""


_FB = "SELECT field(event_type,error) FOLLOWED_BY field(event_type,click) INWINDOW 5"
_FB_CTE = f"{_EV}, n AS ({_near("(SELECT * FROM ev WHERE event_type = 'error')", _kind('r', 'click'), 'p', 5)})"
_CHAIN = f"""WITH {_EV}, a AS ({_near("(SELECT * FROM ev WHERE event_type = 'error')", _kind('r', 'click'), 'us', 30 * _MIN)}),
b AS (SELECT p AS p0, np AS p1, np AS p, nus AS us, us AS us0 FROM a), c AS ({_near('b', _kind('r', 'view'), 'us', 30 * _MIN, key='l.p0, l.p')})"""


def _events_query(query: str, slots: int):
    return lambda spark, sf: _events_engine(spark, sf).wide(query, slots)


def _ends(query: str):
    """A run's first and last position and its length."""

    def of(spark: SparkSession, sf: str) -> DataFrame:
        df = _events_engine(spark, sf).plan(query)
        return df.select(F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"), F.size("positions").cast("long").alias("n"))

    return of


def _value(query: str, kind: str = "bigint"):
    def of(spark: SparkSession, sf: str) -> DataFrame:
        df = _events_engine(spark, sf).plan(query)
        return df.withColumn("value", F.round("value", 4) if kind == "double" else F.col("value").cast(kind))

    return of


def _on(engine, query: str, slots: int = 1):
    return lambda spark, sf: engine(spark, sf).wide(query, slots)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return _events_engine(spark, sf).plan(_FB + " GROUP BY event_type, days(ts)").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    from strideq.operators.search import similar

    e = _vectors_engine(spark, sf)
    return similar(e.corpus, "x", 20).select("position", F.round("score", 6).alias("score"))


def _ranked_count(spark: SparkSession, sf: str) -> DataFrame:
    from strideq.operators.search import similar

    return similar(_vectors_engine(spark, sf).corpus, "x", 1, 0.1).select("total")


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    from strideq.operators.profile import profile

    return profile(_events_engine(spark, sf).corpus.df.select("event_type", "user_id", "value"))


def _scout(spark: SparkSession, sf: str) -> DataFrame:
    from strideq.operators.search import scout

    return scout(_documents_engine(spark, sf).corpus, "licensed apache", 10).select("position", F.round("score", 6).alias("score"))


#: What relative times count from in the query ``ago``: 2024-01-20 00:00 UTC.
_NOW = 1_705_708_800_000_000
#: Words whose stem is that of a word of the dictionary.
_STEMS = ["stupid", "stupids", "stupidly", "stupidity", "stupidities", "loser", "losers"]
_DOC = "d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)"
_TOK = r"regexp_extract_all(lower(text), 'https?://\S+|[\p{L}\p{N}_]+@[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)+|[\p{L}\p{N}_][+#]+|[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)*')"
_PAGE = "g AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'see ' || url ELSE html END AS text, row_number() OVER (ORDER BY page_id) - 1 AS p FROM pages)"
_TURN = "c AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p FROM conversations)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fb_pos": _events_query(_FB, 2),
    "fb_time": _events_query("SELECT field(event_type,error) FOLLOWED_BY field(event_type,click) DURING 30 minutes", 2),
    "pb_time": _events_query("field(event_type,error) <~ field(event_type,click) |> during(30m)", 2),
    "pb_pos": _events_query("SELECT field(event_type,error) PRECEDED_BY field(event_type,click) INWINDOW 5", 2),
    "fb_keyed": _events_query("SELECT field(event_type,error) AND field(user_id,$u) FOLLOWED_BY field(event_type,click) AND field(user_id,$u) DURING 600 minutes", 2),
    "pb_keyed": _events_query("SELECT field(event_type,error) AND field(user_id,$u) PRECEDED_BY field(event_type,click) AND field(user_id,$u) DURING 600 minutes", 2),
    "fb_neq": _events_query("SELECT field(event_type,error) AND field(user_id,$u) FOLLOWED_BY field(event_type,click) AND field(user_id,!$u) INWINDOW 5", 2),
    "fb_tied_orders": _on(_orders_engine, "SELECT field(o_orderstatus,F) FOLLOWED_BY field(o_orderstatus,O) DURING 1 day", 2),
    "fb_orders_keyed": _on(_orders_engine, "SELECT field(o_orderpriority,'1-URGENT') AND field(o_custkey,$c) FOLLOWED_BY from($c) DURING 20 weeks", 2),
    "chain3": _events_query("SELECT field(event_type,error) FOLLOWED_BY field(event_type,click) FOLLOWED_BY field(event_type,view) DURING 30 minutes", 3),
    "chain3_span": _events_query("SELECT field(event_type,error) FOLLOWED_BY field(event_type,click) FOLLOWED_BY field(event_type,view) DURING 30 minutes DURING 20 minutes", 3),
    "chain_mixed": _events_query("SELECT field(event_type,error) FOLLOWED_BY field(event_type,click) INWINDOW 5 FOLLOWED_BY field(event_type,view) DURING 30 minutes", 3),
    "nfb": _events_query("SELECT field(event_type,error) NOT_FOLLOWED_BY field(event_type,click) INWINDOW 5", 1),
    "npb": _events_query("SELECT field(event_type,error) NOT_PRECEDED_BY field(event_type,click) DURING 10 minutes", 1),
    "nfb_keyed": _events_query("SELECT field(event_type,error) AND field(user_id,$u) NOT_FOLLOWED_BY field(event_type,click) AND field(user_id,$u) DURING 600 minutes", 1),
    "nfb_neq": _events_query("SELECT field(event_type,error) AND field(user_id,$u) NOT_FOLLOWED_BY field(event_type,click) AND field(user_id,!$u) INWINDOW 3", 1),
    "cooccur2": _events_query("SELECT field(event_type,error), field(event_type,click) INWINDOW 3", 2),
    "cooccur2_time": _events_query("field(event_type,error) + field(event_type,click) |> during(5m)", 2),
    "cooccur3": _events_query("SELECT field(event_type,error), field(event_type,click), field(event_type,view) INWINDOW 4", 3),
    "cooccur_keyed": _events_query("SELECT field(event_type,error) AND field(user_id,$u), field(event_type,click) AND field(user_id,$u) DURING 120 minutes", 2),
    "quant2": _events_query("SELECT field(event_type,error){2} INWINDOW 4", 2),
    "quant_2_3": _events_query("SELECT field(event_type,error){2,} INWINDOW 4", 3),
    "quant_row": _events_query("SELECT field(event_type,error){1,2}, field(event_type,purchase) INWINDOW 3", 3),
    "run_time": _ends("SELECT RUN(field(event_type,error) AND field(user_id,$u)){2,4} DURING 300 minutes"),
    "run_pos": _ends("SELECT RUN(field(event_type,error)){3,} INWINDOW 2"),
    "run_link": _events_query("SELECT RUN(field(event_type,error), INWINDOW 2){2,2} FOLLOWED_BY field(event_type,click) INWINDOW 3", 3),
    "run_absent": _events_query("SELECT RUN(field(event_type,error), INWINDOW 2){2,2} NOT_FOLLOWED_BY field(event_type,click) INWINDOW 3", 2),
    "sub_fb": _events_query("[field(event_type,error) ~> field(event_type,click) |> within(5)] ~>(4) [field(event_type,view) ~> field(event_type,view) |> within(2)]", 4),
    "sub_nfb": _events_query("[field(event_type,error) ~> field(event_type,click) |> within(5)] !~>(4) [field(event_type,view) ~> field(event_type,view) |> within(2)]", 2),
    "sub_unordered": _events_query("SELECT (SELECT field(event_type,error) FOLLOWED_BY field(event_type,click) INWINDOW 2); (SELECT field(event_type,view)) INWINDOW 3", 3),
    "bool_and_or_not": _events_query("SELECT (field(event_type,error) OR field(event_type,click)) AND NOT field(user_id,7)", 1),
    "field_partial": _events_query("SELECT field(props,'9}',partial)", 1),
    "field_present": _events_query("SELECT field(value,*)", 1),
    "from_author": _events_query("SELECT from(7)", 1),
    "before": _events_query(_FB + ' BEFORE("2024-01-03")', 2),
    "after": _events_query(_FB + ' AFTER("2024-01-10T12:00:00")', 2),
    "between": _events_query(_FB + ' BETWEEN("2024-01-03", "2024-01-05")', 2),
    "lone_time": _events_query("SELECT from(7) DURING 1 second", 1),
    "agg_count": _value(_FB + " AGGREGATE count()"),
    "agg_count_distinct": _value(_FB + " AGGREGATE count(DISTINCT user_id)"),
    "agg_sum": _value(_FB + " AGGREGATE sum(value)", "double"),
    "agg_avg": _value(_FB + " AGGREGATE avg(value)", "double"),
    "agg_min": _value(_FB + " AGGREGATE min(value)", "double"),
    "agg_max_by_user": _value(_FB + " GROUP BY user_id AGGREGATE max(value)", "double"),
    "agg_distinct": lambda spark, sf: _events_engine(spark, sf).plan(_FB + " AGGREGATE distinct(event_type)").select(F.array_join("value", ",").alias("value")),
    "group_day": _value(_FB + " GROUP BY DAYS(ts) AGGREGATE count()"),
    "group_week": _value(_FB + " GROUP BY WEEKS(ts) AGGREGATE count()"),
    "group_hour": _value("SELECT field(event_type,error) GROUP BY HOURS(ts) AGGREGATE count()"),
    "group_fields": _counts,
    "order_limit": _events_query(_FB + " ORDER BY value DESC, event_type DESC LIMIT 20 OFFSET 5", 2),
    "limit_natural": _events_query(_FB + " LIMIT 15 OFFSET 3", 2),
    "tokens": _on(_documents_engine, "SELECT contains_tokens(insults)"),
    "dictionary": _on(_documents_engine, "SELECT contains(articles) AND NOT contains(insults)"),
    "substring": _on(_documents_engine, "SELECT contains(parts)"),
    "stem": _on(_documents_engine, "SELECT contains(wordy)"),
    "phrase": _on(_documents_engine, 'SELECT contains_phrase("under the apache")'),
    "link": _on(_pages_engine, "SELECT contains_link()"),
    "no_link": _on(_pages_engine, "SELECT NOT contains_link()"),
    "entity": _on(_documents_engine, "SELECT mentions_org() OR mentions_date()"),
    "entity_not": _on(_documents_engine, "SELECT NOT mentions_date() AND contains(articles)"),
    "mentioned": _on(_addressed_engine, "SELECT mentions_user(assistant)"),
    "mention_link": _on(_addressed_engine, "SELECT mentions_user($y) FOLLOWED_BY from($y) INWINDOW 3", 2),
    "any_text": _on(_turns_engine, "SELECT contains(*) AND from(user)"),
    "own_equal": _on(_turns_engine, "SELECT field(turn,$c) AND field(conv_id,$c)"),
    "own_differ": _on(_turns_engine, "SELECT field(turn,$c) AND field(conv_id,!$c)"),
    "default_window": _events_query("SELECT field(event_type,purchase) AND field(user_id,7), field(event_type,error) AND field(user_id,7)", 2),
    "named_row": _events_query('SELECT field(event_type,error) AS "e", field(event_type,click) AS "c" INWINDOW 2', 2),
    "pipe_run": _ends("run(field(event_type,error) and field(user_id,$u), 5h){2,4}"),
    "ago": lambda spark, sf: _events_engine(spark, sf).wide(_FB + " AFTER(10 days AGO)", 2, now_us=_NOW),
    "group_month": lambda spark, sf: _orders_engine(spark, sf).plan("SELECT field(o_orderstatus,F) GROUP BY MONTHS(o_orderdate) AGGREGATE count()"),
    "group_year": lambda spark, sf: _orders_engine(spark, sf).plan("SELECT field(o_orderstatus,F) GROUP BY YEARS(o_orderdate) AGGREGATE count()"),
    "agg_first_time": lambda spark, sf: _orders_engine(spark, sf).plan("SELECT field(o_orderpriority,'1-URGENT') AGGREGATE min(o_orderdate)"),
    "agg_last_time": lambda spark, sf: _orders_engine(spark, sf).plan("SELECT field(o_orderpriority,'1-URGENT') GROUP BY o_orderstatus AGGREGATE max(o_orderdate)"),
    "similar_count": _ranked_count,
    "question": _on(_documents_engine, "SELECT is_question()"),
    "feature": _on(_labelled_engine, "SELECT has_feature(toxic) AND NOT labeled_as(good)"),
    "turns_chain": _on(_turns_engine, "SELECT from(user) FOLLOWED_BY from(assistant) INWINDOW 1", 2),
    "similar": _on(_vectors_engine, 'SELECT similar_to("x", 0.2)'),
    "similar_rank": _ranked,
    "scout": _scout,
    "profile": _profile,
}

_PAIR_RUN = """runs AS (SELECT min(p) AS p0, max(p) AS p1, max(p) AS p, max(us) AS us FROM (SELECT *, sum(s) OVER (ORDER BY p) AS g FROM
(SELECT *, CASE WHEN p - lag(p) OVER (ORDER BY p) <= 2 THEN 0 ELSE 1 END AS s FROM ev WHERE event_type = 'error')) GROUP BY g HAVING count(*) = 2)"""
_SUB = f"""{_FB_CTE}, v AS ({_near("(SELECT * FROM ev WHERE event_type = 'view')", _kind('r', 'view'), 'p', 2)})"""

ORACLE_SQL: dict[str, str] = {
    "fb_pos": _link("error", "click", "p", 5),
    "fb_time": _link("error", "click", "us", 30 * _MIN),
    "pb_time": _link("error", "click", "us", 30 * _MIN, False),
    "pb_pos": _link("error", "click", "p", 5, False),
    "fb_keyed": _link("error", "click", "us", 600 * _MIN, True, "l.user_id = r.user_id"),
    "pb_keyed": _link("error", "click", "us", 600 * _MIN, False, "l.user_id = r.user_id"),
    "fb_neq": _link("error", "click", "p", 5, True, "l.user_id <> r.user_id"),
    "fb_tied_orders": f"WITH {_OR}, n AS ({_near("(SELECT * FROM od WHERE o_orderstatus = 'F')", "r.o_orderstatus = 'O'", 'us', 1440 * _MIN, table='od')}) SELECT p AS p0, np AS p1 FROM n",
    "fb_orders_keyed": f"WITH {_OR}, n AS ({_near("(SELECT * FROM od WHERE o_orderpriority = '1-URGENT')", 'l.o_custkey = r.o_custkey', 'us', 20 * 7 * 1440 * _MIN, table='od')}) SELECT p AS p0, np AS p1 FROM n",
    "chain3": _CHAIN + " SELECT p0, p1, np AS p2 FROM c",
    "chain3_span": _CHAIN + f" SELECT p0, p1, np AS p2 FROM c WHERE nus - us0 <= {20 * _MIN}",
    "chain_mixed": f"""WITH {_FB_CTE}, b AS (SELECT p AS p0, np AS p1, np AS p, nus AS us FROM n), c AS ({_near('b', _kind('r', 'view'), 'us', 30 * _MIN, key='l.p0, l.p')}) SELECT p0, p1, np AS p2 FROM c""",
    "nfb": _absent("error", "click", "p", 5),
    "npb": _absent("error", "click", "us", 10 * _MIN, False),
    "nfb_keyed": _absent("error", "click", "us", 600 * _MIN, True, "l.user_id = r.user_id"),
    "nfb_neq": _absent("error", "click", "p", 3, True, "l.user_id <> r.user_id"),
    "cooccur2": _pairs("error", "click", "p", 3),
    "cooccur2_time": _pairs("error", "click", "us", 5 * _MIN),
    "cooccur3": f"""WITH {_EV} SELECT DISTINCT s[1] AS p0, s[2] AS p1, s[3] AS p2 FROM (SELECT list_sort([a.p, b.p, c.p]) AS s FROM ev a JOIN ev b ON {_kind('a', 'error')} AND {_kind('b', 'click')} AND abs(a.p - b.p) <= 4
        JOIN ev c ON {_kind('c', 'view')} AND abs(a.p - c.p) <= 4 AND abs(b.p - c.p) <= 4)""",
    "cooccur_keyed": f"WITH {_EV} SELECT DISTINCT least(l.p, r.p) AS p0, greatest(l.p, r.p) AS p1 FROM ev l JOIN ev r ON {_kind('l', 'error')} AND {_kind('r', 'click')} AND l.user_id = r.user_id AND abs(l.us - r.us) <= {120 * _MIN}",
    "quant2": f"WITH {_EV} SELECT a.p AS p0, b.p AS p1 FROM ev a JOIN ev b ON {_kind('a', 'error')} AND {_kind('b', 'error')} AND b.p > a.p AND b.p - a.p <= 4",
    "quant_2_3": f"""WITH {_EV}, e AS (SELECT p FROM ev WHERE event_type = 'error') SELECT a.p AS p0, b.p AS p1, NULL::BIGINT AS p2 FROM e a JOIN e b ON b.p > a.p AND b.p - a.p <= 4
        UNION ALL SELECT a.p, b.p, c.p FROM e a JOIN e b ON b.p > a.p AND b.p - a.p <= 4 JOIN e c ON c.p > b.p AND c.p - a.p <= 4""",
    "quant_row": f"""WITH {_EV}, e AS (SELECT p FROM ev WHERE event_type = 'error'), q AS (SELECT p FROM ev WHERE event_type = 'purchase')
        SELECT least(e.p, q.p) AS p0, greatest(e.p, q.p) AS p1, NULL::BIGINT AS p2 FROM e JOIN q ON abs(e.p - q.p) <= 3
        UNION ALL SELECT s[1], s[2], s[3] FROM (SELECT list_sort([a.p, b.p, q.p]) AS s FROM e a JOIN e b ON b.p > a.p AND b.p - a.p <= 3 JOIN q ON abs(a.p - q.p) <= 3 AND abs(b.p - q.p) <= 3)""",
    "run_time": _runs("user_id", "error", "us", 300 * _MIN, "count(*) BETWEEN 2 AND 4"),
    "run_pos": _runs("", "error", "p", 2, "count(*) >= 3"),
    "run_link": f"WITH {_EV}, {_PAIR_RUN}, n AS ({_near('runs', _kind('r', 'click'), 'p', 3)}) SELECT p0, p1, np AS p2 FROM n",
    "run_absent": f"WITH {_EV}, {_PAIR_RUN} SELECT p0, p1 FROM runs l WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'click' AND x.p > l.p AND x.p <= l.p + 3)",
    "sub_fb": f"WITH {_SUB} SELECT p0, p1, p2, p3 FROM (SELECT n.p AS p0, n.np AS p1, v.p AS p2, v.np AS p3, rank() OVER (PARTITION BY n.p ORDER BY v.p) AS k FROM n JOIN v ON v.p > n.np AND v.p <= n.np + 4) WHERE k = 1",
    "sub_nfb": f"WITH {_SUB} SELECT n.p AS p0, n.np AS p1 FROM n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.p > n.np AND v.p <= n.np + 4)",
    "sub_unordered": f"""WITH {_EV}, n AS ({_near("(SELECT * FROM ev WHERE event_type = 'error')", _kind('r', 'click'), 'p', 2)}) SELECT DISTINCT s[1] AS p0, s[2] AS p1, s[3] AS p2 FROM (SELECT list_sort([n.p, n.np, v.p]) AS s FROM n JOIN ev v ON v.event_type = 'view' AND greatest(n.np, v.p) - least(n.p, v.p) <= 3)""",
    "bool_and_or_not": f"WITH {_EV} SELECT p AS p0 FROM ev WHERE event_type IN ('error', 'click') AND user_id <> 7",
    "field_partial": f"WITH {_EV} SELECT p AS p0 FROM ev WHERE contains(props, '9}}')",
    "field_present": f"WITH {_EV} SELECT p AS p0 FROM ev WHERE value IS NOT NULL",
    "from_author": f"WITH {_EV} SELECT p AS p0 FROM ev WHERE user_id = 7",
    "before": f"WITH {_FB_CTE} SELECT p AS p0, CASE WHEN nus < epoch_us(TIMESTAMP '2024-01-03') THEN np END AS p1 FROM n WHERE us < epoch_us(TIMESTAMP '2024-01-03')",
    "after": f"""WITH {_FB_CTE}, t AS (SELECT epoch_us(TIMESTAMP '2024-01-10 12:00:00') AS t) SELECT CASE WHEN us > t THEN p ELSE np END AS p0, CASE WHEN us > t THEN np END AS p1 FROM n, t WHERE nus > t""",
    "between": f"""WITH {_FB_CTE}, t AS (SELECT epoch_us(TIMESTAMP '2024-01-03') AS a, epoch_us(TIMESTAMP '2024-01-05') AS b), f AS (SELECT p, np, us BETWEEN a AND b AS x, nus BETWEEN a AND b AS y FROM n, t)
        SELECT CASE WHEN x THEN p ELSE np END AS p0, CASE WHEN x AND y THEN np END AS p1 FROM f WHERE x OR y""",
    "lone_time": f"WITH {_EV} SELECT p AS p0 FROM ev WHERE user_id = 7 AND us IS NOT NULL",
    "agg_count": f"WITH {_FB_CTE} SELECT count(*)::BIGINT AS value FROM n",
    "agg_count_distinct": f"WITH {_FB_CTE} SELECT count(DISTINCT e.user_id)::BIGINT AS value FROM n JOIN ev e ON e.p IN (n.p, n.np)",
    "agg_sum": f"WITH {_FB_CTE} SELECT round(sum(value), 4) AS value FROM ev WHERE p IN (SELECT p FROM n UNION SELECT np FROM n)",
    "agg_avg": f"WITH {_FB_CTE} SELECT round(avg(value), 4) AS value FROM ev WHERE p IN (SELECT p FROM n UNION SELECT np FROM n)",
    "agg_min": f"WITH {_FB_CTE} SELECT round(min(value), 4) AS value FROM ev WHERE p IN (SELECT p FROM n UNION SELECT np FROM n)",
    "agg_max_by_user": f"WITH {_FB_CTE} SELECT n.user_id::VARCHAR AS key, round(max(e.value), 4) AS value FROM n JOIN ev e ON e.p IN (n.p, n.np) GROUP BY 1",
    "agg_distinct": f"WITH {_FB_CTE} SELECT string_agg(event_type, ',' ORDER BY event_type) AS value FROM (SELECT DISTINCT e.event_type FROM n JOIN ev e ON e.p IN (n.p, n.np))",
    "group_day": f"WITH {_FB_CTE} SELECT strftime(ts, '%Y-%m-%d') AS key, count(*)::BIGINT AS value FROM n GROUP BY 1",
    "group_week": f"WITH {_FB_CTE} SELECT strftime(ts, '%G-W%V') AS key, count(*)::BIGINT AS value FROM n GROUP BY 1",
    "group_hour": f"WITH {_EV} SELECT strftime(ts, '%Y-%m-%d %H:00') AS key, count(*)::BIGINT AS value FROM ev WHERE event_type = 'error' GROUP BY 1",
    "group_fields": f"WITH {_FB_CTE} SELECT event_type || '|' || strftime(ts, '%Y-%m-%d') AS key, count(*)::BIGINT AS n FROM n GROUP BY 1",
    "order_limit": f"WITH {_FB_CTE} SELECT p AS p0, np AS p1 FROM n ORDER BY value DESC, event_type DESC, p LIMIT 20 OFFSET 5",
    "limit_natural": f"WITH {_FB_CTE} SELECT p AS p0, np AS p1 FROM n ORDER BY p LIMIT 15 OFFSET 3",
    "tokens": f"WITH {_DOC} SELECT p AS p0 FROM d WHERE list_has_any({_TOK}, ['idiot', 'moron'])",
    "dictionary": f"WITH {_DOC} SELECT p AS p0 FROM d WHERE list_has_any({_TOK}, ['the', 'la', 'der']) AND NOT list_has_any({_TOK}, ['idiot', 'moron'])",
    "substring": f"WITH {_DOC} SELECT p AS p0 FROM d WHERE contains(lower(text), 'tion') OR contains(lower(text), 'licensed')",
    "phrase": f"WITH {_DOC} SELECT p AS p0 FROM d WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' under the apache ')",
    "stem": f"WITH {_DOC} SELECT p AS p0 FROM d WHERE list_has_any({_TOK}, {_STEMS})",
    "link": f"WITH {_PAGE} SELECT p AS p0 FROM g WHERE regexp_matches(text, '(?i)https?://\\S')",
    "no_link": f"WITH {_PAGE} SELECT p AS p0 FROM g WHERE NOT coalesce(regexp_matches(text, '(?i)https?://\\S'), false)",
    "entity": f"WITH {_DOC} SELECT p AS p0 FROM d WHERE contains(text, 'Apache') OR regexp_matches(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')",
    "entity_not": f"WITH {_DOC} SELECT p AS p0 FROM d WHERE NOT regexp_matches(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND list_has_any({_TOK}, ['the', 'la', 'der'])",
    "mentioned": f"WITH {_TURN} SELECT p AS p0 FROM c WHERE turn % 3 = 1 AND EXISTS (SELECT 1 FROM c WHERE role = 'assistant')",
    "mention_link": f"""WITH {_TURN}, l AS (SELECT p, CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' END AS y FROM c),
        n AS (SELECT l.p, r.p AS np, row_number() OVER (PARTITION BY l.p ORDER BY r.p) AS k FROM l JOIN c r ON r.role = l.y AND r.p > l.p AND r.p <= l.p + 3) SELECT p AS p0, np AS p1 FROM n WHERE k = 1""",
    "any_text": f"WITH {_TURN} SELECT p AS p0 FROM c WHERE role = 'user'",
    "own_equal": f"WITH {_TURN} SELECT p AS p0 FROM c WHERE turn = conv_id",
    "own_differ": f"WITH {_TURN} SELECT p AS p0 FROM c WHERE turn <> conv_id",
    "default_window": f"WITH {_EV} SELECT DISTINCT least(l.p, r.p) AS p0, greatest(l.p, r.p) AS p1 FROM ev l JOIN ev r ON {_kind('l', 'purchase')} AND {_kind('r', 'error')} AND l.user_id = 7 AND r.user_id = 7 AND abs(l.p - r.p) <= 70",
    "named_row": _pairs("error", "click", "p", 2),
    "pipe_run": _runs("user_id", "error", "us", 300 * _MIN, "count(*) BETWEEN 2 AND 4"),
    "ago": f"WITH {_FB_CTE}, t AS (SELECT {_NOW} - 10 * 86400000000 AS t) SELECT CASE WHEN us > t THEN p ELSE np END AS p0, CASE WHEN us > t THEN np END AS p1 FROM n, t WHERE nus > t",
    "group_month": f"WITH {_OR} SELECT strftime(o_orderdate, '%Y-%m') AS key, count(*)::BIGINT AS value FROM od WHERE o_orderstatus = 'F' GROUP BY 1",
    "group_year": f"WITH {_OR} SELECT strftime(o_orderdate, '%Y') AS key, count(*)::BIGINT AS value FROM od WHERE o_orderstatus = 'F' GROUP BY 1",
    "agg_first_time": f"WITH {_OR} SELECT strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS value FROM od WHERE o_orderpriority = '1-URGENT'",
    "agg_last_time": f"WITH {_OR} SELECT o_orderstatus AS key, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS value FROM od WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
    "similar_count": """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
        SELECT count(*)::BIGINT AS total FROM embeddings, q WHERE list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE)) >= 0.1""",
    "question": rf"""WITH {_DOC} SELECT p AS p0 FROM d WHERE regexp_matches(text, '\?($|[\s)\]}}"''»”’.,;:!?])')
        OR regexp_matches(lower(trim(text)), '^(what|who|when|where|why|how|which|can|could|would|should|do|does|did|is|are|was|were|will) ')""",
    "feature": f"WITH {_DOC} SELECT p AS p0 FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "turns_chain": f"WITH {_TURN} SELECT l.p AS p0, r.p AS p1 FROM c l JOIN c r ON r.p = l.p + 1 AND l.role = 'user' AND r.role = 'assistant'",
    "similar": """WITH v AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings), q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
        SELECT p AS p0 FROM v, q WHERE list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE)) >= 0.2""",
    "similar_rank": """WITH v AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings), q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
        SELECT p AS position, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE)), 6) AS score FROM v, q ORDER BY 2 DESC, 1 LIMIT 20""",
    "profile": """WITH x AS (SELECT 'event_type' AS field, 'string' AS type, event_type::VARCHAR AS v FROM events UNION ALL SELECT 'user_id', 'bigint', user_id::VARCHAR FROM events UNION ALL SELECT 'value', 'double', value::VARCHAR FROM events),
        c AS (SELECT field, v, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, v) AS k FROM x WHERE v IS NOT NULL GROUP BY field, v)
        SELECT x.field, any_value(x.type) AS type, round(count(v)::DOUBLE / count(*), 6) AS coverage, CASE WHEN any_value(d.n) <= 1000 THEN any_value(d.n) END::BIGINT AS n_distinct, any_value(d.top) AS top
        FROM x JOIN (SELECT field, count(*) AS n, string_agg(v || '=' || n, ',' ORDER BY k) FILTER (WHERE k <= 10) AS top FROM c GROUP BY field) d ON x.field = d.field GROUP BY x.field""",
    "scout": f"""WITH {_DOC}, w AS (SELECT p, {_TOK} AS w FROM d),
        s AS (SELECT p, len(w) AS n, len(list_filter(w, lambda x: x = 'licensed')) AS f0, len(list_filter(w, lambda x: x = 'apache')) AS f1 FROM w),
        st AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM s),
        r AS (SELECT p, ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM s, st WHERE f0 > 0 OR f1 > 0)
        SELECT p AS position, round(score, 6) AS score FROM r ORDER BY r.score DESC, p LIMIT 10""",
}
