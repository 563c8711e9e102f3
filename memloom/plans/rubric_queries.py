"""Rubric and matrix queries. Events are judgements: users are units, event types rubrics, values scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix as X
from ..operators import rubric as R
from .registry import duck_values, inline, query, table
from .text_queries import content_sql

_DEFS = [("click", 2.0, False), ("purchase", 3.0, True), ("error", 1.0, False), ("signup", 1.5, True), ("missing", 0.5, False)]
_DEFS_SQL = duck_values(_DEFS, "rubric, weight, is_gate")

def definitions(spark: SparkSession) -> DataFrame:
    return inline(spark, _DEFS, "rubric string, weight double, is_gate boolean")


def judged(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = F.col("event_id") % 7
    said = F.element_at(F.array(*[F.lit(x) for x in ("true", "1.0", "junk", "-0.5", "1.7", "0.5", "0.25")]), (n + 1).cast("int"))
    return e.select("user_id", F.col("event_type").alias("rubric"), F.col("event_id").alias("pos"), said.alias("score"))


_RAW = "raw AS (SELECT user_id, event_type AS rubric, arg_min(['true','1.0','junk','-0.5','1.7','0.5','0.25'][event_id % 7 + 1], event_id) AS said FROM events GROUP BY ALL)"
_GRID = f"{_RAW}, grid AS (SELECT u.user_id, d.rubric, d.weight, d.is_gate, raw.said FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN {_DEFS_SQL} d LEFT JOIN raw ON raw.user_id = u.user_id AND raw.rubric = d.rubric)"
_CLAMP = "round(least(greatest(coalesce(try_cast(said AS DOUBLE), 0), 0), 1), 4)"


@query(f"WITH {_GRID} SELECT user_id, round(avg(CASE WHEN lower(trim(said)) IN ('1', '1.0', 'true') THEN 1.0 ELSE 0.0 END), 4) AS score FROM grid GROUP BY 1")
def rubric_binary(spark: SparkSession, d: str) -> DataFrame:
    raw = judged(spark, d)
    return R.binary_scores(raw, definitions(spark), raw, ["user_id"])


@query(f"WITH {_GRID} SELECT user_id, round(avg(CASE WHEN coalesce(try_cast(said AS DOUBLE), 0) <= 0.25 THEN 0.0 WHEN try_cast(said AS DOUBLE) < 0.75 THEN 0.5 ELSE 1.0 END), 4) AS score FROM grid GROUP BY 1")
def rubric_trilevel(spark: SparkSession, d: str) -> DataFrame:
    raw = judged(spark, d)
    return R.trilevel_scores(raw, definitions(spark), raw, ["user_id"])


@query(f"WITH {_GRID}, s AS (SELECT *, {_CLAMP} AS s FROM grid), m AS (SELECT user_id, round(sum(weight * s) / sum(weight), 4) AS mean, coalesce(min(CASE WHEN is_gate THEN s END) <= CAST(0.3 AS DOUBLE), false) AS shut FROM s GROUP BY 1) SELECT user_id, CASE WHEN shut THEN least(mean, CAST(0.4 AS DOUBLE)) ELSE mean END AS score FROM m")
def rubric_weighted_cap(spark: SparkSession, d: str) -> DataFrame:
    raw = judged(spark, d)
    return R.weighted_capped(raw, definitions(spark), raw, ["user_id"])


@query(f"WITH {_GRID}, s AS (SELECT user_id, rubric, {_CLAMP} AS s FROM grid) SELECT user_id, max(CASE rubric WHEN 'click' THEN s END) AS click, max(CASE rubric WHEN 'purchase' THEN s END) AS purchase, max(CASE rubric WHEN 'missing' THEN s END) AS missing FROM s GROUP BY 1")
def rubric_pivot(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.scores import clamp

    raw = judged(spark, d)
    rows = R.complete(raw, definitions(spark), raw, ["user_id"], clamp(F.col("score")))
    return R.pivoted(rows, ["user_id"], "rubric", "score", ["click", "purchase", "missing"])


@query("SELECT * FROM (SELECT lang AS model, round(avg(n_chars), 4) AS mean, count(*) AS units FROM documents GROUP BY 1 UNION ALL SELECT '', round(avg(n_chars), 4), count(*) FROM documents)")
def model_means(spark: SparkSession, d: str) -> DataFrame:
    return R.model_means(table(spark, d, "documents").withColumnRenamed("lang", "model"), "model", "n_chars")


@query("SELECT source, round(CASE WHEN count(*) > 0 THEN (avg(CASE WHEN lang = 'en' THEN n_chars::DOUBLE ELSE 0 END) * count(*) FILTER (WHERE lang = 'en') + avg(n_chars::DOUBLE) * count(*) FILTER (WHERE lang <> 'en')) / count(*) ELSE 0 END, 4) AS combined FROM documents GROUP BY 1")
def bucket_combine(spark: SparkSession, d: str) -> DataFrame:
    fact = F.col("lang") == "en"
    g = table(spark, d, "documents").groupBy("source").agg(F.avg(F.when(fact, F.col("n_chars").cast("double")).otherwise(0.0)).alias("a"), F.count_if(fact).alias("n"), F.avg(F.col("n_chars").cast("double")).alias("b"), F.count_if(~fact).alias("m"))
    return g.select("source", F.round(R.count_weighted(F.col("a"), F.col("n"), F.col("b"), F.col("m")), 4).alias("combined"))


@query("""WITH x AS (SELECT user_id, avg(value) AS aux FROM events WHERE event_type = 'view' GROUP BY 1), p AS (SELECT user_id, avg(value) AS p FROM events WHERE event_type = 'click' GROUP BY 1), r AS (SELECT user_id, avg(value) AS r FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT x.user_id, round((coalesce(p, 0) + coalesce(r, 1) + aux) / 3, 4) AS score FROM x LEFT JOIN p ON x.user_id = p.user_id LEFT JOIN r ON x.user_id = r.user_id""")
def hybrid_prf(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind: table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", F.col("value").alias("score"))
    return R.precision_recall_mean(of("click"), of("purchase"), of("view"), ["user_id"]).select("user_id", "score")


@query("""SELECT user_id, round(count(*) FILTER (WHERE event_type = 'click') / count(*)::DOUBLE * CASE WHEN count(*) FILTER (WHERE event_type IN ('view', 'error')) > 0 THEN greatest(0.0, (count(*) FILTER (WHERE event_type IN ('view', 'error')) - count(*) FILTER (WHERE event_type = 'error')) / (count(*) FILTER (WHERE event_type IN ('view', 'error')))::DOUBLE) ELSE 1.0 END, 4) AS score FROM events GROUP BY 1""")
def strict_prf(spark: SparkSession, d: str) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    g = table(spark, d, "events").groupBy("user_id").agg(n("click").alias("passed"), F.count(F.lit(1)).alias("checks"), n("error").alias("missing"), n("view", "error").alias("total"))
    return g.select("user_id", R.strict_score(F.col("passed"), F.col("checks"), F.col("missing"), F.col("total")).alias("score"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Events as memory snapshots: the day is the session, the user's event types the memory ids."""
    e = table(spark, d, "events").groupBy(F.pmod("user_id", F.lit(50)).alias("user_id"), F.dayofyear("ts").alias("session"), F.col("event_type").alias("id"))
    return e.agg(F.count(F.lit(1)).cast("string").alias("text"), F.lit("ADD").alias("event"), F.lit("").alias("anchor_time"))


_SNAP = "s AS (SELECT user_id % 50 AS user_id, dayofyear(ts) AS session, event_type AS id, count(*)::VARCHAR AS text FROM events GROUP BY ALL)"


@query(f"""WITH {_SNAP}, k AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY session) AS place FROM s)
SELECT a.user_id, a.session, a.id, CASE WHEN b.id IS NULL THEN 'new' ELSE 'changed' END AS change FROM k a LEFT JOIN k b ON a.user_id = b.user_id AND a.id = b.id AND b.place = a.place - 1 WHERE b.id IS NULL OR a.text <> b.text""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return R.snapshot_diff(snapshots(spark, d))


@query(f"WITH {_SNAP} SELECT user_id, session, id, text FROM s WHERE session = (SELECT max(session) FROM s t WHERE t.user_id = s.user_id)")
def final_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return R.final_snapshot(snapshots(spark, d)).select("user_id", "session", "id", "text")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY ALL")
def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_runs(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "props"), ["user_id", "event_type"], "event_id")


_ITEM_DEFS = [("en", "r1"), ("en", "r2"), ("de", "r1"), ("fr", "r3")]


@query(f"""WITH i AS (SELECT source AS model, lang AS type, doc_id AS item FROM documents), f AS (SELECT source AS model, doc_id AS item, 'r' || (doc_id % 3 + 1) AS rubric, doc_id % 4 <> 0 AS evaluable, (doc_id % 10)::DOUBLE / 8 AS score FROM documents)
SELECT i.model, i.type, d.rubric, count(*) AS objects, count(*) FILTER (WHERE coalesce(evaluable, false)) AS evaluable, coalesce(round(avg(CASE WHEN coalesce(evaluable, false) THEN least(greatest(score, 0), 1) END), 4), -1) AS mean FROM i JOIN {duck_values(_ITEM_DEFS, 'type, rubric')} d ON i.type = d.type LEFT JOIN f ON f.model = i.model AND f.item = i.item AND f.rubric = d.rubric GROUP BY ALL""")
def item_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    items = docs.select(F.col("source").alias("model"), F.col("lang").alias("type"), F.col("doc_id").alias("item"))
    one = docs.select(F.col("source").alias("model"), F.col("doc_id").alias("item"), F.concat(F.lit("r"), (F.col("doc_id") % 3 + 1).cast("string")).alias("rubric"), (F.col("doc_id") % 4 != 0).alias("evaluable"), ((F.col("doc_id") % 10).cast("double") / 8).cast("string").alias("score"))
    raw = one.withColumn("pos", F.lit(0)).unionByName(one.withColumns({"pos": F.lit(1), "score": F.lit("0.0")}))
    return R.item_scores(items, inline(spark, _ITEM_DEFS, "type string, rubric string"), raw).withColumn("mean", F.coalesce("mean", F.lit(-1.0)))


_FACTS = [("s1", 1, "F9", "she moved", "event", None), ("s1", 2, " ", "he stayed ", "", "high"), ("s1", 3, None, "  ", None, None), ("s2", 1, None, "x", None, "")]


@query(f"""SELECT unit, pos, coalesce(nullif(trim(id), ''), 'F' || pos) AS id, trim(text) AS text, coalesce(nullif(trim(category), ''), 'other') AS category, coalesce(nullif(trim(importance), ''), 'medium') AS importance FROM {duck_values(_FACTS, 'unit, pos, id, text, category, importance')} WHERE trim(text) <> ''""")
def salient_facts(spark: SparkSession, d: str) -> DataFrame:
    return R.salient_facts(inline(spark, _FACTS, "unit string, pos int, id string, text string, category string, importance string"))


@query(f"""WITH w AS (SELECT g, word, count(*) AS tf FROM (SELECT conv_id AS g, unnest({content_sql('text')}) AS word FROM conversations WHERE turn % 2 = 0) GROUP BY ALL), n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations WHERE turn % 2 = 0), s AS (SELECT word, count(*) AS df FROM w GROUP BY 1),
r AS (SELECT g, w.word, row_number() OVER (PARTITION BY g ORDER BY round(tf * ln((n + 1) / (df + 1)::DOUBLE), 6) DESC, w.word) AS r FROM w JOIN s ON w.word = s.word CROSS JOIN n), h AS (SELECT DISTINCT conv_id AS g, unnest({content_sql('text')}) AS word FROM conversations WHERE turn % 2 = 1)
SELECT r.g AS conv_id, count(*) AS keywords, count(h.word) AS covered FROM r LEFT JOIN h ON r.g = h.g AND r.word = h.word WHERE r <= 10 GROUP BY 1""")
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "group")
    return R.keyword_coverage(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"), 10).withColumnRenamed("group", "conv_id")


_MODELS, _BACKENDS = [("m1",), ("m2",), ("m3",)], [("rag",), ("llm",)]


def runs_sql(models: str) -> str:
    return f"""a AS (SELECT model, unnest([1, 2]) AS repeat FROM {models}),
runs AS (SELECT model, repeat, '' AS backend, 0 AS search_repeat, true AS is_add, model || '_add' || lpad(repeat::VARCHAR, 2, '0') AS run_id FROM a
UNION ALL SELECT model, repeat, backend, s, false, model || '_add' || lpad(repeat::VARCHAR, 2, '0') || '_' || backend || '_s' || lpad(s::VARCHAR, 2, '0') FROM a, {duck_values(_BACKENDS, 'backend')}, (SELECT unnest([1, 2, 3]) AS s))"""


_RUNS_SQL = runs_sql(duck_values(_MODELS, "model"))


def runs(spark: SparkSession) -> DataFrame:
    return X.plan_runs(inline(spark, _MODELS, "model string"), inline(spark, _BACKENDS, "backend string"), 2, 3)


@query(f"WITH {_RUNS_SQL} SELECT * FROM runs")
def plan_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark)


@query("SELECT * FROM (VALUES ('raw_add', '', true), ('raw_rag', 'rag', false), ('raw_llm', 'llm', false)) AS v(run_id, backend, is_add)")
def plan_raw_runs(spark: SparkSession, d: str) -> DataFrame:
    return X.plan_raw_runs(spark, inline(spark, _BACKENDS, "backend string"))


@query(f"WITH {_RUNS_SQL}, p AS (SELECT run_id, repeat, unnest(CASE WHEN is_add THEN ['add'] ELSE ['search', 'answer', 'eval', 'score'] END) AS phase FROM runs) SELECT run_id, phase, repeat * 10 + CASE WHEN phase = 'add' THEN 1 WHEN phase IN ('search', 'answer') THEN 2 ELSE 3 END AS wave FROM p")
def run_waves(spark: SparkSession, d: str) -> DataFrame:
    return X.waves(runs(spark)).select("run_id", "phase", "wave")


@query("SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS click, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS view, arg_max(value, event_id) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"), F.col("value").alias("elapsed_s"), F.col("event_id").alias("finished_at"))
    return X.timing_summary(t, ("click", "view", "error")).withColumnRenamed("run_id", "user_id")


@query(f"""WITH {runs_sql("(SELECT DISTINCT 'm' || user_id AS model FROM events)")}, v AS (SELECT 'm' || user_id AS model, min(value) AS low, max(value) AS high FROM events GROUP BY 1) SELECT run_id, CASE WHEN repeat = 1 THEN low END AS llm_score, high AS search FROM runs JOIN v ON runs.model = v.model WHERE NOT is_add""")
def final_scores(spark: SparkSession, d: str) -> DataFrame:
    """Users are models; their least value stands for the score of the first repeat, their largest for the seconds of a search."""
    e = table(spark, d, "events").groupBy(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    r = X.plan_runs(e.select("model"), inline(spark, _BACKENDS, "backend string"), 2, 3)
    rated = r.join(e, "model")
    summaries = rated.where("repeat = 1").select("run_id", F.lit("overall").alias("scope"), F.lit("llm_score").alias("metric"), F.col("low").alias("mean"))
    timings = rated.select("run_id", F.col("high").alias("search"))
    return X.final_scores(r, summaries, timings).select("run_id", "llm_score", "search")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    return X.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id % 7 AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(X.shard(F.col("doc_id"), 7).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


_CALLS = [(1, 429, ""), (2, 200, "ok"), (3, None, "Read Timed Out"), (4, 404, "missing"), (5, None, None), (6, 503, "x")]


@query(f"SELECT id, coalesce(status IN (402, 403, 408, 409, 429, 500, 502, 503, 504), false) OR regexp_matches(lower(coalesce(message, '')), 'timeout|timed out|connection|rate limit|overloaded') AS retry FROM {duck_values(_CALLS, 'id, status, message')}")
def retryable_errors(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, _CALLS, "id int, status int, message string").select("id", X.is_retryable(F.col("status"), F.col("message")).alias("retry"))


@query("""SELECT count(*) AS records, count(*) FILTER (WHERE quality IS NOT NULL) AS searched, count(*) FILTER (WHERE quality IS NOT NULL AND d.doc_id % 3 > 0) AS answered, count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL OR d.doc_id % 3 = 0) AS to_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def resume_state(spark: SparkSession, d: str) -> DataFrame:
    """Which records each stage has still to do: a label stands for a retrieval block, two of three are answered."""
    r = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    searched = X.has_retrieval(F.col("quality"), F.lit(None), F.lit(None), F.lit(None).cast("boolean"))
    answered = searched & X.has_answer(F.when(F.col("doc_id") % 3 > 0, F.lit("a")))
    scored = answered & X.has_scores(F.col("quality"), F.col("toxic"))
    return r.agg(F.count(F.lit(1)).alias("records"), F.count_if(searched).alias("searched"), F.count_if(answered).alias("answered"), F.count_if(~scored).alias("to_score"))


@query(f"WITH {_RUNS_SQL} SELECT run_id FROM runs WHERE model = 'm2' AND (is_add OR backend = 'rag') AND repeat = 1")
def run_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.filter_runs(runs(spark), model="m2", backend="rag", repeat=1).select("run_id")


@query("WITH c AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS idx, count(*) OVER () AS n FROM c) SELECT conv_id FROM r WHERE idx < greatest(1, n // 2)")
def first_half(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evaluation import row_numbers

    units = row_numbers(table(spark, d, "conversations").select("conv_id").distinct(), "conv_id").withColumnRenamed("rn", "idx")
    return X.first_half(units, "idx").select("conv_id")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_add, count(*) FILTER (WHERE event_type = 'view') AS n_update, count(*) FILTER (WHERE event_type = 'error') AS n_none, count(*) FILTER (WHERE event_type = 'signup') AS n_ignored_delete FROM events GROUP BY 1")
def delta_statistics(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.memory import delta_statistics as count_events

    names = F.create_map(*[F.lit(x) for kv in (("click", "add"), ("view", "UPDATE"), ("error", "none"), ("signup", "DELETE")) for x in kv])
    return count_events(table(spark, d, "events").select("user_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("?")).alias("event")))
