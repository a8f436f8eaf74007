"""Queries over the supplied tables, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import features as X
from ledgerline.functions import kernels as K
from ledgerline.functions import text as T
from ledgerline.operators import aggregate as A
from ledgerline.operators import oracle as O
from ledgerline.operators import router as R
from ledgerline.operators import stats as S
from ledgerline.operators import sweep as P
from ledgerline.operators import validate as V
from ledgerline.sources.panel import PANEL_SQL, all_records, panel, table

QUERIES: dict = {}
SQL: dict = {}
CONFIGS = [f"C{i}" for i in range(6)]
WITH = f"WITH RECURSIVE {PANEL_SQL}"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


ISO = """base AS (SELECT *, max(CASE WHEN cfg_ord = 0 THEN score END) OVER (PARTITION BY key) AS base FROM panel),
ok AS (SELECT *, score >= {tau} * base AS ok FROM base WHERE cfg_ord >= {least}),
any_ok AS (SELECT *, max(ok::INT) OVER (PARTITION BY key) = 1 AS has_ok, list_sort(list(configuration) FILTER (ok) OVER (PARTITION BY key)) AS eligible0 FROM ok),
iso AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ok DESC, CASE WHEN has_ok THEN 0.0 ELSE score END DESC, compression DESC, cfg_ord) AS r FROM any_ok) WHERE r = 1)"""
ISO99 = ISO.format(tau=0.99, least=1)


# --- oracles -----------------------------------------------------------------


@query(f"""{WITH}, {ISO99}
SELECT task, configuration, NOT has_ok AS fallback, count(*) AS n, round(avg(score), 6) AS q, round(count(*) / sum(1 / compression), 6) AS cr FROM iso GROUP BY ALL""")
def oracle_iso_summary(spark: SparkSession, sf: str) -> DataFrame:
    best = O.iso_quality(panel(spark, sf))
    return rounded(best.groupBy("task", "configuration", "fallback").agg(F.count("*").alias("n"), F.avg("score").alias("q"), A.harmonic("compression").alias("cr")))


@query(f"""{WITH}, best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, compression DESC, cfg_ord) AS r FROM panel WHERE cfg_ord >= 1)
SELECT key, task, configuration, round(score, 6) AS score, round(compression, 6) AS compression FROM best WHERE r = 1""")
def oracle_quality_first(spark, sf):
    return rounded(O.quality_first(panel(spark, sf)).select("key", "task", "configuration", "score", "compression"))


@query(f"""{WITH}, best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, cfg_ord) AS r FROM panel WHERE cfg_ord >= 1)
SELECT configuration, count(*) AS n FROM best WHERE r = 1 GROUP BY configuration""")
def oracle_quality_order_ties(spark, sf):
    return O.quality_first(panel(spark, sf), ties="order").groupBy("configuration").agg(F.count("*").alias("n"))


CHOSEN = ", ".join(f"{'round(' if f != 'configuration' else ''}{t}.{f}{', 6)' if f != 'configuration' else ''} AS {name}_{f}" for t, name in (("iso", "primary"), ("best", "quality")) for f in ("configuration", "score", "kv_bytes", "kv_bytes_fp16", "compression"))


@query(f"""{WITH}, {ISO99}, best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, compression DESC, cfg_ord) AS r FROM panel WHERE cfg_ord >= 1)
SELECT iso.key, iso.task, {CHOSEN}, NOT has_ok AS primary_fallback, round(0.99 * base, 6) AS threshold, iso.score < 0.99 * base AS below_threshold, coalesce(array_to_string(eligible0, '+'), '') AS eligible
FROM iso JOIN best ON iso.key = best.key AND best.r = 1""")
def oracle_attach(spark, sf):
    rows = O.attach(panel(spark, sf)).withColumn("eligible", F.array_join("eligible", "+"))
    return rounded(rows.select(*(F.col(c).cast("double").alias(c) if "kv_bytes" in c else F.col(c) for c in rows.columns)))


@query(f"""{WITH}, {ISO99}, t AS (SELECT category, task, avg(score) AS q, count(*) / sum(1 / compression) AS h FROM iso GROUP BY ALL), c AS (SELECT category, avg(q) AS q, avg(h) AS h FROM t GROUP BY ALL)
SELECT round((SELECT avg(q) FROM c), 6) AS macro, round(avg(score), 6) AS micro, count(*) AS n, round(count(*) / sum(1 / compression), 6) AS harmonic, round((SELECT avg(h) FROM c), 6) AS category_balanced,
  count(*) FILTER (NOT has_ok) AS fallback_count, round(avg((NOT has_ok)::INT), 6) AS fallback_fraction, count(*) FILTER (has_ok) AS nonfallback_count, count(*) FILTER (has_ok AND score < 0.99 * base) AS violation_count,
  round(coalesce(count(*) FILTER (has_ok AND score < 0.99 * base) / nullif(count(*) FILTER (has_ok), 0), 0), 6)::DOUBLE AS violation_fraction, {", ".join(f"count(*) FILTER (configuration = 'C{i}') AS selected_C{i}" for i in range(1, 6))} FROM iso""")
def oracle_summary(spark, sf):
    return rounded(O.oracle_summary(panel(spark, sf)))


def _labels_sql(tau: float) -> str:
    return f"(SELECT key, configuration FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ok DESC, compression DESC, cfg_ord) AS r FROM (SELECT *, score >= {tau} * base AS ok FROM b)) WHERE r = 1)"


@query(f"""{WITH}, b AS (SELECT *, max(CASE WHEN cfg_ord = 0 THEN score END) OVER (PARTITION BY key) AS base FROM panel),
q AS (SELECT key, task, configuration FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, cfg_ord) AS r FROM panel) WHERE r = 1)
SELECT q.key, q.task, q.configuration AS best_quality, i99.configuration AS iso_99, i95.configuration AS iso_95, i90.configuration AS iso_90
FROM q JOIN {_labels_sql(0.99)} i99 ON q.key = i99.key JOIN {_labels_sql(0.95)} i95 ON q.key = i95.key JOIN {_labels_sql(0.90)} i90 ON q.key = i90.key""")
def dataset_labels(spark, sf):
    return O.dataset_labels(panel(spark, sf))


@query(f"{WITH} SELECT configuration, round(avg(score), 6) AS q FROM panel WHERE cfg_ord >= 1 GROUP BY configuration ORDER BY avg(score) DESC, configuration LIMIT 1")
def best_fixed(spark, sf):
    return rounded(O.best_fixed(panel(spark, sf)))


@query(f"{WITH}, i AS (SELECT key, avg(score) AS q, avg(1 / compression) AS inv FROM panel WHERE cfg_ord >= 1 GROUP BY key) SELECT round(avg(q), 6) AS q, round(count(*) / sum(inv), 6) AS cr, count(*) AS n FROM i")
def random_router(spark, sf):
    return rounded(O.random_router(panel(spark, sf)))


# --- rollups -----------------------------------------------------------------

ROLLUP = """t AS (SELECT configuration, category, task, avg(score) AS q, count(*) / sum(1 / compression) AS h FROM panel GROUP BY ALL),
c AS (SELECT configuration, category, avg(q) AS q, avg(h) AS h FROM t GROUP BY ALL)"""


@query(f"""{WITH}, {ROLLUP}, m AS (SELECT configuration, avg(score) AS micro, count(*) AS n, count(*) / sum(1 / compression) AS harmonic FROM panel GROUP BY ALL)
SELECT configuration, round(avg(c.q), 6) AS macro, round(any_value(micro), 6) AS micro, any_value(n) AS n, round(any_value(harmonic), 6) AS harmonic, round(avg(c.h), 6) AS category_balanced FROM c JOIN m USING (configuration) GROUP BY configuration""")
def configuration_summary(spark, sf):
    return rounded(A.summary(panel(spark, sf), "configuration"))


@query(f"""{WITH}, {ISO99}, t AS (SELECT category, task, avg(score) AS q, count(*) / sum(1 / compression) AS h FROM iso GROUP BY ALL), c AS (SELECT category, avg(q) AS q, avg(h) AS h FROM t GROUP BY ALL)
SELECT round((SELECT avg(q) FROM c), 6) AS macro, round(avg(score), 6) AS micro, count(*) AS n, round(count(*) / sum(1 / compression), 6) AS harmonic, round((SELECT avg(h) FROM c), 6) AS category_balanced FROM iso""")
def oracle_rollup(spark, sf):
    return rounded(A.summary(O.iso_quality(panel(spark, sf))))


@query(f"{WITH} SELECT configuration, round(avg(kv_bytes_fp16) / avg(kv_bytes), 6) AS ratio_of_means, round(sum(kv_bytes_fp16) / sum(kv_bytes), 6) AS ratio_of_sums, round(count(*) / sum(1 / compression), 6) AS harmonic FROM panel GROUP BY configuration")
def compression_bases(spark, sf):
    return rounded(A.bases(panel(spark, sf), "configuration"))


@query(f"{WITH} SELECT task, round(avg(score), 4) AS q, round(count(*) / sum(1 / compression), 3) AS cr, count(*) AS n FROM panel WHERE cfg_ord = 1 GROUP BY task")
def task_report(spark, sf):
    return A.task_report(panel(spark, sf).filter("cfg_ord = 1"))


PICKS = ", ".join(f"count(*) FILTER (configuration = '{c}') AS picks_{c}" for c in CONFIGS[1:])


@query(f"""{WITH}, {ISO99}
SELECT CASE WHEN grouping(task) = 1 THEN 'overall' ELSE task END AS task, round(avg(score), 6) AS q, round(count(*) / sum(1 / compression), 6) AS cr, count(*) AS n, {PICKS} FROM iso GROUP BY ROLLUP (task)""")
def picks_report(spark, sf):
    return A.picks_report(O.iso_quality(panel(spark, sf)), CONFIGS[1:], (6, 6))



@query(f"{WITH} SELECT configuration, round(avg(score), 6) AS q, round(count(*) / sum(1 / compression), 6) AS cr, count(*) AS n FROM panel GROUP BY configuration")
def fixed_configurations(spark, sf):
    return rounded(A.fixed_configurations(panel(spark, sf)))


@query(f"{WITH} SELECT configuration, round(avg(score), 6) AS q, round(count(*) / sum(1 / compression), 6) AS cr, count(*) AS n FROM panel WHERE key IN (SELECT p_partkey FROM part WHERE p_size <= 15) GROUP BY configuration")
def fixed_on_subset(spark, sf):
    return rounded(A.fixed_configurations(panel(spark, sf), table(spark, sf, "part").filter("p_size <= 15").select(F.col("p_partkey").alias("key"))))


@query(f"""{WITH}, {ISO99} SELECT t.task, c.configuration, count(iso.key) AS n FROM (SELECT DISTINCT task FROM iso) t CROSS JOIN (SELECT DISTINCT configuration FROM panel) c
LEFT JOIN iso ON iso.task = t.task AND iso.configuration = c.configuration GROUP BY t.task, c.configuration""")
def selection_counts(spark, sf):
    labels = panel(spark, sf)
    return A.selection_counts(O.iso_quality(labels), labels)


@query(f"""{WITH}, {ISO99} SELECT count(*) AS n, round(avg((score < 0.99 * base)::INT), 6) AS below_tau, round(avg((score < base)::INT), 6) AS below_base, round(avg(score - base), 6) AS mean_delta FROM iso""")
def violation_rates(spark, sf):
    labels = panel(spark, sf)
    return rounded(A.violations(O.iso_quality(labels), labels.filter("cfg_ord = 0"), 0.99))


@query("""SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99,
max(n_chars) AS longest, CAST(sum((n_chars > 4000)::INT) AS BIGINT) AS truncated, round(sum(least(n_chars, 4000)) / sum(n_chars), 6) AS retained FROM documents GROUP BY lang""")
def length_profile(spark, sf):
    return rounded(A.length_profile(table(spark, sf, "documents"), "n_chars", 4000, "lang"))


@query(f"{WITH} SELECT task, " + ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in ("score", "compression") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) + " FROM panel GROUP BY task")
def value_report(spark, sf):
    return rounded(A.value_report(panel(spark, sf), "task"))


@query(f"""{WITH}, {ISO99}, p AS (SELECT task, avg(score) AS q, avg(base) AS b, sum(score - base) AS d, count(*) AS n FROM iso GROUP BY task)
SELECT task, round(q, 6) AS q, round(b, 6) AS base_q, round(q - b, 6) AS delta, round(d / sum(n) OVER (), 6) AS contribution, n FROM p""")
def task_decomposition(spark, sf):
    labels = panel(spark, sf)
    return rounded(A.decomposition(O.iso_quality(labels), labels.filter("cfg_ord = 0")))


@query(f"""{WITH}, b AS (SELECT *, max(CASE WHEN cfg_ord = 0 THEN score END) OVER (PARTITION BY key) AS base FROM panel), m AS (SELECT *, max(CASE WHEN cfg_ord > 0 THEN abs(score - base) END) OVER (PARTITION BY key) AS most FROM b)
SELECT configuration, round(avg((score > base)::INT), 6) AS above, round(avg((score = base)::INT), 6) AS tie, round(avg((score < base)::INT), 6) AS below, round(avg(most), 6) AS mean_max_diff FROM m WHERE cfg_ord > 0 GROUP BY configuration""")
def noise_profile(spark, sf):
    return rounded(A.noise(panel(spark, sf)))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM r WHERE r > 3 GROUP BY event_type""")
def latency_summary(spark, sf):
    return rounded(A.latency(table(spark, sf, "events").select("event_type", "event_id", "value"), "value", "event_id", 3, "event_type"))


@query("SELECT conv_id, sha256(string_agg('[' || turn || ',\"' || role || '\"]' || chr(9) || sha256(text) || chr(10), '' ORDER BY turn)) AS digest, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_digest(spark, sf):
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(',"'), "role", F.lit('"]\t'), F.sha2("text", 256), F.lit("\n"))
    return A.ordered_digest(table(spark, sf, "conversations"), "conv_id", ["turn"], line)


# --- joins and checks --------------------------------------------------------


@query(f"{WITH} SELECT task, key, " + ", ".join(f"round(max(CASE WHEN configuration = '{c}' THEN score END), 6) AS {c}" for c in CONFIGS) + " FROM panel GROUP BY task, key")
def pivot_join(spark, sf):
    return rounded(V.pivot_join(all_records(spark, sf), "score", CONFIGS))


@query(f"{WITH}, f AS (SELECT key, count(*) AS c FROM records GROUP BY key) SELECT p_partkey AS key, CASE WHEN f.key IS NOT NULL THEN 'failed' ELSE 'absent' END AS state FROM part LEFT JOIN f ON p_partkey = f.key WHERE coalesce(c, 0) < 6")
def missing_keys(spark, sf):
    expected = table(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    return V.missing(panel(spark, sf), expected, all_records(spark, sf), "key")


@query(f"""{WITH}, e AS (SELECT p_type || '-' || (p_size % 3) AS task, p_partkey AS key, 'C' || i AS configuration FROM part, range(6) t(i) WHERE p_size <= 40), f AS (SELECT task, key, configuration, count(*) AS n FROM (SELECT task, key, configuration FROM records UNION ALL SELECT task, key, configuration FROM records WHERE key % 50 = 1) GROUP BY ALL)
SELECT coalesce(e.task, f.task) AS task, coalesce(e.key, f.key) AS key, coalesce(e.configuration, f.configuration) AS configuration, CASE WHEN e.key IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem
FROM e FULL JOIN f ON e.task = f.task AND e.key = f.key AND e.configuration = f.configuration WHERE e.key IS NULL OR n IS NULL OR n > 1""")
def join_coverage(spark, sf):
    records = all_records(spark, sf).select("task", "key", "configuration")
    authority = table(spark, sf, "part").filter("p_size <= 40").select(F.concat_ws("-", "p_type", (F.col("p_size") % 3).cast("string")).alias("task"), F.col("p_partkey").alias("key"))
    return V.coverage(records.unionAll(records.filter("key % 50 = 1")), authority, CONFIGS)


@query(f"{WITH}, p AS (SELECT task, key, count(DISTINCT configuration) AS n FROM records GROUP BY task, key) SELECT task, count(*) FILTER (n < 6) AS dropped, count(*) FILTER (n = 6) AS kept FROM p GROUP BY task")
def dropped_items(spark, sf):
    return V.incomplete(all_records(spark, sf), CONFIGS)


@query("""SELECT conv_id, sha256(unhex(string_agg(printf('%02X', octet_length(encode(text)) % 256) || printf('%02X', octet_length(encode(text)) // 256) || '000000000000' || hex(encode(text)), '' ORDER BY turn))) AS digest, count(*) AS n FROM conversations GROUP BY conv_id""")
def ordered_id_digest(spark, sf):
    return A.ordered_ids_sha256(table(spark, sf, "conversations"), "conv_id", "text", ["turn"])


@query(f"{WITH} SELECT DISTINCT key FROM panel WHERE key NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def unexpected_keys(spark, sf):
    expected = table(spark, sf, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("key"))
    return V.unexpected(panel(spark, sf).select("key").distinct(), expected, "key")


@query(f"{WITH} SELECT key, count(DISTINCT kv_bytes_fp16) AS \"values\", count(kv_bytes_fp16) AS present, count(*) AS rows FROM panel GROUP BY key HAVING count(DISTINCT kv_bytes_fp16) > 1")
def cross_configuration_agreement(spark, sf):
    return V.disagreeing(panel(spark, sf), F.col("kv_bytes_fp16"), 6, "key")


@query(f"{WITH} SELECT task, key, configuration, CASE WHEN score NOT BETWEEN 0 AND 0.05 THEN 'score' ELSE '' END AS broken FROM panel WHERE score NOT BETWEEN 0 AND 0.05")
def value_checks(spark, sf):
    scaled = panel(spark, sf).withColumn("score", F.col("score") + F.when(F.col("score") > 0.05, 1.0).otherwise(0.0))
    return V.value_violations(scaled).select("task", "key", "configuration", F.array_join("broken", "+").alias("broken"))


JOURNAL = "j AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt FROM events)"


def _journal(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.row_number().over(w).alias("attempt"))


@query(f"""WITH {JOURNAL}, n AS (SELECT *, lead(status) OVER (PARTITION BY user_id ORDER BY attempt) AS nxt FROM j)
SELECT user_id, count(*) AS attempts, arg_max(status, attempt) AS latest, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status = 'completed' AND nxt IS NOT NULL) AS invalid FROM n GROUP BY user_id""")
def journal_history(spark, sf):
    return V.journal(_journal(spark, sf), "user_id")


@query(f"""WITH {JOURNAL}, k AS (SELECT user_id, count(*) FILTER (status = 'completed') AS c, count(*) FILTER (status = 'failed') AS f, count(*) AS n FROM j GROUP BY user_id)
SELECT CAST(sum(c) AS BIGINT) AS completed, CAST(sum(f) AS BIGINT) AS failed, count(*) FILTER (n > 1) AS retried FROM k""")
def journal_status(spark, sf):
    return V.status_counts(_journal(spark, sf), "user_id")


@query("""WITH j AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'completed' END AS status FROM events),
d AS (SELECT *, coalesce(max((status = 'completed')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM j),
o AS (SELECT *, CASE WHEN status = 'running' THEN 'invalid status' WHEN done = 1 THEN 'already completed' ELSE 'appended' END AS outcome FROM d)
SELECT user_id, event_id, status, outcome, CASE WHEN outcome = 'appended' THEN CAST(count(*) FILTER (outcome = 'appended') OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) END AS attempt FROM o""")
def journal_stream(spark, sf):
    from ledgerline.sources.scratch import fresh
    from ledgerline.streaming.journal import decide_stream

    schema = table(spark, sf, "events").schema
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("completed")
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").select("user_id", "event_id", F.col("event_id").alias("seq"), status.alias("status"))
    path = fresh(spark, "journal")
    decide_stream(events, f"{path}/rows", f"{path}/state", "user_id").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("user_id", "event_id", "status", "outcome", "attempt")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')")
def pending_keys(spark, sf):
    return V.pending(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), _journal(spark, sf), "user_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_record_wins(spark, sf):
    return V.last_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "event_id", "user_id")


def _event_lines(spark, sf):
    """Events as JSON lines in several files, whose names and lines are in order of the event's number."""
    from ledgerline.sources.scratch import fresh

    path, rows = fresh(spark, "event-lines"), table(spark, sf, "events").select("event_id", "user_id", "event_type")
    rows.repartitionByRange(6, "event_id").sortWithinPartitions("event_id").write.json(path)
    return path


PLACED = "p AS (SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)"


@query(f"WITH {PLACED} SELECT user_id, max(place) AS place, arg_max(event_id, place) AS event_id, arg_max(event_type, place) AS event_type FROM p GROUP BY user_id")
def last_line_wins(spark, sf):
    from ledgerline.sources.files import last_lines, placed_json

    rows = placed_json(spark, _event_lines(spark, sf), "event_id long, user_id long, event_type string")
    return last_lines(rows.drop("file", "line"), "place", "user_id").select("user_id", "place", "event_id", "event_type")


@query(f"""WITH {PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY place) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY event_type) // 7) AS s FROM p)
SELECT event_type, place, event_id FROM n WHERE k % s = 0 AND k // s < 7""")
def sample_by_place(spark, sf):
    from ledgerline.sources.files import placed_json, sample_steps

    rows = placed_json(spark, _event_lines(spark, sf), "event_id long, user_id long, event_type string")
    return sample_steps(rows.select("event_type", "place", "event_id"), 7, "place", "event_type")


@query(f"""WITH {PLACED}, b AS (SELECT place, event_id + CASE WHEN event_id % 1000 = 7 THEN 1 WHEN event_id % 1000 = 8 THEN -1 ELSE 0 END AS event_id FROM p),
c AS (SELECT place, event_id FROM b WHERE place + 3 < (SELECT count(*) FROM events))
SELECT p.place, CASE WHEN c.place IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM p LEFT JOIN c USING (place) WHERE c.place IS NULL OR p.event_id <> c.event_id""")
def ordered_equality(spark, sf):
    from ledgerline.sources.files import placed_json

    rows = placed_json(spark, _event_lines(spark, sf), "event_id long").select("place", "event_id")
    swapped = F.when(F.col("event_id") % 1000 == 7, 1).when(F.col("event_id") % 1000 == 8, -1).otherwise(0)
    other = rows.withColumn("event_id", F.col("event_id") + swapped).filter(F.col("place") + 3 < table(spark, sf, "events").count())
    return V.ordered_differences(rows, other, "place", 256)


@query("""WITH l AS (SELECT source, string_agg(doc_id || ' ' || sha256(text) || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY source)
SELECT source, strlen(t) AS bytes, sha256(t) AS sha256, CASE WHEN source LIKE '%3' THEN 'changed' WHEN source LIKE '%4' THEN 'unexpected' ELSE 'whole' END AS state FROM l UNION ALL SELECT 'gone', NULL, NULL, 'missing'""")
def hash_chain(spark, sf):
    from ledgerline.sources.files import file_hashes, hash_differences
    from ledgerline.sources.scratch import fresh

    path, docs = fresh(spark, "chain"), table(spark, sf, "documents")
    lines = docs.select("source", "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("value"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)  # one file a source
    found = file_hashes(spark, path).filter("name like 'source=%'").withColumn("source", F.regexp_extract("name", "source=([^/]*)/", 1))
    listed = found.filter("source not like '%4'").select("name", F.when(F.col("source").like("%3"), F.sha2("source", 256)).otherwise(F.col("sha256")).alias("sha256"))
    expected = listed.unionByName(docs.limit(1).select(F.lit("source=gone/part").alias("name"), F.lit("0").alias("sha256")))
    broken = hash_differences(found, expected).select(F.regexp_extract("name", "source=([^/]*)/", 1).alias("source"), "rule")
    return found.select("source", "bytes", "sha256").join(broken, "source", "full").select("source", "bytes", "sha256", F.coalesce("rule", F.lit("whole")).alias("state"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return V.repeated_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), d AS (SELECT source AS task, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents),
f AS (SELECT task, count(*) AS n, min(i) AS low, max(i) AS high FROM d GROUP BY task), e AS (SELECT source AS task, n + (source = 'src3')::INT AS expected FROM s)
SELECT task, n, n AS "distinct", low, high, expected FROM f JOIN e USING (task) WHERE n <> expected""")
def panel_checks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("task"), "doc_id")
    items = docs.withColumn("source_index", (F.row_number().over(W.partitionBy("task").orderBy("doc_id")) - 1).cast("long"))
    registry = docs.groupBy("task").agg((F.count("*") + F.when(F.col("task") == "src3", 1).otherwise(0)).alias("expected"))
    return V.panel_violations(items, registry)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS c FROM documents)
SELECT source, doc_id FROM n WHERE (r - 1) % greatest(1, c // 5) = 0 AND (r - 1) // greatest(1, c // 5) < 5""")
def task_sample(spark, sf):
    from ledgerline.sources.readers import sample_task

    return sample_task(table(spark, sf, "documents").select("source", "doc_id"), 5, "doc_id", "source")


# --- folds, router, sweep ----------------------------------------------------

FOLDS = "folds AS (SELECT key, CAST((row_number() OVER (PARTITION BY task ORDER BY key) - 1) % 10 AS INTEGER) AS fold FROM (SELECT DISTINCT task, key FROM panel))"
STATS = """per AS (SELECT fold, configuration, cfg_ord, count(*) AS n, sum(score) AS s, sum(1 / compression) AS inv FROM panel JOIN folds USING (key) GROUP BY ALL),
stats AS (SELECT fold, configuration, cfg_ord, (sum(s) OVER c - s) / (sum(n) OVER c - n) AS train_q, (sum(n) OVER c - n) / (sum(inv) OVER c - inv) AS train_cr, sum(n) OVER c - n AS train_n FROM per WINDOW c AS (PARTITION BY configuration))"""
PRED = """pp AS (SELECT fold, task, cfg_ord, sum(score) AS s, count(*) AS n FROM panel JOIN folds USING (key) GROUP BY ALL),
pr AS (SELECT fold, task, cfg_ord, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS prediction FROM pp WINDOW w AS (PARTITION BY task, cfg_ord)),
pred AS (SELECT p.*, f.fold, round(pr.prediction, 9) AS prediction, round(st.train_cr, 9) AS train_cr FROM panel p JOIN folds f USING (key) JOIN pr ON pr.fold = f.fold AND pr.task = p.task AND pr.cfg_ord = p.cfg_ord JOIN stats st ON st.fold = f.fold AND st.cfg_ord = p.cfg_ord)"""


def _router(spark, sf):
    labels = _staged_panel(spark, sf)  # read four times
    folds = R.stratified_folds(labels)
    stats = R.train_stats(labels, folds).withColumn("train_cr", F.round("train_cr", 9))  # sums are rounded before they are compared
    return labels, folds, stats, R.mean_predictions(labels, folds).withColumn("prediction", F.round("prediction", 9))


@query(f"{WITH}, {FOLDS} SELECT key, fold FROM folds")
def stratified_folds(spark, sf):
    return R.stratified_folds(panel(spark, sf))


@query(f"{WITH} SELECT DISTINCT key, task AS fold FROM panel")
def task_folds(spark, sf):
    return R.task_folds(panel(spark, sf))


@query(f"{WITH} SELECT CAST(floor(0.7 * count(DISTINCT key)) AS BIGINT) AS train, count(DISTINCT key) - CAST(floor(0.7 * count(DISTINCT key)) AS BIGINT) AS test FROM panel")
def split_sizes(spark, sf):
    return R.split_70_30(panel(spark, sf)).agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"))


@query(f"{WITH}, {FOLDS}, {STATS} SELECT fold, configuration, round(train_q, 6) AS train_q, round(train_cr, 6) AS train_cr, CAST(train_n AS BIGINT) AS train_n FROM stats")
def train_fold_stats(spark, sf):
    labels = panel(spark, sf)
    return rounded(R.train_stats(labels, R.stratified_folds(labels)).drop("cfg_ord"))


@query(f"{WITH}, {FOLDS}, {STATS} SELECT fold, configuration, round(train_cr, 6) AS train_cr, CAST(row_number() OVER (PARTITION BY fold ORDER BY train_cr DESC, cfg_ord) AS INTEGER) AS rank FROM stats WHERE cfg_ord >= 1")
def compression_order(spark, sf):
    labels = panel(spark, sf)
    return rounded(R.compression_order(R.train_stats(labels, R.stratified_folds(labels))))


@query(f"""{WITH}, {FOLDS}, {STATS}, v AS (SELECT *, train_q >= 0.99 * max(CASE WHEN cfg_ord = 0 THEN train_q END) OVER (PARTITION BY fold) AS ok FROM stats), a AS (SELECT *, max(ok::INT) OVER (PARTITION BY fold) AS any_ok FROM v WHERE cfg_ord >= 1)
SELECT fold, configuration, round(train_q, 6) AS train_q, round(train_cr, 6) AS train_cr FROM a WHERE ok OR any_ok = 0""")
def viable_configurations(spark, sf):
    labels = panel(spark, sf)
    return rounded(R.viable(R.train_stats(labels, R.stratified_folds(labels)), 0.99).drop("cfg_ord"))


DECIDE = """d0 AS (SELECT *, max(CASE WHEN cfg_ord = 0 THEN prediction END) OVER (PARTITION BY key) AS bp FROM pred), d1 AS (SELECT *, prediction >= 0.99 * bp AS ok FROM d0 WHERE cfg_ord >= 1),
d2 AS (SELECT *, max(ok::INT) OVER (PARTITION BY key) = 1 AS has_ok, list_sort(list(configuration) FILTER (ok) OVER (PARTITION BY key)) AS el FROM d1),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ok DESC, CASE WHEN has_ok THEN train_cr ELSE prediction END DESC, cfg_ord) AS r FROM d2) WHERE r = 1)"""


@query(f"{WITH}, {FOLDS}, {STATS}, {PRED}, {DECIDE} SELECT key, task, fold, configuration, round(score, 6) AS score, round(compression, 6) AS compression, CASE WHEN has_ok THEN 'eligible' ELSE 'fallback' END AS reason, coalesce(array_to_string(el, '+'), '') AS eligible, (SELECT string_agg(s.configuration, '+' ORDER BY round(s.train_cr, 9) DESC, s.cfg_ord) FROM stats s WHERE s.fold = d.fold AND s.cfg_ord >= 1) AS ranked FROM d")
def router_decisions(spark, sf):
    _, _, stats, predicted = _router(spark, sf)
    return rounded(R.decide(predicted, stats).select("key", "task", "fold", "configuration", "score", "compression", "reason", F.array_join("eligible", "+").alias("eligible"), F.array_join("ranked", "+").alias("ranked")))


@query(f"""{WITH}, {FOLDS}, {STATS}, {PRED}, {DECIDE}, t AS (SELECT category, task, avg(score) AS q, count(*) / sum(1 / compression) AS h FROM d GROUP BY ALL), c AS (SELECT category, avg(q) AS q, avg(h) AS h FROM t GROUP BY ALL)
SELECT round((SELECT avg(q) FROM c), 6) AS macro, round(avg(score), 6) AS micro, count(*) AS n, round(count(*) / sum(1 / compression), 6) AS harmonic, round((SELECT avg(h) FROM c), 6) AS category_balanced FROM d""")
def router_rollup(spark, sf):
    _, _, stats, predicted = _router(spark, sf)
    return rounded(A.summary(R.decide(predicted, stats)))


@query(f"""{WITH}, {FOLDS}, {STATS}, {PRED} SELECT fold, configuration, round(avg(abs(score - prediction)), 6) AS mae,
round(1 - sum((score - prediction) ** 2) / (sum(score ** 2) - count(*) * avg(score) ** 2), 6) AS r2, count(*) AS n FROM pred GROUP BY fold, configuration""")
def fit_metrics(spark, sf):
    _, _, _, predicted = _router(spark, sf)
    return rounded(A.fit_metrics(predicted, "fold", "configuration"))


TAUS = (0.85, 0.9, 0.95, 0.99)
POOLS = """b AS (SELECT i, list_filter([1, 2, 3, 4, 5], lambda x: (i & (1 << (x - 1))) <> 0) AS m FROM range(1, 32) t(i)), pools AS (SELECT list_transform(m, lambda x: 'C' || x) AS pool, len(m) AS size, array_to_string(list_transform(m, lambda x: 'C' || x), '+') AS pool_key FROM b WHERE len(m) BETWEEN 2 AND 5)"""
SWEEP = f"""{POOLS}, pts AS (SELECT pool_key, pool, size, tau FROM pools, (VALUES (0.85::DOUBLE), (0.9), (0.95), (0.99)) v(tau)),
d0 AS (SELECT *, max(CASE WHEN cfg_ord = 0 THEN prediction END) OVER (PARTITION BY key) AS bp FROM pred), d1 AS (SELECT d0.*, pool_key, size, tau, prediction >= tau * bp AS ok FROM d0 JOIN pts ON list_contains(pool, configuration)),
d2 AS (SELECT *, max(ok::INT) OVER (PARTITION BY pool_key, tau, key) = 1 AS has_ok FROM d1),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_key, tau, key ORDER BY ok DESC, CASE WHEN has_ok THEN train_cr ELSE prediction END DESC, cfg_ord) AS r FROM d2) WHERE r = 1),
ev AS (SELECT pool_key, tau, any_value(size) AS size, round(avg(score), 6) AS q, round(count(*) / sum(1 / compression), 6) AS cr, count(*) AS n FROM d GROUP BY pool_key, tau)"""


def _sweep(spark, sf):
    _, _, stats, predicted = _router(spark, sf)
    return rounded(R.evaluate_points(predicted, stats, P.points(spark, TAUS)))


@query(f"WITH {POOLS} SELECT pool_key, CAST(size AS INTEGER) AS size FROM pools")
def candidate_pools(spark, sf):
    return P.pools(spark).select("pool_key", "size")


@query(f"{WITH}, {FOLDS}, {STATS}, {PRED}, {SWEEP} SELECT pool_key, tau, CAST(size AS INTEGER) AS size, q, cr, n FROM ev")
def pool_sweep(spark, sf):
    return _sweep(spark, sf)


@query(f"{WITH}, {FOLDS}, {STATS}, {PRED}, {SWEEP} SELECT pool_key, tau, q, cr FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.q >= a.q AND b.cr >= a.cr AND (b.q > a.q OR b.cr > a.cr))")
def pareto_frontier(spark, sf):
    return P.frontier(_sweep(spark, sf)).select("pool_key", "tau", "q", "cr")


@query(f"{WITH}, {FOLDS}, {STATS}, {PRED}, {SWEEP} SELECT pool_key, tau, q, cr FROM ev ORDER BY q DESC, cr DESC, size, pool_key, tau DESC LIMIT 1")
def best_operating_point(spark, sf):
    return P.best_point(_sweep(spark, sf)).select("pool_key", "tau", "q", "cr")


def _sweep_sql(folds: str) -> str:
    return f"""{WITH}, folds AS ({folds}), {STATS}, taus AS (SELECT unnest([0.9, 0.95, 0.99])::DOUBLE AS tau),
e0 AS (SELECT p.*, st.fold, round(st.train_q, 9) AS prediction, round(st.train_cr, 9) AS train_cr FROM panel p JOIN folds f USING (key) JOIN stats st ON st.fold = f.fold AND st.cfg_ord = p.cfg_ord),
e1 AS (SELECT *, max(CASE WHEN cfg_ord = 0 THEN prediction END) OVER (PARTITION BY key) AS bp, max(CASE WHEN cfg_ord = 0 THEN score END) OVER (PARTITION BY key) AS base FROM e0),
e2 AS (SELECT e1.*, tau, prediction >= tau * bp AS ok FROM e1, taus WHERE cfg_ord >= 1), e3 AS (SELECT *, max(ok::INT) OVER (PARTITION BY key, tau) = 1 AS has_ok FROM e2),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, tau ORDER BY ok DESC, CASE WHEN has_ok THEN train_cr ELSE prediction END DESC, cfg_ord) AS r FROM e3) WHERE r = 1)
SELECT tau, round(avg(score), 6) AS q, round(count(*) / sum(1 / compression), 6) AS cr, count(*) AS n, round(avg((score < tau * base)::INT), 6) AS violation_rate FROM e GROUP BY tau"""


def _staged_panel(spark, sf):
    from ledgerline.sources.scratch import fresh, staged

    return staged(panel(spark, sf), fresh(spark, "panel"))


def _tau_sweep(labels, folds):
    stats = R.train_stats(labels, folds).withColumn("train_q", F.round("train_q", 9)).withColumn("train_cr", F.round("train_cr", 9))
    predictions = labels.select("key", "cfg_ord").join(folds, "key").join(stats.select("fold", "cfg_ord", F.col("train_q").alias("prediction")), ["fold", "cfg_ord"])
    return rounded(R.evaluate_folds(labels, folds, (0.9, 0.95, 0.99), predictions, stats))


@query(_sweep_sql("SELECT DISTINCT key, task AS fold FROM panel"))
def leave_one_task_out_sweep(spark, sf):
    labels = _staged_panel(spark, sf)
    return _tau_sweep(labels, R.task_folds(labels))


@query(_sweep_sql("SELECT DISTINCT key, key % 3 AS fold FROM panel"))
def fold_tau_sweep(spark, sf):
    labels = _staged_panel(spark, sf)
    return _tau_sweep(labels, labels.select("key", (F.col("key") % 3).alias("fold")).distinct())


@query(f"""{WITH}, {FOLDS}, {STATS}, {PRED}, {DECIDE}, pt AS (SELECT round(avg(score), 4) AS q, round(count(*) / sum(1 / compression), 3) AS cr FROM d), fx AS (SELECT configuration, round(avg(score), 4) AS q, round(count(*) / sum(1 / compression), 3) AS cr FROM panel GROUP BY configuration)
SELECT configuration, CASE WHEN pt.q >= fx.q AND pt.cr >= fx.cr AND (pt.q > fx.q OR pt.cr > fx.cr) THEN 'dominates' WHEN fx.q >= pt.q AND fx.cr >= pt.cr AND (fx.q > pt.q OR fx.cr > pt.cr) THEN 'dominated' ELSE 'non_dominated' END AS verdict FROM fx, pt""")
def pareto_verdicts(spark, sf):
    labels, _, stats, predicted = _router(spark, sf)
    point = R.decide(predicted, stats).agg(F.avg("score").alias("q"), A.harmonic("compression").alias("cr"))
    return P.verdicts(point, A.fixed_configurations(labels))


@query(f"""{WITH}, f AS (SELECT configuration, round(avg(score), 4) AS q FROM panel GROUP BY configuration), s AS (SELECT configuration, q + (configuration = 'C2')::INT AS q FROM f WHERE configuration <> 'C5')
SELECT f.configuration, f.q, CASE WHEN s.q IS NULL THEN 'not_available' WHEN abs(f.q - s.q) <= 0.0005 THEN 'match' ELSE 'mismatch' END AS status FROM f LEFT JOIN s USING (configuration)""")
def cross_check(spark, sf):
    computed = rounded(A.fixed_configurations(panel(spark, sf)), 4).select("configuration", "q")
    stored = computed.filter("configuration <> 'C5'").withColumn("q", F.col("q") + F.when(F.col("configuration") == "C2", 1.0).otherwise(0.0))
    return P.cross_check(computed, stored, ["configuration"], "q", 5e-4)


# --- statistics --------------------------------------------------------------


def _pairs(spark, sf):
    return panel(spark, sf).groupBy("key").agg(F.max(F.when(F.col("cfg_ord") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("cfg_ord") == 0, F.col("score"))).alias("b"))


PAIRS = "pairs AS (SELECT key, max(CASE WHEN cfg_ord = 1 THEN score END) AS a, max(CASE WHEN cfg_ord = 0 THEN score END) AS b FROM panel GROUP BY key)"


@query(f"{WITH}, {PAIRS} SELECT count(*) FILTER (a > b) AS win, count(*) FILTER (a = b) AS tie, count(*) FILTER (a < b) AS loss, round(avg(a - b), 6) AS mean_difference FROM pairs")
def win_tie_loss(spark, sf):
    return rounded(S.win_tie_loss(_pairs(spark, sf)))


@query(f"""{WITH}, {PAIRS}, d AS (SELECT round(a - b, 12) AS d FROM pairs), nz AS (SELECT * FROM d WHERE d <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM nz)
SELECT round(least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)), 6)::DOUBLE AS statistic, count(*) AS n FROM r""")
def wilcoxon(spark, sf):
    return S.wilcoxon(_pairs(spark, sf)).select(F.round(F.col("statistic").cast("double"), 6).alias("statistic"), "n")


@query(f"""{WITH}, {PAIRS}, d AS (SELECT round(a - b, 12) AS d FROM pairs), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d),
s AS (SELECT sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END)::DOUBLE AS wm, count(*)::DOUBLE AS n, (count(*) FILTER (d = 0))::DOUBLE AS z0 FROM r),
t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM d WHERE d <> 0 GROUP BY abs(d)))
SELECT round(least(wp, wm), 6) AS statistic, (n - z0)::BIGINT AS n, round((least(wp, wm) - (n * (n + 1) - z0 * (z0 + 1)) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - ties / 2) / 24), 6) AS z FROM s, t""")
def wilcoxon_pratt(spark, sf):
    return S.wilcoxon(_pairs(spark, sf), "pratt").select(F.round(F.col("statistic").cast("double"), 6).alias("statistic"), "n", F.round("z", 6).alias("z"))


@query(f"""{WITH}, {PAIRS}, tasks AS (SELECT task, avg(a) AS a, avg(b) AS b FROM pairs JOIN (SELECT DISTINCT task, key FROM panel) USING (key) GROUP BY task),
d AS (SELECT round(a - b, 12) AS d FROM tasks), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) AS rk FROM d), s AS (SELECT least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END))::BIGINT AS w, count(*) AS n FROM r),
ways AS (SELECT 0::BIGINT AS k, list_transform(range(1276), lambda i: (i = 0)::INT::HUGEINT) AS c UNION ALL SELECT k + 1, list_transform(c, lambda x, i: x + CASE WHEN i > k + 1 THEN c[i - k - 1] ELSE 0 END) FROM ways WHERE k < (SELECT n FROM s))
SELECT w::DOUBLE AS statistic, n, true AS exact, round(least(1, 2 * list_sum(c[:w + 1])::DOUBLE / 2 ** n), 9) AS p FROM s JOIN ways ON k = n""")
def wilcoxon_tasks(spark, sf):
    tasks = panel(spark, sf).select("key", "task").distinct()
    pairs = _pairs(spark, sf).join(tasks, "key").groupBy("task").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return S.wilcoxon(pairs).select(F.col("statistic").cast("double").alias("statistic"), "n", "exact", F.round("p", 9).alias("p"))


@query()
def paired_bootstrap(spark, sf):
    return S.paired_bootstrap(_pairs(spark, sf))


@query()
def random_router_draws(spark, sf):
    return S.random_router_draws(panel(spark, sf))


# --- text --------------------------------------------------------------------

TURNS = "turns AS (SELECT u.conv_id, u.turn, u.text AS gold, a.text AS prediction FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g'), '\s+', ' ', 'g'))"


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    nxt = {x: F.lead(x).over(W.partitionBy("conv_id").orderBy("turn")) for x in ("role", "text", "turn")}
    pairs = c.select("conv_id", "turn", "role", F.col("text").alias("gold"), nxt["role"].alias("r"), nxt["text"].alias("prediction"), nxt["turn"].alias("t"))
    return pairs.filter("role = 'user' and r = 'assistant' and t = turn + 1").select("conv_id", "turn", "gold", "prediction")


@query(f"""WITH {TURNS}, n AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(gold), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS g,
  list_filter(string_split(trim(regexp_replace(regexp_replace(lower(prediction), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS p FROM turns),
pc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS w FROM n) GROUP BY ALL), gc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(g) AS w FROM n) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(pc.c, gc.c)) AS s FROM pc JOIN gc USING (conv_id, turn, w) GROUP BY ALL)
SELECT n.conv_id, n.turn, round(coalesce(2 * (s / len(p)) * (s / len(g)) / (s / len(p) + s / len(g)), 0), 6)::DOUBLE AS f1 FROM n LEFT JOIN o ON n.conv_id = o.conv_id AND n.turn = o.turn""")
def score_token_f1(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(T.token_f1(F.col("prediction"), F.col("gold")), 6).alias("f1"))


@query()
def score_rouge_l(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", T.rouge_l("prediction", "gold").alias("rouge_l"))


@query()
def score_code_similarity(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", T.code_similarity(F.col("prediction"), F.col("gold")).alias("similarity"))


@query("SELECT page_id, CASE WHEN len(n) = 0 THEN 0.0 ELSE len(list_filter(n, lambda x: x = '2')) / len(n) END::DOUBLE AS score FROM (SELECT page_id, regexp_extract_all(url, '(\\d+)', 1) AS n FROM pages)")
def score_count(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.count_score(F.col("url"), F.lit("2")).alias("score"))


@query("SELECT page_id, CASE WHEN len(n) = 0 THEN 0.0 ELSE len(list_filter(n, lambda x: x = '2')) / len(n) END::DOUBLE AS score FROM (SELECT page_id, regexp_extract_all(url, '(\\d+)', 1) AS n FROM pages)")
def score_retrieval(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.retrieval_score(F.col("url"), F.lit("Paragraph 2")).alias("score"))


@query("""WITH m AS (SELECT doc_id, list_filter(['the', 'de', 'der', 'und', 'a'], lambda c: contains(text, c)) AS f FROM documents), k AS (SELECT doc_id, list_filter(f, lambda c: NOT (contains('der', c) AND c <> 'der')) AS f FROM m)
SELECT doc_id, CASE WHEN list_contains(f, 'der') THEN 1.0 / len(f) ELSE 0.0 END::DOUBLE AS score FROM k""")
def score_classification(spark, sf):
    classes = F.array(*map(F.lit, ("the", "de", "der", "und", "a")))
    return table(spark, sf, "documents").select("doc_id", T.classification(F.col("text"), F.lit("der"), classes, strict=False).alias("score"))


@query("""WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'under' WHEN 1 THEN 'ende' ELSE 'und' END AS gold, list_filter(['e', 'd', 'n', 'nd', 'und', 'de', 'under', 'ende', 'zzz'], lambda c: contains(text, c)) AS f FROM documents),
x AS (SELECT doc_id, gold, unnest(f) AS c, unnest(range(len(f))) AS i FROM m), p AS (SELECT *, contains(gold, c) AND c <> gold AS part FROM x),
z AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, part ORDER BY i) AS z FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part, z ORDER BY i) AS k FROM z),
s AS (SELECT doc_id, count(*) AS kept, max((c = gold)::INT) AS hit FROM n WHERE NOT (part AND k % 2 = 1) GROUP BY doc_id)
SELECT doc_id, CASE WHEN hit = 1 THEN 1.0 / kept ELSE 0.0 END::DOUBLE AS score FROM documents LEFT JOIN s USING (doc_id)""")
def score_classification_walk(spark, sf):
    classes = F.array(*map(F.lit, ("e", "d", "n", "nd", "und", "de", "under", "ende", "zzz")))
    gold = F.when(F.col("doc_id") % 3 == 0, "under").when(F.col("doc_id") % 3 == 1, "ende").otherwise("und")
    return table(spark, sf, "documents").select("doc_id", T.classification(F.col("text"), gold, classes).alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN split_part(ltrim(text, chr(10)), chr(10), 1) ELSE text END AS answer FROM documents")
def postprocess(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.postprocess(F.col("text"), F.col("doc_id") % 2 == 0).alias("answer"))


@query("SELECT conv_id, turn, 'Context: ' || prediction || chr(10) || 'Question: ' || gold || ' {x}' AS prompt FROM turns".replace("SELECT", f"WITH {TURNS} SELECT", 1))
def prompt_template(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.concat(T.fill_template("Context: {context}\nQuestion: {input}", {"context": F.col("prediction"), "input": F.col("gold")}), F.lit(" {x}")).alias("prompt"))


@query("""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents), c AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(t) AS w FROM w) GROUP BY ALL),
e AS (SELECT doc_id, sum(c * log2(c)) AS s FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(t) AS BIGINT) AS seq_len_tokens, length(text) AS seq_len_chars, round(CASE WHEN len(t) = 0 THEN 0 ELSE log2(len(t)) - s / len(t) END, 4)::DOUBLE AS token_entropy,
round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_distinct(t)) / len(t) END, 4)::DOUBLE AS unique_token_ratio,
CASE WHEN contains(text, '.') THEN round((length(text) - position('.' IN reverse(text))) / length(text), 4) END AS question_position,
round((length(text) - length(replace(text, chr(10), ''))) / length(text), 4)::DOUBLE AS newline_density FROM w LEFT JOIN e ON w.doc_id = e.doc_id""")
def prompt_features(spark, sf):
    text = F.col("text")
    f = X.prompt_features(text, F.col("ids"), marker=".")
    docs = table(spark, sf, "documents").select("doc_id", "text", X.words(text).alias("ids"))  # split once for all features
    return docs.select("doc_id", *(c.alias(n) for n, c in f.items()))


@query()
def gzip_ratio(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(X.gzip_ratio("text"), 4).alias("gzip_ratio"))


def _ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.transform(X.words(F.col("text")), lambda w: F.char_length(w)).alias("ids"))


@query("WITH i AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda w: length(w)) AS t FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(t) > 20 THEN list_concat(t[1:10], t[-10:]) ELSE t END, ' ') AS ids FROM i")
def middle_truncation(spark, sf):
    return _ids(spark, sf).select("doc_id", F.array_join(F.transform(X.middle_truncate(F.col("ids"), 20), lambda x: x.cast("string")), " ").alias("ids"))


@query("WITH i AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda w: length(w)) AS t FROM documents) SELECT doc_id, sha256(unhex(array_to_string(list_transform(t, lambda x: printf('%02x%02x0000', x % 256, x // 256)), ''))) AS digest FROM i")
def token_digest(spark, sf):
    return _ids(spark, sf).select("doc_id", X.ids_sha256(F.col("ids")).alias("digest"))


# --- rules that decide -------------------------------------------------------


@query(f"""{WITH}, {FOLDS}, {STATS}, {PRED}, f0 AS (SELECT p.*, max(CASE WHEN p.cfg_ord = 0 THEN greatest(prediction, round(train_q, 9)) END) OVER (PARTITION BY key) AS bp, max(CASE WHEN p.cfg_ord = 0 THEN prediction END) OVER (PARTITION BY key) AS plain
  FROM pred p JOIN stats st ON st.fold = p.fold AND st.cfg_ord = p.cfg_ord),
f1 AS (SELECT *, prediction >= 0.99 * bp AS ok, prediction >= 0.99 * plain AS ok0 FROM f0 WHERE cfg_ord >= 1), f2 AS (SELECT *, max(ok::INT) OVER (PARTITION BY key) = 1 AS has_ok, max(ok0::INT) OVER (PARTITION BY key) = 1 AS has_ok0 FROM f1),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ok DESC, CASE WHEN has_ok THEN train_cr ELSE prediction END DESC, cfg_ord) AS r FROM f2) WHERE r = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ok0 DESC, CASE WHEN has_ok0 THEN train_cr ELSE prediction END DESC, cfg_ord) AS r FROM f2) WHERE r = 1)
SELECT a.task, a.fold, a.key, a.configuration, CASE WHEN a.has_ok THEN 'eligible' ELSE 'fallback' END AS reason, round(a.bp, 6) AS base_pred, a.configuration <> b.configuration OR a.has_ok <> b.has_ok0 AS floor_decides FROM a JOIN b USING (key)""")
def floor_decisions(spark, sf):
    _, _, stats, predicted = _router(spark, sf)
    stats = stats.withColumn("train_q", F.round("train_q", 9))
    floor = R.decide(predicted, stats, use_floor=True).select("task", "fold", "key", "configuration", "reason", F.round("base_pred", 6).alias("base_pred"))
    plain = R.decide(predicted, stats).select("key", F.col("configuration").alias("_c"), F.col("reason").alias("_r"))
    return floor.join(plain, "key").withColumn("floor_decides", (F.col("configuration") != F.col("_c")) | (F.col("reason") != F.col("_r"))).drop("_c", "_r")


@query(f"""{WITH}, v AS (SELECT task, key, configuration, cfg_ord, CASE WHEN key % 11 = 1 THEN -score - 1 ELSE score END AS score, CASE WHEN key % 13 = 1 THEN 0 ELSE kv_bytes END AS kv_bytes, kv_bytes_fp16, CASE WHEN key % 17 = 1 THEN compression + 0.5 ELSE compression END AS compression FROM panel),
b AS (SELECT task, key, configuration, array_to_string(list_filter([CASE WHEN score < 0 OR score > 1 THEN 'score' END, CASE WHEN kv_bytes <= 0 THEN 'bytes' END, CASE WHEN kv_bytes <= 0 OR abs(compression - kv_bytes_fp16 / kv_bytes) > greatest(1e-6 * compression, 5e-5) THEN 'compression' END,
  CASE WHEN cfg_ord = 0 AND compression <> 1 THEN 'baseline' END], lambda x: x IS NOT NULL), '+') AS broken FROM v) SELECT * FROM b WHERE broken <> ''""")
def value_rules(spark, sf):
    spoiled = {"score": (11, -F.col("score") - 1), "kv_bytes": (13, F.lit(0.0)), "compression": (17, F.col("compression") + 0.5)}
    rows = panel(spark, sf)
    rows = rows.select(*(F.when(F.col("key") % spoiled[c][0] == 1, spoiled[c][1]).otherwise(F.col(c)).alias(c) if c in spoiled else F.col(c) for c in rows.columns))
    # bytes of nothing have no ratio
    rows = rows.withColumn("kv_bytes", F.when(F.col("kv_bytes") > 0, F.col("kv_bytes")))
    return V.value_violations(rows).select("task", "key", "configuration", F.array_join("broken", "+").alias("broken"))


@query(f"""{WITH}, s AS (SELECT key, CASE WHEN key % 7 = 3 AND cfg_ord = 2 THEN 'other' WHEN key % 7 = 4 AND cfg_ord = 5 THEN NULL WHEN key % 7 = 5 THEN NULL ELSE task END AS v FROM panel)
SELECT key, count(DISTINCT v) AS "values", count(v) AS present, count(*) AS rows FROM s GROUP BY key HAVING count(DISTINCT v) > 1 OR (count(v) > 0 AND count(v) < count(*))""")
def agreement_of_some(spark, sf):
    k = F.col("key") % 7
    value = F.when((k == 3) & (F.col("cfg_ord") == 2), "other").when((k == 4) & (F.col("cfg_ord") == 5) | (k == 5), F.lit(None)).otherwise(F.col("task"))
    return V.disagreeing(panel(spark, sf).withColumn("v", value), F.col("v"), 6, "key")


@query("""SELECT page_id, CASE WHEN len(n) = 0 THEN 0.0 ELSE len(list_filter(n, lambda x: x = (page_id % 5)::VARCHAR)) / len(n) END::DOUBLE AS score FROM (SELECT page_id, regexp_extract_all(url, '(\\d+)', 1) AS n FROM pages)""")
def score_retrieval_by_row(spark, sf):
    reference = F.concat(F.lit("Paragraph "), (F.col("page_id") % 5).cast("string"), F.lit(": text 7"))
    return table(spark, sf, "pages").select("page_id", T.retrieval_score(F.col("url"), reference).alias("score"))


@query("SELECT page_id, CASE WHEN contains(url, '?') THEN round((length(url) - position('?' IN reverse(url))) / length(url), 4) END AS question_position, length(url) AS seq_len_chars FROM pages")
def question_places(spark, sf):
    f = X.prompt_features(F.col("url"), X.words(F.col("url")))
    return table(spark, sf, "pages").select("page_id", *(f[c].alias(c) for c in ("question_position", "seq_len_chars")))


@query(f"""{WITH}, m AS (SELECT category, key, max(CASE WHEN cfg_ord > 0 THEN score END) > max(CASE WHEN cfg_ord = 0 THEN score END) AS b FROM panel GROUP BY category, key)
SELECT category, count(*) FILTER (b) AS beats, count(*) AS items, round(avg(b::INT), 6) AS share FROM m GROUP BY category""")
def metric_beats(spark, sf):
    return rounded(A.metric_beats(panel(spark, sf), "category"))


@query(f"""{WITH}, t AS (SELECT configuration, task, round(avg(score), 4) AS q, sum(compression) AS c, count(*) AS n FROM panel GROUP BY ALL)
SELECT configuration, round(avg(q), 4) AS q, round(sum(c) / sum(n), 3) AS ratio, count(*) AS tasks FROM t GROUP BY configuration""")
def run_averages(spark, sf):
    return A.run_averages(panel(spark, sf), "configuration")


WIDE = ", ".join(f"round(max(CASE WHEN configuration = '{c}' THEN {f} END), 6) AS {n}_{c.lower()}" for c in CONFIGS for n, f in (("score", "score"), ("cr", "compression"), ("kv_bytes", "kv_bytes"), ("kv_bytes_fp16", "kv_bytes_fp16")))


@query(f"""{WITH}, b AS (SELECT *, max(CASE WHEN cfg_ord = 0 THEN score END) OVER (PARTITION BY key) AS base FROM panel),
q AS (SELECT key, configuration, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, cfg_ord) AS r FROM panel) WHERE r = 1), w AS (SELECT task, key, {WIDE} FROM panel GROUP BY task, key)
SELECT w.*, q.configuration AS best_quality, round(q.score, 6) AS best_quality_score, i99.configuration AS iso_99, i95.configuration AS iso_95, i90.configuration AS iso_90
FROM w JOIN q USING (key) JOIN {_labels_sql(0.99)} i99 USING (key) JOIN {_labels_sql(0.95)} i95 USING (key) JOIN {_labels_sql(0.90)} i90 USING (key)""")
def wide_export(spark, sf):
    from ledgerline.sinks.export import wide_export as wide

    labels = panel(spark, sf)
    chosen = O.dataset_labels(labels).drop("task")
    best = labels.groupBy("key").agg(F.max("score").alias("best_quality_score"))
    return rounded(wide(labels, chosen.join(best, "key")))


@query("""SELECT '{"event":' || event_id || ',"kind":{"name":"' || event_type || '","tags":["' || event_type || '",null]},"more":{"a":' || (user_id % 3) || ',"z":true},"none":null}' AS json FROM events""")
def canonical_events(spark, sf):
    from ledgerline.sinks.export import canonical_rows

    rows = table(spark, sf, "events").select(
        F.struct(F.array("event_type", F.lit(None)).alias("tags"), F.col("event_type").alias("name")).alias("kind"), F.lit(None).cast("string").alias("none"),
        F.struct(F.lit(True).alias("z"), (F.col("user_id") % 3).alias("a")).alias("more"), F.col("event_id").alias("event"),
    )
    return canonical_rows(rows)


# --- kernels -----------------------------------------------------------------


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _long(spark, sf):
    return _vectors(spark, sf).select("vec_id", "label", F.posexplode("x").alias("pos", "score"))


VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda y: y::DOUBLE) AS x FROM embeddings)"
LONG = f"{VEC}, l AS (SELECT vec_id, label, unnest(x) AS score, CAST(unnest(range(0, len(x))) AS INTEGER) AS pos FROM v)"


@query(f"""WITH {LONG}, g AS (SELECT vec_id, pos, score, min(score) OVER w AS lo, greatest(max(score) OVER w - min(score) OVER w, 1e-8) / 15 AS sc FROM l WINDOW w AS (PARTITION BY vec_id, pos // 16))
SELECT vec_id, round(sum(abs(round_even((score - lo) / sc, 0) * sc + lo - score)), 6) AS error FROM g GROUP BY vec_id""")
def quantize_groups(spark, sf):
    q = _vectors(spark, sf).withColumn("q", K.quantize_groups(F.col("x"), 4, 16))
    return q.select("vec_id", F.round(F.aggregate(F.zip_with("q", "x", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v), 6).alias("error"))


MASKED = "SELECT vec_id, round(sum(CASE WHEN m THEN score ELSE least(levels, greatest(0, round_even((score - lo) / sc, 0))) * sc + lo END), 6) AS total FROM g GROUP BY vec_id"


def _masked_sql(low: str, high: str, levels: str, by: str) -> str:
    kept = "coalesce({f}(score) FILTER (NOT m) OVER w, 0)"
    lo, hi = kept.format(f="min"), kept.format(f="max")
    return f"""WITH {LONG}, o AS (SELECT l.*, score < list_sort(x)[{low}] OR score > list_sort(x)[{high}] AS m, {levels} AS levels FROM l JOIN v USING (vec_id)),
g AS (SELECT *, {lo} AS lo, greatest({hi} - {lo}, 1e-8) / levels AS sc FROM o WINDOW w AS (PARTITION BY {by})) {MASKED}"""


@query(_masked_sql("2", "63", "15.0::DOUBLE", "vec_id, pos // 16"))
def quantize_with_outliers(spark, sf):
    q = K.quantize_masked(F.col("x"), K.kth_outliers(F.col("x"), 2, 63), 4, 16)
    return _vectors(spark, sf).select("vec_id", F.round(F.aggregate(q, F.lit(0.0), lambda s, y: s + y), 6).alias("total"))


@query(f"WITH {LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(score) DESC, vec_id, pos) AS r, count(*) OVER (PARTITION BY label) AS n FROM l) SELECT label, vec_id, pos FROM r WHERE r <= round_even(n * 0.01, 0)")
def tensor_outliers(spark, sf):
    return K.outlier_ranks(_long(spark, sf), 0.01, "label", "score", "vec_id", "pos").filter("outlier").select("label", "vec_id", "pos")


@query(f"WITH {VEC} SELECT vec_id, CAST(len(list_filter(x, lambda y: y < list_sort(x)[3] OR y > list_sort(x)[62])) AS INTEGER) AS outliers FROM v")
def vector_outliers(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.size(F.filter(K.kth_outliers(F.col("x"), 3, 62), lambda m: m)).alias("outliers"))


@query("SELECT vec_id, (len(embedding) * 4 / 8 + ceil(len(embedding) / 16) * 4)::DOUBLE AS plain, ((len(embedding) - 2) * 4 / 8 + ceil(len(embedding) / 16) * 4 + 12)::DOUBLE AS with_outliers FROM embeddings")
def packed_bytes(spark, sf):
    n = F.size("embedding")
    return table(spark, sf, "embeddings").select("vec_id", K.packed_bytes(n, 4, 16).cast("double").alias("plain"), K.packed_bytes(n, 4, 16, F.lit(2)).cast("double").alias("with_outliers"))


SMOOTH = f"{LONG}, s AS (SELECT *, sum(score) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS smoothed FROM l)"


@query(f"WITH {SMOOTH} SELECT vec_id, pos, round(smoothed, 6) AS smoothed FROM s")
def smooth_scores(spark, sf):
    return rounded(K.smooth(_long(spark, sf), 7, "vec_id").select("vec_id", "pos", "smoothed"))


@query(f"WITH {LONG} SELECT vec_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, pos >= 56 ORDER BY score DESC, pos) AS r FROM l) WHERE pos >= 56 OR r <= 8")
def retain_recent_top(spark, sf):
    return K.retain(_long(spark, sf), 8, 8, "vec_id").select("vec_id", "pos")


@query(f"WITH {LONG} SELECT label, vec_id AS layer, count(*) FILTER (r <= 100) AS budget FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id, pos) AS r FROM l) GROUP BY ALL")
def layer_budgets(spark, sf):
    return K.layer_budgets(_long(spark, sf).withColumnRenamed("vec_id", "layer"), 100, "label")


@query("""WITH RECURSIVE r AS (
  SELECT p_type AS g, p_partkey AS item, p_size::DOUBLE AS weight, 30::BIGINT AS cap, 0::BIGINT AS share, least(1000, 30 * count(*) OVER (PARTITION BY p_type))::BIGINT AS rest, 0 AS k FROM part
  UNION ALL
  SELECT g, item, weight, cap, (share + more)::BIGINT, (rest - sum(more) OVER (PARTITION BY g))::BIGINT, k + 1 FROM (
    SELECT *, CASE WHEN most > 0 THEN given WHEN open AND place <= rest THEN 1 ELSE 0 END AS more FROM (
      SELECT *, max(given) OVER (PARTITION BY g) AS most, row_number() OVER (PARTITION BY g, open ORDER BY claim DESC, item) AS place FROM (
        SELECT *, CASE WHEN open THEN least(floor(claim), cap - share) ELSE 0 END::BIGINT AS given FROM (
          SELECT *, share < cap AS open, rest * (weight / sum(CASE WHEN share < cap THEN weight END) OVER (PARTITION BY g)) AS claim FROM r WHERE rest > 0))))
) SELECT g, item, arg_max(share, k) AS share FROM r GROUP BY g, item""")
def budget_allocation(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("g"), F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("weight"), F.lit(30).alias("cap"))
    return K.allocate(rows.withColumn("total", F.lit(1000)), "g", "total")


HEADS = f"{LONG}, h AS (SELECT label, vec_id % 4 AS head, pos, round(avg(score), 9) AS score, 8 AS budget FROM l GROUP BY ALL)"


@query(f"""WITH {HEADS}, p AS (SELECT *, row_number() OVER (PARTITION BY label, head ORDER BY score DESC, pos) AS r FROM h), vo AS (SELECT label, pos, sum(CASE WHEN r <= budget THEN score ELSE 0 END) AS votes FROM p GROUP BY ALL)
SELECT label, pos, round(votes, 6) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(votes, 9) DESC, pos) AS r FROM vo) WHERE r <= 12""")
def head_votes(spark, sf):
    heads = _long(spark, sf).groupBy("label", (F.col("vec_id") % 4).alias("head"), "pos").agg(F.round(F.avg("score"), 9).alias("score")).withColumn("budget", F.lit(8))
    return rounded(K.head_votes(heads, "label", 12))


@query(f"""WITH {HEADS}, b AS (SELECT *, row_number() OVER (PARTITION BY label, head ORDER BY score DESC, pos) AS r FROM h WHERE pos < 60), c AS (SELECT label, head, greatest(sum(score) FILTER (r <= 12), 1e-6) AS c FROM b GROUP BY ALL),
k AS (SELECT label, head, greatest(0, least(60, round_even(c / sum(c) OVER (PARTITION BY label) * (SELECT 12 * count(DISTINCT head) - 4 * count(DISTINCT head) FROM h WHERE h.label = c.label), 0))) AS share FROM c),
vo AS (SELECT label, pos, sum(CASE WHEN r <= share THEN score ELSE 0 END) AS votes FROM b JOIN k USING (label, head) GROUP BY ALL)
SELECT label, pos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(votes, 9) DESC, pos) AS r FROM vo) WHERE r <= 8 UNION ALL SELECT DISTINCT label, pos FROM h WHERE pos >= 60""")
def kept_positions(spark, sf):
    heads = _long(spark, sf).groupBy("label", (F.col("vec_id") % 4).alias("head"), "pos").agg(F.round(F.avg("score"), 9).alias("score"))
    return K.keep_positions(heads, "label", 12, 4)


@query(f"WITH {VEC} SELECT vec_id, CAST(least(16, greatest(2, ceil(log2((list_max(x) - list_min(x)) / (2 * sqrt(12.0 / 100) * 0.01 / greatest(abs(x[1]), 1e-6)) + 1)))) AS INTEGER) AS bits FROM v")
def value_bits(spark, sf):
    x = F.col("x")
    return _vectors(spark, sf).select("vec_id", K.value_bits(F.array_max(x) - F.array_min(x), F.lit(100.0), 0.01, F.abs(F.get(x, F.lit(0)))).alias("bits"))


@query(f"WITH {VEC} SELECT vec_id, CAST(least(16, greatest(2, ceil(log2((list_max(x) - list_min(x)) / (2 * sqrt(3.0) * (0.001 * sqrt(power(100.0, 3) / 99.0) / greatest(abs(x[1]), 1e-6))) + 1)))) AS INTEGER) AS bits FROM v")
def key_bits(spark, sf):
    x = F.col("x")
    return _vectors(spark, sf).select("vec_id", K.key_bits(F.array_max(x) - F.array_min(x), F.lit(100.0), 0.001, F.abs(F.get(x, F.lit(0)))).alias("bits"))


@query(_masked_sql("1", "63", "(2 ** (vec_id % 7 + 2) - 1)::DOUBLE", "vec_id"))
def variable_bits(spark, sf):
    q = K.apply_bits(F.col("x"), (F.col("vec_id") % 7 + 2).cast("int"), K.tail_outliers(F.col("x"), 0.01))
    return _vectors(spark, sf).select("vec_id", F.round(F.aggregate(q, F.lit(0.0), lambda s, y: s + y), 6).alias("total"))


@query("SELECT vec_id, round((1 - 1.0 / 64) * b + 48.0 / 64 + 36.0 / 64, 6)::DOUBLE AS bits, round(10 * 64 * ((1 - 1.0 / 64) * b + 48.0 / 64 + 36.0 / 64) / 8 * 3 / 4, 6)::DOUBLE AS held FROM (SELECT vec_id, (vec_id % 7 + 2)::DOUBLE AS b FROM embeddings)")
def effective_bits(spark, sf):
    b = (F.col("vec_id") % 7 + 2).cast("double")
    return rounded(table(spark, sf, "embeddings").select("vec_id", K.effective_bits(b, 64).alias("bits"), K.held_bytes(K.effective_bytes(F.lit(10), b, 64), F.lit(3), F.lit(4)).alias("held")))


@query(f"WITH {LONG}, m AS (SELECT label, pos, vec_id, score, row_number() OVER (PARTITION BY label, pos ORDER BY vec_id) - 1 AS step FROM l) SELECT label, pos, step, round(greatest(max(score) OVER (PARTITION BY label, pos ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), 6) AS rolling FROM m")
def rolling_maximum(spark, sf):
    rows = _long(spark, sf).withColumn("step", (F.row_number().over(W.partitionBy("label", "pos").orderBy("vec_id")) - 1).cast("long"))
    return rounded(K.rolling_max(rows, 5, "label").select("label", "pos", "step", "rolling"))


@query(f"WITH {LONG}, r AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM l) SELECT label, round(greatest(score, 0.1), 6) AS threshold FROM r WHERE i = floor(n * 0.9)")
def percentile_calibration(spark, sf):
    return rounded(K.calibrated(_long(spark, sf), "score", 0.9, 0.1, "label"))


@query(f"WITH {LONG} SELECT label, pos, CAST((vec_id % 8) // 2 AS BIGINT) AS kv_head, round(avg(score), 6) AS score FROM l GROUP BY ALL")
def head_group_mean(spark, sf):
    return rounded(K.head_groups(_long(spark, sf).withColumn("head", F.col("vec_id") % 8), 2, "label", "pos"))


@query(f"WITH {VEC}, m AS (SELECT vec_id, CASE WHEN vec_id % 3 < 2 THEN list_transform(x, lambda y, i: CASE WHEN i IN (6, 10) THEN '-Infinity'::DOUBLE ELSE y END) ELSE x END AS a FROM v) SELECT vec_id, CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS token FROM m")
def greedy_token(spark, sf):
    return _vectors(spark, sf).select("vec_id", K.greedy_token(F.col("x"), F.array(F.lit(5), F.lit(9)), (F.col("vec_id") % 3).cast("int"), 2).alias("token"))


@query("SELECT event_type, round(exp(sum(value / 1000) / count(*)), 6) AS perplexity FROM events GROUP BY event_type")
def perplexity(spark, sf):
    return rounded(table(spark, sf, "events").groupBy("event_type").agg(K.perplexity(F.col("value") / 1000, F.lit(1)).alias("perplexity")))


# --- learned and sink-shaped -------------------------------------------------


TEXT_FOLDS = """d AS (SELECT doc_id AS key, coalesce(lang, '') AS task FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 0),
f AS (SELECT key, CAST((row_number() OVER (PARTITION BY task ORDER BY key) - 1) % 2 AS INTEGER) AS fold FROM d)"""


@query(f"""WITH {TEXT_FOLDS}, n AS (SELECT fold, count(*) AS test_rows FROM f GROUP BY fold)
SELECT fold, 'C' || i AS configuration, CAST(sum(test_rows) OVER (PARTITION BY i) - test_rows AS BIGINT) AS train_rows, test_rows, true AS beats_mean FROM n, range(1, 6) t(i)""")
def learned_fits(spark, sf):
    from ledgerline.operators import learned

    labels, _, rows, predicted = learned.cross_validated(spark, sf, folds=2)  # as its SQL has them
    report = learned.fit_report(labels, rows, predicted).filter("configuration <> 'C0'")
    return report.select("fold", "configuration", "train_rows", "test_rows", (F.col("mae") < F.col("mean_mae")).alias("beats_mean"))


@query()
def router_learned(spark, sf):
    from ledgerline.operators import learned

    labels, fold, _, predicted = learned.cross_validated(spark, sf)
    return rounded(R.evaluate_folds(labels, fold, (0.5, 0.7, 0.9), predicted))


@query(f"{WITH}, {ISO99} SELECT p.task, p.key, " + ", ".join(f"round(max(CASE WHEN p.configuration = '{c}' THEN p.{f} END), 6) AS {c}_{f}" for c in CONFIGS for f in ("score", "compression")) + ", any_value(iso.configuration) AS oracle FROM panel p JOIN iso ON iso.key = p.key GROUP BY p.task, p.key")
def flat_export(spark, sf):
    from ledgerline.sinks.export import flat

    labels = panel(spark, sf)
    return rounded(flat(labels, O.iso_quality(labels).select("key", F.col("configuration").alias("oracle")), CONFIGS))
