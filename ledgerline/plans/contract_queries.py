"""Queries of record contracts and of evaluations on a split, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import contracts as C
from ledgerline.operators import router as R
from ledgerline.plans.queries import CONFIGS, PRED, STATS, WITH, _staged_panel, query, rounded
from ledgerline.sources.panel import panel, table


def _json(**fields) -> F.Column:
    """A JSON object's text from its fields' JSON texts; a field without text is left out."""
    parts = [F.concat(F.lit(f'"{name}":'), text) for name, text in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(text) -> F.Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _where(condition: str, then: str, other: F.Column) -> F.Column:
    return F.when(F.expr(condition), F.lit(then)).otherwise(other)


@query("""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, n_chars, coalesce(source, '') LIKE '%1' AS classed FROM documents), r AS (SELECT doc_id, [
 CASE WHEN doc_id % 61 = 8 THEN 'task' END, CASE WHEN doc_id % 29 = 3 THEN 'model' END, CASE WHEN doc_id % 31 = 5 THEN 'place' END, CASE WHEN doc_id % 37 = 1 OR doc_id % 61 = 8 THEN 'metric' END,
 CASE WHEN doc_id % 43 IN (0, 2) THEN 'references' END,
 CASE WHEN doc_id % 61 = 8 THEN CASE WHEN classed <> (doc_id % 41 = 2) THEN 'classes' END WHEN doc_id % 41 = 2 THEN 'classes' END,
 CASE WHEN doc_id % 67 IN (3, 4) THEN 'features' END,
 CASE WHEN n_chars > 4000 AND doc_id % 47 = 4 THEN 'lengths' END, CASE WHEN doc_id % 53 = 6 OR (n_chars > 4000 AND doc_id % 47 = 4) THEN 'truncation' END,
 CASE WHEN doc_id % 59 = 7 OR doc_id % 61 = 8 THEN 'new_tokens' END] AS l FROM d)
SELECT doc_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), '+') AS broken FROM r WHERE len(list_filter(l, lambda x: x IS NOT NULL)) > 0""")
def shared_record_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON records, every rule broken by some of them."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars")
    registry = docs.select(F.col("source").alias("task")).distinct().select("task", F.lit("any").alias("category"), F.when(F.col("task").like("%1"), "classification").otherwise("qa_f1").alias("scorer"), F.lit(64).alias("max_new_tokens"))
    classed = F.col("source").like("%1")
    some, n = F.lit('["a","b"]'), F.col("n_chars").cast("string")
    line = _json(
        task=_where("doc_id % 61 = 8", '"no such task"', _quoted(F.col("source"))), model=_where("doc_id % 29 = 3", '""', F.lit('"m"')), model_id=F.lit('"m/1"'),
        source_index=_where("doc_id % 31 = 5", "true", F.col("doc_id").cast("string")),
        metric=_where("doc_id % 37 = 1", '"rouge_l"', F.when(classed, '"classification"').otherwise('"qa_f1"')),
        references=_where("doc_id % 43 = 0", "[]", _where("doc_id % 43 = 1", '["x",3,2.5]', _where("doc_id % 43 = 2", "[true]", F.lit('["x"]')))),
        all_classes=F.when(classed, _where("doc_id % 41 = 2", "null", some)).otherwise(_where("doc_id % 41 = 2", '["a","b"]', F.when(F.expr("doc_id % 2 = 0"), "null"))),
        features=F.concat(F.lit('{"seq_len_tokens":1,"seq_len_chars":'), n, F.lit(',"token_entropy":0.5,"gzip_ratio":1.2,"unique_token_ratio":'), _where("doc_id % 67 = 3", "1.5", F.lit("1.0")), F.lit(',"newline_density":0'), _where("doc_id % 67 = 4", "", F.lit(',"question_position":null')), F.lit("}")),
        pre_truncation_token_count=n, post_truncation_token_count=F.when(F.expr("doc_id % 47 = 4"), n).otherwise(F.least("n_chars", F.lit(4000)).cast("string")),
        truncated=_where("doc_id % 53 = 6", '"no"', F.when(F.col("n_chars") > 4000, "true").otherwise("false")),
        max_new_tokens=_where("doc_id % 59 = 7", "65", F.lit("64")), token_hash_algorithm=F.lit('"sha256"'),
    )
    found = C.shared_violations(C.parsed(docs.select("doc_id", line.alias("value"))), registry, 4000, "sha256")
    return found.select("doc_id", F.array_join("broken", "+").alias("broken"))


@query(f"""{WITH}, k AS (SELECT DISTINCT key FROM panel) SELECT key, 'answers' AS field, 'value' AS problem FROM k WHERE key % 7 = 3
UNION ALL SELECT key, 'note', 'presence' FROM k WHERE key % 5 IN (0, 2) UNION ALL SELECT key, 'meta', 'missing' FROM k WHERE key % 11 = 4""")
def shared_field_presence(spark, sf):
    """Fields that configurations must agree in: other values, fields of some records only, and required ones that are gone."""
    rows = panel(spark, sf).select("key", "cfg_ord")
    odd = F.expr("cfg_ord % 2 = 1")
    last = F.when(F.expr("key % 7 = 3 and cfg_ord = 2"), "[1,3]").otherwise("[1,2]")
    answers = F.when(odd, F.concat(F.lit('{"b": {"x": null, "a": "t"}, "a": '), last, F.lit("}"))).otherwise(F.concat(F.lit('{"a":'), last, F.lit(',"b":{"a":"t","x":null}}')))
    note = F.when(F.expr("key % 5 = 0 and cfg_ord < 4"), '"n"').when(F.expr("key % 5 = 1"), "null").when(F.expr("key % 5 = 2 and cfg_ord < 5"), "null")
    line = _json(answers=answers, note=note, meta=F.when(F.expr("key % 11 <> 4 or cfg_ord = 1"), F.lit("[]")))
    return C.shared_field_differences(C.parsed(rows.select("key", line.alias("value"))), ["key"], ["answers", "meta"], ["note"])


@query(f"""{WITH}, r AS (SELECT key, configuration, [CASE WHEN key % 13 = 1 AND cfg_ord = 3 THEN 'fields' END, CASE WHEN key % 17 = 2 AND cfg_ord = 0 THEN 'prediction' END, CASE WHEN key % 13 = 1 AND cfg_ord = 3 THEN 'accounting' END,
 CASE WHEN key % 19 = 3 AND cfg_ord = 5 THEN 'tokens' END, CASE WHEN key % 23 = 4 THEN 'score' END, CASE WHEN key % 29 = 5 AND cfg_ord = 2 THEN 'bytes' END, CASE WHEN (key % 31 = 6 AND cfg_ord = 1) OR (key % 29 = 5 AND cfg_ord = 2) THEN 'ratio' END] AS l FROM panel)
SELECT key, configuration, array_to_string(list_filter(l, lambda x: x IS NOT NULL), '+') AS broken FROM r WHERE len(list_filter(l, lambda x: x IS NOT NULL)) > 0""")
def wide_row_contract(spark, sf):
    """Joined rows, a field a configuration and output; some lack a field, or hold another type or value."""
    rows = panel(spark, sf)
    name = lambda n: F.concat(F.lit('"'), F.col("configuration"), F.lit(f'_{n}":'))
    cells = {
        "prediction": _where("key % 17 = 2 and cfg_ord = 0", "7", F.lit('"p"')),
        "kv_accounting": F.when(~F.expr("key % 13 = 1 and cfg_ord = 3"), _quoted(F.concat(F.lit("of "), "configuration"))),
        "generated_token_count": _where("key % 19 = 3 and cfg_ord = 5", "2.5", F.lit("2")),
        "score": F.when(F.expr("key % 23 = 4"), F.lit("1.25")).otherwise(F.col("score").cast("string")),
        "kv_bytes": _where("key % 29 = 5 and cfg_ord = 2", "0", F.col("kv_bytes").cast("string")),
        "kv_bytes_fp16": F.col("kv_bytes_fp16").cast("string"),
        "compression": F.when(F.expr("key % 31 = 6 and cfg_ord = 1"), (F.col("compression") * 1.01).cast("string")).otherwise(F.col("compression").cast("string")),
    }
    part = F.concat_ws(",", *(F.concat(name(n), x) for n, x in cells.items()))
    lines = rows.groupBy("key").agg(F.array_join(F.collect_list(part), ",").alias("p")).select("key", F.concat(F.lit("{"), "p", F.lit("}")).alias("value"))  # one entry a configuration
    found = C.wide_violations(C.parsed(lines), ["key"], CONFIGS, {c: f"of {c}" for c in CONFIGS})
    return found.select("key", "configuration", F.array_join("broken", "+").alias("broken"))


@query(f"""{WITH}, t AS (SELECT task, key FROM (SELECT DISTINCT task, key FROM panel)), reg AS (SELECT task, any_value(category) AS category, count(DISTINCT key) AS expected FROM panel GROUP BY task)
SELECT rule, task FROM (SELECT CASE WHEN expected % 5 = 0 THEN 'max_new_tokens' END AS rule, task FROM reg UNION ALL SELECT CASE WHEN category NOT LIKE '%R%' THEN 'category' END, task FROM reg
UNION ALL SELECT CASE WHEN expected % 7 = 0 THEN 'repeated' END, task FROM reg UNION ALL SELECT 'covered', 'left out' UNION ALL SELECT 'total', NULL) WHERE rule IS NOT NULL""")
def registry_rules(spark, sf):
    """The panel's tasks as a registry beside a published list that it departs from."""
    found = panel(spark, sf).groupBy("task").agg(F.first("category").alias("category"), F.countDistinct("key").alias("expected"))
    published = found.select("task", F.when(F.col("expected") % 5 == 0, 32).otherwise(64).alias("max_new_tokens"))
    more = spark.createDataFrame([("left out", 64), ("excluded", 64)], "task string, max_new_tokens int")
    tasks = found.withColumn("scorer", F.lit("qa_f1")).withColumn("max_new_tokens", F.lit(64))
    tasks = tasks.unionByName(tasks.filter("expected % 7 = 0"))
    categories = [r[0] for r in found.select("category").distinct().filter("category like '%R%'").collect()]  # registry-sized
    return C.registry_violations(tasks, published.unionByName(more), ["excluded"], categories, ["qa_f1"], 0)


SPLIT = "folds AS (SELECT DISTINCT key, key % 10 >= 7 AS held FROM panel)"
SPLIT_SQL = f"""{SPLIT}, tr AS (SELECT configuration, cfg_ord, sum(score) / count(*) AS train_q, count(*) / sum(1 / compression) AS train_cr FROM panel JOIN folds USING (key) WHERE NOT held GROUP BY ALL),
pr AS (SELECT task, cfg_ord, avg(score) AS m FROM panel JOIN folds USING (key) WHERE NOT held GROUP BY ALL),
pred AS (SELECT p.*, held, round(coalesce(m, train_q), 9) AS prediction, round(train_q, 9) AS train_q, round(train_cr, 9) AS train_cr FROM panel p JOIN folds USING (key) JOIN tr USING (configuration, cfg_ord) LEFT JOIN pr ON pr.task = p.task AND pr.cfg_ord = p.cfg_ord),
d0 AS (SELECT *, max(CASE WHEN cfg_ord = 0 THEN score END) OVER (PARTITION BY key) AS base, max(CASE WHEN cfg_ord = 0 THEN greatest(prediction, train_q) END) OVER (PARTITION BY key) AS bp FROM pred),
pts AS (SELECT * FROM (VALUES (0.9::DOUBLE), (0.95), (0.99)) v(tau)),
d1 AS (SELECT d0.*, tau, prediction >= tau * bp AS ok FROM d0, pts WHERE cfg_ord >= 1), d2 AS (SELECT *, max(ok::INT) OVER (PARTITION BY key, tau) = 1 AS has_ok FROM d1),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, tau ORDER BY ok DESC, CASE WHEN has_ok THEN train_cr ELSE prediction END DESC, cfg_ord) AS r FROM d2) WHERE r = 1)"""


@query(f"""{WITH}, {SPLIT_SQL} SELECT CASE WHEN held THEN 'test' ELSE 'train' END AS side, tau, round(avg(score), 6) AS q, round(count(*) / sum(1 / compression), 6) AS cr, count(*) AS n, round(avg((score < tau * base)::INT), 6) AS violation_rate FROM d GROUP BY ALL""")
def split_evaluation(spark, sf):
    """Routing of either side of a 70/30 split by what its training side says, for three taus."""
    labels = _staged_panel(spark, sf)
    split = labels.select("key", (F.col("key") % 10 < 7).alias("train")).distinct()
    return rounded(R.evaluate_split(labels, split, R.split_predictions(labels, split), (0.9, 0.95, 0.99)))


@query(f"""{WITH}, {SPLIT_SQL} SELECT configuration, CASE WHEN held THEN 'test' ELSE 'train' END AS side, count(*) AS n, round(avg(abs(score - prediction)), 6) AS mae,
round(1 - sum((score - prediction) ** 2) / nullif(sum(score ** 2) - count(*) * avg(score) ** 2, 0), 6) AS r2 FROM pred GROUP BY ALL""")
def split_fit_metrics(spark, sf):
    """Errors of the same predictions on the side that they were made from and on the other."""
    labels = _staged_panel(spark, sf)
    split = labels.select("key", (F.col("key") % 10 < 7).alias("train")).distinct()
    return rounded(R.split_fit(labels, split, R.split_predictions(labels, split)))


LINE_FOLDS = "folds AS (SELECT key, CAST((row_number() OVER (PARTITION BY task ORDER BY key) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT task, key FROM panel))"


@query(f"""{WITH}, {LINE_FOLDS}, {STATS}, x AS (SELECT p_partkey AS key, p_size::DOUBLE AS x FROM part), h AS (SELECT DISTINCT fold FROM folds),
f AS (SELECT h.fold, cfg_ord, regr_slope(score, x) AS b, regr_intercept(score, x) AS a FROM panel JOIN folds f USING (key) JOIN x USING (key) JOIN h ON h.fold <> f.fold GROUP BY ALL),
pred AS (SELECT p.*, fo.fold, round(a + b * x, 9) AS prediction, round(train_q, 9) AS train_q, round(train_cr, 9) AS train_cr FROM panel p JOIN folds fo USING (key) JOIN x USING (key) JOIN f ON f.fold = fo.fold AND f.cfg_ord = p.cfg_ord JOIN stats s ON s.fold = fo.fold AND s.cfg_ord = p.cfg_ord),
{SPLIT_SQL[SPLIT_SQL.index("d0 AS") :]} SELECT tau, round(avg(score), 6) AS q, round(count(*) / sum(1 / compression), 6) AS cr, count(*) AS n, round(avg((score < tau * base)::INT), 6) AS violation_rate FROM d GROUP BY tau""")
def length_only_router(spark, sf):
    """The baseline router that sees an item's size alone: a least-squares line per held-out fold and configuration."""
    labels = _staged_panel(spark, sf)
    folds = R.stratified_folds(labels, 5)
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("x"))
    stats = R.train_stats(labels, folds).withColumn("train_q", F.round("train_q", 9)).withColumn("train_cr", F.round("train_cr", 9))
    predicted = R.line_predictions(labels, folds, sizes, "x").withColumn("prediction", F.round("prediction", 9))
    return rounded(R.evaluate_folds(labels, folds, (0.9, 0.95, 0.99), predicted, stats))


@query("SELECT event_type, user_id % 10 AS part, count(*) AS n, sum(event_id)::BIGINT AS ids, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def published_table(spark, sf):
    """Events published in a new run and read back behind their record."""
    from ledgerline.sinks.publish import create_run, publish, read_published
    from ledgerline.sources.scratch import fresh

    run = create_run(spark, fresh(spark, "runs"), "model", "run-1")
    rows = table(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    publish(rows.repartition("event_type"), f"{run}/events", "event_type")  # some files a type
    back = read_published(spark, f"{run}/events", rows.schema)
    return back.groupBy("event_type", (F.col("user_id") % 10).alias("part")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("value"))
