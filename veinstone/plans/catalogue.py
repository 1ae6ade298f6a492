"""Queries of the catalogue: lookups, pages, searches, joins, roll-ups, walks, changes, mining and verification.

Tables with repeated and outdated rows are read through their current rows. Each query has the same result
as its SQL over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veinstone.functions.code_text import code_hash
from veinstone.functions.ids import canonical_id, id_name, id_path, valid_id
from veinstone.functions.schema import ARTIFACT_STATUSES
from veinstone.operators import catalog, contracts, graph, intervals, merge, mining, stats, verify
from veinstone.sources.tables import current_rows, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _current(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    df = load(spark, d, table)
    return current_rows(df.select(*dict.fromkeys(["function_id", *columns, "updated_at"])) if columns else df, "function_id")


def _history(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "learning_history").dropDuplicates()


def _edges(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "dependencies").select(canonical_id("caller_id").alias("caller"), canonical_id("callee_id").alias("callee"))
    return graph.distinct_edges(raw)


def _stamp(column: str) -> Column:
    """A time as text, so that no client's time type or zone matters."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _double(column: str) -> Column:
    return F.col(column).cast("double").alias(column)


def _stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _cur(table: str) -> str:
    return f"(SELECT * FROM {table} WHERE function_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY updated_at DESC NULLS LAST) = 1)"


def _canon(c: str) -> str:
    return rf"regexp_replace(replace(trim({c}, ' ' || chr(9)), '\', '/'), '^(\./)+', '')"


_A, _C, _Q = _cur("artifacts"), _cur("contracts"), _cur("queue")
#: Current contracts with their scores on one scale: above 1 they are percentages.
_S = f"(SELECT * REPLACE ((CASE WHEN confidence_score::DOUBLE > 1 THEN confidence_score::DOUBLE / 100 ELSE confidence_score::DOUBLE END)::REAL AS confidence_score) FROM {_C})"
_H = "(SELECT DISTINCT * FROM learning_history)"
_E = f"(SELECT DISTINCT {_canon('caller_id')} AS caller, {_canon('callee_id')} AS callee FROM dependencies WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL)"
_START = f"(SELECT min(caller) FROM {_E})"


# lookups and pages


@query(f"SELECT function_id, file_path, function_name, language, start_line, end_line, status FROM {_A} WHERE function_id = (SELECT min(function_id) FROM artifacts)")
def artifact_lookup(spark, d):
    artifacts = load(spark, d, "artifacts")
    first = artifacts.agg(F.min("function_id")).scalar()
    columns = ["function_id", "file_path", "function_name", "language", "start_line", "end_line", "status"]
    return current_rows(catalog.lookup(artifacts.select(*columns, "updated_at"), "function_id", first), "function_id").select(*columns)


@query(f"""SELECT function_id, file_path, start_line, status, language FROM {_A} WHERE status = 'PENDING' AND file_path LIKE '%/core/%' AND language = 'python'
ORDER BY file_path NULLS LAST, start_line NULLS LAST, function_id LIMIT 100""")
def artifact_list_filtered(spark, d):
    rows = _current(spark, d, "artifacts", "file_path", "start_line", "status", "language")
    hits = catalog.where_all(rows, {"status": "PENDING", "language": "python"}, {"file_path": "%/core/%"})
    return catalog.page(hits, [("file_path", "asc"), ("start_line", "asc"), ("function_id", "asc")], 100).select("function_id", "file_path", "start_line", "status", "language")


@query(f"SELECT function_id, file_path, start_line FROM {_A} ORDER BY file_path NULLS LAST, start_line NULLS LAST, function_id LIMIT 50 OFFSET 100")
def artifact_page(spark, d):
    rows = _current(spark, d, "artifacts", "file_path", "start_line")
    return catalog.page(rows, [("file_path", "asc"), ("start_line", "asc"), ("function_id", "asc")], 50, 100).select("function_id", "file_path", "start_line")


@query(f"""SELECT c.function_id, c.confidence_score::DOUBLE AS confidence_score, c.verification_script IS NOT NULL AS has_verification_script, a.file_path, a.status
FROM {_C} c JOIN {_A} a USING (function_id) WHERE c.function_id IN (SELECT function_id FROM {_Q} WHERE status = 'FAILED')""")
def contract_batch(spark, d):
    failed = catalog.where_all(_current(spark, d, "queue", "status"), {"status": "FAILED"})
    wanted = catalog.lookup_many(_current(spark, d, "contracts", "confidence_score", "verification_script"), "function_id", failed)
    artifacts = _current(spark, d, "artifacts", "file_path", "status").drop("updated_at")
    return wanted.join(artifacts, "function_id").select("function_id", _double("confidence_score"), F.col("verification_script").isNotNull().alias("has_verification_script"), "file_path", "status")


@query(f"""SELECT c.function_id, a.function_name, c.confidence_score::DOUBLE AS confidence_score FROM {_C} c JOIN {_A} a USING (function_id)
WHERE a.function_name LIKE 'merge%' OR c.function_id LIKE '%merge%'
ORDER BY CASE WHEN a.function_name = 'merge' THEN 0 ELSE 1 END, a.function_name NULLS LAST, c.function_id LIMIT 10""")
def contract_search(spark, d):
    joined = _current(spark, d, "contracts", "confidence_score").drop("updated_at").join(_current(spark, d, "artifacts", "function_name").drop("updated_at"), "function_id")
    return catalog.search(joined, "merge", "function_name", "function_id", 10).select("function_id", "function_name", _double("confidence_score"))


@query(f"""SELECT c.function_id, c.confidence_score::DOUBLE AS confidence_score, a.status FROM {_C} c JOIN {_A} a USING (function_id)
ORDER BY c.confidence_score DESC NULLS LAST, c.function_id LIMIT 50""")
def contract_list(spark, d):
    joined = _current(spark, d, "contracts", "confidence_score").drop("updated_at").join(_current(spark, d, "artifacts", "status").drop("updated_at"), "function_id")
    return catalog.page(joined, [("confidence_score", "desc"), ("function_id", "asc")], 50).select("function_id", _double("confidence_score"), "status")


@query(f"""WITH hits AS (
  SELECT c.function_id, c.confidence_score, c.updated_at, a.status FROM {_C} c JOIN {_A} a USING (function_id)
  WHERE c.confidence_score::DOUBLE >= 0.7::DOUBLE AND a.status = 'VERIFIED')
SELECT function_id, CAST(trunc(CASE WHEN confidence_score::DOUBLE > 1.0 THEN confidence_score::DOUBLE ELSE confidence_score::DOUBLE * 100 END) AS INTEGER) AS percent,
  (SELECT count(*) FROM hits) AS total, 25 < (SELECT count(*) FROM hits) AS has_more
FROM hits ORDER BY updated_at DESC NULLS LAST, function_id LIMIT 25""")
def contract_list_min_conf(spark, d):
    contracts = _current(spark, d, "contracts", "confidence_score")
    artifacts = catalog.where_all(_current(spark, d, "artifacts", "status"), {"status": "VERIFIED"}).drop("updated_at")
    score = F.col("confidence_score").cast("double")
    hits = catalog.where_all(contracts, at_least={"confidence_score": F.lit(0.7)}).join(artifacts, "function_id")
    paged = catalog.page_with_total(hits, [("updated_at", "desc"), ("function_id", "asc")], 25)
    return paged.select("function_id", F.when(score > 1.0, score).otherwise(score * 100).cast("int").alias("percent"), "total", "has_more")


@query(f"""SELECT function_id,
  CASE WHEN json_valid(contract_json) AND json_type(contract_json, '$.invariants') = 'ARRAY' THEN CAST(json_array_length(contract_json, '$.invariants') AS INTEGER) ELSE 0 END AS n_invariants,
  CASE WHEN json_valid(contract_json) AND json_type(contract_json, '$.intent_summary') = 'VARCHAR' THEN
    CASE WHEN length(contract_json->>'$.intent_summary') > 100 THEN contract_json->>'$.intent_summary'[1:100] || '...' ELSE contract_json->>'$.intent_summary' END END AS summary
FROM {_C}""".replace("contract_json->>'$.intent_summary'[1:100]", "left(contract_json->>'$.intent_summary', 100)"))
def contract_enrichment(spark, d):
    rows = _current(spark, d, "contracts", "contract_json")
    return rows.select("function_id", catalog.list_size("contract_json", "invariants").alias("n_invariants"), catalog.shortened(catalog.text_field("contract_json", "intent_summary"), 100).alias("summary"))


@query()
def contract_problems(spark, d):
    rows = _current(spark, d, "contracts", "contract_json")
    return contracts.validate(rows, F.col("function_id"), F.col("contract_json")).withColumnRenamed("key", "function_id")


@query(f"""SELECT function_id, function_name, tier FROM (
  SELECT function_id, function_name, CASE WHEN contains(lower(function_name), 'cache') THEN 0 WHEN contains(lower(file_path), 'cache') THEN 1 END AS tier FROM {_A})
WHERE tier IS NOT NULL ORDER BY tier, function_id LIMIT 5""")
def similar_functions(spark, d):
    rows = _current(spark, d, "artifacts", "function_name", "file_path")
    return catalog.similar(rows, "Cache", "cache", "function_name", "file_path", "function_id", 5).select("function_id", "function_name", "tier")


@query(f"""SELECT a.function_id, a.status, c.function_id IS NOT NULL AS has_contract FROM {_A} a LEFT JOIN {_C} c USING (function_id)""")
def node_info(spark, d):
    return catalog.with_existence(_current(spark, d, "artifacts", "status"), load(spark, d, "contracts"), "function_id", "has_contract").select("function_id", "status", "has_contract")


@query(f"""SELECT function_id, split_part(function_id, '::', 1) AS path, CASE WHEN contains(function_id, '::') THEN substr(function_id, instr(function_id, '::') + 2) END AS name,
  contains(function_id, '::') AND instr(function_id, '::') > 1 AND length(function_id) > instr(function_id, '::') + 1 AS is_valid
FROM (SELECT DISTINCT {_canon('function_id')} AS function_id FROM artifact_snapshots WHERE function_id IS NOT NULL)""")
def id_parts(spark, d):
    ids = load(spark, d, "artifact_snapshots").select(canonical_id("function_id").alias("function_id")).filter("function_id is not null").distinct()
    return ids.select("function_id", id_path("function_id").alias("path"), id_name("function_id").alias("name"), valid_id("function_id").alias("is_valid"))


@query(f"""SELECT function_id, priority, status FROM (SELECT * FROM {_Q} ORDER BY priority NULLS LAST, created_at NULLS LAST, function_id LIMIT 200) WHERE status = 'PENDING' AND priority >= 20""")
def queue_list(spark, d):
    rows = _current(spark, d, "queue", "priority", "status", "created_at")
    kept = catalog.limit_then_filter(rows, [("priority", "asc"), ("created_at", "asc"), ("function_id", "asc")], 200, (F.col("status") == "PENDING") & (F.col("priority") >= 20))
    return kept.select("function_id", "priority", "status")


@query(f"SELECT id, commit_sha, function_id, {_stamp_sql('created_at')} AS created_at FROM {_H} h WHERE commit_sha LIKE 'a%' AND pattern_type = 'off_by_one' ORDER BY h.created_at DESC NULLS LAST, id LIMIT 100")
def learning_events(spark, d):
    rows = catalog.where_all(_history(spark, d), {"pattern_type": "off_by_one"}, {"commit_sha": "a%"})
    return catalog.page(rows, [("created_at", "desc"), ("id", "asc")], 100).select("id", "commit_sha", "function_id", _stamp("created_at"))


@query(f"SELECT event_id, {_stamp_sql('ts')} AS ts, value FROM events e WHERE event_type = 'error' ORDER BY e.ts DESC NULLS LAST, event_id LIMIT 100")
def findings_newest(spark, d):
    rows = catalog.where_all(load(spark, d, "events"), {"event_type": "error"})
    return catalog.page(rows, [("ts", "desc"), ("event_id", "asc")], 100).select("event_id", _stamp("ts"), "value")


@query(f"SELECT event_id, user_id, {_stamp_sql('ts')} AS ts FROM events e WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY e.ts DESC NULLS LAST, event_id DESC) <= 3")
def traces_newest_per_key(spark, d):
    return stats.newest_per_key(load(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3).select("event_id", "user_id", _stamp("ts"))


# roll-ups


@query(f"SELECT status, count(*) AS n FROM {_A} GROUP BY status")
def artifact_counts(spark, d):
    return stats.count_by(_current(spark, d, "artifacts", "status"), "status")


@query(f"SELECT status, upper(trim(reason)) AS reason, count(*) AS n FROM {_Q} GROUP BY ALL")
def queue_counts(spark, d):
    rows = _current(spark, d, "queue", "status", "reason").withColumn("reason", F.upper(F.btrim("reason", F.lit(" "))))
    return stats.count_by(rows, "status", "reason")


@query(f"""SELECT count(*) AS total, round(avg(confidence_score::DOUBLE) * 100, 1) AS average,
  CAST(coalesce(sum(CASE WHEN confidence_score < 0.5::REAL THEN 1 ELSE 0 END), 0) AS BIGINT) AS low,
  CAST(coalesce(sum(CASE WHEN confidence_score >= 0.5::REAL AND confidence_score < 0.7::REAL THEN 1 ELSE 0 END), 0) AS BIGINT) AS moderate,
  CAST(coalesce(sum(CASE WHEN confidence_score >= 0.7::REAL AND confidence_score < 0.9::REAL THEN 1 ELSE 0 END), 0) AS BIGINT) AS good,
  CAST(coalesce(sum(CASE WHEN confidence_score >= 0.9::REAL THEN 1 ELSE 0 END), 0) AS BIGINT) AS high
FROM {_S}""")
def confidence_stats(spark, d):
    return stats.buckets(_scores(spark, d), "confidence_score", [0.5, 0.7, 0.9], ["low", "moderate", "good", "high"])


@query(f"""SELECT l.level, coalesce(n, 0) AS n FROM (VALUES ('high'), ('good'), ('moderate'), ('low')) l(level) LEFT JOIN (
  SELECT CASE WHEN confidence_score >= 0.9::REAL THEN 'high' WHEN confidence_score >= 0.7::REAL THEN 'good' WHEN confidence_score >= 0.5::REAL THEN 'moderate' ELSE 'low' END AS level, count(*) AS n
  FROM {_S} WHERE confidence_score IS NOT NULL GROUP BY 1) USING (level)""")
def confidence_distribution(spark, d):
    return stats.levels(_scores(spark, d), "confidence_score", [("high", 0.9), ("good", 0.7), ("moderate", 0.5)], "low")


@query(f"""WITH s AS (SELECT CAST(trunc(confidence_score::DOUBLE * 100) AS INTEGER) AS v FROM {_S} WHERE confidence_score IS NOT NULL),
r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS k, count(*) OVER () AS n FROM s)
SELECT CASE WHEN (SELECT count(*) FROM s) = 0 THEN 70 WHEN floor((SELECT count(*) FROM s) * 0.7) < 1 THEN least((SELECT max(v) FROM s) + 1, 100)
  ELSE (SELECT v FROM r WHERE k = CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) END AS threshold""")
def suggest_threshold(spark, d):
    return stats.kth_largest(_scores(spark, d), F.col("confidence_score").cast("double") * 100, 0.7, 70)


_PIVOT = ", ".join(f"CAST(coalesce(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_{s.lower()}" for s in ARTIFACT_STATUSES)


@query(f"SELECT count(*) AS total, {_PIVOT} FROM {_A}")
def status_summary(spark, d):
    return stats.pivot_counts(_current(spark, d, "artifacts", "status"), "status", ARTIFACT_STATUSES)


@query(f"SELECT file_path, count(*) AS total, {_PIVOT} FROM {_A} GROUP BY file_path")
def file_status_summary(spark, d):
    return stats.pivot_counts(_current(spark, d, "artifacts", "status", "file_path"), "status", ARTIFACT_STATUSES, ["file_path"])


@query(f"SELECT lower(language) AS language, count(*) AS total, {_PIVOT} FROM {_A} GROUP BY 1")
def language_status_summary(spark, d):
    rows = _current(spark, d, "artifacts", "status", "language").withColumn("language", F.lower("language"))
    return stats.pivot_counts(rows, "status", ARTIFACT_STATUSES, ["language"])


_RATES = """round(coalesce(n_verified / nullif(total, 0)::DOUBLE, 0), 4) AS completion_rate, round(coalesce((n_verified + n_needs_review) / nullif(total, 0)::DOUBLE, 0), 4) AS success_rate,
  n_pending + n_stale + n_needs_review + n_broken AS actionable"""


@query(f"SELECT total, {_RATES} FROM (SELECT count(*) AS total, {_PIVOT} FROM {_A})")
def status_rates(spark, d):
    return stats.rates(status_summary(spark, d)).select("total", "completion_rate", "success_rate", "actionable")


@query(f"SELECT file_path, total, {_RATES} FROM (SELECT file_path, count(*) AS total, {_PIVOT} FROM {_A} GROUP BY file_path)")
def file_status_rates(spark, d):
    return stats.rates(file_status_summary(spark, d)).select("file_path", "total", "completion_rate", "success_rate", "actionable")


# open findings about contracts: the history's events that changed no contract, weighed by what they added
_WEIGHT = "CASE WHEN new_invariants_added >= 2 THEN 15 WHEN new_invariants_added = 1 THEN 8 ELSE 3 END"


@query(f"""SELECT function_id, base, base - greatest(0, base - coalesce(p, 0)) AS penalty, greatest(0, base - coalesce(p, 0)) AS adjusted, coalesce(n, 0) AS n_open
FROM (SELECT function_id, CAST(trunc(confidence_score::DOUBLE * 100) AS INTEGER) AS base FROM {_S} WHERE confidence_score IS NOT NULL)
LEFT JOIN (SELECT function_id, CAST(sum({_WEIGHT}) AS BIGINT) AS p, count(*) AS n FROM {_H} WHERE NOT contract_modified GROUP BY 1) USING (function_id)""")
def adjusted_confidence(spark, d):
    scores = _scores(spark, d).filter("confidence_score is not null").select("function_id", (F.col("confidence_score").cast("double") * 100).cast("int").alias("base"))
    return stats.adjusted(scores, _history(spark, d), "function_id", "base", F.expr(_WEIGHT), ~F.col("contract_modified")).select("function_id", "base", "penalty", "adjusted", "n_open")


@query(f"""SELECT 'artifacts' AS part, count(*) AS n_functions, count(*) FILTER (WHERE h) AS n_with_contract, round(coalesce(count(*) FILTER (WHERE h) / nullif(count(*), 0)::DOUBLE, 0), 4) AS coverage
FROM (SELECT function_id IN (SELECT function_id FROM contracts WHERE function_id IS NOT NULL) AS h FROM {_A})""")
def contract_coverage(spark, d):
    flagged = catalog.with_existence(_current(spark, d, "artifacts", "status"), load(spark, d, "contracts"), "function_id", "has")
    counted = flagged.agg(F.count("*").alias("n_functions"), F.count_if("has").alias("n_with_contract"))
    share = F.round(F.coalesce(F.try_divide("n_with_contract", "n_functions"), F.lit(0.0)), 4)
    return counted.select(F.lit("artifacts").alias("part"), "n_functions", "n_with_contract", share.alias("coverage"))


@query(f"""SELECT function_id, status, priority, attempts, confidence_score::DOUBLE AS confidence_score, file_path FROM {_A} a
LEFT JOIN (SELECT function_id, priority, attempts FROM {_Q}) q USING (function_id) LEFT JOIN (SELECT function_id, confidence_score FROM {_C}) c USING (function_id)
WHERE function_id = (SELECT max(function_id) FROM artifacts)""")
def function_record(spark, d):
    artifacts = load(spark, d, "artifacts")
    last = artifacts.agg(F.max("function_id")).scalar()
    one = lambda table, *columns: current_rows(catalog.lookup(load(spark, d, table).select("function_id", *columns, "updated_at"), "function_id", last), "function_id").drop("updated_at")
    joined = one("artifacts", "status", "file_path").join(one("queue", "priority", "attempts"), "function_id", "left").join(one("contracts", "confidence_score"), "function_id", "left")
    return joined.select("function_id", "status", "priority", "attempts", _double("confidence_score"), "file_path")


@query(f"""SELECT function_id, id, pattern_type, k FROM (SELECT function_id, id, pattern_type, row_number() OVER (PARTITION BY function_id ORDER BY created_at DESC NULLS LAST, id DESC) AS k
FROM {_H} WHERE function_id IS NOT NULL) WHERE k <= 5""")
def newest_events(spark, d):
    newest = stats.newest_per_key(_history(spark, d).select("function_id", "id", "pattern_type", "created_at"), "function_id", "created_at", "id", 5)
    place = F.row_number().over(Window.partitionBy("function_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last()))
    return newest.select("function_id", "id", "pattern_type", place.cast("long").alias("k"))


@query(f"""SELECT 'artifact' AS part, status AS name, count(*) AS n FROM {_A} GROUP BY status
UNION ALL SELECT 'queue', status, count(*) FROM {_Q} GROUP BY status
UNION ALL SELECT 'contract', 'total', count(*) FROM {_C}""")
def project_status(spark, d):
    part = lambda table: stats.count_by(_current(spark, d, table, "status"), "status")
    contracts = _current(spark, d, "contracts", "confidence_score").agg(F.count("*").alias("n")).select(F.lit("contract").alias("part"), F.lit("total").alias("name"), "n")
    out = part("artifacts").select(F.lit("artifact").alias("part"), F.col("status").alias("name"), "n")
    return out.unionByName(part("queue").select(F.lit("queue").alias("part"), F.col("status").alias("name"), "n")).unionByName(contracts)


@query(f"""SELECT count(*) AS n_events, count(DISTINCT commit_sha) AS n_commits, count(DISTINCT function_id) AS n_functions,
  CAST(sum(CASE WHEN contract_modified THEN 1 ELSE 0 END) AS BIGINT) AS n_modified, CAST(sum(new_invariants_added) AS BIGINT) AS n_added,
  CAST(sum(invariants_validated) AS BIGINT) AS n_validated, round(avg(confidence_boost::DOUBLE), 6) AS avg_boost FROM {_H}""")
def learning_stats(spark, d):
    return _history(spark, d).agg(
        F.count("*").alias("n_events"), F.countDistinct("commit_sha").alias("n_commits"), F.countDistinct("function_id").alias("n_functions"),
        F.sum(F.when(F.col("contract_modified"), 1).otherwise(0)).alias("n_modified"), F.sum("new_invariants_added").alias("n_added"),
        F.sum("invariants_validated").alias("n_validated"), F.round(F.avg(F.col("confidence_boost").cast("double")), 6).alias("avg_boost"),
    )


@query(f"SELECT pattern_type, count(*) AS n FROM {_H} WHERE pattern_type IS NOT NULL GROUP BY 1")
def pattern_distribution(spark, d):
    return stats.count_by(_history(spark, d).filter("pattern_type is not null"), "pattern_type")


@query(f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM {_H} WHERE created_at >= DATE '2024-06-10' - INTERVAL 7 DAY AND created_at < DATE '2024-06-11' GROUP BY 1")
def daily_activity(spark, d):
    at = F.col("created_at")
    rows = _history(spark, d).filter((at >= F.date_sub(F.lit("2024-06-10").cast("date"), 7)) & (at < F.lit("2024-06-11").cast("date")))
    return rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"""WITH n AS (SELECT * FROM {_H} WHERE function_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY created_at DESC NULLS LAST, id DESC) <= 50)
SELECT function_id, count(*) AS n_events, array_to_string(list_sort(list_distinct(list(pattern_type))), ',') AS patterns, round(sum(confidence_boost::DOUBLE), 4) AS boost,
  CAST(sum(new_invariants_added) AS BIGINT) AS n_added, CAST(sum(invariants_validated) AS BIGINT) AS n_validated FROM n GROUP BY 1""")
def function_learning_rollup(spark, d):
    newest = stats.newest_per_key(_history(spark, d), "function_id", "created_at", "id", 50)
    return newest.groupBy("function_id").agg(
        F.count("*").alias("n_events"), F.array_join(F.array_sort(F.collect_set("pattern_type")), ",").alias("patterns"), F.round(F.sum(F.col("confidence_boost").cast("double")), 4).alias("boost"),
        F.sum("new_invariants_added").alias("n_added"), F.sum("invariants_validated").alias("n_validated"),
    )


@query("""SELECT user_id, CAST(sum(w) AS BIGINT) AS penalty, CAST(greatest(0, 100 - sum(w)) AS BIGINT) AS remaining FROM (
  SELECT user_id, CASE WHEN value >= 150 THEN 15 WHEN value >= 50 THEN 8 ELSE 3 END AS w FROM events WHERE event_type = 'error') GROUP BY 1""")
def confidence_penalty(spark, d):
    weight = F.when(F.col("value") >= 150, 15).when(F.col("value") >= 50, 8).otherwise(3)
    return stats.penalised(catalog.where_all(load(spark, d, "events"), {"event_type": "error"}), "user_id", weight, 100)


# graph


@query(f"SELECT caller AS node, count(*) AS n FROM {_E} GROUP BY 1 ORDER BY n DESC, caller LIMIT 5")
def most_calls(spark, d):
    return stats.top_k(_edges(spark, d), ["caller"], 5).withColumnRenamed("caller", "node")


@query(f"SELECT callee AS node, count(*) AS n FROM {_E} GROUP BY 1 ORDER BY n DESC, callee LIMIT 5")
def most_called(spark, d):
    return stats.top_k(_edges(spark, d), ["callee"], 5).withColumnRenamed("callee", "node")


@query(f"""SELECT (SELECT count(*) FROM {_A}) AS n_nodes, (SELECT count(*) FROM {_E}) AS n_edges,
  (SELECT count(*) FROM {_A} WHERE function_id IN (SELECT function_id FROM contracts)) AS n_with_contract""")
def graph_stats(spark, d):
    artifacts = _current(spark, d, "artifacts", "status")
    flagged = catalog.with_existence(artifacts, load(spark, d, "contracts"), "function_id", "has")
    nodes = flagged.agg(F.count("*").alias("n_nodes"), F.count_if("has").alias("n_with_contract"))
    return nodes.withColumn("n_edges", _edges(spark, d).agg(F.count("*").alias("n")).scalar()).select("n_nodes", "n_edges", "n_with_contract")


@query(f"""SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (
  SELECT caller AS node, 1 AS o, 0 AS i FROM {_E} UNION ALL SELECT callee, 0, 1 FROM {_E}) GROUP BY 1""")
def degrees(spark, d):
    return graph.degrees(_edges(spark, d))


#: The function whose direct neighbours are listed.
HUB = "runtime/logging.py::emit"


@query(f"SELECT DISTINCT caller AS node FROM {_E} WHERE callee = '{HUB}'")
def callers(spark, d):
    return graph.neighbours(_edges(spark, d), HUB, "in")


@query(f"SELECT DISTINCT callee AS node FROM {_E} WHERE caller = (SELECT caller FROM {_E} GROUP BY 1 ORDER BY count(*) DESC, caller LIMIT 1)")
def callees(spark, d):
    edges = _edges(spark, d)
    return graph.neighbours(edges, stats.top_k(edges, ["caller"], 1).head().caller, "out")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d, "contracts", "confidence_score").withColumn("confidence_score", stats.unit_score("confidence_score"))


def _start(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("caller").alias("node"))


def _walk_sql(step: str, depth: int) -> str:
    return f"""WITH RECURSIVE e AS (FROM {_E}), s AS ({step}),
w AS (SELECT min(caller) AS node, 0 AS depth FROM e UNION SELECT s.next, w.depth + 1 FROM w JOIN s ON s.node = w.node WHERE w.depth < {depth})
"""


_OUT, _IN = "SELECT caller AS node, callee AS next FROM e", "SELECT callee AS node, caller AS next FROM e"


@query(_walk_sql(_OUT, 5) + "SELECT node, min(depth) AS depth FROM w WHERE node IS NOT NULL GROUP BY 1")
def dependency_callees(spark, d):
    edges = graph.cut(_edges(spark, d))
    return graph.walk(edges, _start(edges), 5, "out")


@query(_walk_sql(_IN, 5) + "SELECT node, min(depth) AS depth FROM w WHERE node IS NOT NULL GROUP BY 1")
def dependency_callers(spark, d):
    edges = graph.cut(_edges(spark, d))
    return graph.walk(edges, _start(edges), 5, "in")


@query(_walk_sql(f"{_OUT} UNION ALL {_IN}", 3) + "SELECT node, min(depth) AS depth FROM w WHERE node IS NOT NULL GROUP BY 1")
def dependency_around(spark, d):
    edges = graph.cut(_edges(spark, d))
    return graph.walk(edges, _start(edges), 3, "any")


@query(f"""WITH RECURSIVE e AS (FROM {_E}),
w AS (SELECT min(caller) AS node, 0 AS depth FROM e UNION SELECT e.callee, w.depth + 1 FROM w JOIN e ON e.caller = w.node WHERE w.depth < 2),
v AS (SELECT min(caller) AS node, 0 AS depth FROM e UNION SELECT e.caller, v.depth + 1 FROM v JOIN e ON e.callee = v.node WHERE v.depth < 2),
a AS (SELECT node, min(depth) AS down FROM w WHERE node IS NOT NULL GROUP BY 1), b AS (SELECT node, min(depth) AS up FROM v WHERE node IS NOT NULL GROUP BY 1)
SELECT node, least(down, up) AS depth, CASE WHEN least(down, up) = 0 THEN 'root' WHEN down IS NOT NULL AND up IS NOT NULL THEN 'both' WHEN down IS NOT NULL THEN 'callee' ELSE 'caller' END AS relationship
FROM a FULL JOIN b USING (node)""")
def dependency_both(spark, d):
    edges = graph.cut(_edges(spark, d))
    return graph.dependency_graph(edges, _start(edges), 2)


@query(_walk_sql(_OUT, 2) + f"""SELECT node, min(depth) AS depth, CASE min(depth) WHEN 0 THEN 'direct' WHEN 1 THEN 'callee' ELSE 'transitive' END AS relationship FROM w
WHERE node IN (SELECT function_id FROM artifacts) AND node NOT IN (SELECT function_id FROM contracts WHERE function_id IS NOT NULL) GROUP BY 1""")
def missing_contracts(spark, d):
    edges = graph.cut(_edges(spark, d))
    ids = lambda t: load(spark, d, t).select(F.col("function_id").alias("node"))
    return graph.missing_records(edges, _start(edges), ids("artifacts"), ids("contracts"), 2)


@query(f"""WITH p AS (SELECT function_id AS node FROM {_A} ORDER BY file_path NULLS LAST, start_line NULLS LAST, function_id LIMIT 100)
SELECT caller, callee FROM {_E} WHERE caller IN (FROM p) AND callee IN (FROM p)""")
def induced_subgraph(spark, d):
    nodes = catalog.page(_current(spark, d, "artifacts", "file_path", "start_line"), [("file_path", "asc"), ("start_line", "asc"), ("function_id", "asc")], 100)
    return graph.induced(_edges(spark, d), nodes.select(F.col("function_id").alias("node"))).select("caller", "callee")


@query(f"""WITH RECURSIVE e AS (FROM {_E}), r AS (SELECT caller AS a, callee AS b FROM e UNION SELECT r.a, e.callee FROM r JOIN e ON e.caller = r.b),
c AS (SELECT DISTINCT a AS n FROM r WHERE a = b), up AS (FROM c UNION SELECT a FROM r WHERE b IN (FROM c)), down AS (FROM c UNION SELECT b FROM r WHERE a IN (FROM c))
SELECT caller, callee FROM e WHERE caller IN (FROM down) AND callee IN (FROM up)""")
def cyclic_calls(spark, d):
    return graph.cyclic_core(_edges(spark, d)).select("caller", "callee")


# changes

_LATEST = "(SELECT max(scan_no) FROM artifact_snapshots)"
_SCAN = f"""(SELECT {_canon('function_id')} AS function_id, code_hash, updated_at FROM artifact_snapshots WHERE scan_no = {_LATEST} AND function_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_canon('function_id')} ORDER BY updated_at DESC NULLS LAST) = 1)"""


def _scan(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "artifact_snapshots")
    return rows.filter(F.col("scan_no") == rows.agg(F.max("scan_no")).scalar()).select(canonical_id("function_id").alias("function_id"), "code_hash", "updated_at").filter("function_id is not null")


@query(f"""SELECT function_id, CASE WHEN a.function_id IS NULL THEN 'new' WHEN s.function_id IS NULL THEN 'absent' WHEN s.code_hash IS NOT DISTINCT FROM a.code_hash THEN 'unchanged' ELSE 'changed' END AS outcome
FROM (SELECT function_id, code_hash FROM {_A}) a FULL JOIN {_SCAN} s USING (function_id)""")
def scan_outcomes(spark, d):
    return merge.classify(_current(spark, d, "artifacts", "code_hash"), _scan(spark, d), ["function_id"], "code_hash", "updated_at")


@query(f"""SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN a.function_id IS NULL THEN 'new' WHEN s.function_id IS NULL THEN 'absent' WHEN s.code_hash IS NOT DISTINCT FROM a.code_hash THEN 'unchanged' ELSE 'changed' END AS outcome
  FROM (SELECT function_id, code_hash FROM {_A}) a FULL JOIN {_SCAN} s USING (function_id)) GROUP BY 1""")
def scan_stats(spark, d):
    return stats.count_by(scan_outcomes(spark, d), "outcome")


@query(f"""SELECT coalesce(s.function_id, a.function_id) AS function_id,
  CASE WHEN s.function_id IS NULL OR s.code_hash IS NOT DISTINCT FROM a.code_hash THEN a.code_hash ELSE s.code_hash END AS code_hash,
  {_stamp_sql('CASE WHEN a.function_id IS NULL THEN s.created_at ELSE a.created_at END')} AS created_at
FROM (SELECT function_id, code_hash, created_at FROM {_A}) a FULL JOIN (SELECT *, updated_at AS created_at FROM {_SCAN}) s USING (function_id)""")
def artifact_upsert(spark, d):
    table = _current(spark, d, "artifacts", "code_hash", "created_at").select("function_id", "code_hash", "created_at")
    delta = _scan(spark, d).withColumn("created_at", F.col("updated_at"))
    return merge.merge_changed(table, delta, ["function_id"], "code_hash", ["created_at"], "updated_at").select("function_id", "code_hash", _stamp("created_at"))


@query(f"""SELECT coalesce(n.function_id, o.function_id) AS function_id, coalesce(n.confidence_score, CASE WHEN n.function_id IS NULL THEN o.confidence_score END)::DOUBLE AS confidence_score,
  {_stamp_sql('CASE WHEN o.function_id IS NULL THEN n.created_at ELSE o.created_at END')} AS created_at
FROM (SELECT function_id, confidence_score, created_at FROM contracts WHERE function_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY function_id ORDER BY updated_at ASC NULLS FIRST) = 1) o
FULL JOIN (SELECT function_id, confidence_score, created_at FROM {_C}) n USING (function_id)""")
def contract_upsert(spark, d):
    columns = ["function_id", "confidence_score", "created_at"]
    raw = load(spark, d, "contracts").select(*columns, "updated_at")
    age = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**62))
    old = current_rows(raw.withColumn("age", age), "function_id", "age").select(*columns)
    return merge.upsert(old, _current(spark, d, "contracts", "confidence_score", "created_at").select(*columns), ["function_id"], ["created_at"]).select("function_id", _double("confidence_score"), _stamp("created_at"))


@query(f"""SELECT caller_id, callee_id FROM (SELECT DISTINCT caller_id, callee_id FROM dependencies WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL)
UNION SELECT caller, callee FROM {_E}""")
def dependency_insert_ignore(spark, d):
    table = load(spark, d, "dependencies").select("caller_id", "callee_id").filter("caller_id is not null and callee_id is not null").distinct()
    return merge.insert_ignore(table, _edges(spark, d).toDF("caller_id", "callee_id"), ["caller_id", "callee_id"])


@query(f"SELECT function_id, CASE WHEN status = 'FAILED' THEN 'PENDING' ELSE status END AS status, CASE WHEN status = 'FAILED' THEN NULL ELSE error_message END AS error_message FROM {_Q}")
def queue_update(spark, d):
    rows = _current(spark, d, "queue", "status", "error_message").select("function_id", "status", "error_message")
    failed = F.col("status") == "FAILED"
    return merge.update_where(rows.withColumn("hit", failed), F.col("hit"), {"status": F.lit("PENDING"), "error_message": F.lit(None).cast("string")}).drop("hit")


@query(f"SELECT function_id, status FROM {_Q} WHERE status IS DISTINCT FROM 'COMPLETED'")
def queue_delete(spark, d):
    return merge.delete_where(_current(spark, d, "queue", "status"), F.col("status") == "COMPLETED").select("function_id", "status")


@query(f"""WITH q AS (FROM {_Q}), f AS (SELECT function_id FROM q WHERE status = 'PENDING' AND attempts < max_attempts ORDER BY priority NULLS LAST, created_at NULLS LAST, function_id LIMIT 1)
SELECT function_id, CASE WHEN function_id IN (FROM f) THEN 'PROCESSING' ELSE status END AS status, CASE WHEN function_id IN (FROM f) THEN attempts + 1 ELSE attempts END AS attempts, function_id IN (FROM f) AS claimed FROM q""")
def queue_claim(spark, d):
    rows = graph.cut(_current(spark, d, "queue", "status", "attempts", "max_attempts", "priority", "created_at"))
    order = [F.col("priority").asc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("function_id")]
    open_ = (F.col("status") == "PENDING") & (F.col("attempts") < F.col("max_attempts"))
    done = merge.claim_first(rows, open_, order, "function_id", {"status": F.lit("PROCESSING"), "attempts": F.col("attempts") + 1})
    return done.select("function_id", "status", "attempts", "claimed")


@query(f"SELECT function_id, priority, status FROM {_Q} WHERE status = 'PENDING' AND attempts < max_attempts ORDER BY priority NULLS LAST, created_at NULLS LAST, function_id LIMIT 10")
def queue_peek(spark, d):
    rows = _current(spark, d, "queue", "status", "attempts", "max_attempts", "priority", "created_at").filter("status = 'PENDING' and attempts < max_attempts")
    return catalog.page(rows, [("priority", "asc"), ("created_at", "asc"), ("function_id", "asc")], 10).select("function_id", "priority", "status")


# mining

_WORDS = " + ".join(f"CAST(contains(lower(commit_message), '{w}') AS INTEGER)" for w in mining.BUG_WORDS)
_ISSUES = "|".join(f"(?:{p})" for p in mining.ISSUE_PATTERNS)


@query(f"""SELECT id, least(100, least(50, 20 * ({_WORDS})) + CASE WHEN regexp_matches(commit_message, '{_ISSUES}', 'i') THEN 30 ELSE 0 END
  + CASE WHEN starts_with(lower(commit_message), 'fix') THEN 20 ELSE 0 END + CASE WHEN contains(lower(commit_message), 'bug') OR contains(lower(commit_message), 'error') THEN 15 ELSE 0 END) / 100.0::DOUBLE AS score
FROM {_H} WHERE commit_message IS NOT NULL""")
def bug_fix_score(spark, d):
    return _history(spark, d).filter("commit_message is not null").select("id", mining.bug_fix_score(F.col("commit_message")).alias("score"))


def _score_sql(kind: str) -> str:
    return " + ".join("1.5 * CAST(regexp_matches(body, '" + rule.replace("'", "''") + "', 'i') AS INTEGER)" for rule in mining.PATTERN_RULES[kind])


@query(f"SELECT function_id, {', '.join(f'CAST({_score_sql(k)} AS DOUBLE) AS {k}' for k in mining.PATTERN_RULES)} FROM {_A} WHERE body IS NOT NULL")
def pattern_scores(spark, d):
    rows = _current(spark, d, "artifacts", "body").filter("body is not null")
    return rows.select("function_id", *[s.alias(k) for k, s in mining.pattern_scores(F.col("body")).items()])


_RANKED = ", ".join(f"{{'score': CAST({_score_sql(k)} AS DOUBLE), 'rank': {-i}, 'pattern': '{k}'}}" for i, k in enumerate(mining.PATTERN_RULES))


@query(f"""SELECT function_id, CASE WHEN b.score <= 0 THEN 'unknown' ELSE b.pattern END AS pattern, CASE WHEN b.score <= 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, b.score / 3), 6) END AS confidence
FROM (SELECT function_id, list_max([{_RANKED}]) AS b FROM {_A} WHERE body IS NOT NULL)""")
def pattern_best(spark, d):
    rows = _current(spark, d, "artifacts", "body").filter("body is not null")
    best = rows.select("function_id", mining.best_pattern(mining.pattern_scores(F.col("body"))).alias("b"))
    return best.select("function_id", "b.pattern", F.round("b.confidence", 6).alias("confidence"))


@query()
def code_hashes(spark, d):
    return _current(spark, d, "artifacts", "body", "language").select("function_id", code_hash(F.col("body"), F.col("language")).alias("code_hash"))


@query(r"""SELECT function_id, start_line + CAST(pos AS INTEGER) - 1 AS line, lower(regexp_extract(text, '(?:#|//|/\*|\*|^|\s)\s*@(invariant|pre|post|requires)[:\s]+(.+)$', 1, 'i')) AS hint_type,
  regexp_replace(regexp_extract(text, '(?:#|//|/\*|\*|^|\s)\s*@(invariant|pre|post|requires)[:\s]+(.+)$', 2, 'i'), '\s*(?:\*+/?)?\s*$', '') AS hint
FROM (SELECT function_id, start_line, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1) AS pos
  FROM (SELECT function_id, start_line, replace(replace(body, chr(13), ''), 'return ', '# @post: ') AS body FROM """ + _A + r""" WHERE body IS NOT NULL))
WHERE regexp_matches(text, '(?:#|//|/\*|\*|^|\s)\s*@(invariant|pre|post|requires)[:\s]+(.+)$', 'i')""")
def hints(spark, d):
    # the bodies' returns are written as conditions, since no body of the test tables has a hint
    rows = _current(spark, d, "artifacts", "body", "start_line").withColumn("body", F.replace("body", F.lit("return "), F.lit("# @post: ")))
    return mining.hints(rows, "function_id", "body", "start_line")


@query()
def suspicious_lines(spark, d):
    rows = _current(spark, d, "artifacts", "body")
    return mining.suspicious_lines(rows, "function_id", "body", ["duplicate", "add", "append", "unique", "set"])


_HUNKS = f"(SELECT DISTINCT file_path, start_line AS hunk_start, end_line AS hunk_end FROM artifact_snapshots WHERE scan_no = {_LATEST})"


@query(f"""SELECT a.function_id, count(*) AS n_hunks FROM {_A} a JOIN {_HUNKS} h ON h.file_path = a.file_path AND a.start_line <= h.hunk_end AND a.end_line >= h.hunk_start
WHERE a.start_line <= a.end_line AND h.hunk_start <= h.hunk_end GROUP BY 1""")
def hunk_function_overlap(spark, d):
    rows = load(spark, d, "artifact_snapshots")
    changed = rows.filter(F.col("scan_no") == rows.agg(F.max("scan_no")).scalar()).select("file_path", F.col("start_line").alias("hunk_start"), F.col("end_line").alias("hunk_end")).distinct()
    functions = _current(spark, d, "artifacts", "file_path", "start_line", "end_line")
    return intervals.overlap_join(functions, changed, "file_path", ("start_line", "end_line"), ("hunk_start", "hunk_end")).groupBy("function_id").agg(F.count("*").alias("n_hunks"))


# verification of (input, output) rows

RULES = (
    verify.Invariant("positive", "output is positive", "HIGH"),
    verify.Invariant("not_negative", "output is not negative", "LOW"),
    verify.Invariant("bounded", "output is less than or equal to the input sum", "MEDIUM"),
    verify.Invariant("in_range", "output lies between 1000 and 50000", "MEDIUM"),
    verify.Invariant("present", "output is not None", "HIGH"),
    verify.Invariant("opaque", "the ledger keeps its order", "LOW"),
)
_PAIRS = "(SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS charged FROM lineitem)"
_TESTS = {
    "positive": "charged > 0", "not_negative": "charged >= 0", "bounded": "charged <= 0 + l_extendedprice + l_discount",
    "in_range": "charged BETWEEN 1000 AND 50000", "present": "charged IS NOT NULL", "opaque": "true",
}


def _checked(spark: SparkSession, d: str) -> DataFrame:
    pairs = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("charged")).distinct()
    return verify.check_rows(pairs, "charged", ["l_extendedprice", "l_discount"], RULES)


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (coalesce({t}, false)) AS n_passed, count(*) FILTER (NOT coalesce({t}, false)) AS n_failed FROM {_PAIRS}" for n, t in _TESTS.items()))
def verify_invariants(spark, d):
    return verify.summary(_checked(spark, d))


@query("SELECT name, criticality, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r.name}' AS name, '{r.criticality}' AS criticality FROM {_PAIRS} WHERE NOT coalesce({_TESTS[r.name]}, false)" for r in RULES) + ") GROUP BY ALL")
def violations(spark, d):
    found = verify.violations(_checked(spark, d), ["l_orderkey", "l_linenumber"])
    return stats.count_by(found, "name", "criticality")
