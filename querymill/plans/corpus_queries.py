"""Report queries over the template corpus; their SQL twins read the hand-written truth instead of a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators.audit import audit, status
from querymill.plans import corpus, reports
from querymill.plans.registry import query
from querymill.session import table
from querymill.sql.findings import MESSAGES

_G = corpus.gold_sql()
_V = "(SELECT * FROM m WHERE parseable)"
#: The tables of each database of the corpus: all have the first three, even ones two more.
_CATALOG_SQL = "catalog AS (SELECT 'db_' || CAST(d AS VARCHAR) AS db_id, t AS \"table\" FROM (SELECT unnest(range(7)) AS d), (SELECT unnest(['users','orders','singer','admins','archive']) AS t) WHERE t IN ('users','orders','singer') OR d % 2 = 0)"
_USED_SQL = "used AS (SELECT db_id, t AS \"table\", count(DISTINCT id) AS queries FROM (SELECT db_id, id, unnest(tables) AS t FROM m WHERE parseable) GROUP BY 1, 2)"
_COVER = f"{_G}, {_CATALOG_SQL}, {_USED_SQL}, cov AS (SELECT c.db_id, count(*) AS tables, count(u.queries) AS used, CAST(coalesce(sum(u.queries), 0) AS BIGINT) AS uses, coalesce(string_agg(CASE WHEN u.queries IS NULL THEN c.\"table\" END, ',' ORDER BY c.\"table\"), '') AS unused_tables, round(count(u.queries) * 100.0::DOUBLE / count(*), 1) AS coverage FROM catalog c LEFT JOIN used u ON c.db_id = u.db_id AND c.\"table\" = u.\"table\" GROUP BY 1)"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return audit(corpus.items(spark, d))


def catalog(spark: SparkSession) -> DataFrame:
    tables = F.array(*[F.lit(t) for t in ("users", "orders", "singer", "admins", "archive")])
    return spark.range(7).select(F.concat(F.lit("db_"), F.col("id").cast("string")).alias("db_id"), F.explode(tables).alias("table"), "id").where("table in ('users', 'orders', 'singer') or id % 2 = 0").drop("id")


def _over(report, name: str, sql: str) -> None:
    query(name, sql)(lambda spark, d: report(metrics(spark, d)))


def _covered(report, name: str, sql: str | None) -> None:
    query(name, sql)(lambda spark, d: report(metrics(spark, d), catalog(spark)))


_FLAT = (
    "id, statement_type, is_read_only, is_select, table_count, column_count, join_count, subquery_count, max_subquery_depth, aggregate_count, where_condition_count, order_by_columns, cte_count, has_recursive_cte, window_fn_count, set_op_count, "
    "uses_wildcard, has_distinct, has_group_by, has_having, has_limit, has_offset, has_like, has_in, has_between, has_case, has_window_frame, difficulty_level, complexity_score"
)
_LISTS = ("tables", "join_types", "aggregate_types", "window_fn_types", "set_op_types")


@query("syntax_features_flat", f"{_G} SELECT {_FLAT.replace('table_count', 'CAST(len(tables) AS INTEGER) AS table_count')}, {', '.join(f"array_to_string({c}, ',') AS {c}" for c in _LISTS)} FROM {_V}")
def syntax_features_flat(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).where("parseable")
    return m.select(*_FLAT.split(", "), *[F.array_join(c, ",").alias(c) for c in _LISTS])


_over(reports.difficulty_share, "difficulty_share", f"{_G} SELECT difficulty_level, count(*) AS queries, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share FROM {_V} GROUP BY 1")
_over(reports.difficulty_density, "difficulty_density", f"{_G} SELECT difficulty_level, round(avg(len(tables)), 1) AS avg_tables, round(avg(join_count), 1) AS avg_joins, round(avg(subquery_count), 1) AS avg_subqueries, round(avg(aggregate_count), 1) AS avg_aggregates, round(avg(complexity_score), 1) AS avg_complexity FROM {_V} GROUP BY 1")
_over(reports.join_histogram, "join_histogram", f"{_G} SELECT CAST(least(join_count, 7) AS INTEGER) AS joins, count(*) AS queries, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS share FROM {_V} GROUP BY 1")
_over(reports.join_type_usage, "join_type_usage", f"{_G}, t AS (SELECT unnest(join_types) AS join_type FROM {_V}), n AS (SELECT count(*) AS every, count(*) FILTER (join_count > 0) AS joined FROM {_V}) SELECT join_type, count(*) AS uses, round(count(*) * 100.0::DOUBLE / max(joined), 1) AS share_of_joined, round(count(*) * 100.0::DOUBLE / max(every), 1) AS share_of_all FROM t, n GROUP BY 1")
_over(reports.subquery_summary, "subquery_summary", f"{_G} SELECT 'with_subquery' AS kind, count(*) FILTER (subquery_count >= 1) AS queries FROM {_V} UNION ALL SELECT 'correlated_proxy', count(*) FILTER (subquery_count >= 1 AND (has_in OR has_where)) FROM {_V} UNION ALL SELECT 'nested', count(*) FILTER (max_subquery_depth >= 2) FROM {_V}")
_over(reports.subquery_depth, "subquery_depth", f"{_G} SELECT CAST(least(max_subquery_depth, 3) AS INTEGER) AS depth, count(*) AS queries FROM {_V} WHERE max_subquery_depth > 0 GROUP BY 1")
_over(reports.cte_stats, "cte_stats", f"{_G} " + " UNION ALL ".join(f"SELECT 'at_least_{k}' AS kind, count(*) FILTER (cte_count >= {k}) AS queries, CAST(median(cte_count) FILTER (cte_count >= {k}) AS INTEGER) AS median_ctes FROM {_V}" for k in (1, 2, 3)) + f" UNION ALL SELECT 'recursive', count(*) FILTER (has_recursive_cte), CAST(NULL AS INTEGER) FROM {_V}")
_over(reports.aggregate_usage, "aggregate_usage", f"{_G}, t AS (SELECT CASE WHEN a IN ('COUNT', 'SUM', 'AVG', 'MAX', 'MIN') THEN a ELSE 'Other' END AS aggregate FROM (SELECT unnest(aggregate_types) AS a FROM {_V})), n AS (SELECT count(*) AS every, count(*) FILTER (aggregate_count > 0) AS aggregating FROM {_V}) SELECT aggregate, count(*) AS uses, round(count(*) * 100.0::DOUBLE / max(every), 1) AS share_of_all, round(count(*) * 100.0::DOUBLE / max(aggregating), 1) AS share_of_aggregating FROM t, n GROUP BY 1")
_over(reports.aggregation_patterns, "aggregation_patterns", f"{_G} SELECT 'single' AS kind, count(*) FILTER (aggregate_count = 1) AS queries FROM {_V} UNION ALL SELECT 'multiple', count(*) FILTER (aggregate_count > 1) FROM {_V} UNION ALL SELECT 'nested', count(*) FILTER (aggregate_count > 0 AND subquery_count > 0) FROM {_V} UNION ALL SELECT 'distinct_group_by', count(*) FILTER (has_distinct AND has_group_by) FROM {_V}")
_over(reports.feature_combinations, "feature_combinations", f"{_G} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS combination, count(*) FILTER ({c}) AS queries FROM {_V}" for n, c in reports.COMBINATIONS.items()) + ") WHERE queries > 0 ORDER BY queries DESC, combination LIMIT 10")
_over(reports.health_summary, "health_summary", f"{_G} SELECT count(*) AS total, count(*) FILTER (parseable) AS parsed, round(count(*) FILTER (parseable) * 100.0::DOUBLE / count(*), 1) AS parsed_share, round(avg(complexity_score) FILTER (parseable), 6) AS avg_complexity, CAST(median(complexity_score) FILTER (parseable) AS DOUBLE) AS median_complexity, round(stddev_samp(complexity_score) FILTER (parseable), 6) AS stddev_complexity FROM m")
_over(
    reports.balance,
    "balance",
    f"{_G}, b AS (SELECT CAST(count(DISTINCT difficulty_level) AS DOUBLE) AS levels, "
    + ", ".join(f"round(count(*) FILTER ({c}) * 100.0::DOUBLE / count(*), 1) AS {n}" for n, c in (("multi_table", "len(tables) > 1"), ("window_", "window_fn_count > 0"), ("single_table", "len(tables) <= 1"), ("recursive_", "has_recursive_cte"), ("set_operation", "set_op_count > 0"), ("subquery", "subquery_count > 0"), ("aggregate", "aggregate_count > 0")))
    + f" FROM {_V}) "
    + " UNION ALL ".join(f"SELECT '{n.rstrip('_')}' AS criterion, {n} AS value, {c} AS met FROM b" for n, c in (("levels", "levels >= 3"), ("multi_table", "multi_table >= 60"), ("window_", "window_ >= 5"), ("single_table", "single_table BETWEEN 20 AND 35"), ("recursive_", "recursive_ > 0"), ("set_operation", "set_operation >= 2"), ("subquery", "subquery > 0"), ("aggregate", "aggregate > 0"))),
)
_P = "p AS (SELECT id, db_id, split_part(x, ':', 1) AS pattern, split_part(x, ':', 2) AS severity FROM (SELECT id, db_id, unnest(patterns) AS x FROM m WHERE parseable))"
_TEXT = "text(pattern, message) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in MESSAGES.items()) + ")"
_over(reports.antipattern_rows, "antipattern_rows", f"{_G}, {_P}, {_TEXT} SELECT id, db_id, pattern, severity, message FROM p JOIN text USING (pattern)")
_over(reports.antipattern_by_severity, "antipattern_by_severity", f"{_G}, {_P} SELECT severity, count(*) AS findings, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS severity_order FROM p GROUP BY 1")
_BY = f"by_pattern AS (SELECT pattern, severity, count(*) AS findings, count(DISTINCT id) AS queries, round(count(DISTINCT id) * 100.0::DOUBLE / (SELECT count(*) FROM {_V}), 1) AS share, any_value(message) AS example_message FROM p JOIN text USING (pattern) GROUP BY 1, 2)"
_over(reports.antipattern_by_pattern, "antipattern_by_pattern", f"{_G}, {_P}, {_TEXT}, {_BY} SELECT * FROM by_pattern")
_over(reports.antipattern_top, "antipattern_top", f"{_G}, {_P}, {_TEXT}, {_BY} SELECT *, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS severity_order FROM by_pattern ORDER BY severity_order, findings DESC, pattern LIMIT 15")
_over(reports.antipattern_items, "antipattern_items", f"{_G}, {_P} SELECT DISTINCT pattern, severity, id FROM p")
_over(reports.quality_summary, "quality_summary", f"{_G} SELECT count(*) AS total, count(*) FILTER (parseable) AS parsed, round(avg(quality_score) FILTER (parseable), 6) AS avg_quality, round(avg(len(patterns)) FILTER (parseable), 6) AS avg_findings, count(*) FILTER (parseable AND len(patterns) = 0) AS clean, round(count(*) FILTER (parseable AND len(patterns) = 0) * 100.0::DOUBLE / count(*) FILTER (parseable), 1) AS clean_share FROM m")
_over(reports.quality_levels, "quality_levels", f"{_G} SELECT CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 70 THEN 'good' WHEN quality_score >= 50 THEN 'fair' ELSE 'poor' END AS quality_level, count(*) AS queries FROM m GROUP BY 1")
_over(reports.worst_items, "worst_items", f"{_G} SELECT id, CAST(quality_score AS INTEGER) AS quality_score, CAST(len(patterns) AS INTEGER) AS total_antipatterns FROM m WHERE parseable AND quality_score < 50 ORDER BY total_antipatterns DESC, quality_score, CAST(id AS BIGINT), id LIMIT 10")
_over(reports.unparseable, "unparseable", f"{_G} SELECT count(*) FILTER (NOT parseable) AS unparseable, count(*) AS total, round(count(*) FILTER (NOT parseable) * 100.0::DOUBLE / count(*), 1) AS share FROM m")
_over(reports.unparseable_items, "unparseable_items", f"{_G} SELECT id, err FROM m WHERE NOT parseable")
_over(reports.used_tables, "used_tables", f"{_G}, {_USED_SQL} SELECT * FROM used")
_over(reports.dataset_overview, "dataset_overview", f"{_G} SELECT count(DISTINCT id) AS items, count(DISTINCT db_id) AS dbs FROM m")
_covered(reports.coverage_by_db, "coverage_by_db", f"{_COVER} SELECT *, CASE WHEN tables - used >= 3 THEN 'High' WHEN tables > used THEN 'Medium' ELSE 'None' END AS priority, greatest(0.0::DOUBLE, round(95 - coverage, 1)) AS lacking FROM cov")
_covered(reports.coverage_summary, "coverage_summary", f"{_COVER} SELECT count(*) AS dbs, CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(used) AS BIGINT) AS used, round(avg(tables), 2) AS avg_tables, round(avg(coverage), 2) AS avg_coverage, list_sort(list(coverage))[count(*) // 2 + 1] AS median_coverage FROM cov")
_covered(reports.table_usage_buckets, "table_usage_buckets", f"{_G}, {_CATALOG_SQL}, {_USED_SQL} SELECT {reports.USAGE} AS bucket, count(*) AS tables FROM (SELECT coalesce(queries, 0) AS queries FROM catalog LEFT JOIN used USING (db_id, \"table\")) GROUP BY 1")
_covered(reports.coverage_ranking, "coverage_ranking", f"{_COVER} SELECT * FROM (SELECT db_id, tables, used, coverage, 'top' AS side FROM cov ORDER BY coverage DESC, tables DESC, db_id LIMIT 5) UNION ALL SELECT * FROM (SELECT db_id, tables, used, coverage, 'bottom' AS side FROM cov ORDER BY coverage, tables DESC, db_id LIMIT 5)")
_covered(reports.unknown_tables, "unknown_tables", f"{_G}, {_CATALOG_SQL}, {_USED_SQL} SELECT * FROM used WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.db_id = used.db_id AND c.\"table\" = used.\"table\")")
_covered(reports.heat_map, "heat_map", f"{_COVER} SELECT db_id, rpad(db_id, 18, ' ') AS name, repeat('#', CAST(floor(coverage / 100 * 24) AS INTEGER)) || repeat('.', 24 - CAST(floor(coverage / 100 * 24) AS INTEGER)) AS bar, coverage, CASE WHEN coverage >= 100 THEN 'full' WHEN coverage >= 90 THEN 'high' WHEN coverage >= 75 THEN 'good' WHEN coverage >= 50 THEN 'partial' ELSE 'low' END AS label FROM cov")


@query("analyzer_success", f"{_G} SELECT 'query_syntax' AS name, count(*) AS analyzed, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (NOT parseable) AS failed, round(count(*) FILTER (parseable) * 100.0::DOUBLE / count(*), 1) AS ok_share FROM m UNION ALL SELECT 'query_antipattern', count(*), 0, count(*) FILTER (NOT parseable), round(count(*) FILTER (parseable AND len(patterns) = 0) * 100.0::DOUBLE / count(*), 1) FROM m")
def analyzer_success(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).withColumns(status())
    steps = m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("status"), F.col("collect_ms").alias("duration_ms")) for n, c in (("query_syntax", "syntax_status"), ("query_antipattern", "antipattern_status"))])).alias("x")).select("x.*")
    return reports.analyzer_success(steps).drop("avg_ms")


@query("empty_tables_used", f"{_G}, {_CATALOG_SQL}, {_USED_SQL} SELECT db_id, count(queries) AS empty_used, count(*) - count(queries) AS empty_unused FROM (SELECT c.db_id, u.queries FROM catalog c LEFT JOIN used u USING (db_id, \"table\") WHERE c.\"table\" IN ('singer', 'archive')) GROUP BY 1")
def empty_tables_used(spark: SparkSession, d: str) -> DataFrame:
    from querymill.operators import schema

    tables = catalog(spark).withColumn("is_empty", F.col("table").isin("singer", "archive"))
    return schema.empty_tables_used(tables, reports.used_tables(metrics(spark, d)))


_RUNS = f"tpl NOT IN ({', '.join(map(str, corpus.FAIL))})"


@query(
    "pipeline_statuses",
    f"""{_G}, s AS (SELECT id, tpl % 4 = 1 AS gone, parseable, len(patterns) AS n, {_RUNS} AS runs FROM m)
SELECT id, CASE WHEN gone THEN 'failed' ELSE 'ok' END AS earlier, CASE WHEN gone THEN 'skipped' WHEN parseable THEN 'ok' ELSE 'failed' END AS query_syntax, CASE WHEN gone OR NOT parseable THEN 'skipped' WHEN n > 0 THEN 'warns' ELSE 'ok' END AS query_antipattern,
CASE WHEN gone OR NOT parseable THEN 'skipped' WHEN runs THEN 'ok' ELSE 'failed' END AS query_execution, CASE WHEN gone OR NOT parseable OR NOT runs THEN 'skipped' ELSE 'ok' END AS last FROM s""",
)
def pipeline_statuses(spark: SparkSession, d: str) -> DataFrame:
    """The steps of each item through a pipeline whose earlier step failed every fourth template."""
    from querymill.plans import pipeline

    done = _passed(spark, d)
    last = pipeline.gate(done)[0].select("row", F.lit("ok").alias("last"))
    done = pipeline.advance(done, last, "last")
    return done.select("id", *[F.element_at("steps", i + 1)["status"].alias(n) for i, n in enumerate(("earlier", "query_syntax", "query_antipattern", "query_execution", "last"))])


def _passed(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with its steps after the audits and execution."""
    from querymill.operators import normalize
    from querymill.plans import pipeline

    items = corpus.items(spark, d).withColumn("steps", F.array(normalize.step("earlier", F.when(F.col("tpl") % 4 == 1, "failed").otherwise("ok")))).withColumnRenamed("db_id", "dbId")
    items = pipeline.numbered(items)
    audited = pipeline.audit_stage(items).select("row", F.col("syntax_status").alias("query_syntax"), F.col("antipattern_status").alias("query_antipattern"))
    items = pipeline.advance(items, audited, "query_syntax", "query_antipattern")
    ddl = spark.range(7).select(F.concat(F.lit("db_"), F.col("id").cast("string")).alias("db_id"), F.lit(corpus.DDL).alias("ddl"))
    tried = pipeline.execution_stage(items, databases=ddl).select("row", F.col("status").alias("query_execution"))
    return pipeline.advance(items, tried, "query_execution")


@query(
    "analyzer_success_skipped",
    f"""{_G}, s AS (SELECT tpl % 4 = 1 AS gone, parseable, len(patterns) AS n, {_RUNS} AS runs FROM m), x AS (SELECT 'query_syntax' AS name, CASE WHEN gone THEN 'skipped' WHEN parseable THEN 'ok' ELSE 'failed' END AS status FROM s
UNION ALL SELECT 'query_antipattern', CASE WHEN gone OR NOT parseable THEN 'skipped' WHEN n > 0 THEN 'warns' ELSE 'ok' END FROM s UNION ALL SELECT 'query_execution', CASE WHEN gone OR NOT parseable THEN 'skipped' WHEN runs THEN 'ok' ELSE 'failed' END FROM s)
SELECT name, count(*) FILTER (status <> 'skipped') AS analyzed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'ok') * 100.0::DOUBLE / count(*) FILTER (status <> 'skipped'), 1) AS ok_share FROM x GROUP BY 1""",
)
def analyzer_success_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Q3, Q6, Q8: analyzers with what they skipped."""
    steps = _passed(spark, d).select(F.explode(F.slice("steps", 2, 3)).alias("s")).select("s.name", "s.status", F.lit(None).cast("double").alias("duration_ms"))
    return reports.analyzer_success(steps).drop("avg_ms")


@query("performance", "SELECT event_type AS name, round(avg(value), 2) AS avg_ms FROM events GROUP BY 1")
def performance(spark: SparkSession, d: str) -> DataFrame:
    """Q13 over events in place of measured durations, which differ from run to run."""
    return reports.performance(table(spark, d, "events", F.col("event_type").alias("name"), F.lit("ok").alias("status"), F.col("value").alias("duration_ms")))


@query("overview_of_datasets", "SELECT 'train' AS dataset_id, count(DISTINCT id) AS items, count(DISTINCT db_id) AS dbs, CAST(min(loaded_at) AS TIMESTAMP) AS first_ts, CAST(max(loaded_at) AS TIMESTAMP) AS last_ts FROM calibration_train UNION ALL SELECT 'dev', count(DISTINCT id), count(DISTINCT db_id), CAST(min(loaded_at) AS TIMESTAMP), CAST(max(loaded_at) AS TIMESTAMP) FROM calibration_dev")
def overview_of_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Q2: datasets with their first and last time."""
    parts = [table(spark, d, f"calibration_{s}", F.lit(s).alias("dataset_id"), "id", "db_id", F.col("loaded_at").cast("timestamp_ntz").alias("ts")) for s in ("train", "dev")]
    return reports.dataset_overview(parts[0].unionByName(parts[1]))


@query("failing_then_skipped", f"{_G} SELECT CASE WHEN tpl % 4 = 1 THEN 'skipped' WHEN parseable THEN 'ok' ELSE 'failed' END AS status, count(*) AS items FROM m GROUP BY 1")
def failing_then_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Items that an earlier step failed never reach the parser and come back as skipped."""
    from querymill.operators import normalize

    items = corpus.items(spark, d).withColumn("steps", F.array(normalize.step("earlier", F.when(F.col("tpl") % 4 == 1, "failed").otherwise("ok"))))
    bad = normalize.failed_before()
    done = audit(items.where(~bad)).withColumns(status()).select(F.col("syntax_status").alias("status"))
    return done.union(items.where(bad).select(F.lit("skipped"))).groupBy("status").agg(F.count(F.lit(1)).alias("items"))
