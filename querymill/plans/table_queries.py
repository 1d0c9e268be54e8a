"""Queries over the project's own tables: votes, calibration, schemas, identities, execution, joins by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators import calibration, databases, execution, judge, normalize, schema
from querymill.operators.audit import audit
from querymill.plans import reports
from querymill.plans.registry import query
from querymill.session import table

# votes ----------------------------------------------------------------------------------------------
_V = """v AS (SELECT item_id, model, coalesce(weight, 1.0) AS weight, error, CASE WHEN regexp_replace(upper(trim(verdict)), '[\\s-]+', '_', 'g') IN ('CORRECT','PARTIALLY_CORRECT','INCORRECT','UNANSWERABLE') THEN regexp_replace(upper(trim(verdict)), '[\\s-]+', '_', 'g') END AS k FROM voters WHERE item_id IS NOT NULL),
g AS (SELECT *, error IS NULL AND k IS NOT NULL AS good FROM v),
a AS (SELECT item_id, count(*) AS total_voters, count(*) FILTER (good AND k = 'CORRECT') AS c, count(*) FILTER (good AND k = 'PARTIALLY_CORRECT') AS p, count(*) FILTER (good AND k = 'INCORRECT') AS i, count(*) FILTER (good AND k = 'UNANSWERABLE') AS u, count(*) FILTER (NOT good) AS f,
  sum(CASE k WHEN 'CORRECT' THEN 1.0 WHEN 'PARTIALLY_CORRECT' THEN 0.5 ELSE 0.0 END * weight) FILTER (good) AS s, sum(weight) FILTER (good) AS w FROM g GROUP BY 1),
j AS (SELECT *, total_voters - f AS n, greatest(c, p, i, u) AS most FROM a),
judged AS (SELECT *, n > 0 AND most * 2 > n AS consensus_reached, CASE WHEN n > 0 AND most * 2 > n THEN CASE most WHEN c THEN 'CORRECT' WHEN p THEN 'PARTIALLY_CORRECT' WHEN i THEN 'INCORRECT' ELSE 'UNANSWERABLE' END END AS consensus_verdict, n > 0 AND most = n AS is_unanimous FROM j),
st AS (SELECT *, CASE WHEN n = 0 THEN 'failed' WHEN consensus_verdict = 'CORRECT' THEN 'ok' WHEN consensus_verdict = 'PARTIALLY_CORRECT' THEN 'warns' WHEN consensus_verdict IS NOT NULL THEN 'errors' ELSE 'warns' END AS status FROM judged)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return judge.aggregate(table(spark, d, "voters"))


@query("vote_consensus", f"WITH {_V} SELECT item_id, total_voters, c AS voters_correct, p AS voters_partially_correct, i AS voters_incorrect, u AS voters_unanswerable, f AS voters_failed, consensus_reached, consensus_verdict, is_unanimous, status FROM st")
def vote_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).drop("weighted_score", "err")


@query("vote_scores", f"WITH {_V} SELECT round(avg(CASE WHEN w > 0 THEN s / w ELSE 0 END), 4) AS avg_score, round(min(CASE WHEN w > 0 THEN s / w ELSE 0 END), 3) AS min_score, round(max(CASE WHEN w > 0 THEN s / w ELSE 0 END), 3) AS max_score, count(*) AS items FROM st")
def vote_scores(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "voters").withColumn("k", judge.normal_verdict(F.col("verdict")))
    worth = F.create_map(*[F.lit(x) for k, s in judge.VERDICTS.items() for x in (k, s)])
    good = F.col("error").isNull() & F.col("k").isin(*judge.VERDICTS)
    w = F.when(good, F.coalesce("weight", F.lit(1.0)))
    s = v.where("item_id is not null").groupBy("item_id").agg(F.coalesce(F.try_divide(F.sum(w * worth[F.col("k")]), F.sum(w)), F.lit(0.0)).alias("s"))
    return s.agg(F.round(F.avg("s"), 4).alias("avg_score"), F.round(F.min("s"), 3).alias("min_score"), F.round(F.max("s"), 3).alias("max_score"), F.count(F.lit(1)).alias("items"))


@query("judge_summary", f"WITH {_V}, o AS (SELECT CASE WHEN status = 'failed' THEN 'FAILED' WHEN consensus_reached THEN consensus_verdict ELSE 'MIXED' END AS outcome, is_unanimous FROM st) SELECT outcome, count(*) AS items, count(*) FILTER (is_unanimous) AS unanimous, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share FROM o GROUP BY 1")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return judge.summary(_judged(spark, d))


_MIXED = f"""WITH {_V}, b AS (SELECT item_id, model, min(k) AS k FROM g WHERE good AND model IS NOT NULL AND item_id IN (SELECT item_id FROM st WHERE NOT consensus_reached AND status <> 'failed') GROUP BY 1, 2)
SELECT verdicts, count(*) AS items FROM (SELECT item_id, string_agg(model || ': ' || k, ', ' ORDER BY model) AS verdicts FROM b GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1"""


@query("verdict_breakdown", _MIXED)
def verdict_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return judge.verdict_texts(table(spark, d, "voters"))


@query("failed_items", f"WITH {_V} SELECT item_id, 'All voters failed' AS err, f AS voters_failed, total_voters FROM st WHERE status = 'failed'")
def failed_items(spark: SparkSession, d: str) -> DataFrame:
    return judge.failed_items(_judged(spark, d))


_LIST = "SELECT item_id, consensus_verdict, total_voters, f AS voters_failed FROM st WHERE"


@query("majority_partial_top50", f"WITH {_V} {_LIST} consensus_verdict = 'PARTIALLY_CORRECT' ORDER BY TRY_CAST(item_id AS BIGINT) NULLS LAST, item_id LIMIT 50")
def majority_partial_top50(spark: SparkSession, d: str) -> DataFrame:
    return judge.listing(_judged(spark, d), "PARTIALLY_CORRECT", k=50).drop("weighted_score")


def _listing(name: str, verdict: str | None, divided: bool, condition: str) -> None:
    query(name, f"WITH {_V} {_LIST} {condition}")(lambda spark, d: judge.listing(_judged(spark, d), verdict, divided).drop("weighted_score"))


_listing("majority_correct_divided", "CORRECT", True, "consensus_verdict = 'CORRECT' AND NOT is_unanimous")
_listing("majority_incorrect", "INCORRECT", False, "consensus_verdict = 'INCORRECT'")
_listing("majority_unanswerable", "UNANSWERABLE", False, "consensus_verdict = 'UNANSWERABLE'")
_listing("mixed_items", None, False, "consensus_verdict IS NULL AND status <> 'failed'")


@query("failed_votes", "SELECT provider, error, count(*) AS votes, count(DISTINCT item_id) AS items FROM voters WHERE error IS NOT NULL GROUP BY 1, 2")
def failed_votes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "voters").where("error is not null").groupBy("provider", "error").agg(F.count(F.lit(1)).alias("votes"), F.count_distinct("item_id").alias("items"))


# calibration ----------------------------------------------------------------------------------------
_N = "CASE WHEN upper(trim({0})) IN ('CORRECT','PARTIALLY_CORRECT','INCORRECT','UNANSWERABLE') THEN upper(trim({0})) WHEN {0} LIKE '%Mixed%' THEN 'Mixed' ELSE 'Unknown' END"
_R = f"r AS (SELECT DISTINCT id, {_N.format('original')} AS original, {_N.format('human')} AS human FROM calibration_verdicts WHERE human IS NOT NULL)"
_B = "b AS (SELECT original = 'CORRECT' AS o, human = 'CORRECT' AS h FROM r WHERE original NOT IN ('Mixed','Unknown') AND human NOT IN ('Mixed','Unknown')), n AS (SELECT count(*) AS n, count(*) FILTER (o AND h) AS aa, count(*) FILTER (o AND NOT h) AS ar, count(*) FILTER (NOT o AND h) AS ra, count(*) FILTER (NOT o AND NOT h) AS rr FROM b)"


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return calibration.rated(table(spark, d, "calibration_verdicts"))


def _on_rated(name: str, f, sql: str) -> None:
    query(name, f"WITH {_R} {sql}")(lambda spark, d: f(_rated(spark, d)))


_on_rated("confusion_matrix", calibration.confusion, "SELECT original, human, count(*) AS items FROM r GROUP BY ROLLUP (original, human)")
_on_rated("category_precision", calibration.precision, "SELECT original, count(*) AS items, count(*) FILTER (original = human) AS agreed, round(count(*) FILTER (original = human)::DOUBLE / count(*), 6) AS precision FROM r GROUP BY 1")
_on_rated("binary_prf", calibration.binary, f", {_B} " + " UNION ALL ".join(f"SELECT '{c}' AS class, n AS items, round((aa + rr)::DOUBLE / n, 6) AS accuracy, round({hit}::DOUBLE / ({hit} + {wrong}), 6) AS precision, round({hit}::DOUBLE / ({hit} + {lost}), 6) AS recall, round(2.0 * {hit} / (2 * {hit} + {wrong} + {lost}), 6)::DOUBLE AS f1 FROM n" for c, hit, wrong, lost in (("accept", "aa", "ar", "ra"), ("reject", "rr", "ra", "ar"))))
_on_rated("cohen_kappa", calibration.kappa, ", c AS (SELECT sum(a.n * b.n)::DOUBLE AS c FROM (SELECT original AS l, count(*) AS n FROM r GROUP BY 1) a JOIN (SELECT human AS l, count(*) AS n FROM r GROUP BY 1) b USING (l)), t AS (SELECT count(*) AS n, count(*) FILTER (original = human) AS g FROM r) SELECT n AS items, round((g::DOUBLE / n - c / n / n) / (1 - c / n / n), 6) AS kappa FROM t, c")
_on_rated("disagreement_rate", calibration.disagreement, "SELECT count(*) AS items, count(*) FILTER (original <> human OR original = 'Mixed') AS differing, round(count(*) FILTER (original <> human OR original = 'Mixed')::DOUBLE / count(*), 6) AS rate FROM r")


@query("stratified_sample", "WITH t AS (SELECT DISTINCT id, originalConsensVerdict AS verdict FROM calibration_train WHERE originalConsensVerdict IS NOT NULL) SELECT id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) AS r FROM t) WHERE r <= 50")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "calibration_train", "id", F.col("originalConsensVerdict").alias("verdict")).where("verdict is not null").distinct()
    return calibration.stratified_sample(t, "verdict", "id")


@query("complement_ids", "SELECT i AS id FROM (SELECT unnest(range(1, max(id) + 1)) AS i FROM calibration_train) WHERE i NOT IN (SELECT id FROM calibration_train WHERE id IS NOT NULL)")
def complement_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "calibration_train", "id")
    return calibration.complement(ids.agg(F.max("id")).first()[0] or 0, ids)


@query("default_verdicts", "WITH t AS (SELECT DISTINCT id FROM calibration_train), v AS (SELECT id, max(original) AS verdict FROM calibration_verdicts WHERE original <> 'CORRECT' GROUP BY 1) SELECT coalesce(v.verdict, 'CORRECT') AS verdict, count(*) AS items FROM t LEFT JOIN v USING (id) GROUP BY 1")
def default_verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "calibration_verdicts").where("original <> 'CORRECT'").groupBy("id").agg(F.max("original").alias("verdict"))
    return calibration.with_default(table(spark, d, "calibration_train", "id").distinct(), v).groupBy("verdict").agg(F.count(F.lit(1)).alias("items"))


_PLAIN = r"lower(trim(regexp_replace(query, '[\s\x{0b}\x{85}\pZ]+', ' ', 'g')))"


@query(
    "normalized_sql_match",
    f"WITH a AS (SELECT DISTINCT id, {_PLAIN} AS k FROM calibration_train WHERE query IS NOT NULL), h AS (SELECT id, query, 'dev' AS split FROM calibration_dev UNION ALL SELECT id, query, 'test' FROM calibration_test), b AS (SELECT DISTINCT id, split, {_PLAIN} AS k FROM h WHERE query IS NOT NULL) SELECT a.id AS train_id, b.id AS eval_id, b.split FROM a JOIN b USING (k)",
)
def normalized_sql_match(spark: SparkSession, d: str) -> DataFrame:
    def plain(split: str, name: str) -> DataFrame:
        return table(spark, d, f"calibration_{split}").where("query is not null").select(F.col("id").alias(name), F.lit(split).alias("split"), calibration.plain_sql(F.col("query")).alias("k")).distinct()

    held_out = plain("dev", "eval_id").unionByName(plain("test", "eval_id"))
    return plain("train", "train_id").drop("split").join(held_out, "k").select("train_id", "eval_id", "split")


@query("positional_lookup", "WITH o AS (SELECT id, row_number() OVER (ORDER BY loaded_at, id) AS position FROM calibration_train) SELECT o.position, o.id FROM o JOIN (SELECT DISTINCT c_custkey AS position FROM customer) c USING (position)")
def positional_lookup(spark: SparkSession, d: str) -> DataFrame:
    return calibration.lookup_by_position(table(spark, d, "calibration_train", "id", "loaded_at"), ["loaded_at", "id"], table(spark, d, "customer", F.col("c_custkey").alias("position"))).select("position", "id")


# schemas --------------------------------------------------------------------------------------------
_C = 'c AS (SELECT db_id, table_name AS "table", pos, col_name AS name, col_type AS type, coalesce(nullable, true) AS nullable, coalesce(pk, false) AS pk, coalesce(uniq, false) AS uniq FROM cat_columns)'
_FAMILY = "CASE WHEN upper(coalesce({0}, '')) LIKE '%INT%' THEN 'INTEGER' WHEN upper({0}) LIKE '%CHAR%' OR upper({0}) LIKE '%CLOB%' OR upper({0}) LIKE '%TEXT%' THEN 'TEXT' WHEN upper({0}) LIKE '%BLOB%' OR trim(coalesce({0}, '')) = '' THEN 'BLOB' WHEN upper({0}) LIKE '%REAL%' OR upper({0}) LIKE '%FLOA%' OR upper({0}) LIKE '%DOUB%' THEN 'REAL' ELSE 'NUMERIC' END"
#: A column named <table>_id that is no key of its own table points to the table it names, there or not.
_FK = "fk AS (SELECT db_id, \"table\", name, type, regexp_replace(name, '_id$', '') AS parent_table FROM c WHERE name LIKE '%\\_id' ESCAPE '\\' AND NOT pk)"
_CLASS = f"""par AS (SELECT DISTINCT db_id, "table" AS parent_table FROM c), pc AS (SELECT db_id, "table" AS parent_table, name, any_value(type) AS ptype, bool_or(pk) AS pk, bool_or(uniq) AS uniq FROM c GROUP BY 1, 2, 3),
cls AS (SELECT fk.db_id, fk."table", fk.name, fk.parent_table, CASE WHEN par.parent_table IS NULL THEN 'fk_missing_table' WHEN pc.name IS NULL THEN 'fk_missing_column' WHEN NOT pc.pk AND NOT pc.uniq THEN 'fk_target_not_key' WHEN trim(coalesce(fk.type, '')) <> '' AND trim(coalesce(pc.ptype, '')) <> '' AND {_FAMILY.format('fk.type')} <> {_FAMILY.format('pc.ptype')} THEN 'fk_type_mismatch' ELSE 'valid' END AS fk_class
  FROM fk LEFT JOIN par USING (db_id, parent_table) LEFT JOIN pc ON pc.db_id = fk.db_id AND pc.parent_table = fk.parent_table AND pc.name = fk.name)"""


def catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(columns, foreign keys) of cat_columns, in the form of operators.schema."""
    c = table(spark, d, "cat_columns").select("db_id", F.col("table_name").alias("table"), "pos", F.col("col_name").alias("name"), F.col("col_type").alias("type"), F.coalesce("nullable", F.lit(True)).alias("nullable"), F.coalesce("pk", F.lit(False)).alias("pk"), F.coalesce("uniq", F.lit(False)).alias("uniq"))
    f = c.where("name like '%\\_id' and not pk").select("db_id", "table", F.col("pos").alias("fk_id"), F.array("name").alias("local"), F.regexp_replace("name", "_id$", "").alias("parent_table"), F.array("name").alias("parent_columns"))
    return c, f


@query("schema_table_counts", f'WITH {_C} SELECT db_id, count(DISTINCT "table") AS tables, count(*) AS columns FROM c GROUP BY 1')
def schema_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return schema.table_counts(catalog(spark, d)[0])


@query("duplicate_columns", f'WITH {_C} SELECT db_id, "table", name, count(*) AS times FROM c GROUP BY 1, 2, 3 HAVING count(*) > 1')
def duplicate_columns(spark: SparkSession, d: str) -> DataFrame:
    return schema.duplicate_columns(catalog(spark, d)[0])


@query("type_family", f"WITH {_C} SELECT {_FAMILY.format('type')} AS family, count(*) AS columns, count(DISTINCT type) AS spellings FROM c GROUP BY 1")
def type_family(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d)[0].groupBy(schema.type_family(F.col("type")).alias("family")).agg(F.count(F.lit(1)).alias("columns"), F.count_distinct("type").alias("spellings"))


@query("fk_status_counts", f"WITH {_C}, {_FK}, {_CLASS} SELECT fk_class, count(*) AS fks, count(DISTINCT db_id) AS dbs FROM cls GROUP BY 1")
def fk_status_counts(spark: SparkSession, d: str) -> DataFrame:
    columns, fks = catalog(spark, d)
    return schema.fk_classes(fks, columns).groupBy("fk_class").agg(F.count(F.lit(1)).alias("fks"), F.count_distinct("db_id").alias("dbs"))


_STATUS = f"""{_C}, {_FK}, {_CLASS}, k AS (SELECT db_id, count(*) AS fk_total, count(*) FILTER (fk_class = 'valid') AS fk_valid FROM cls GROUP BY 1), dup AS (SELECT db_id, count(DISTINCT "table") AS n FROM (SELECT db_id, "table", name FROM c GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1),
t AS (SELECT db_id, count(DISTINCT "table") AS tables, count(*) AS columns FROM c GROUP BY 1),
s AS (SELECT d.db_id, d.health = 'ok' AS healthy, coalesce(tables, 0) AS tables, coalesce(columns, 0) AS columns, coalesce(fk_total, 0) AS fk_total, coalesce(fk_valid, 0) AS fk_valid, coalesce(dup.n, 0) AS dups FROM (SELECT db_id, coalesce(health, 'unknown') AS health FROM db_catalog) d LEFT JOIN t USING (db_id) LEFT JOIN k USING (db_id) LEFT JOIN dup USING (db_id)),
val AS (SELECT *, CASE WHEN NOT healthy THEN 1 ELSE fk_total - fk_valid + dups END AS blocking_errors_total, CASE WHEN NOT healthy THEN 'failed' WHEN fk_total - fk_valid + dups > 0 THEN 'errors' ELSE 'ok' END AS status FROM s)"""


def _validated(spark: SparkSession, d: str) -> DataFrame:
    columns, fks = catalog(spark, d)
    dbs = table(spark, d, "db_catalog").select("db_id", (F.coalesce("health", F.lit("unknown")) == "ok").alias("healthy"))
    return schema.validate(dbs, columns.select("db_id", "table", F.lit(False).alias("is_empty")).distinct(), columns, fks)


@query("schema_validation", f"WITH {_STATUS} SELECT db_id, tables, columns, fk_total, fk_valid, dups AS duplicate_columns_count, blocking_errors_total, status FROM val")
def schema_validation(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).select("db_id", "tables", "columns", "fk_total", "fk_valid", "duplicate_columns_count", "blocking_errors_total", "status")


@query("schema_totals", f"WITH {_STATUS} SELECT count(*) AS dbs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'warns') AS warns, count(*) FILTER (status = 'errors') AS errors, count(*) FILTER (status = 'failed') AS failed, CAST(sum(tables) AS BIGINT) AS sum_tables, CAST(sum(columns) AS BIGINT) AS sum_columns, CAST(sum(fk_total) AS BIGINT) AS sum_fk_total, CAST(sum(fk_total - fk_valid) AS BIGINT) AS sum_fk_invalid, CAST(sum(blocking_errors_total) AS BIGINT) AS sum_blocking_errors_total, CAST(0 AS BIGINT) AS dbs_with_violations, CAST(0 AS BIGINT) AS empty_tables FROM val")
def schema_totals(spark: SparkSession, d: str) -> DataFrame:
    return schema.schema_totals(_validated(spark, d))


@query("schema_listing", f"WITH {_STATUS} SELECT CASE status WHEN 'failed' THEN 1 WHEN 'errors' THEN 2 WHEN 'warns' THEN 3 ELSE 4 END AS status_order, db_id, status, tables, tables AS tables_non_empty, columns, fk_total, fk_total - fk_valid AS fk_invalid, blocking_errors_total, CAST(0 AS INTEGER) AS warnings, 0 AS fk_violations, CASE WHEN status = 'failed' THEN 'database is not accessible' END AS err FROM val")
def schema_listing(spark: SparkSession, d: str) -> DataFrame:
    return schema.listing(_validated(spark, d))


@query("schema_findings", f"WITH {_STATUS} SELECT db_id, status, 'error' AS level, 'db_connection_error' AS kind, 'database is not accessible' AS message FROM val WHERE NOT healthy UNION ALL SELECT cls.db_id, val.status, 'error', fk_class, \"table\" || '(' || name || ') -> ' || parent_table || '(' || name || '): the types of both sides differ' FROM cls JOIN val USING (db_id) WHERE fk_class <> 'valid' AND healthy")
def schema_findings(spark: SparkSession, d: str) -> DataFrame:
    return schema.findings(_validated(spark, d))


#: Tables with names of even length are empty, databases have as many orphaned rows as their name's length modulo 3, the third column of a table is there twice.
_PLANTED = f"""{_C}, h AS (SELECT db_id, coalesce(health, 'unknown') = 'ok' AS healthy, length(db_id) % 3 AS n FROM db_catalog), t AS (SELECT DISTINCT db_id, "table", length("table") % 2 = 0 AS is_empty FROM c),
e AS (SELECT db_id, count(*) FILTER (is_empty) AS empty, string_agg(CASE WHEN is_empty THEN '"' || "table" || '"' END, ', ' ORDER BY "table") AS names FROM t GROUP BY 1), dup AS (SELECT db_id, count(DISTINCT "table") AS dups FROM c WHERE pos = 3 GROUP BY 1),
p AS (SELECT db_id, healthy, n, coalesce(empty, 0) AS empty, names, coalesce(dups, 0) AS dups FROM h LEFT JOIN e USING (db_id) LEFT JOIN dup USING (db_id))"""


@query(
    "schema_statuses_planted",
    f"WITH {_PLANTED} SELECT db_id, CASE WHEN NOT healthy THEN 'failed' WHEN dups > 0 OR n > 0 THEN 'errors' WHEN empty > 0 THEN 'warns' ELSE 'ok' END AS status, CAST(CASE WHEN healthy THEN dups ELSE 1 END AS BIGINT) AS blocking_errors_total, n AS fk_violations, CASE WHEN healthy AND empty > 0 THEN empty || ' tables are empty: ' || names END AS warning FROM p",
)
def schema_statuses_planted(spark: SparkSession, d: str) -> DataFrame:
    columns, fks = catalog(spark, d)
    dbs = table(spark, d, "db_catalog").select("db_id", (F.coalesce("health", F.lit("unknown")) == "ok").alias("healthy"))
    tables = columns.select("db_id", "table", (F.length("table") % 2 == 0).alias("is_empty")).distinct()
    violations = dbs.select("db_id", (F.length("db_id") % 3).cast("long").alias("n"))
    out = schema.validate(dbs, tables, columns.unionByName(columns.where("pos = 3")), fks.where("false"), violations)
    return out.select("db_id", "status", "blocking_errors_total", F.col("fk_data_violations_count").alias("fk_violations"), F.try_element_at("warnings", F.lit(1))["message"].alias("warning"))


@query("duplicate_columns_planted", f'WITH {_C} SELECT db_id, "table", name, CAST(2 AS BIGINT) AS times FROM c WHERE pos = 3')
def duplicate_columns_planted(spark: SparkSession, d: str) -> DataFrame:
    columns = catalog(spark, d)[0]
    return schema.duplicate_columns(columns.unionByName(columns.where("pos = 3")))


@query(
    "fk_classes_planted",
    f"WITH {_C}, x AS (SELECT *, CASE pos % 4 WHEN 0 THEN 'fk_missing_table' WHEN 1 THEN 'fk_missing_column' WHEN 2 THEN 'fk_arity_mismatch' ELSE CASE WHEN pk OR uniq THEN 'valid' ELSE 'fk_target_not_key' END END AS fk_class FROM c) SELECT fk_class, count(*) AS fks, count(DISTINCT db_id) AS dbs FROM x GROUP BY 1",
)
def fk_classes_planted(spark: SparkSession, d: str) -> DataFrame:
    """A foreign key from each column: to no table, to no column, of two columns to one, to itself, by its position."""
    columns = catalog(spark, d)[0]
    k = F.col("pos") % 4
    local = F.when(k == 2, F.array("name", "name")).otherwise(F.array("name"))
    parent = F.when(k == 0, "no such table").otherwise(F.col("table"))
    fks = columns.select("db_id", "table", F.col("pos").alias("fk_id"), local.alias("local"), parent.alias("parent_table"), F.when(k == 1, F.array(F.lit("no such column"))).otherwise(F.array("name")).alias("parent_columns"))
    return schema.fk_classes(fks, columns).groupBy("fk_class").agg(F.count(F.lit(1)).alias("fks"), F.count_distinct("db_id").alias("dbs"))


@query("clean_dbs_preview", f"WITH {_STATUS} SELECT db_id, tables, columns FROM val WHERE status = 'ok' ORDER BY db_id LIMIT 3")
def clean_dbs_preview(spark: SparkSession, d: str) -> DataFrame:
    return schema.listing(_validated(spark, d), "ok", 3).select("db_id", "tables", "columns")


@query("top_issue", f"WITH {_STATUS}, x AS (SELECT fk_class AS kind, count(*) AS findings FROM cls WHERE fk_class <> 'valid' GROUP BY 1 UNION ALL SELECT 'duplicate_columns_count', CAST(sum(dups) AS BIGINT) FROM val) SELECT kind, CAST(findings AS BIGINT) AS findings FROM x ORDER BY findings DESC, kind LIMIT 1")
def top_issue(spark: SparkSession, d: str) -> DataFrame:
    return schema.top_issue(_validated(spark, d))


@query("items_on_bad_dbs", f"WITH {_STATUS} SELECT count(DISTINCT t.id) FILTER (val.status IN ('errors', 'failed')) AS items, count(DISTINCT t.id) AS total, round(count(DISTINCT t.id) FILTER (val.status IN ('errors', 'failed')) * 100.0::DOUBLE / count(DISTINCT t.id), 1) AS share FROM calibration_train t LEFT JOIN val USING (db_id)")
def items_on_bad_dbs(spark: SparkSession, d: str) -> DataFrame:
    return schema.items_on_bad_dbs(table(spark, d, "calibration_train", "id", "db_id"), _validated(spark, d))


_LINES = f"""WITH {_C}, {_FK}, l AS (SELECT db_id, "table", 0 AS part, pos, '  "' || replace(name, '"', '""') || '"' || CASE WHEN coalesce(type, '') <> '' THEN ' ' || type ELSE '' END || CASE WHEN NOT nullable THEN ' NOT NULL' ELSE '' END AS line FROM c
UNION ALL SELECT db_id, "table", 1, 0, '  PRIMARY KEY (' || string_agg('"' || name || '"', ', ' ORDER BY pos) || ')' FROM c WHERE pk GROUP BY 1, 2
UNION ALL SELECT db_id, "table", 2, 0, '  FOREIGN KEY ("' || name || '") REFERENCES "' || parent_table || '" ("' || name || '")' FROM fk)
SELECT db_id, "table", 'CREATE TABLE "' || "table" || '" (' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY part, pos, line) || chr(10) || ');' AS ddl FROM l GROUP BY 1, 2"""


@query("schema_ddl", _LINES)
def schema_ddl(spark: SparkSession, d: str) -> DataFrame:
    columns, fks = catalog(spark, d)
    return schema.ddl(columns, fks)


@query("column_examples", "WITH d AS (SELECT 'customer' AS \"table\", c_mktsegment AS v FROM customer UNION SELECT 'orders', o_orderpriority FROM orders UNION SELECT 'part', p_brand FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY \"table\" ORDER BY v) AS n FROM d WHERE v IS NOT NULL) SELECT \"table\", string_agg(v, ',' ORDER BY v) AS examples FROM r WHERE n <= 2 GROUP BY 1")
def column_examples(spark: SparkSession, d: str) -> DataFrame:
    values = [table(spark, d, t).select(F.lit(t).alias("table"), F.col(c).alias("v")) for t, c in (("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("part", "p_brand"))]
    return schema.column_examples(values[0].union(values[1]).union(values[2]), ["table"], "v").select("table", F.array_join("examples", ",").alias("examples"))


def _orphan_query(name: str, child: str, local: str, parent: str, key: str, hidden: str) -> None:
    """Rows of child without a row in parent; parents of even keys in `hidden` are left out so that there are some."""

    @query(name, f"SELECT count(*) AS orphans, count(DISTINCT {local}) AS missing_keys FROM {child} c WHERE {local} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{local} AND NOT ({hidden}))")
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = schema.orphans(table(spark, d, child, local), table(spark, d, parent).where(f"not ({hidden})").select(key), [local], [key])
        return found.agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct(local).alias("missing_keys"))


_orphan_query("fk_orphans_orders_customer", "orders", "o_custkey", "customer", "c_custkey", "c_custkey % 97 = 3")
_orphan_query("fk_orphans_lineitem_part", "lineitem", "l_partkey", "part", "p_partkey", "p_size = 7")
_orphan_query("fk_orphans_lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey", "o_orderstatus = 'P'")


# identities and text --------------------------------------------------------------------------------
@query("hash_ids", "SELECT id AS row_id, substr(sha256(coalesce(db_id, '') || chr(0) || coalesce(question, '') || chr(0) || coalesce(query, '')), 1, 16) AS id FROM calibration_train")
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "calibration_train").select(F.col("id").alias("row_id"), "question", "query", "db_id")
    items = normalize.alias_mapper(raw.withColumn("none", F.lit(None).cast("string")), {"question": "question", "sql": "query", "dbId": "db_id", "id": "none"})
    return normalize.hash_ids(items).select(F.get_json_object("metadata", "$.row_id").cast("long").alias("row_id"), "id")


@query("incremental_ids", "WITH t AS (SELECT id, loaded_at, question, originalConsensVerdict = 'CORRECT' AS kept FROM calibration_train) SELECT CAST(id AS BIGINT) AS row_id, CASE WHEN kept THEN 'k' ELSE CAST(row_number() OVER (PARTITION BY coalesce(kept, false) ORDER BY loaded_at, id) + 99 AS VARCHAR) END AS id FROM (SELECT id, loaded_at, coalesce(kept, false) AS kept FROM t)")
def incremental_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "calibration_train").select(F.col("id").alias("row_id"), "loaded_at", F.when(F.col("originalConsensVerdict") == "CORRECT", "k").alias("id"))
    return normalize.incremental_ids(t, ["loaded_at", "row_id"], 100).select("row_id", "id")


@query("bad_schema_id", r"SELECT id, 'sql_err_' || substr(sha1(lower(trim(regexp_replace(regexp_replace(regexp_replace(query, '--[^\n]*', ' ', 'g'), '(?s)/\*.*?\*/', ' ', 'g'), '[\s\x{0b}\x{85}\pZ]+', ' ', 'g')))), 1, 16) AS schema_id FROM calibration_train WHERE query IS NOT NULL")
def bad_schema_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "calibration_train", "id", "query").where("query is not null").select("id", normalize.bad_schema_id(F.col("query"), "sqlite").alias("schema_id"))


@query("schema_identity")
def schema_identity(spark: SparkSession, d: str) -> DataFrame:
    text = schema_ddl(spark, d).groupBy("db_id").agg(F.array_join(F.array_sort(F.collect_list("ddl")), "\n").alias("schema"))
    return normalize.schema_ids(text).select("db_id", "schema_id")


@query("database_health", "SELECT CASE WHEN t.db_id IS NULL OR trim(t.db_id) = '' THEN 'neither dbId nor schema' WHEN c.health = 'ok' THEN 'kept' ELSE 'database is not healthy and there is no schema' END AS reason, count(*) AS items FROM calibration_train t LEFT JOIN db_catalog c ON t.db_id = c.db_id GROUP BY 1")
def database_health(spark: SparkSession, d: str) -> DataFrame:
    items = normalize.alias_mapper(table(spark, d, "calibration_train", "id", "question", "query", "db_id"), {"sql": "query", "dbId": "db_id"})
    done = normalize.database_identity(items, table(spark, d, "db_catalog", "db_id", "health"))
    return done.groupBy(F.element_at("steps", -1)["reason"].alias("reason")).agg(F.count(F.lit(1)).alias("items"))


@query("json_props", "SELECT event_type, count(*) AS events, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("sum_k"))


# execution ------------------------------------------------------------------------------------------
_WORD = "regexp_extract(upper(trim(sql)), '^(DROP|TRUNCATE|ALTER|VACUUM|ATTACH|DETACH)\\s', 1)"


@query("destructive_block", f"WITH i AS (SELECT CASE WHEN id % 5 = 0 THEN 'DROP TABLE t' WHEN id % 7 = 0 THEN 'vacuum ' ELSE query END AS sql FROM calibration_train) SELECT CASE WHEN {_WORD} = '' THEN NULL ELSE {_WORD} END AS blocked, count(*) AS items FROM i GROUP BY 1")
def destructive_block(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "calibration_train", "id", "query").select(F.expr("case when id % 5 = 0 then 'DROP TABLE t' when id % 7 = 0 then 'vacuum ' else query end").alias("sql"))
    return i.groupBy(execution.blocked(F.col("sql")).alias("blocked")).agg(F.count(F.lit(1)).alias("items"))


def _statements(spark: SparkSession, d: str, names: DataFrame | None = None) -> DataFrame:
    """(id, db_id, sql) of the training records, once each, with the registered database they mean."""
    rows = table(spark, d, "calibration_train", "id", "db_id", F.col("query").alias("sql")).where("id is not null").dropDuplicates(["id"])
    return databases.resolved(rows, table(spark, d, "db_catalog", "db_id") if names is None else names)


def _probed(spark: SparkSession, d: str) -> DataFrame:
    columns, fks = catalog(spark, d)
    return execution.probe(_statements(spark, d), schema.ddl(columns, fks).select("db_id", "ddl"))


@query("execution_totals")
def execution_totals(spark: SparkSession, d: str) -> DataFrame:
    return execution.totals(_probed(spark, d))


@query("execution_error_patterns")
def execution_error_patterns(spark: SparkSession, d: str) -> DataFrame:
    return execution.error_patterns(_probed(spark, d))


@query("execution_failures")
def execution_failures(spark: SparkSession, d: str) -> DataFrame:
    return execution.failures(_probed(spark, d))


_TRIED = """x AS (SELECT db_id || '.' || table_name || '.' || pos AS id, CASE pos % 7 WHEN 5 THEN 'nowhere' WHEN 6 THEN NULL ELSE db_id END AS db_id, CASE pos % 7
  WHEN 1 THEN 'SELECT "no_such_column_here" + 1 FROM no_such_table' WHEN 2 THEN '-- gone\nDROP TABLE "' || table_name || '"' WHEN 3 THEN ' ' WHEN 4 THEN 'DELETE FROM "' || table_name || '"' ELSE 'SELECT "' || col_name || '" FROM "' || table_name || '"' END AS sql, pos % 7 AS k FROM cat_columns)"""


@query(
    "execution_outcomes",
    f"WITH {_TRIED} SELECT id, db_id, CASE k WHEN 0 THEN 'ok' ELSE 'failed' END AS status, CASE k WHEN 1 THEN 'Execution error: no such table: no_such_table' WHEN 2 THEN 'Blocked destructive statement: DROP' WHEN 3 THEN 'Empty SQL' WHEN 4 THEN 'Only SELECT statements are allowed' WHEN 5 THEN 'DB not accessible: unknown database' WHEN 6 THEN 'DB not accessible: unknown database' END AS err FROM x",
)
def execution_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A statement for every column of the catalog, good and bad in turn, tried on its database."""
    return _tried(spark, d).drop("duration_ms")


def _tried(spark: SparkSession, d: str) -> DataFrame:
    columns, fks = catalog(spark, d)
    source = table(spark, d, "cat_columns")
    k = F.col("pos") % 7
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    sql = F.when(k == 1, 'SELECT "no_such_column_here" + 1 FROM no_such_table').when(k == 2, F.concat(F.lit("-- gone\nDROP TABLE "), quoted("table_name"))).when(k == 3, " ").when(k == 4, F.concat(F.lit("DELETE FROM "), quoted("table_name")))
    items = source.select(F.concat_ws(".", "db_id", "table_name", F.col("pos").cast("string")).alias("id"), F.when(k == 5, "nowhere").when(k == 6, F.lit(None)).otherwise(F.col("db_id")).alias("db_id"), sql.otherwise(F.concat(F.lit("SELECT "), quoted("col_name"), F.lit(" FROM "), quoted("table_name"))).alias("sql"))
    return execution.probe(items, schema.ddl(columns, fks).select("db_id", "ddl"))


@query("execution_patterns", f"WITH {_TRIED} SELECT 'db not accessible' AS pattern, count(*) AS failures FROM x WHERE k IN (5, 6) UNION ALL SELECT 'execution error', count(*) FROM x WHERE k = 1 UNION ALL SELECT 'blocked destructive statement', count(*) FROM x WHERE k = 2")
def execution_patterns(spark: SparkSession, d: str) -> DataFrame:
    return execution.error_patterns(_tried(spark, d))


@query("execution_summary", f"WITH {_TRIED} SELECT count(*) AS total, count(*) AS analyzed, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (k <> 0) AS failed, round(count(*) FILTER (k <> 0) * 100.0::DOUBLE / count(*), 1) AS failed_share FROM x")
def execution_summary(spark: SparkSession, d: str) -> DataFrame:
    return execution.totals(_tried(spark, d))


# audit of the project's own statements ---------------------------------------------------------------
@query("corpus_audit")
def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty, quality and findings of every training statement, once each, by registered database."""
    m = audit(_statements(spark, d))
    return m.groupBy("db_id", "difficulty_level").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("complexity_score"), 3).alias("avg_complexity"), F.round(F.avg("quality_score"), 3).alias("avg_quality"), F.sum("total_antipatterns").alias("findings"))


@query("corpus_coverage")
def corpus_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each registered database's tables by the training statements."""
    return reports.coverage_by_db(audit(_statements(spark, d)), table(spark, d, "cat_columns", "db_id", F.col("table_name").alias("table")))


_KEY = r"""regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(written, '^[\s\pZ"''`\[\](){}]+|[\s\pZ"''`\[\](){}]+$', '', 'g'), '^.*[/\\]', ''), '\.[A-Za-z][A-Za-z0-9]{0,9}[\s"''`\]]*$', '')), '[^\pL\pN]+', '', 'g')"""


@query(
    "resolved_databases",
    f"""WITH c AS (SELECT db_id, regexp_replace(lower(db_id), '[^a-z0-9]+', '', 'g') AS key FROM db_catalog), t AS (SELECT DISTINCT id, db_id AS written FROM calibration_train WHERE id IS NOT NULL),
k AS (SELECT *, {_KEY} AS key FROM t), u AS (SELECT key, min(db_id) AS db_id FROM c GROUP BY 1 HAVING count(*) = 1)
SELECT coalesce(e.db_id, u.db_id) AS db_id, count(*) AS items FROM k LEFT JOIN c e ON e.db_id = k.written LEFT JOIN u ON u.key = k.key GROUP BY 1""",
)
def resolved_databases(spark: SparkSession, d: str) -> DataFrame:
    return _statements(spark, d).groupBy("db_id").agg(F.count(F.lit(1)).alias("items"))


# streams, here over tables at rest ------------------------------------------------------------------
@query("windowed_events", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    from querymill.streaming import ingest

    out = ingest.windowed_counts(table(spark, d, "events", "ts", "event_type", "value"))
    return out.withColumn("value", F.round("value", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", "WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS events FROM s GROUP BY user_id, n")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    from querymill.streaming import ingest

    out = ingest.session_counts(table(spark, d, "events", "ts", "user_id"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
