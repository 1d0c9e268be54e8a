"""The questions of the reports, each a DataFrame of audited items → DataFrame.

`m` is what operators.audit.audit returns, with id and db_id; VALID rows are the parseable ones that no
earlier step failed. Shares are percentages rounded half up. Sorts that a report needs carry tiebreaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querymill.operators.audit import SEVERITY_DISPLAY, SEVERITY_ORDER
from querymill.sql.findings import LABELS

VALID = "parseable and coalesce(status, 'ok') <> 'skipped'"
LEVELS = ("easy", "medium", "hard", "expert")


def count_if(condition: Column | str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def valid(m: DataFrame) -> DataFrame:
    return m.where(VALID) if "status" in m.columns else m.where("parseable")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0)), digits)


def of_total(n: Column) -> Column:
    return F.sum(n).over(Window.partitionBy())


def level_order(level: Column) -> Column:
    return F.coalesce(*[F.when(level == name, i) for i, name in enumerate(LEVELS)], F.lit(len(LEVELS)))


def _long(row: DataFrame, label: str, value: str, names: list[str]) -> DataFrame:
    """One row of several counts as rows (label, value)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias(label), F.col(n).cast("long").alias(value)) for n in names])).alias("x")).select("x.*")


def difficulty_share(m: DataFrame) -> DataFrame:
    """Q7, Q44: statements and share by difficulty."""
    n = valid(m).groupBy("difficulty_level").agg(F.count(F.lit(1)).alias("queries"))
    return n.withColumn("share", percent(F.col("queries"), of_total(F.col("queries"))))


def difficulty_density(m: DataFrame) -> DataFrame:
    """Q45: what the statements of a difficulty hold on average."""
    means = {"avg_tables": "table_count", "avg_joins": "join_count", "avg_subqueries": "subquery_count", "avg_aggregates": "aggregate_count", "avg_complexity": "complexity_score"}
    return valid(m).groupBy("difficulty_level").agg(*[F.round(F.avg(c), 1).alias(a) for a, c in means.items()])


def join_histogram(m: DataFrame) -> DataFrame:
    """Q37: statements by number of joins, 7 and more together."""
    n = valid(m).groupBy(F.least("join_count", F.lit(7)).cast("int").alias("joins")).agg(F.count(F.lit(1)).alias("queries"))
    return n.withColumn("share", percent(F.col("queries"), of_total(F.col("queries")), 2))


def join_type_usage(m: DataFrame) -> DataFrame:
    """Q38: occurrences of join types, as a share of statements with joins and of all statements."""
    v = valid(m)
    totals = v.agg(F.count(F.lit(1)).alias("every"), count_if("join_count > 0").alias("joined"))
    uses = v.select(F.explode("join_types").alias("join_type")).groupBy("join_type").agg(F.count(F.lit(1)).alias("uses"))
    return uses.crossJoin(F.broadcast(totals)).select("join_type", "uses", percent(F.col("uses"), F.col("joined")).alias("share_of_joined"), percent(F.col("uses"), F.col("every")).alias("share_of_all"))


def subquery_summary(m: DataFrame) -> DataFrame:
    """Q39: statements with subqueries, with ones that may be correlated, with nested ones."""
    row = valid(m).agg(count_if("subquery_count >= 1").alias("with_subquery"), count_if("subquery_count >= 1 and (has_in or has_where)").alias("correlated_proxy"), count_if("max_subquery_depth >= 2").alias("nested"))
    return _long(row, "kind", "queries", row.columns)


def subquery_depth(m: DataFrame) -> DataFrame:
    """Q40: statements by depth of subqueries, 3 and more together."""
    return valid(m).where("max_subquery_depth > 0").groupBy(F.least("max_subquery_depth", F.lit(3)).cast("int").alias("depth")).agg(F.count(F.lit(1)).alias("queries"))


def cte_stats(m: DataFrame) -> DataFrame:
    """Q41: statements with at least 1, 2, 3 CTEs, their median number, and recursive ones."""
    v = valid(m)
    rows = [F.struct(F.lit(f"at_least_{k}").alias("kind"), count_if(F.col("cte_count") >= k).alias("queries"), F.median(F.when(F.col("cte_count") >= k, F.col("cte_count"))).cast("int").alias("median_ctes")) for k in (1, 2, 3)]
    rows.append(F.struct(F.lit("recursive").alias("kind"), count_if("has_recursive_cte").alias("queries"), F.lit(None).cast("int").alias("median_ctes")))
    return v.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("x")).select("x.*")


def aggregate_usage(m: DataFrame) -> DataFrame:
    """Q42: statements by aggregate function, as a share of all and of aggregating statements."""
    v = valid(m)
    totals = v.agg(F.count(F.lit(1)).alias("every"), count_if("aggregate_count > 0").alias("aggregating"))
    name = F.col("t")
    kind = reduce(lambda w, k: w.when(name.contains(k), k), ["SUM", "AVG", "MAX", "MIN"], F.when(name.contains("COUNT"), "COUNT")).otherwise("Other")
    uses = v.select(F.explode("aggregate_types").alias("t")).groupBy(kind.alias("aggregate")).agg(F.count(F.lit(1)).alias("uses"))
    return uses.crossJoin(F.broadcast(totals)).select("aggregate", "uses", percent(F.col("uses"), F.col("every")).alias("share_of_all"), percent(F.col("uses"), F.col("aggregating")).alias("share_of_aggregating"))


def aggregation_patterns(m: DataFrame) -> DataFrame:
    """Q43: single, multiple and nested aggregation, DISTINCT with GROUP BY."""
    row = valid(m).agg(count_if("aggregate_count = 1").alias("single"), count_if("aggregate_count > 1").alias("multiple"), count_if("aggregate_count > 0 and subquery_count > 0").alias("nested"), count_if("has_distinct and has_group_by").alias("distinct_group_by"))
    return _long(row, "kind", "queries", row.columns)


#: Q46: combinations of features and what makes a statement count for them.
COMBINATIONS = {
    "join + where": "join_count > 0 and has_where",
    "join + aggregate": "join_count > 0 and aggregate_count > 0",
    "join + group by": "join_count > 0 and has_group_by",
    "group by + having": "has_group_by and has_having",
    "where + order by": "has_where and has_order_by",
    "order by + limit": "has_order_by and has_limit",
    "subquery + join": "subquery_count > 0 and join_count > 0",
    "subquery + aggregate": "subquery_count > 0 and aggregate_count > 0",
    "cte + window": "cte_count > 0 and window_fn_count > 0",
    "distinct + join": "has_distinct and join_count > 0",
}


def feature_combinations(m: DataFrame) -> DataFrame:
    """Q46: the ten most frequent combinations that occur."""
    row = valid(m).agg(*[count_if(c).alias(n) for n, c in COMBINATIONS.items()])
    return _long(row, "combination", "queries", list(COMBINATIONS)).where("queries > 0").orderBy(F.desc("queries"), "combination").limit(10)


def health_summary(m: DataFrame) -> DataFrame:
    """Q5, Q47: totals, share parsed, mean, median and deviation of complexity."""
    c = F.when(F.col("parseable"), F.col("complexity_score"))
    return m.agg(F.count(F.lit(1)).alias("total"), count_if("parseable").alias("parsed"), percent(count_if("parseable"), F.count(F.lit(1))).alias("parsed_share"), F.round(F.avg(c), 6).alias("avg_complexity"), F.median(c).cast("double").alias("median_complexity"), F.round(F.stddev_samp(c), 6).alias("stddev_complexity"))


def balance(m: DataFrame) -> DataFrame:
    """Q48, Q49: how balanced the corpus is, a row per criterion with its value and whether it is met."""
    n = F.count(F.lit(1))
    row = valid(m).agg(
        F.count_distinct("difficulty_level").cast("double").alias("levels"),
        percent(count_if("table_count > 1"), n).alias("multi_table"),
        percent(count_if("window_fn_count > 0"), n).alias("window"),
        percent(count_if("table_count <= 1"), n).alias("single_table"),
        percent(count_if("has_recursive_cte"), n).alias("recursive"),
        percent(count_if("set_op_count > 0"), n).alias("set_operation"),
        percent(count_if("subquery_count > 0"), n).alias("subquery"),
        percent(count_if("aggregate_count > 0"), n).alias("aggregate"),
    )
    met = {"levels": "levels >= 3", "multi_table": "multi_table >= 60", "window": "window >= 5", "single_table": "single_table between 20 and 35", "recursive": "recursive > 0", "set_operation": "set_operation >= 2", "subquery": "subquery > 0", "aggregate": "aggregate > 0"}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(k).alias("value"), F.expr(e).alias("met")) for k, e in met.items()])).alias("x")).select("x.*")


def severity_display(severity: Column) -> Column:
    """A severity's sign and label in reports; one that isn't known has a blank sign and its own name."""
    known = F.create_map(*[F.lit(x) for k, v in SEVERITY_DISPLAY.items() for x in (k, v)])
    return F.coalesce(known[severity], F.concat(F.lit("⚪ "), F.initcap(severity)))


def pattern_label(pattern: Column) -> Column:
    """What a pattern is called in reports."""
    known = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)])
    return F.coalesce(known[pattern], F.initcap(F.replace(pattern, F.lit("_"), F.lit(" "))))


def displayed(rows: DataFrame) -> DataFrame:
    """rows (pattern, severity, …) as reports show them."""
    shown = {"pattern": pattern_label(F.col("pattern")), "severity": severity_display(F.col("severity"))}
    return rows.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in rows.columns if c != "severity_order"])


def antipattern_rows(m: DataFrame) -> DataFrame:
    """One row for each antipattern found."""
    return valid(m).select("id", "db_id", F.explode("antipatterns").alias("a")).select("id", "db_id", "a.pattern", "a.severity", "a.message")


def antipattern_by_severity(m: DataFrame) -> DataFrame:
    """Q10, Q61: findings by severity, in the order of severity."""
    order = F.create_map(*[F.lit(x) for k, v in SEVERITY_ORDER.items() for x in (k, v)])
    return antipattern_rows(m).groupBy("severity").agg(F.count(F.lit(1)).alias("findings")).withColumn("severity_order", F.coalesce(order[F.col("severity")], F.lit(999)))


def antipattern_by_pattern(m: DataFrame) -> DataFrame:
    """Q11, Q59: findings and statements by pattern and severity, as a share of parsed statements, with a message of one of them."""
    every = valid(m).agg(F.count(F.lit(1)).alias("every"))
    n = antipattern_rows(m).groupBy("pattern", "severity").agg(F.any_value("message").alias("example_message"), F.count(F.lit(1)).alias("findings"), F.count_distinct("id").alias("queries"))
    return n.crossJoin(F.broadcast(every)).select("pattern", "severity", "example_message", "findings", "queries", percent(F.col("queries"), F.col("every")).alias("share"))


def antipattern_top(m: DataFrame, k: int = 15) -> DataFrame:
    """Q11: the k most frequent patterns, the severest first."""
    order = F.create_map(*[F.lit(x) for key, v in SEVERITY_ORDER.items() for x in (key, v)])
    return antipattern_by_pattern(m).withColumn("severity_order", F.coalesce(order[F.col("severity")], F.lit(999))).orderBy("severity_order", F.desc("findings"), "pattern").limit(k)


def antipattern_items(m: DataFrame) -> DataFrame:
    """Q62: by pattern, every statement that has it once, numerically ordered; ids that are no numbers come last."""
    return antipattern_rows(m).select("pattern", "severity", "id").distinct().orderBy("pattern", "severity", F.expr("try_cast(id as bigint)").asc_nulls_last(), "id")


def quality_summary(m: DataFrame) -> DataFrame:
    """Q9, Q58, Q60: means of quality and findings, statements without findings."""
    p = F.col("parseable")
    return m.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(p).alias("parsed"),
        F.round(F.avg(F.when(p, F.col("quality_score"))), 6).alias("avg_quality"),
        F.round(F.avg(F.when(p, F.col("total_antipatterns"))), 6).alias("avg_findings"),
        count_if(p & (F.col("total_antipatterns") == 0)).alias("clean"),
        percent(count_if(p & (F.col("total_antipatterns") == 0)), count_if(p)).alias("clean_share"),
    )


def quality_levels(m: DataFrame) -> DataFrame:
    """Statements by quality level."""
    return m.groupBy("quality_level").agg(F.count(F.lit(1)).alias("queries"))


def worst_items(m: DataFrame, below: int = 50, k: int = 10) -> DataFrame:
    """Q64: the k statements of most findings among those of low quality."""
    return m.where(F.col("parseable") & (F.col("quality_score") < below)).select("id", "quality_score", "total_antipatterns").orderBy(F.desc("total_antipatterns"), "quality_score", F.expr("try_cast(id as bigint)"), "id").limit(k)


def unparseable(m: DataFrame) -> DataFrame:
    """Q63: statements that can't be parsed, as a share of all."""
    return m.agg(count_if(~F.col("parseable")).alias("unparseable"), F.count(F.lit(1)).alias("total"), percent(count_if(~F.col("parseable")), F.count(F.lit(1))).alias("share"))


def unparseable_items(m: DataFrame) -> DataFrame:
    """Q63: every statement that can't be parsed, in numerical order, with the first 100 characters of why."""
    why = F.coalesce("err", F.lit("Unknown error"))
    short = F.when(F.length(why) > 100, F.concat(F.substring(why, 1, 100), F.lit("..."))).otherwise(why)
    return m.where(~F.col("parseable")).select("id", short.alias("err")).orderBy(F.expr("try_cast(id as bigint)").asc_nulls_last(), "id")


def used_tables(m: DataFrame) -> DataFrame:
    """(db_id, table, queries): tables that statements name, in lower case and without quotes."""
    t = valid(m).select("db_id", "id", F.explode("tables").alias("t")).select("db_id", "id", F.lower(F.regexp_replace("t", "[\"'`]", "")).alias("table"))
    return t.groupBy("db_id", "table").agg(F.count_distinct("id").alias("queries"))


def coverage_by_db(m: DataFrame, catalog: DataFrame) -> DataFrame:
    """Q50, Q52, Q54, Q55: tables of each database, used and unused ones, coverage and what lacks to 95 %.

    catalog: (db_id, table). Names that no catalog has are not counted as used.
    """
    known = catalog.select("db_id", F.lower("table").alias("table")).distinct()
    used = used_tables(m)
    per = known.join(used, ["db_id", "table"], "left").groupBy("db_id").agg(F.count(F.lit(1)).alias("tables"), count_if(F.col("queries").isNotNull()).alias("used"), F.sum(F.coalesce("queries", F.lit(0))).alias("uses"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("queries").isNull(), F.col("table")))), ",").alias("unused_tables"))
    per = per.withColumn("coverage", percent(F.col("used"), F.col("tables")))
    return per.withColumn("priority", F.when(F.col("tables") - F.col("used") >= 3, "High").when(F.col("tables") > F.col("used"), "Medium").otherwise("None")).withColumn("lacking", F.greatest(F.lit(0.0), F.round(95 - F.col("coverage"), 1)))


def upper_median(column: str) -> Column:
    """Of an even number of values the greater of the middle two: the least that is exceeded by less than half of them."""
    return -F.expr(f"percentile_disc(0.5) within group (order by -{column})")


def coverage_summary(m: DataFrame, catalog: DataFrame) -> DataFrame:
    """Q50, Q56: over all databases, with the upper median of coverage."""
    c = coverage_by_db(m, catalog)
    return c.agg(F.count(F.lit(1)).alias("dbs"), F.sum("tables").alias("tables"), F.sum("used").alias("used"), F.round(F.avg("tables"), 2).alias("avg_tables"), F.round(F.avg("coverage"), 2).alias("avg_coverage"), upper_median("coverage").alias("median_coverage"))


USAGE = "case when queries = 0 then '0' when queries <= 2 then '1-2' when queries <= 5 then '3-5' when queries <= 10 then '6-10' when queries <= 20 then '11-20' when queries <= 50 then '21-50' else '51+' end"


def table_usage_buckets(m: DataFrame, catalog: DataFrame) -> DataFrame:
    """Q51: tables by the number of statements that use them."""
    known = catalog.select("db_id", F.lower("table").alias("table")).distinct()
    n = known.join(used_tables(m), ["db_id", "table"], "left").select(F.coalesce("queries", F.lit(0)).alias("queries"))
    return n.groupBy(F.expr(USAGE).alias("bucket")).agg(F.count(F.lit(1)).alias("tables"))


def coverage_ranking(m: DataFrame, catalog: DataFrame, k: int = 5) -> DataFrame:
    """Q52: the k best and the k worst covered databases."""
    c = coverage_by_db(m, catalog).select("db_id", "tables", "used", "coverage")
    best = c.orderBy(F.desc("coverage"), F.desc("tables"), "db_id").limit(k).withColumn("side", F.lit("top"))
    return best.unionByName(c.orderBy("coverage", F.desc("tables"), "db_id").limit(k).withColumn("side", F.lit("bottom")))


def unknown_tables(m: DataFrame, catalog: DataFrame) -> DataFrame:
    """Q53: tables that statements name and their database doesn't have."""
    known = catalog.select("db_id", F.lower("table").alias("table")).distinct()
    return used_tables(m).join(known, ["db_id", "table"], "left_anti")


def heat_map(m: DataFrame, catalog: DataFrame) -> DataFrame:
    """Q57: a bar of 24 cells for each database's coverage, with a label."""
    c = coverage_by_db(m, catalog)
    filled = F.floor(F.col("coverage") / 100 * 24).cast("int")
    label = F.when(F.col("coverage") >= 100, "full").when(F.col("coverage") >= 90, "high").when(F.col("coverage") >= 75, "good").when(F.col("coverage") >= 50, "partial").otherwise("low")
    return c.select("db_id", F.rpad("db_id", 18, " ").alias("name"), F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), 24 - filled)).alias("bar"), "coverage", label.alias("label"))


def analyzer_success(steps: DataFrame) -> DataFrame:
    """Q2, Q3, Q8, Q13: by analyzer, items, failures, skips, share of ok and mean duration. steps: (name, status, duration_ms)."""
    n = F.count(F.lit(1))
    done = n - count_if("status = 'skipped'")
    return steps.groupBy("name").agg(done.alias("analyzed"), count_if("status = 'skipped'").alias("skipped"), count_if("status = 'failed'").alias("failed"), percent(count_if("status = 'ok'"), done).alias("ok_share"), F.round(F.avg("duration_ms"), 3).alias("avg_ms"))


def performance(steps: DataFrame) -> DataFrame:
    """Q13: mean duration of each analyzer's rows, in milliseconds. steps: (name, status, duration_ms)."""
    return steps.groupBy("name").agg(F.round(F.avg("duration_ms"), 2).alias("avg_ms"))


def dataset_overview(m: DataFrame) -> DataFrame:
    """Q2: by dataset, items and databases, and when the first and the last was analyzed, where m says so."""
    keys = [c for c in ("dataset_id",) if c in m.columns]
    times = [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")] if "ts" in m.columns else []
    return m.where("id is not null").groupBy(*keys).agg(F.count_distinct("id").alias("items"), F.count_distinct("db_id").alias("dbs"), *times)
