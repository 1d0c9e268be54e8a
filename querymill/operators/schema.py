"""Database schemas checked: keys, types, duplicate columns, empty tables, orphaned rows, status.

A catalog is three tables: tables (db_id, table, is_empty), columns (db_id, table, pos, name, type,
nullable, pk, uniq) and foreign keys (db_id, table, fk_id, local, parent_table, parent_columns), the
last two arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of a foreign key, in the order in which they are looked for.
FK_CLASSES = ("fk_missing_table", "fk_missing_column", "fk_arity_mismatch", "fk_target_not_key", "fk_type_mismatch")


def type_family(kind: Column, dialect: str = "sqlite") -> Column:
    """The family of a declared type: SQLite's affinities, or coarse families for other dialects."""
    t = F.upper(F.trim(F.coalesce(kind, F.lit(""))))
    has = lambda *words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    if dialect == "sqlite":
        return F.when(has("INT"), "INTEGER").when(has("CHAR", "CLOB", "TEXT"), "TEXT").when(has("BLOB") | (t == ""), "BLOB").when(has("REAL", "FLOA", "DOUB"), "REAL").otherwise("NUMERIC")
    return (
        F.when(has("INT", "SERIAL"), "INTEGER").when(has("CHAR", "TEXT", "CLOB", "UUID"), "TEXT").when(has("BOOL"), "BOOLEAN").when(has("REAL", "FLOAT", "DOUBLE"), "REAL")
        .when(has("NUMERIC", "DECIMAL", "MONEY"), "NUMERIC").when(has("DATE", "TIME", "INTERVAL"), "DATETIME").when(has("JSON"), "JSON").when(has("BYTEA", "BLOB", "BINARY"), "BLOB").when(t == "", "UNKNOWN").otherwise(t)
    )


def table_counts(columns: DataFrame) -> DataFrame:
    """Tables and columns of each database."""
    return columns.groupBy("db_id").agg(F.count_distinct("table").alias("tables"), F.count(F.lit(1)).alias("columns"))


def duplicate_columns(columns: DataFrame) -> DataFrame:
    """(db_id, table, name, times) of names that a table has more than once, compared as written."""
    return columns.groupBy("db_id", "table", "name").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def fk_classes(fks: DataFrame, columns: DataFrame, dialect: str = "sqlite") -> DataFrame:
    """Fks with fk_class: the first class of FK_CLASSES that applies, else valid.

    Parents are looked up once: a foreign key meets the map of its parent's columns by one join.
    """
    info = F.struct(type_family(F.col("type"), dialect).alias("family"), (F.trim(F.coalesce("type", F.lit(""))) == "").alias("untyped"), F.coalesce("pk", F.lit(False)).alias("pk"), F.coalesce("uniq", F.lit(False)).alias("uniq"))
    # of columns of one name, the first is the one a key means
    named = columns.groupBy("db_id", "table", "name").agg(F.min_by(F.struct("type", "pk", "uniq"), "pos").alias("x")).select("db_id", "table", "name", "x.*")
    per = named.groupBy("db_id", "table").agg(F.map_from_entries(F.collect_list(F.struct("name", info))).alias("cols"))
    parents = per.select("db_id", F.col("table").alias("parent_table"), F.col("cols").alias("parent"))
    own = per.select("db_id", "table", F.col("cols").alias("own"))
    j = fks.join(parents, ["db_id", "parent_table"], "left").join(own, ["db_id", "table"], "left")
    missing = F.exists("parent_columns", lambda c: c.isNull() | ~F.coalesce(F.map_contains_key("parent", F.coalesce(c, F.lit(""))), F.lit(False)))
    pks = F.map_keys(F.map_filter("parent", lambda _, v: v["pk"]))
    not_key = (F.size(F.array_except("parent_columns", pks)) > 0) & ~F.forall("parent_columns", lambda c: F.coalesce(F.element_at("parent", c)["uniq"], F.lit(False)))
    pairs = F.arrays_zip("local", "parent_columns")

    def differs(p: Column) -> Column:
        a, b = F.try_element_at("own", p["local"]), F.try_element_at("parent", p["parent_columns"])
        return F.coalesce(~a["untyped"] & ~b["untyped"] & (a["family"] != b["family"]), F.lit(False))

    kind = (
        F.when(F.col("parent").isNull(), FK_CLASSES[0])
        .when(missing, FK_CLASSES[1])
        .when(F.size("local") != F.size("parent_columns"), FK_CLASSES[2])
        .when(not_key, FK_CLASSES[3])
        .when(F.exists(pairs, differs), FK_CLASSES[4])
        .otherwise("valid")
    )
    return j.withColumn("fk_class", kind).drop("parent", "own")


def orphans(child: DataFrame, parent: DataFrame, local: list[str], parent_columns: list[str]) -> DataFrame:
    """Rows of child whose key, none of it null, has no row in parent."""
    keys = parent.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(parent_columns)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(local)])
    return child.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in local])).join(keys, on, "left_anti")


#: What a finding of each class says.
FK_TEXTS = {
    "fk_missing_table": "there is no such parent table",
    "fk_missing_column": "the parent table has no such column",
    "fk_arity_mismatch": "both sides have different numbers of columns",
    "fk_target_not_key": "the parent columns are no key",
    "fk_type_mismatch": "the types of both sides differ",
}
FINDINGS = "array<struct<kind:string,message:string>>"


def _finding(kind: Column | str, message: Column) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), message.alias("message"))


def fk_message(fk_class: Column) -> Column:
    """Which key a foreign key's class is about, and what it says."""
    sides = F.concat(F.col("table"), F.lit("("), F.array_join("local", ", "), F.lit(") -> "), F.col("parent_table"), F.lit("("), F.array_join("parent_columns", ", "), F.lit("): "))
    return F.concat(sides, F.coalesce(*[F.when(fk_class == k, v) for k, v in FK_TEXTS.items()]))


def validate(dbs: DataFrame, tables: DataFrame, columns: DataFrame, fks: DataFrame, violations: DataFrame | None = None, dialect: str = "sqlite") -> DataFrame:
    """One row per database with its counts, errors, warnings and status.

    dbs: (db_id, healthy), and err and fk_enforcement where they are known. violations: (db_id, n) orphaned
    rows. status: failed if the database can't be reached, errors if anything blocks, warns if there are
    warnings, else ok; a database without tables is ok. errors and warnings: (kind, message) each; all
    empty tables are one warning.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    classed = fk_classes(fks, columns, dialect)
    keys = classed.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("fk_total"),
        F.count_if(F.col("fk_class") == "valid").alias("fk_valid"),
        *[F.count_if(F.col("fk_class") == c).alias(c) for c in FK_CLASSES],
        F.array_sort(F.collect_list(F.when(F.col("fk_class") != "valid", _finding(F.col("fk_class"), fk_message(F.col("fk_class")))))).alias("_fk"),
    )
    doubles = duplicate_columns(columns).groupBy("db_id").agg(
        F.count_distinct("table").alias("duplicate_columns_count"),
        F.array_sort(F.collect_list(_finding("duplicate_columns", F.concat(F.col("table"), F.lit("."), F.col("name"), F.lit(" is there "), F.col("times").cast("string"), F.lit(" times"))))).alias("_double"),
    )
    empty = tables.groupBy("db_id").agg(F.count_if(~F.coalesce("is_empty", F.lit(True))).alias("tables_non_empty"), F.array_sort(F.collect_list(F.when(F.coalesce("is_empty", F.lit(True)), F.col("table")))).alias("empty_tables"))
    known = [c for c in ("err", "fk_enforcement") if c in dbs.columns]
    out = dbs.select("db_id", "healthy", *known, *[F.lit(None).cast("string").alias(c) for c in ("err", "fk_enforcement") if c not in known]).dropDuplicates(["db_id"])
    for part in (table_counts(columns), keys, doubles, empty):
        out = out.join(part, "db_id", "left")
    out = out.join(violations.select("db_id", F.col("n").alias("fk_data_violations_count")), "db_id", "left") if violations is not None else out.withColumn("fk_data_violations_count", F.lit(0).cast("long"))
    counts = ["tables", "columns", "fk_total", "fk_valid", *FK_CLASSES, "duplicate_columns_count", "tables_non_empty", "fk_data_violations_count"]
    none = F.array().cast(FINDINGS)
    n = F.coalesce("fk_data_violations_count", F.lit(0))
    reason = F.coalesce("err", F.lit("database is not accessible"))
    errors = (
        F.when(~F.col("healthy"), F.array(_finding("db_connection_error", reason)))
        .otherwise(F.concat(F.when(n > 0, F.array(_finding("fk_data_violation", F.concat(n.cast("string"), F.lit(" rows point to no parent row"))))).otherwise(none), F.coalesce("_fk", none), F.coalesce("_double", none)))
    )
    names = F.transform("empty_tables", lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    warned = F.concat(F.size("empty_tables").cast("string"), F.lit(" tables are empty: "), F.array_join(names, ", "))
    warnings = F.when(F.col("healthy") & (F.size("empty_tables") > 0), F.array(_finding("empty_tables", warned))).otherwise(none)
    out = out.withColumn("empty_tables", F.coalesce("empty_tables", F.array().cast("array<string>")))
    out = out.select("db_id", "healthy", "fk_enforcement", *[zero(c) for c in counts], "empty_tables", errors.alias("errors"), warnings.alias("warnings"), F.when(~F.col("healthy"), reason).alias("err"))
    out = out.withColumn("fk_invalid", F.col("fk_total") - F.col("fk_valid")).withColumn("blocking_errors_total", F.when(~F.col("healthy"), F.lit(1)).otherwise(F.col("fk_invalid") + F.col("duplicate_columns_count")))
    blocking = F.col("blocking_errors_total") + (F.col("fk_data_violations_count") > 0).cast("long")
    return out.withColumn("status", F.when(~F.col("healthy"), "failed").when(blocking > 0, "errors").when(F.size("warnings") > 0, "warns").otherwise("ok"))


def skipped(items: DataFrame) -> DataFrame:
    """A row for each item that an earlier step failed: its database, status skipped."""
    return items.select("db_id", F.lit(False).alias("healthy"), F.lit("skipped").alias("status"), F.lit("skipped due to previous analyzer failure").alias("err"))


def findings(validated: DataFrame) -> DataFrame:
    """Q24: every error and warning of every database: (db_id, status, level, kind, message)."""
    both = F.concat(*[F.transform(c, lambda x: F.struct(F.lit(level).alias("level"), x["kind"].alias("kind"), x["message"].alias("message"))) for c, level in (("errors", "error"), ("warnings", "warning"))])  # noqa: B023
    return validated.select("db_id", "status", F.explode(both).alias("x")).select("db_id", "status", "x.*")


def schema_totals(validated: DataFrame) -> DataFrame:
    """Q4, Q14, Q15: databases by status and sums over all."""
    sums = ["tables", "columns", "fk_total", "fk_invalid", "blocking_errors_total"]
    return validated.agg(F.count(F.lit(1)).alias("dbs"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warns", "errors", "failed")], *[F.sum(c).alias(f"sum_{c}") for c in sums], F.count_if(F.col("fk_data_violations_count") > 0).alias("dbs_with_violations"), F.sum(F.col("tables") - F.col("tables_non_empty")).alias("empty_tables"))


def top_issue(validated: DataFrame) -> DataFrame:
    """Q19: the most frequent kind of error, ties by name."""
    kinds = [*FK_CLASSES, "duplicate_columns_count"]
    row = validated.agg(*[F.sum(c).alias(c) for c in kinds])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("findings")) for k in kinds])).alias("x")).select("x.*").orderBy(F.desc("findings"), "kind").limit(1)


#: Order of the statuses in listings.
STATUS_ORDER = {"failed": 1, "errors": 2, "warns": 3, "ok": 4}


def listing(validated: DataFrame, status: str | None = None, k: int | None = None) -> DataFrame:
    """Q16, Q20 to Q24: databases with what was found, by status and name; one status only, or its first k."""
    order = F.create_map(*[F.lit(x) for n, i in STATUS_ORDER.items() for x in (n, i)])
    rows = validated if status is None else validated.where(F.col("status") == status)
    short = F.when(F.length("err") > 180, F.concat(F.substring("err", 1, 180), F.lit("..."))).otherwise(F.col("err"))
    rows = rows.select(
        order[F.col("status")].alias("status_order"), "db_id", "status", "tables", "tables_non_empty", "columns", "fk_total", "fk_invalid", "blocking_errors_total", F.size("warnings").alias("warnings"), F.col("fk_data_violations_count").alias("fk_violations"), short.alias("err")
    )
    return rows.orderBy("status_order", "db_id").limit(k) if k else rows


def empty_tables_used(tables: DataFrame, used: DataFrame) -> DataFrame:
    """Q18: empty tables by database, those that statements use and those that none does. used: (db_id, table, queries)."""
    empty = tables.where(F.coalesce("is_empty", F.lit(True))).select("db_id", F.lower("table").alias("table")).distinct()
    j = empty.join(used.select("db_id", F.lower("table").alias("table"), "queries"), ["db_id", "table"], "left")
    return j.groupBy("db_id").agg(F.count_if(F.col("queries").isNotNull()).alias("empty_used"), F.count_if(F.col("queries").isNull()).alias("empty_unused"))


def items_on_bad_dbs(items: DataFrame, validated: DataFrame) -> DataFrame:
    """Q17: items on databases with errors, and their share."""
    bad = validated.where("status in ('errors', 'failed')").select("db_id").withColumn("bad", F.lit(True))
    j = items.select("id", "db_id").join(bad, "db_id", "left")
    return j.agg(F.count_distinct(F.when(F.col("bad"), F.col("id"))).alias("items"), F.count_distinct("id").alias("total")).withColumn("share", F.round(F.coalesce(F.try_divide(F.col("items") * F.lit(100.0).cast("double"), F.col("total")), F.lit(0.0)), 1))


def column_examples(values: DataFrame, keys: list[str], value: str, n: int = 2) -> DataFrame:
    """The n least distinct values of each column, as an array. Deterministic, and combined before the shuffle by distinct."""
    from pyspark.sql.window import Window

    d = values.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    ranked = d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("__r") <= n)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("examples"))


def example_text(values: Column) -> Column:
    """An array of examples as [a, b]; strings quoted, with \\' for a quote in them."""
    one = lambda v: F.when(v.isNull(), "NULL").when(v.cast("string").try_cast("double").isNotNull(), v.cast("string")).otherwise(F.concat(F.lit("'"), F.replace(v.cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(values, one), ", "), F.lit("]"))


def ddl(columns: DataFrame, fks: DataFrame | None = None, examples: DataFrame | None = None) -> DataFrame:
    """(db_id, table, ddl): CREATE TABLE of each table, its columns in order, then keys.

    examples: (db_id, table, name, examples), shown as comments.
    """
    if examples is not None:
        columns = columns.join(examples, ["db_id", "table", "name"], "left")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    line = F.concat(F.lit("  "), quoted(F.col("name")), F.when(F.coalesce("type", F.lit("")) != "", F.concat(F.lit(" "), F.col("type"))).otherwise(""), F.when(~F.coalesce("nullable", F.lit(True)), " NOT NULL").otherwise(""))
    if examples is not None:
        line = F.concat(line, F.when(F.size("examples") > 0, F.concat(F.lit(" /* ex: "), example_text(F.col("examples")), F.lit(" */"))).otherwise(""))
    per = columns.groupBy("db_id", "table").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l"), F.when(F.col("pk"), quoted(F.col("name"))).alias("k")))).alias("cs"))
    lines = F.transform("cs", lambda x: x["l"])
    keys = F.array_join(F.filter(F.transform("cs", lambda x: x["k"]), lambda k: k.isNotNull()), ", ")
    body = F.concat(lines, F.when(keys != "", F.array(F.concat(F.lit("  PRIMARY KEY ("), keys, F.lit(")")))).otherwise(F.array().cast("array<string>")))
    if fks is not None:
        names = lambda c: F.array_join(F.transform(c, lambda x: quoted(x)), ", ")
        foreign = fks.groupBy("db_id", "table").agg(F.array_sort(F.collect_list(F.concat(F.lit("  FOREIGN KEY ("), names("local"), F.lit(") REFERENCES "), quoted(F.col("parent_table")), F.lit(" ("), names("parent_columns"), F.lit(")")))).alias("fs"))
        per = per.join(foreign, ["db_id", "table"], "left")
        body = F.concat(body, F.coalesce("fs", F.array().cast("array<string>")))
    return per.select("db_id", "table", F.concat(F.lit("CREATE TABLE "), quoted(F.col("table")), F.lit(" (\n"), F.array_join(body, ",\n"), F.lit("\n);")).alias("ddl"))
