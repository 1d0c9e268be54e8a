"""Raw records made items: aliases, ids, identities of databases, steps and the gate they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querymill.session import write_shared

STANDARD = ("id", "dbId", "question", "sql", "schema")
STEP = "struct<name:string,status:string,reason:string>"
SKIPPED = "skipped due to previous analyzer failure"


def alias_mapper(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The standard columns by mapping (standard name → source column), all else as JSON in metadata.

    Values become strings; a missing question or sql is empty, other missing columns are null. steps starts empty.
    """
    have = set(raw.columns)
    sources = {std: mapping.get(std, std) for std in STANDARD}
    columns = []
    for std, src in sources.items():
        c = F.col(f"`{src}`").cast("string") if src in have else F.lit(None).cast("string")
        columns.append((F.coalesce(c, F.lit("")) if std in ("question", "sql") else c).alias(std))
    rest = [c for c in raw.columns if c not in set(sources.values())]
    meta = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit("{}")
    return raw.select(*columns, meta.alias("metadata"), F.array().cast(f"array<{STEP}>").alias("steps"))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def hash_ids(items: DataFrame, length: int = 16) -> DataFrame:
    """Items without id get the first `length` digits of the SHA-256 of dbId, question and sql; nulls count as empty."""
    if not 4 <= length <= 64:
        raise ValueError("length must be between 4 and 64")
    digest = F.sha2(F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in ("dbId", "question", "sql")]), 256)
    return items.withColumn("id", F.when(_blank(F.col("id")), F.substring(digest, 1, length)).otherwise(F.col("id")))


def incremental_ids(items: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """Items without id are numbered from start in the given order; only they count.

    Ranges of the order are counted first and numbered on their own, so that no task sees all rows.
    """
    n = items.sparkSession.sparkContext.defaultParallelism * 4
    kept = write_shared(items.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "numbered")
    blank = _blank(F.col("id"))
    starts = kept.where(blank).groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    along = Window.partitionBy("_p", blank).orderBy(*order)
    out = kept.withColumn("_r", F.row_number().over(along)).join(F.broadcast(starts.select("_p", "_s")), "_p", "left")
    return out.withColumn("id", F.when(blank, (F.col("_s") + F.col("_r") - 1 + start).cast("string")).otherwise(F.col("id"))).drop("_p", "_r", "_s")


def plain_ddl(schema: Column) -> Column:
    """DDL without comments, in lower case with single blanks."""
    text = F.regexp_replace(F.regexp_replace(schema, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))  # blanks of any kind


def bad_schema_id(schema: Column, dialect: str = "sqlite") -> Column:
    """The identity of DDL that can't be parsed."""
    return F.concat(F.lit(f"{dialect[:3]}_err_"), F.substring(F.sha1(plain_ddl(schema)), 1, 16))


def schema_ids(items: DataFrame, dialect: str = "sqlite") -> DataFrame:
    """Items with schema_id: the same for DDL texts that define the same tables, columns and types."""
    from querymill.sql.ddl import identity

    known = items.select("schema").where("schema is not null and trim(schema) <> ''").distinct()

    def run(batches):
        for batch in batches:
            batch["schema_id"] = [identity(t, dialect) for t in batch["schema"]]
            yield batch

    ids = known.mapInPandas(run, "schema string, schema_id string")
    out = items.join(ids, "schema", "left")
    return out.withColumn("schema_id", F.when(F.col("schema").isNotNull() & (F.trim("schema") != ""), F.coalesce("schema_id", bad_schema_id(F.col("schema"), dialect))))


def step(name: str, status: Column | str, reason: Column | str | None = None) -> Column:
    """One step of an item."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(name).alias("name"), as_column(status).alias("status"), as_column(reason).alias("reason"))


def add_step(items: DataFrame, name: str, status: Column | str, reason: Column | str | None = None) -> DataFrame:
    return items.withColumn("steps", F.array_append("steps", step(name, status, reason)))


def failed_before() -> Column:
    """Whether an earlier step of the item failed."""
    return F.exists("steps", lambda s: s["status"] == "failed")


def database_identity(items: DataFrame, databases: DataFrame, dialect: str = "sqlite") -> DataFrame:
    """Items with a usable dbId, or marked failed. databases: (db_id, health).

    Healthy: as it is. Unhealthy or unknown with a schema: kept, to be rebuilt from it. Without dbId but
    with a schema: the schema's identity. Neither: the step db_identity fails with its reason.
    """
    health = databases.select(F.col("db_id").alias("_db"), F.col("health").alias("_health")).dropDuplicates(["_db"])
    j = schema_ids(items, dialect).join(health, F.col("dbId") == F.col("_db"), "left")
    has_db, has_schema = ~_blank(F.col("dbId")), ~_blank(F.col("schema"))
    healthy = F.coalesce(F.col("_health") == "ok", F.lit(False))
    bad = F.coalesce(F.col("schema_id").contains("_err_"), F.lit(False))
    action = F.when(has_db & healthy, "kept").when(has_db & has_schema & ~bad, "rebuilt").when(has_db, "failed").when(has_schema & ~bad, "derived").otherwise("failed")
    reason = F.when(has_schema & bad, "schema can't be parsed").when(has_db, "database is not healthy and there is no schema").otherwise("neither dbId nor schema")
    out = j.withColumn("_action", action).withColumn("dbId", F.when(F.col("_action") == "derived", F.col("schema_id")).otherwise(F.col("dbId")))
    out = out.withColumn("steps", F.array_append("steps", step("db_identity", F.when(F.col("_action") == "failed", "failed").otherwise("ok"), F.when(F.col("_action") == "failed", reason).otherwise(F.col("_action")))))
    return out.drop("_db", "_health", "_action", "schema_id")
