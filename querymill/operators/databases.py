"""Databases named carelessly: which registered one a spelling stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def database_key(name: Column) -> Column:
    """What identifies a database in a carelessly written db_id, null if nothing is left.

    The last part of a path, without a file ending, in lower case, with letters and digits only.
    """
    bare = F.regexp_replace(name, r"^[\s \p{Z}\"'`\[\](){}]+|[\s \p{Z}\"'`\[\](){}]+$", "")
    last = F.regexp_replace(bare, r"^.*[/\\]", "")
    stem = F.regexp_replace(last, r"\.[A-Za-z][A-Za-z0-9]{0,9}[\s\"'`\]]*$", "")
    key = F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(key) > 0, key)


def spellings(written: DataFrame, known: DataFrame) -> DataFrame:
    """(written, db_id) of the distinct values of a column `written` that stand for a row of known (db_id, …), with its other columns.

    A registered name is itself; any other spelling is the database with the same database_key, provided
    only one has it. Each spelling is looked up once. Nothing is broadcast by force: Spark does that where
    a side is small enough.
    """
    others = [c for c in known.columns if c != "db_id"]
    entry = F.struct("db_id", *others)
    exact = known.select(F.col("db_id").alias("written"), entry.alias("exact")).dropDuplicates(["written"])
    by_key = known.groupBy(database_key(F.col("db_id")).alias("key")).agg(F.first(entry).alias("alike"), F.countDistinct("db_id").alias("n")).where("n = 1 and key is not null").drop("n")
    distinct = written.select("written").where("written is not null").distinct().withColumn("key", database_key(F.col("written")))
    found = distinct.join(exact, "written", "left").join(by_key, "key", "left").withColumn("as", F.coalesce("exact", "alike"))
    return found.where("as is not null").select("written", "as.*")


def resolved(rows: DataFrame, catalog: DataFrame, column: str = "db_id") -> DataFrame:
    """rows with the registered spelling in `column`, null where what is written stands for no database of catalog (db_id)."""
    rest = [c for c in rows.columns if c != column]
    names = spellings(rows.select(F.col(column).alias("written")), catalog.select("db_id").where("db_id is not null"))
    joined = rows.withColumnRenamed(column, "written").join(names.withColumnRenamed("db_id", "_registered"), "written", "left")
    return joined.select(*rest, F.col("_registered").alias(column))
