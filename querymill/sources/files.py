"""Readers of raw items: JSON lines, JSON arrays, CSV, Parquet, SQLite files, prompt templates."""

from __future__ import annotations

import csv
import sqlite3
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "utf-8") -> DataFrame:
    """L1: a JSON object a line, gzip included, blank lines skipped; a bad line fails the read."""
    reader = spark.read.option("mode", "FAILFAST").option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "utf-8") -> DataFrame:
    """L2: files that are one array of objects each; a file that is anything else, a lone object too, is refused."""
    lone = spark.read.option("encoding", encoding).text(path, wholetext=True).where(~F.col("value").rlike(r"^[\s\ufeff]*\[\s*[\]{]")).limit(1).collect()
    if lone:
        raise ValueError(f"{path} has a file that is no array of objects: {lone[0][0][:60]!r}")
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, quotechar: str = '"', has_header: bool | None = None, encoding: str = "utf-8", sniff_bytes: int = 4096, multi_line: bool = True) -> DataFrame:
    """L3: CSV, all values strings. Delimiter and header are sniffed from the first bytes where not given;
    without a header columns are col_1 to col_n and no row is lost. multi_line: quoted values may hold
    line breaks, so a file can't be divided; False for large files whose records are single lines."""
    if delimiter is None or has_header is None:
        head = spark.read.text(path).limit(50).collect()
        sample = "\n".join(r[0] for r in head)[:sniff_bytes]
        try:
            delimiter = delimiter or csv.Sniffer().sniff(sample, ",;\t|").delimiter
        except csv.Error:
            delimiter = delimiter or ","
        if has_header is None:
            try:
                has_header = csv.Sniffer().has_header(sample) if sample.count("\n") > 1 else True
            except csv.Error:
                has_header = True
    df = spark.read.option("sep", delimiter).option("quote", quotechar).option("escape", quotechar).option("header", has_header).option("encoding", encoding).option("multiLine", multi_line).csv(path)
    return df if has_header else df.toDF(*[f"col_{i + 1}" for i in range(len(df.columns))])


def read_table(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """An exported dataset in Parquet; only the columns asked for are read, absent ones are null."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if not columns:
        return df
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


class Catalog(NamedTuple):
    """What databases hold: tables (db_id, table, is_empty), columns, foreign keys, and health (db_id, health, err, fk_enforcement, violations)."""

    tables: DataFrame
    columns: DataFrame
    fks: DataFrame
    health: DataFrame


_CATALOG = (
    "db_id string, kind string, table string, pos int, name string, type string, flag boolean, pk boolean, uniq boolean, local array<string>, parent_table string, parent_columns array<string>, violations long"
)


def _described(db: str, c: sqlite3.Connection) -> Iterator[tuple]:
    """Rows of _CATALOG of one open database."""
    q = lambda name: '"' + name.replace('"', '""') + '"'
    enforced = bool(c.execute("pragma foreign_keys").fetchone()[0])
    try:
        orphans = len(c.execute("pragma foreign_key_check").fetchall())
    except sqlite3.Error:  # a key whose parent can't be compared; it is a finding of its own
        orphans = 0
    yield (db, "health", None, None, "ok", None, enforced, None, None, None, None, None, orphans)
    for (t,) in c.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name").fetchall():
        try:
            empty = c.execute(f"select 1 from {q(t)} limit 1").fetchone() is None
        except sqlite3.Error:
            empty = True
        yield (db, "table", t, None, None, None, empty, None, None, None, None, None, None)
        unique = {parts[0][2] for i in c.execute(f"pragma index_list({q(t)})").fetchall() if i[2] for parts in [c.execute(f"pragma index_info({q(i[1])})").fetchall()] if len(parts) == 1}
        for pos, name, kind, notnull, _, pk in c.execute(f"pragma table_info({q(t)})").fetchall():
            yield (db, "column", t, pos, name, kind, not notnull, pk > 0, name in unique, None, None, None, None)
        keys: dict[int, list] = {}
        for fk, seq, parent, own, theirs, *_ in c.execute(f"pragma foreign_key_list({q(t)})").fetchall():
            keys.setdefault(fk, []).append((seq, parent, own, theirs))
        for fk, parts in sorted(keys.items()):
            parts.sort()
            theirs = [p[3] for p in parts]
            if all(x is None for x in theirs):
                theirs = [r[1] for r in sorted(c.execute(f"pragma table_info({q(parts[0][1])})").fetchall(), key=lambda r: r[5]) if r[5]]
            yield (db, "fk", t, fk, None, None, None, None, None, [p[2] for p in parts], parts[0][1], theirs, None)


def sqlite_catalog(spark: SparkSession, root: str, db_ids: DataFrame) -> Catalog:
    """The catalog of SQLite files root/<db_id>/<db_id>.sqlite, read in the tasks.

    uniq comes from unique indexes of one column. Foreign keys without parent columns point to the
    parent's key. A database that is missing or can't be read has health unknown or error and nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for db in batch["db_id"]:
                path = Path(root, db, f"{db}.sqlite")
                if not path.exists():
                    rows.append((db, "health", None, None, "unknown", "there is no such file", *[None] * 7))
                    continue
                c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                try:
                    rows += list(_described(db, c))
                except sqlite3.Error as e:
                    rows = [r for r in rows if r[0] != db] + [(db, "health", None, None, "error", str(e), *[None] * 7)]
                finally:
                    c.close()
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _CATALOG.split(", ")])

    every = db_ids.select("db_id").where("db_id is not null").distinct().mapInPandas(run, _CATALOG)
    return catalog_of(every)


def catalog_of(every: DataFrame) -> Catalog:
    """A Catalog from rows of _CATALOG."""
    tables = every.where("kind = 'table'").select("db_id", "table", F.col("flag").alias("is_empty"))
    columns = every.where("kind = 'column'").select("db_id", "table", "pos", "name", "type", F.col("flag").alias("nullable"), "pk", "uniq")
    fks = every.where("kind = 'fk'").select("db_id", "table", F.col("pos").alias("fk_id"), "local", "parent_table", "parent_columns")
    health = every.where("kind = 'health'").select("db_id", F.col("name").alias("health"), F.col("type").alias("err"), F.when(F.col("flag"), "enabled").when(~F.col("flag"), "disabled").alias("fk_enforcement"), F.coalesce("violations", F.lit(0)).alias("violations"))
    return Catalog(tables, columns, fks, health)


def build_databases(schemas: DataFrame, root: str) -> DataFrame:
    """(db_id, health, err) of SQLite files root/<db_id>/<db_id>.sqlite made from DDL: schemas (db_id, schema).

    A file that is missing or empty gets the DDL in one transaction; one that has tables stays as it is.
    DDL that fails leaves no table and gives health error with the first 200 characters of the statement.
    Null schemas are not built. The folder must be one that all executors share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(db, *_built(Path(root, db, f"{db}.sqlite"), ddl)) for db, ddl in zip(batch["db_id"], batch["schema"])], columns=["db_id", "health", "err"])

    one = schemas.where("db_id is not null and schema is not null").groupBy("db_id").agg(F.min("schema").alias("schema"))
    return one.mapInPandas(run, "db_id string, health string, err string")


def _built(path: Path, ddl: str) -> tuple[str, str | None]:
    path.parent.mkdir(parents=True, exist_ok=True)
    c = sqlite3.connect(path, isolation_level=None)
    statement = ""
    try:
        if c.execute("select 1 from sqlite_master limit 1").fetchone():
            return "ok", None
        c.execute("begin")
        for statement in _statements(ddl):
            c.execute(statement)
        c.execute("commit")
        return "ok", None
    except (sqlite3.Error, sqlite3.Warning) as e:
        if c.in_transaction:
            c.execute("rollback")
        return "error", f"{e}: {statement[:200]}"
    finally:
        c.close()


def _statements(ddl: str) -> Iterator[str]:
    """The statements of a script, as sqlite3 tells where each is complete."""
    held = ""
    for part in ddl.split(";"):
        held += part + ";"
        if sqlite3.complete_statement(held):
            if held.strip(" \t\r\n;"):
                yield held.strip()
            held = ""
    if held.strip(" \t\r\n;"):
        yield held.strip()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table, or a query in brackets with a name, of a database server whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


#: The views of PostgreSQL's information_schema that describe tables and keys.
POSTGRES_VIEWS = {
    "columns": "table_schema, table_name, column_name, ordinal_position, data_type, is_nullable",
    "table_constraints": "constraint_schema, constraint_name, table_schema, table_name, constraint_type",
    "key_column_usage": "constraint_schema, constraint_name, table_name, column_name, ordinal_position, position_in_unique_constraint",
    "referential_constraints": "constraint_schema, constraint_name, unique_constraint_schema, unique_constraint_name",
}


def postgres_catalog(spark: SparkSession, url: str, db_id: str, schema: str = "public", **options: str) -> Catalog:
    """The catalog of one PostgreSQL database: a probe, then the views read through JDBC and joined here."""
    try:
        read_jdbc(spark, url, "(select 1 as one) probe", **options).collect()
    except Exception as e:  # noqa: BLE001 - whatever the driver raises is the database's health
        names = [x.split()[0] for x in _CATALOG.split(", ")]
        row = dict.fromkeys(names) | {"db_id": db_id, "kind": "health", "name": "error", "type": str(e).split("\n")[0][:200]}
        return catalog_of(spark.createDataFrame([tuple(row[n] for n in names)], _CATALOG))
    views = {v: read_jdbc(spark, url, f"(select {c} from information_schema.{v}) {v}", **options) for v, c in POSTGRES_VIEWS.items()}
    return postgres_catalog_of(views, db_id, schema)


def postgres_catalog_of(views: dict[str, DataFrame], db_id: str, schema: str = "public") -> Catalog:
    """The catalog that rows of POSTGRES_VIEWS describe. Tables count as filled: only their own rows could tell."""
    usage, constraints = views["key_column_usage"], views["table_constraints"].where(F.col("table_schema") == schema)
    keyed = usage.join(constraints.select("constraint_schema", "constraint_name", "constraint_type"), ["constraint_schema", "constraint_name"])
    alone = keyed.groupBy("constraint_schema", "constraint_name", "constraint_type", "table_name").agg(F.collect_list("column_name").alias("cs"))
    primary = keyed.where("constraint_type = 'PRIMARY KEY'").select("table_name", "column_name", F.lit(True).alias("pk")).distinct()
    unique = alone.where("constraint_type = 'UNIQUE' and size(cs) = 1").select("table_name", F.col("cs")[0].alias("column_name"), F.lit(True).alias("uniq")).distinct()
    columns = views["columns"].where(F.col("table_schema") == schema).join(primary, ["table_name", "column_name"], "left").join(unique, ["table_name", "column_name"], "left")
    columns = columns.select(F.lit(db_id).alias("db_id"), F.col("table_name").alias("table"), F.col("ordinal_position").alias("pos"), F.col("column_name").alias("name"), F.col("data_type").alias("type"), (F.col("is_nullable") == "YES").alias("nullable"), F.coalesce("pk", F.lit(False)).alias("pk"), F.coalesce("uniq", F.lit(False)).alias("uniq"))
    target = usage.select(F.col("constraint_schema").alias("unique_constraint_schema"), F.col("constraint_name").alias("unique_constraint_name"), F.col("ordinal_position").alias("position_in_unique_constraint"), F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"))
    parts = keyed.where("constraint_type = 'FOREIGN KEY'").join(views["referential_constraints"], ["constraint_schema", "constraint_name"]).join(target, ["unique_constraint_schema", "unique_constraint_name", "position_in_unique_constraint"])
    fks = parts.groupBy("constraint_name", "table_name", "parent_table").agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "parent_column"))).alias("x"))
    fks = fks.select(F.lit(db_id).alias("db_id"), F.col("table_name").alias("table"), F.pmod(F.xxhash64("constraint_name"), F.lit(2**31 - 1)).cast("int").alias("fk_id"), F.col("x.column_name").alias("local"), "parent_table", F.col("x.parent_column").alias("parent_columns"))
    tables = columns.select("db_id", "table", F.lit(False).alias("is_empty")).distinct()
    health = tables.sparkSession.range(1).select(F.lit(db_id).alias("db_id"), F.lit("ok").alias("health"), F.lit(None).cast("string").alias("err"), F.lit("enabled").alias("fk_enforcement"), F.lit(0).cast("long").alias("violations"))
    return Catalog(tables, columns, fks, health)


def prompt_template(path: str, variant: str = "default") -> str:
    """A variant of a YAML file of templates; a variant may name another one instead of holding text."""
    import yaml

    every = yaml.safe_load(Path(path).read_text())
    seen = set()
    while variant in every:
        value = every[variant]
        text = value["template"] if isinstance(value, dict) else value
        if text not in every or variant in seen:
            return text
        seen.add(variant)
        variant = text
    raise KeyError(f"no variant {variant!r} in {path}; there are {', '.join(sorted(every))}")
