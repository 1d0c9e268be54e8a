"""Statements tried on their databases: what is blocked, how it is limited, what comes of it."""

from __future__ import annotations

import re
import sqlite3
import time
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.session import spread
from querymill.sql.facts import WRITES
from querymill.sql.lexer import SqlError
from querymill.sql.parser import parse
from querymill.sql.tree import Node

#: Statements that are never run.
BLOCKED = ("DROP", "TRUNCATE", "ALTER", "VACUUM", "ATTACH", "DETACH")
MODES = ("none", "select_only", "all")
OUTCOME = "status string, err string, duration_ms double"
#: What the messages of failures speak of in reports.
PATTERNS = {"db not accessible": "db not accessible", "execution error": "execution error", "health check failed": "health check failed", "blocked destructive statement": "blocked destructive"}
#: Parts that the items of a database are dealt into, each of which gets the database's DDL once.
PARTS = 16


def blocked(sql: Column) -> Column:
    """The word for which a statement is blocked, null if it isn't."""
    word = F.regexp_extract(F.upper(F.trim(sql)), rf"^({'|'.join(BLOCKED)})\s", 1)
    return F.nullif(word, F.lit(""))


@lru_cache(maxsize=1024)
def _parsed(sql: str) -> tuple[list[Node], str | None]:
    """(roots of the statements of a text, None) or ([], why it can't be parsed): each text is parsed once for all that is asked of it."""
    try:
        return parse(sql), None
    except (SqlError, RecursionError) as e:
        return [], f"Unparsable error: {e}"


def limited(sql: str, limit: int = 1) -> str:
    """A SELECT without LIMIT gets one; anything else stays as it is."""
    roots, _ = _parsed(sql)
    if not roots or roots[0].kind not in ("Select", "Union", "Intersect", "Except") or roots[0]["limit"]:
        return sql
    bare = re.sub(r"(?:\s|;|--[^\n]*$|/\*[^*]*\*/$)+$", "", sql)
    return f"{bare}\nLIMIT {limit}"


_KIND_WORD = {"Drop": "DROP", "TruncateTable": "TRUNCATE", "Alter": "ALTER"}
_LEADING = re.compile(r"(?:\s|;|\(|--[^\n]*(?:\n|$)|/\*.*?\*/)+", re.S)


def destructive(sql: str) -> str | None:
    """The word of BLOCKED that any statement of a text is, whatever comments stand before it; None if none is."""
    roots, _ = _parsed(sql)
    words = [_KIND_WORD.get(n.kind) or (n.value if n.kind == "Command" else None) for n in roots]
    if not roots:
        start = _LEADING.match(sql)
        first = re.match(r"[A-Za-z]+", sql[start.end() :] if start else sql)
        words = [first.group().upper()] if first else []
    return next((w for w in words if w in BLOCKED), None)


def gate(sql: str | None, mode: str = "select_only", strict_compat: bool = False) -> str | None:
    """Why a statement must not run, or None. strict_compat: set operations are no SELECT in select_only mode."""
    if sql is None or not sql.strip():
        return "Empty SQL"
    if word := destructive(sql):
        return f"Blocked destructive statement: {word}"
    if mode == "select_only":
        roots, err = _parsed(sql)
        if not roots:
            return err
        queries = ("Select",) if strict_compat else ("Select", "Union", "Intersect", "Except", "Values", "Subquery")
        if roots[0].kind not in queries or next(roots[0].find(*WRITES), None) is not None:
            return "Only SELECT statements are allowed"
    return None


def attempt(connection: sqlite3.Connection, sql: str, mode: str = "select_only", limit: int = 1, timeout: float = 30.0, strict_compat: bool = False) -> tuple[bool, str | None, float]:
    """(ok, error, milliseconds) of one statement; writes are rolled back, a deadline interrupts it."""
    began = time.perf_counter()
    spent = lambda: (time.perf_counter() - began) * 1000
    if mode == "none":
        return True, None, 0.0
    if reason := gate(sql, mode, strict_compat):
        return False, reason, spent()
    connection.set_progress_handler(lambda: time.perf_counter() - began > timeout, 10_000)
    try:
        connection.execute("BEGIN")
        connection.execute(limited(sql, limit)).fetchone()
        return True, None, spent()
    except sqlite3.OperationalError as e:
        return False, f"Query timed out after {timeout:g}s" if "interrupted" in str(e) else f"Execution error: {e}", spent()
    except (sqlite3.Error, sqlite3.Warning, ValueError) as e:
        return False, f"Execution error: {e}", spent()
    finally:
        connection.set_progress_handler(None, 0)
        if connection.in_transaction:
            connection.rollback()


def _memory(ddl: str) -> sqlite3.Connection:
    connection = sqlite3.connect(":memory:", isolation_level=None, check_same_thread=False)
    connection.executescript(ddl)
    return connection


def _file(path: Path, mode: str) -> sqlite3.Connection:
    if mode != "all":
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True, isolation_level=None)
    copy = sqlite3.connect(":memory:", isolation_level=None)  # writes only ever meet a copy
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as source:
        source.backup(copy)
    return copy


def probe(items: DataFrame, databases: DataFrame | None = None, root: str | None = None, mode: str = "select_only", limit: int = 1, timeout: float = 30.0, strict_compat: bool = False, open_most: int = 32, parts: int = PARTS) -> DataFrame:
    """items (id, db_id, sql) with status (ok or failed), err and duration_ms of each statement on its database.

    Databases are DDL texts (db_id, ddl), built empty in memory, or SQLite files root/<db_id>/<db_id>.sqlite
    that every executor can read. A task keeps up to open_most of them open. The items of a database are
    dealt into `parts` by their ids, so that one with a third of all items has many tasks; its DDL is sent
    once to each part, ahead of the items, not with every item. Items of no or an unknown database fail.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = items.select("id", "db_id", "sql", F.lit(True).alias("item"))
    if databases is not None:
        texts = databases.groupBy("db_id").agg(F.array_join(F.array_sort(F.collect_list("ddl")), "\n").alias("sql"))
        texts = texts.select(F.lit(None).cast(items.schema["id"].dataType).alias("id"), "db_id", "sql", F.lit(False).alias("item"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        both = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).unionByName(texts)
        source = both.repartition("db_id", "part").sortWithinPartitions("db_id", "part", "item").select("id", "db_id", "sql", "item")
    else:
        source = spread(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, sqlite3.Connection | str] = {}

        def connect(db: str | None, ddl: str | None) -> sqlite3.Connection | str:
            path = Path(root or "", str(db), f"{db}.sqlite")
            try:
                return _memory(ddl) if ddl is not None else _file(path, mode) if root and db and path.exists() else "DB not accessible: unknown database"
            except sqlite3.Error as e:
                return f"DB not accessible: {e}"
            except Exception as e:  # noqa: BLE001 - whatever else a database raises is its items' error
                return f"Health check failed: {e}"

        def keep(db: str | None, ddl: str | None) -> None:
            if db in open_:
                return
            if len(open_) >= open_most:
                first = open_.pop(next(iter(open_)))
                if not isinstance(first, str):
                    first.close()
            open_[db] = connect(db, ddl)

        for batch in batches:
            out = []
            for id_, db, sql, item in zip(batch["id"], batch["db_id"], batch["sql"], batch["item"]):
                keep(db, None if item else sql)
                if item:
                    at = open_[db]
                    ok, err, spent = (False, at, 0.0) if isinstance(at, str) else attempt(at, sql, mode, limit, timeout, strict_compat)
                    out.append((id_, db, "ok" if ok else "failed", err, spent))
            yield pd.DataFrame(out, columns=["id", "db_id", "status", "err", "duration_ms"])
        for c in open_.values():
            if not isinstance(c, str):
                c.close()

    return source.mapInPandas(run, f"id {items.schema['id'].dataType.simpleString()}, db_id string, {OUTCOME}")


def error_patterns(probed: DataFrame) -> DataFrame:
    """Q27: failures by what their message speaks of, those that occur; a failure may count for several."""
    low = F.lower(F.coalesce("err", F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.contains(words), F.lit(name)) for name, words in PATTERNS.items()]))
    return probed.where("status = 'failed'").select(F.explode(found).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("failures"))


def totals(probed: DataFrame) -> DataFrame:
    """Q8, Q25: items, those analyzed, skipped and failed, and the share of failures among the analyzed."""
    count = lambda s: F.count_if(F.col("status") == s)
    analyzed = F.count_if(F.col("status") != "skipped")
    share = F.round(F.coalesce(F.try_divide(count("failed") * F.lit(100.0).cast("double"), analyzed), F.lit(0.0)), 1)
    return probed.agg(F.count(F.lit(1)).alias("total"), analyzed.alias("analyzed"), count("skipped").alias("skipped"), count("failed").alias("failed"), share.alias("failed_share"))


def failures(probed: DataFrame) -> DataFrame:
    """Q26: failed items in numerical order, then those whose id is no number, with the first 400 characters of their error."""
    short = F.when(F.length("err") > 400, F.concat(F.substring("err", 1, 400), F.lit("..."))).otherwise(F.coalesce("err", F.lit("")))
    return probed.where("status = 'failed'").select("id", "db_id", short.alias("err")).orderBy(F.expr("try_cast(id as bigint)").asc_nulls_last(), "id")
