"""DDL texts: the tables they define, and an identity that formatting doesn't change."""

from __future__ import annotations

import hashlib
import json
import re

from querymill.sql.lexer import SqlError
from querymill.sql.parser import parse


def tables(text: str) -> dict[str, list[dict[str, object]]]:
    """Table → columns (name, type, nullable, pk, unique) in order. Raises SqlError for text that is no DDL."""
    out: dict[str, list[dict[str, object]]] = {}
    for node in parse(text):
        if node.kind != "Create" or node.value != "TABLE" or not node["table"]:
            continue
        columns = []
        for m in node["members"] or []:
            if m.kind == "ColumnDef":
                columns.append({"name": m.value, "type": m["type"].value.upper(), "nullable": "not_null" not in m.flags, "pk": "primary" in m.flags, "unique": "unique" in m.flags})
        keys = [c for m in node["members"] or [] if m.kind == "Constraint" and m.value == "PRIMARY" for c in (m["columns"] or [])]
        for c in columns:
            c["pk"] = c["pk"] or c["name"] in {k.value for k in keys}
        out[node["table"].value] = columns
    return out


def foreign_keys(text: str) -> list[dict[str, object]]:
    """(table, local, parent_table, parent_columns) of each foreign key of DDL."""
    out = []
    for node in parse(text):
        for m in (node["members"] or []) if node.kind == "Create" else []:
            if m["target"]:
                local = [c.value for c in m["columns"]] if m.kind == "Constraint" else [m.value]
                out.append({"table": node["table"].value, "local": local, "parent_table": m["target"].value, "parent_columns": [c.value for c in m["target_columns"] or []]})
    return out


def identity(text: str, dialect: str = "sqlite") -> str | None:
    """t2sql_ and 16 digits that stand for the schema, or None if the text can't be parsed or defines no table."""
    try:
        found = tables(text)
    except (SqlError, RecursionError):
        return None
    if not found:
        return None
    plain = {"dialect": dialect, "schema": {"indexes": [], "tables": {t: {"cols": [{"name": c["name"], "type": c["type"]} for c in sorted(cols, key=lambda c: str(c["name"]))]} for t, cols in sorted(found.items())}}}
    return "t2sql_" + hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def normal(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)).strip().lower()
