"""All queries of the core. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators import drift
from querymill.plans import corpus_queries, table_queries  # noqa: F401
from querymill.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from querymill.session import table


_NAMES = ", ".join(f"('{role}', '{n}')" for role, (names, *_) in drift.ROLES.items() for n in names.split() + (["Question"] if role == "question" else []))
_CHANGES = f"""WITH names(role, name) AS (VALUES {_NAMES}), o AS (SELECT feed, file_no, line_no, line FROM dataitem_lines WHERE json_valid(line) AND json_type(CAST(line AS JSON)) = 'OBJECT'),
v AS (SELECT feed, file_no, line_no, role, name, json_type(line, '$."' || name || '"') AS kind FROM o, names), last AS (SELECT feed, file_no, role, arg_max({{'name': name, 'kind': CASE kind WHEN 'UBIGINT' THEN 'BIGINT' ELSE kind END}}, line_no) AS x FROM v WHERE kind IS NOT NULL AND kind <> 'NULL' GROUP BY 1, 2, 3),
files AS (SELECT *, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS prev FROM (SELECT feed, file_no, max(file_name) AS file_name FROM dataitem_lines GROUP BY 1, 2)), f AS (SELECT * FROM files WHERE prev IS NOT NULL),
n AS (SELECT f.feed, f.file_no, f.file_name, role, x FROM f JOIN last USING (feed, file_no)), p AS (SELECT f.feed, f.file_no, f.file_name, role, x FROM f JOIN last ON last.feed = f.feed AND last.file_no = f.prev),
b AS (SELECT coalesce(n.file_name, p.file_name) AS file_name, n.x AS new, p.x AS old FROM n FULL JOIN p ON n.feed = p.feed AND n.file_no = p.file_no AND n.role = p.role)
SELECT file_name, 'added' AS change, new.name AS field_name FROM b WHERE old IS NULL UNION ALL SELECT file_name, 'removed', old.name FROM b WHERE new IS NULL
UNION ALL SELECT file_name, 'renamed', new.name FROM b WHERE new.name <> old.name UNION ALL SELECT file_name, 'retyped', new.name FROM b WHERE new.kind <> old.kind"""


@query("p3_found", _CHANGES)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "dataitem_lines"))


def _first(role: str) -> str:
    """The JSON text of a role's value in a line, whatever its file calls it; null where it has none."""
    names = drift.ROLES[role][0].split() + (["Question"] if role == "question" else [])
    return "coalesce(" + ", ".join(f"nullif(CAST(json_extract(line, '$.\"{n}\"') AS VARCHAR), 'null')" for n in names) + ")"


def _text(j: str, joiner: str = " ") -> str:
    parts = ", ".join(f"json_extract_string({j}, '$.{k}')" for k in ("text", "sql", "query", "name", "db_id", "value"))
    return f"CASE json_type(CAST({j} AS JSON)) WHEN 'VARCHAR' THEN json_extract_string({j}, '$') WHEN 'ARRAY' THEN array_to_string(CAST(from_json(CAST({j} AS JSON), '[\"VARCHAR\"]') AS VARCHAR[]), '{joiner}') WHEN 'OBJECT' THEN coalesce({parts}) ELSE {j} END"


_PLAIN = {r: _text(f"j_{r}") for r in ("id", "question", "sql", "db", "difficulty", "rows", "checked", "weight", "created")}
_ITEMS = f"""WITH l AS (SELECT DISTINCT feed, file_no, CAST(line_no AS BIGINT) AS line_no, line FROM dataitem_lines WHERE json_valid(line)), o AS (SELECT * FROM l WHERE json_type(CAST(line AS JSON)) = 'OBJECT'),
j AS (SELECT feed, file_no, line_no, {", ".join(f"{_first(r)} AS j_{r}" for r in drift.ROLES)} FROM o), t AS (SELECT *, {", ".join(f"{sql} AS t_{r}" for r, sql in _PLAIN.items())} FROM j)
SELECT feed, file_no, line_no, t_id AS id, t_question AS question, t_sql AS sql, t_db AS "dbId", CASE WHEN json_type(CAST(j_schema AS JSON)) = 'VARCHAR' THEN json_extract_string(j_schema, '$') ELSE j_schema END AS schema, {_text("j_evidence", "; ")} AS evidence,
coalesce(CASE TRY_CAST(t_difficulty AS INTEGER) WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' WHEN 3 THEN 'hard' WHEN 4 THEN 'expert' END, t_difficulty) AS difficulty, TRY_CAST(t_rows AS BIGINT) AS gold_rows,
CASE WHEN lower(trim(t_checked)) IN ('true', 'yes', 'y', 't', '1') THEN true WHEN lower(trim(t_checked)) IN ('false', 'no', 'n', 'f', '0') THEN false END AS checked, TRY_CAST(t_weight AS DOUBLE) AS weight,
CASE WHEN j_tags IS NULL THEN NULL WHEN json_type(CAST(j_tags AS JSON)) = 'ARRAY' THEN CAST(from_json(CAST(j_tags AS JSON), '["VARCHAR"]') AS VARCHAR[]) ELSE list_filter(regexp_split_to_array(trim(json_extract_string(j_tags, '$')), '\\s*[,;|]\\s*'), lambda x: x <> '') END AS tags,
CASE WHEN json_type(CAST(j_metadata AS JSON)) = 'VARCHAR' THEN json_extract_string(j_metadata, '$') ELSE j_metadata END AS metadata,
CAST(CASE WHEN TRY_CAST(t_created AS BIGINT) IS NOT NULL THEN to_timestamp(CAST(t_created AS BIGINT)) ELSE CAST(t_created AS TIMESTAMPTZ) END AS TIMESTAMP) AS created FROM t"""


@query("p3_items", _ITEMS)
def p3_items(spark: SparkSession, d: str) -> DataFrame:
    items = drift.consistent(table(spark, d, "dataitem_lines"))
    return items.withColumn("created", F.col("created").cast("timestamp_ntz"))
