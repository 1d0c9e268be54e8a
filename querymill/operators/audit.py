"""SQL texts audited once each: structural features and antipatterns by one Arrow pass, scores by native columns."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.session import spread
from querymill.sql import facts, findings

_BOOLEANS = ("is_select", "is_read_only", "uses_wildcard", "has_distinct", "has_group_by", "has_having", "has_where", "has_order_by", "has_limit", "has_offset", "has_recursive_cte", "has_window_frame", "has_like", "has_in", "has_between", "has_case")
_INTEGERS = ("table_count", "column_count", "join_count", "subquery_count", "max_subquery_depth", "aggregate_count", "where_condition_count", "order_by_columns", "cte_count", "window_fn_count", "set_op_count")
_LISTS = ("tables", "join_types", "join_sides", "aggregate_types", "window_fn_types", "set_op_types")

FEATURES = T.StructType(
    [T.StructField("parseable", T.BooleanType()), T.StructField("statement_type", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in _BOOLEANS]
    + [T.StructField(n, T.IntegerType()) for n in _INTEGERS]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in _LISTS]
    + [T.StructField("err", T.StringType())]
)
ANTIPATTERN = T.StructType([T.StructField(n, T.StringType()) for n in ("pattern", "severity", "message", "location")])

#: What a finding of each severity costs, and one of a severity not named here.
PENALTIES = {"critical": 30, "high": 15, "medium": 5, "low": 2}
OTHER_PENALTY = 10
#: Order and name of severities in reports.
SEVERITY_ORDER = {"critical": 1, "high": 2, "medium": 3, "low": 4}
SEVERITY_DISPLAY = {"critical": "🔴 Critical", "high": "⚠️ High", "medium": "🔵 Medium", "low": "🟢 Low"}
#: Statements a worker remembers the audit of.
REMEMBERED = 50_000

_EMPTY = {"parseable": False, "statement_type": None, **dict.fromkeys(_BOOLEANS, False), **dict.fromkeys(_INTEGERS, 0), **{n: [] for n in _LISTS}}


def collect_features(sql: str | None) -> dict[str, object]:
    """The features of one statement, with difficulty_level and complexity_score; a plain Python function."""
    statement, err = facts.read(sql)
    out = {**_EMPTY, "err": err} if statement is None else {"parseable": True, **facts.features(statement), "err": None}
    return {**out, "difficulty_level": difficulty_of(out), "complexity_score": complexity_of(out)}


def detect_antipatterns(sql: str | None, severities: dict[str, list[str]] | None = None, penalties: dict[str, int] | None = None) -> dict[str, object]:
    """The antipatterns of one statement with its quality; a plain Python function."""
    statement, err = facts.read(sql)
    if statement is None:
        return {"parseable": False, "antipatterns": [], "quality_score": 0, "quality_level": "poor", "err": err}
    found = findings.antipatterns(statement, severities)
    cost = PENALTIES | (penalties or {})
    score = max(0, min(100, 100 - sum(cost.get(f[1], OTHER_PENALTY) for f in found)))
    return {"parseable": True, "antipatterns": [dict(zip(ANTIPATTERN.names, f)) for f in found], "quality_score": score, "quality_level": "excellent" if score >= 90 else "good" if score >= 70 else "fair" if score >= 50 else "poor", "err": None}


class _Columns:
    """Features as columns, for rules over rows."""

    number = staticmethod(lambda name: F.coalesce(F.col(name), F.lit(0)))
    holds = staticmethod(lambda name: F.col(name))
    one = staticmethod(lambda condition: condition.cast("int"))
    capped = staticmethod(lambda value, most: F.least(value, F.lit(most)))


class _Values:
    """Features of one statement in Python, for the same rules."""

    def __init__(self, features: dict) -> None:
        self.features = features

    def number(self, name: str) -> int:
        return self.features[name] or 0

    def holds(self, name: str) -> bool:
        return bool(self.features[name])

    one, capped = staticmethod(int), staticmethod(min)


#: Where the complexity of a level begins.
BASES = {"easy": 10, "medium": 40, "hard": 70, "expert": 90, "unknown": 0}


def _levels(x) -> list[tuple[str, object]]:
    """(level, condition) in the order in which they are asked; what meets none is easy. x: _Columns or _Values."""
    n, has, one = x.number, x.holds, x.one
    advanced = one(n("cte_count") > 0) + one(n("window_fn_count") > 0) + one(n("subquery_count") >= 2)
    traits = one(has("has_where")) + one(has("has_order_by")) + one(has("has_distinct")) + one(has("has_case")) + one(has("has_like") | has("has_in") | has("has_between"))
    return [
        ("expert", has("has_recursive_cte") | (n("max_subquery_depth") >= 2) | ((n("subquery_count") >= 3) & (n("cte_count") >= 1)) | (n("set_op_count") >= 3) | (advanced >= 2)),
        ("hard", (n("subquery_count") > 0) | (n("cte_count") > 0) | (n("window_fn_count") > 0) | (n("set_op_count") >= 2) | (n("table_count") >= 4) | (n("join_count") >= 3) | has("has_having")),
        ("medium", (n("table_count") >= 2) | (n("join_count") >= 1) | has("has_group_by") | (n("aggregate_count") > 0) | (n("where_condition_count") >= 3) | (n("set_op_count") == 1) | (traits >= 3)),
    ]


def _refinement(x):
    """What is added to a level's base, before it is capped at 9."""
    counted = {"join_count": 3, "subquery_count": 2, "window_fn_count": 2, "cte_count": 2, "aggregate_count": 2}
    parts = [x.capped(x.number(c), most) for c, most in counted.items()]
    parts += [x.one(x.holds("has_having")), x.one(x.number("max_subquery_depth") >= 2) * 2, x.one(x.holds("has_window_frame")), x.one(x.holds("has_recursive_cte")) * 2]
    return sum(parts[1:], parts[0])


def difficulty_of(f: dict) -> str:
    """difficulty() of one statement's features, for callers without Spark."""
    return "unknown" if not f["parseable"] else next((level for level, holds in _levels(_Values(f)) if holds), "easy")


def complexity_of(f: dict) -> int:
    level = difficulty_of(f)
    return 0 if level == "unknown" else BASES[level] + min(9, _refinement(_Values(f)))


def difficulty() -> Column:
    """easy, medium, hard, expert or unknown, from the feature columns; the first rule that holds."""
    out = F.when(~F.col("parseable"), "unknown")
    for level, holds in _levels(_Columns):
        out = out.when(holds, level)
    return out.otherwise("easy")


def complexity() -> Column:
    """0 to 99 from difficulty_level and the features: a base by level and at most 9 for what is in the statement."""
    base = F.coalesce(*[F.when(F.col("difficulty_level") == level, n) for level, n in BASES.items()])
    return F.when(F.col("difficulty_level") == "unknown", 0).otherwise(base + F.least(_refinement(_Columns), F.lit(9)))


def quality(antipatterns: Column, parseable: Column, penalties: dict[str, int] | None = None) -> Column:
    """100 less the findings' penalties, within 0 and 100; 0 if the statement can't be parsed."""
    cost = F.create_map(*[F.lit(x) for k, v in (PENALTIES | (penalties or {})).items() for x in (k, v)])
    lost = F.aggregate(antipatterns, F.lit(0), lambda a, x: a + F.coalesce(F.element_at(cost, x["severity"]), F.lit(OTHER_PENALTY)))
    return F.when(parseable, F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost))).otherwise(0)


def quality_level(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[kind.simpleString()]


def audit(items: DataFrame, sql: str = "sql", severities: dict[str, list[str]] | None = None, penalties: dict[str, int] | None = None) -> DataFrame:
    """items with the feature columns, difficulty_level, complexity_score, antipatterns, quality_score, quality_level and collect_ms.

    Each statement is parsed once; its features and its antipatterns come from the same tree. The pass is
    narrow and remembers statements it has met; scores are native columns on what it returns. Null, blank
    and unparseable statements have parseable = false, an err, no antipatterns and quality 0. Columns of
    items keep their values; one that is called like an audit column is replaced.
    """
    added = [f.name for f in FEATURES.fields] + ["antipatterns", "difficulty_level", "complexity_score", "quality_score", "quality_level", "collect_ms"]
    kept = items.select(*[F.col(f"`{c}`") for c in items.columns if c not in added])
    schema = T.StructType([*kept.schema.fields, T.StructField("_audit", T.StructType([*FEATURES.fields, T.StructField("antipatterns", T.ArrayType(ANTIPATTERN)), T.StructField("collect_ms", T.DoubleType())]))])
    arrow = _arrow(schema["_audit"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=REMEMBERED)
        def one(text: str | None) -> dict[str, object]:
            began = time.perf_counter()
            statement, err = facts.read(text)
            if statement is None:
                row = {**_EMPTY, "err": err, "antipatterns": []}
            else:
                row = {"parseable": True, **facts.features(statement), "err": None, "antipatterns": [dict(zip(ANTIPATTERN.names, f)) for f in findings.antipatterns(statement, severities)]}
            return {**row, "collect_ms": (time.perf_counter() - began) * 1000}

        for batch in batches:
            rows = [one(t) for t in batch.column(sql).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, type=arrow)], names=[*batch.schema.names, "_audit"])

    out = spread(kept).mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in kept.columns], "_audit.*")
    out = out.withColumn("difficulty_level", difficulty()).withColumn("complexity_score", complexity())
    out = out.withColumn("quality_score", quality(F.col("antipatterns"), F.col("parseable"), penalties))
    flags = {f"has_{name}": F.exists("antipatterns", lambda x: x["pattern"].isin("unsafe_delete", "unsafe_update") if name == "unsafe_update_delete" else x["pattern"] == name) for name in findings.SWITCHES}  # noqa: B023
    return out.withColumn("quality_level", quality_level(F.col("quality_score"))).withColumn("total_antipatterns", F.size("antipatterns")).withColumns(flags)


def register(spark) -> None:
    """sql_features(text) and sql_antipatterns(text) as functions of Spark SQL, Arrow-batched."""
    from pyspark.sql.functions import pandas_udf

    fields = T.StructType([*FEATURES.fields, T.StructField("difficulty_level", T.StringType()), T.StructField("complexity_score", T.IntegerType())])
    import pandas as pd

    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([collect_features(t) for t in texts], columns=fields.names)

    def patterns(texts: pd.Series) -> pd.Series:
        return pd.Series([[a for a in detect_antipatterns(t)["antipatterns"]] for t in texts])

    features.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    patterns.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    spark.udf.register("sql_features", pandas_udf(features, fields))
    spark.udf.register("sql_antipatterns", pandas_udf(patterns, T.ArrayType(ANTIPATTERN)))


def status(skipped: Column | None = None) -> dict[str, Column]:
    """syntax_status and antipattern_status of audited rows: skipped, failed, warns or ok."""
    skip = F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False)
    return {
        "syntax_status": F.when(skip, "skipped").when(F.col("parseable"), "ok").otherwise("failed"),
        "antipattern_status": F.when(skip, "skipped").when(~F.col("parseable"), "failed").when(F.size("antipatterns") > 0, "warns").otherwise("ok"),
    }
