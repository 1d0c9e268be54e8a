"""A corpus from its files to metric tables, annotated items and reports, by a YAML config."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from querymill import sinks
from querymill.operators import audit as audits
from querymill.operators import execution, judge, normalize, schema
from querymill.operators import providers as provider_calls
from querymill.plans import reports
from querymill.registry import get, register
from querymill.sources import config as settings
from querymill.session import release, write_shared, written
from querymill.sources import files

register("loader", "jsonl")(files.read_jsonl)
register("loader", "json")(files.read_json)
register("loader", "csv")(files.read_csv)
register("loader", "parquet")(files.read_table)


@register("loader", "hf")
def _exported(spark: SparkSession, data_files: str | list | dict | None = None, columns: list[str] | None = None, name: str | None = None, config_name: str | None = None, split: str | None = None, **_: object) -> DataFrame:
    """L4: datasets of a hub, exported as Parquet; the engine itself never goes to a network.

    data_files: paths, or paths by split; else `name` is the folder of an export, in which config_name is
    a subfolder and each split's files begin with its name.
    """
    if isinstance(data_files, dict):
        chosen = data_files[split] if split else [p for paths in data_files.values() for p in (paths if isinstance(paths, list) else [paths])]
    else:
        chosen = data_files or "/".join(x for x in (name, config_name, f"{split}*.parquet" if split else "*.parquet") if x)
    return files.read_table(spark, chosen, columns)


@register("normalizer", "alias_mapper")
def _aliases(df: DataFrame, mapping: dict[str, str], **_: object) -> DataFrame:
    return normalize.alias_mapper(df, mapping)


@register("normalizer", "id_assign")
def _ids(df: DataFrame, mode: str = "incremental", hash_len: int = 16, start: int = 1, **_: object) -> DataFrame:
    return normalize.hash_ids(df, hash_len) if mode == "hash" else normalize.incremental_ids(df, ["dbId", "question", "sql"], start)


#: Report → the switch that turns it on has the same name, that of the summary also `summary_report`.
REPORTS = ("summary", "schema_validation", "llm_judge_issues", "query_execution_issues", "query_structure_profile", "table_coverage", "query_quality")
ANALYZERS = ("schema_validation_analyzer", "query_syntax_analyzer", "query_antipattern_analyzer", "query_execution_analyzer", "semantic_llm_analyzer")


# stages: items → metric rows and what each item comes to; `row` numbers the items, ids need not be unique ---
def numbered(items: DataFrame) -> DataFrame:
    """items with their database as db_id and a number for each row, kept, so that stages can be joined by it."""
    return write_shared(items.withColumn("row", F.monotonically_increasing_id()), "items")


def gate(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that no earlier step failed, the others)."""
    failed = F.coalesce(normalize.failed_before(), F.lit(False))
    return items.where(~failed), items.where(failed)


def advance(items: DataFrame, outcome: DataFrame, *names: str) -> DataFrame:
    """Items with a step for each name, its status in outcome (row, name…); skipped where outcome has none."""
    joined = items.join(outcome.select("row", *[F.col(n).alias(f"_{n}") for n in names]), "row", "left")
    for n in names:
        passed = F.col(f"_{n}").isNull() | (F.col(f"_{n}") == "skipped")
        joined = joined.withColumn("steps", F.array_append("steps", normalize.step(n, F.coalesce(f"_{n}", F.lit("skipped")), F.when(passed, "previous analyzer failed"))))
    return joined.drop(*[f"_{n}" for n in names])


def _skipped(items: DataFrame) -> DataFrame:
    return items.select("row", "id", F.col("dbId").alias("db_id"), F.lit("skipped").alias("status"), F.lit(normalize.SKIPPED).alias("err"))


@register("analyzer", "query_syntax_analyzer")
@register("analyzer", "query_antipattern_analyzer")
def audit_stage(items: DataFrame, antipatterns: dict | None = None, penalties: dict | None = None, dialect: str = "sqlite", syntax: bool = True, patterns: bool = True, **_: object) -> DataFrame:
    """Metric rows of both audits, from one parse. A statement that the first fails is skipped by the second."""
    ready, rest = gate(items)
    done = audits.audit(ready.select("row", "id", F.col("dbId").alias("db_id"), "sql"), "sql", settings.severities(antipatterns, dialect), penalties)
    status = audits.status()
    second = F.when(~F.col("parseable"), "skipped").otherwise(status["antipattern_status"]) if syntax else status["antipattern_status"]
    done = done.withColumn("syntax_status", status["syntax_status"]).withColumn("antipattern_status", second if patterns else F.lit(None).cast("string"))
    done = done.withColumn("status", F.col("syntax_status" if syntax else "antipattern_status"))
    skips = {c: F.lit("skipped") for c, on in (("syntax_status", syntax), ("antipattern_status", patterns)) if on}
    return done.unionByName(_skipped(rest).withColumn("parseable", F.lit(False)).withColumns(skips), allowMissingColumns=True)


@register("analyzer", "query_execution_analyzer")
def execution_stage(items: DataFrame, root: str | None = None, databases: DataFrame | None = None, mode: str = "select_only", safety_limit: int = 1, timeout: float = 30.0, strict_compat: bool = False, **_: object) -> DataFrame:
    """Metric rows of the statements tried on their databases."""
    ready, rest = gate(items)
    tried = execution.probe(ready.select(F.col("row").alias("id"), F.col("dbId").alias("db_id"), "sql"), databases, root, mode, safety_limit, timeout, strict_compat)
    done = tried.withColumnRenamed("id", "row").join(ready.select("row", "id"), "row")
    return done.unionByName(_skipped(rest), allowMissingColumns=True)


@register("analyzer", "semantic_llm_analyzer")
def judge_stage(items: DataFrame, voters: list[dict] | None = None, providers: list[dict] | None = None, call=None, template: str = "", ddl: DataFrame | None = None, **_: object) -> DataFrame:
    """Metric rows of the voters' verdicts. Items that lack what a prompt needs fail without being asked.

    Voters are given or expanded from providers; without `call` their providers are asked over HTTP, and a
    voter of no known provider is refused. ddl: (row, ddl); without it the items' own schema is shown.
    """
    every = voters or judge.expand_voters(providers or [])
    every = [v | {"provider": str(v["provider"]).lower()} for v in every] if call is None else every
    ask = call or provider_calls.caller(providers or [], every)
    ready, rest = gate(items)
    shown = ready.join(ddl, "row", "left") if ddl is not None else ready.withColumn("ddl", F.col("schema"))
    checked = shown.withColumn("_why", judge.invalid(len(every)))
    table = items.sparkSession.createDataFrame([(v["model"], v["provider"], float(v.get("weight", 1.0))) for v in every], "model string, provider string, weight double")
    asked = checked.where("_why is null").withColumn("_id", F.col("id")).withColumn("id", F.col("row").cast("string"))
    done = judge.aggregate(judge.ask(asked, table, ask, template)).withColumn("row", F.col("item_id").cast("long")).drop("item_id")
    known = ready.select("row", F.col("id").alias("item_id"), F.col("dbId").alias("db_id"))
    cannot = checked.where("_why is not null").select("row", F.lit("failed").alias("status"), F.col("_why").alias("err"))
    rows = done.unionByName(cannot, allowMissingColumns=True).join(known, "row")
    return rows.unionByName(_skipped(rest).withColumnRenamed("id", "item_id"), allowMissingColumns=True)


def shown_ddl(items: DataFrame, catalog: files.Catalog, mode: str = "query_derived") -> DataFrame:
    """(row, ddl) for prompts: the tables the statement names, or all of its database; all where it names none."""
    if mode not in ("query_derived", "full"):
        raise ValueError("schema_mode must be query_derived or full")
    texts = schema.ddl(catalog.columns, catalog.fks)
    whole = texts.groupBy("db_id").agg(F.array_join(F.array_sort(F.collect_list("ddl")), "\n\n").alias("whole"))
    base = items.select("row", F.col("dbId").alias("db_id"), "sql").join(whole, "db_id", "left")
    if mode == "full":
        return base.select("row", F.col("whole").alias("ddl"))
    named = audits.audit(items.select("row", F.col("dbId").alias("db_id"), "sql")).select("row", "db_id", F.explode("tables").alias("table"))
    derived = named.join(texts, ["db_id", "table"]).groupBy("row").agg(F.array_join(F.array_sort(F.collect_list("ddl")), "\n\n").alias("derived"))
    return base.join(derived, "row", "left").select("row", F.coalesce("derived", "whole").alias("ddl"))


def checked_config(config: dict) -> dict:
    """Config, or ValueError for what can't work."""
    if not isinstance(config.get("load"), dict) or not config["load"].get("name"):
        raise ValueError("the config needs load.name")
    for kind in ("normalize", "analyze"):
        for step in config.get(kind) or []:
            if not isinstance(step, dict) or not step.get("name"):
                raise ValueError(f"a step of {kind} has no name")
    for step in config.get("analyze") or []:
        get("analyzer", step["name"]) if step["name"] != "schema_validation_analyzer" else None
    return config


class Run:
    """One run: its directory, what it has written, and the counts that tell how far it is."""

    def __init__(self, out: str, dataset: str, tell=None, lines: bool = False) -> None:
        self.out, self.dataset, self.tell, self.lines, self.counts = out, dataset, tell or (lambda _: None), lines, {}

    def write(self, df: DataFrame, name: str, event: str) -> DataFrame:
        """A metric table, as JSON lines too if output.sinks names jsonl; how many rows, and how many of each status, is observed while it is written."""
        seen = Observation(name)
        kept = df.drop("name", "ts", "success", "event_type", "dataset_id", "spec_version")
        counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warns", "errors", "failed", "skipped")]
        sinks.write_metrics(sinks.envelope(kept, name, event, self.dataset).observe(seen, F.count(F.lit(1)).alias("rows"), *counts), self.out, name)
        self.counts[name] = dict(seen.get)
        self.tell(f"{name}: {self.counts[name]}")
        written = df.sparkSession.read.parquet(f"{self.out}/metrics_{name}")
        if self.lines:
            sinks.write_jsonl(written, f"{self.out}/{name}_metrics")
        return written


def run(spark: SparkSession, config: dict, base: str = "runs", tell=None) -> str:
    """Runs a config and returns the directory of its results.

    Each analyzer adds its step to the items it saw; items that a step failed come back from the later
    ones as skipped. Statements are parsed once for both audits. Every metric table is written once and
    read back for the steps; the annotated items are written at the end, with a file of the counts.
    """
    config, mark = checked_config(config), written(spark)
    try:
        return _run(spark, config, base, tell)
    finally:
        release(spark, mark)  # all results are tables of their own by now


def _run(spark: SparkSession, config: dict, base: str, tell) -> str:
    source, load = config.get("sourceDb") or {}, config["load"]
    params = dict(load.get("params") or {})
    dataset = config.get("dataset_id") or Path(str(params.get("path") or params.get("data_files") or load["name"])).stem
    out = sinks.run_directory((config.get("output") or {}).get("base_dir", base), dataset)
    dialect, root = source.get("dialect", "sqlite"), source.get("endpoint")
    this = Run(out, dataset, tell, "jsonl" in ((config.get("output") or {}).get("sinks") or []))
    df = get("loader", load["name"])(spark, **params)
    identify = False
    if not any(step["name"] == "alias_mapper" for step in config.get("normalize") or []):
        df = normalize.alias_mapper(df, {})  # columns that are called by the standard names
    for step in config.get("normalize") or []:
        if step["name"] == "db_identity_assign":
            identify = True
        else:
            df = get("normalizer", step["name"])(df, **(step.get("params") or {}))
    items = numbered(df)
    catalog = None
    if root and dialect == "sqlite":
        catalog = files.sqlite_catalog(spark, root, items.select(F.col("dbId").alias("db_id")))
        if identify:
            items, catalog = identified(spark, items, catalog, root, dialect)
        catalog = files.Catalog(*[write_shared(t, "catalog") for t in catalog])
        this.write(catalog.tables.withColumn("status", F.lit("ok")), "schema_tables", "schema_analysis")
    steps = [(s["name"], dict(s.get("params") or {})) for s in config.get("analyze") or []]
    steps = [(n, p) for n, p in steps if p.pop("enabled", True)]
    names = [n for n, _ in steps]
    audited = False
    for name, options in steps:
        if name == "schema_validation_analyzer" and catalog:
            items = validated(this, items, catalog, dialect)
        elif name in ("query_syntax_analyzer", "query_antipattern_analyzer") and not audited:
            audited = True
            both = {"syntax": "query_syntax_analyzer" in names, "patterns": "query_antipattern_analyzer" in names}
            merged = {k: v for n, p in steps if n in ("query_syntax_analyzer", "query_antipattern_analyzer") for k, v in p.items()}
            done = this.write(audit_stage(items, dialect=dialect, **merged, **both), "query_audit", "query_analysis")
            kept = [(n, c) for n, c, on in (("query_syntax", "syntax_status", both["syntax"]), ("query_antipattern", "antipattern_status", both["patterns"])) if on]
            items = advance(items, done.select("row", *[F.col(c).alias(n) for n, c in kept]), *[n for n, _ in kept])
        elif name == "query_execution_analyzer" and root:
            done = this.write(execution_stage(items, root=root, **options), "query_execution", "query_execution")
            items = advance(items, done.select("row", F.col("status").alias("query_execution")), "query_execution")
        elif name == "semantic_llm_analyzer" and (options.get("voters") or options.get("providers")):
            template = options.pop("prompt_template", None) or files.prompt_template(options["prompt_file"], options.get("prompt_variant", "default"))
            ddl = shown_ddl(gate(items)[0], catalog, options.get("schema_mode", "query_derived")) if catalog else None
            done = this.write(judge_stage(items, template=template, ddl=ddl, **options), "semantic_llm_judge", "semantic_validation")
            items = advance(items, done.select("row", F.col("status").alias("semantic_llm")), "semantic_llm")
    sinks.write_jsonl(items.drop("row").withColumnRenamed("steps", "analysisSteps"), f"{out}/annotatedOutputDataset")
    sinks.write_text(spark, f"{out}/run_info.json", json.dumps({"dataset_id": dataset, "counts": this.counts}))
    wanted = config.get("reports") or {}
    if wanted.get("enabled", True) and config.get("auto_generate_report", True):
        write_reports(spark, out, f"{out}/{wanted.get('output_dir', 'all_reports')}", [r for r in REPORTS if wanted.get(r, wanted.get("summary_report", True) if r == "summary" else True)])
    return out


def identified(spark: SparkSession, items: DataFrame, catalog: files.Catalog, root: str, dialect: str) -> tuple[DataFrame, files.Catalog]:
    """Items with a usable database. Databases that only a schema tells are built from it below root."""
    done = write_shared(normalize.database_identity(items, catalog.health.select("db_id", "health"), dialect), "identified")
    last = F.element_at("steps", -1)
    wanted = done.where(last["reason"].isin("rebuilt", "derived")).select(F.col("dbId").alias("db_id"), "schema")
    built = write_shared(files.build_databases(wanted, root), "built")
    bad = built.where("health <> 'ok'").select(F.col("db_id").alias("dbId"), F.col("err").alias("_why"))
    steps = F.concat(F.slice("steps", F.lit(1), F.size("steps") - 1), F.array(normalize.step("db_identity", F.lit("failed"), F.col("_why"))))
    done = done.join(bad, "dbId", "left").withColumn("steps", F.when(F.col("_why").isNotNull(), steps).otherwise(F.col("steps"))).drop("_why")
    return done, files.sqlite_catalog(spark, root, done.select(F.col("dbId").alias("db_id")))


def validated(this: Run, items: DataFrame, catalog: files.Catalog, dialect: str) -> DataFrame:
    """A metric row for each database that items not failed before name, skipped ones for the others; items with their step."""
    ready, rest = gate(items)
    named = ready.select(F.col("dbId").alias("db_id")).where("db_id is not null").distinct()
    known = named.join(catalog.health, "db_id", "left").select("db_id", F.coalesce(F.col("health") == "ok", F.lit(False)).alias("healthy"), "err", "fk_enforcement")
    violations = catalog.health.select("db_id", F.col("violations").alias("n"))
    rows = schema.validate(known, catalog.tables, catalog.columns, catalog.fks, violations, dialect)
    done = this.write(rows.unionByName(schema.skipped(rest.select(F.col("dbId").alias("db_id"))), allowMissingColumns=True), "schema_validation", "schema_analysis")
    status = done.where("status <> 'skipped'").select(F.col("db_id").alias("dbId"), F.col("status").alias("schema_validation"))
    return advance(items, ready.join(status, "dbId", "left").select("row", F.coalesce("schema_validation", F.lit("failed")).alias("schema_validation")), "schema_validation")


def write_reports(spark: SparkSession, metrics: str, to: str, which: list[str] | tuple[str, ...] = REPORTS) -> list[str]:
    """Markdown reports from the metric tables below `metrics`; a table that isn't there gives a line that says so."""
    have = set(sinks.metric_tables(spark, metrics))
    table = {n: spark.read.parquet(f"{metrics}/metrics_{n}") for n in have}
    m, sch, run_, jud = (table.get(n) for n in ("query_audit", "schema_validation", "query_execution", "semantic_llm_judge"))
    missing = "No metrics available."
    catalog = table.get("schema_tables")
    written = []
    for name in which:
        if name == "summary":
            parts = {"Corpus": (reports.dataset_overview, m), "Structure": (reports.health_summary, m), "Difficulty": (reports.difficulty_share, m), "Quality": (reports.quality_summary, m), "Schemas": (schema.schema_totals, sch), "Execution": (execution.totals, run_), "Verdicts": (judge.summary, jud)}
            body = {title: f(df) if df is not None else missing for title, (f, df) in parts.items()}
            steps = [t for t in (_steps("query_syntax", m, "syntax_status", "collect_ms"), _steps("query_antipattern", m, "antipattern_status", "collect_ms"), _steps("schema_validation", sch), _steps("query_execution", run_, "status", "duration_ms"), _steps("semantic_llm_judge", jud)) if t is not None]
            if steps:
                every = reduce(DataFrame.unionByName, steps).where("status is not null")
                body |= {"Analyzers": reports.analyzer_success(every).orderBy("name"), "Performance": reports.performance(every).orderBy("name")}
        elif name == "schema_validation":
            own = sch.where("status <> 'skipped'") if sch is not None else None
            body = {"Totals": schema.schema_totals(own), "Top issue": schema.top_issue(own), **{f"Databases: {s}": schema.listing(own, s).orderBy("db_id") for s in schema.STATUS_ORDER}, "Findings": schema.findings(own).orderBy("db_id", "level", "kind", "message")} if own is not None else {"Schemas": missing}
        elif name == "llm_judge_issues":
            body = {"Summary": judge.summary(jud.where("status <> 'skipped'")), **{v or "Mixed": judge.listing(jud, v, v == "CORRECT", 50 if v == "PARTIALLY_CORRECT" else None).orderBy(F.expr("try_cast(item_id as bigint)").asc_nulls_last(), "item_id") for v in (*judge.VERDICTS, None)}, "Failed": judge.failed_items(jud)} if jud is not None else {"Verdicts": missing}
        elif name == "query_execution_issues":
            body = {"Totals": execution.totals(run_), "Error patterns": execution.error_patterns(run_), "Failures": execution.failures(run_)} if run_ is not None else {"Execution": missing}
        elif name == "query_structure_profile":
            shown = (reports.join_histogram, reports.join_type_usage, reports.subquery_summary, reports.subquery_depth, reports.cte_stats, reports.aggregate_usage, reports.aggregation_patterns, reports.difficulty_share, reports.difficulty_density, reports.feature_combinations, reports.health_summary, reports.balance)
            body = {f.__name__.replace("_", " ").capitalize(): f(m) for f in shown} if m is not None else {"Structure": missing}
        elif name == "table_coverage":
            body = {"Used tables": reports.used_tables(m).orderBy("db_id", "table")} if m is not None else {"Coverage": missing}
            if m is not None and catalog is not None:
                body |= {"Summary": reports.coverage_summary(m, catalog), "Databases": reports.coverage_by_db(m, catalog)}
        else:
            shown = (reports.quality_summary, reports.quality_levels, reports.antipattern_by_severity, reports.antipattern_top, reports.antipattern_items, reports.unparseable, reports.unparseable_items, reports.worst_items)
            body = {f.__name__.replace("_", " ").capitalize(): reports.displayed(f(m)) if f in (reports.antipattern_top, reports.antipattern_items) else f(m) for f in shown} if m is not None else {"Quality": missing}
        written.append(sinks.write_markdown(f"{to}/{name}_report.md", name.replace("_", " ").capitalize(), body))
    return written


def _steps(name: str, df: DataFrame | None, status: str = "status", duration: str | None = None) -> DataFrame | None:
    """(name, status, duration_ms) of a metric table."""
    if df is None or status not in df.columns:
        return None
    return df.select(F.lit(name).alias("name"), F.col(status).alias("status"), (F.col(duration) if duration and duration in df.columns else F.lit(None)).cast("double").alias("duration_ms"))
