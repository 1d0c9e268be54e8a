"""Where results go: metric tables, annotated items, exports, Markdown."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_directory(base: str, dataset: str, now: float | None = None) -> str:
    """K5: <base>/<dataset>_<unix time>."""
    return f"{base.rstrip('/')}/{dataset}_{int(time.time() if now is None else now)}"


def envelope(df: DataFrame, name: str, event_type: str, dataset: str, status: str = "status") -> DataFrame:
    """A metric row's frame around df's columns: version, time, dataset, kind, name, success."""
    return df.select(F.lit("1.0").alias("spec_version"), F.current_timestamp().alias("ts"), F.lit(dataset).alias("dataset_id"), F.lit(event_type).alias("event_type"), F.lit(name).alias("name"), (F.col(status) == "ok").alias("success"), "*")


def write_metrics(df: DataFrame, base: str, name: str, mode: str = "append") -> str:
    """K3: the Parquet table metrics_<name>, partitioned by dataset."""
    path = f"{base}/metrics_{name}"
    df.write.mode(mode).partitionBy("dataset_id").parquet(path)
    return path


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K1, K2: a JSON object a row, nulls included, in as many files as df has partitions."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def write_all(df: DataFrame, *writers) -> None:
    """K4: df computed once, given to every writer; the first error stops them."""
    kept = df.persist()
    try:
        for writer in writers:
            writer(kept)
    finally:
        kept.unpersist()


def export(df: DataFrame, path: str, kind: str = "csv") -> str:
    """K7: one file with a header, for samples and other small results."""
    w = df.coalesce(1).write.mode("overwrite")
    (w.option("header", True).csv if kind == "csv" else w.json)(path)
    return path


def metric_tables(spark, base: str) -> list[str]:
    """Q1: names of the metric tables below base."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName()[len("metrics_") :] for s in fs.listStatus(hadoop) if s.isDirectory() and s.getPath().getName().startswith("metrics_")) if fs.exists(hadoop) else []


def markdown_table(df: DataFrame, most: int | None = 1000) -> str:
    """A report table; more than `most` rows end in an ellipsis, None writes them whole."""
    rows = list(df.toLocalIterator()) if most is None else df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + (["| … |"] if most is not None and len(rows) > most else []))


def write_text(spark, path: str, text: str) -> str:
    """A small text on whatever file system the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def write_markdown(path: str, title: str, sections: dict[str, DataFrame | str]) -> str:
    """K6: a report of titled tables, written whole, or texts."""
    parts = [f"# {title}", ""]
    for name, body in sections.items():
        parts += [f"## {name}", "", body if isinstance(body, str) else markdown_table(body, None), ""]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(parts))
    return path
