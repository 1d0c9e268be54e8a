"""Duplicates hidden by formatting: dictionary-encoded columns, grouped as compact integer tuples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.records import field_digest, fingerprint, lowered


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(raw, hi, lo) of every distinct value of the columns.

    Each distinct value is canonicalised once, after a distinct whose map-side half already drops
    the repeats of a task. (hi, lo) is the integer identifier of the canonical form, `raw` that of the
    value as written; both are content-derived 128-bit integers, so numbering needs no order, no
    driver and no second pass, and a lost executor computes the same ones again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.frombuffer(b"".join([field_digest(lowered(v)) for v in batch.column("v").to_pylist()]), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("raw"), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["raw", "hi", "lo"])

    values = df.select(F.explode(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns])).alias("v")).distinct()
    return values.select("v", fingerprint(F.col("v")).alias("raw")).mapInArrow(run, "raw struct<hi:long,lo:long>, hi long, lo long")


def encode(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id, key) of each record: key is the sorted tuple of its fields' dictionary codes.

    The records travel as integers only; the dictionary's exchange is reused by the join of each column.
    """
    codes = dictionary(df, columns)
    out = df.select(F.col(id_column).alias("id"), *[fingerprint(F.coalesce(F.col(c), F.lit(""))).alias(f"r{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        out = out.join(codes.select(F.col("raw").alias(f"r{i}"), F.struct("hi", "lo").alias(f"c{i}")), f"r{i}").drop(f"r{i}")
    return out.select("id", F.sort_array(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("key"))


def duplicates(df: DataFrame, id_column: str = "id", columns: tuple[str, ...] = ("question", "query")) -> DataFrame:
    """(keep_id, dup_id): each record but the one of smallest id of its set of equal records, with that id.

    Records are equal if their fields agree, in any order, after canonicalisation. Rows that repeat
    an id with the same content count once; null equals empty; a null id is no record; other columns
    of df are ignored; an empty table gives no rows. A set of any size costs one row per record: the
    minimum is combined before the shuffle, and the join back to the members is split by the adaptive
    skew join where one set is hot.
    """
    members = encode(df.select(id_column, *columns).where(F.col(id_column).isNotNull()), id_column, list(columns)).distinct()
    kept = members.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return members.join(kept, "key").where("id <> keep_id").select("keep_id", F.col("id").alias("dup_id"))


def collapse(df: DataFrame, id_column: str = "id", columns: tuple[str, ...] = ("question", "query")) -> DataFrame:
    """(keep_id, copies): one row per set of equal records with the number of its records."""
    members = encode(df.select(id_column, *columns).where(F.col(id_column).isNotNull()), id_column, list(columns)).distinct()
    return members.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).drop("key")
