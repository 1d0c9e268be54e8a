"""Canonical forms of calibration records, shared by the duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters that survive canonicalisation, after lower-casing; every other one is formatting.
KEPT_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789<>=*+/%"


def fingerprint(value: Column) -> Column:
    """A 128-bit integer (two longs) that stands for a string on every executor, with no numbering pass."""
    return F.struct(F.xxhash64(value).alias("hi"), F.xxhash64(F.lit(1), value).alias("lo"))


_DROPPED = bytes(sorted(set(range(256)) - set(KEPT_BYTES)))


def lowered(value: str | None) -> bytes:
    """A field in lower case as UTF-8; null as empty."""
    return value.lower().encode("utf-8", "surrogatepass") if value else b""


def field_digest(field: bytes) -> bytes:
    """16 bytes that stand for a lowered field's canonical form: every byte but those of KEPT_BYTES is formatting."""
    return xxhash.xxh3_128_digest(field.translate(None, _DROPPED))


def record_digest(fields: list[bytes]) -> bytes:
    """16 bytes that stand for a record: the digests of its lowered fields in sorted order."""
    return xxhash.xxh3_128_digest(b"".join(sorted(field_digest(f) for f in fields)))


def record_hashes(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id, hi, lo): the 128-bit hash of each record, in one narrow pass. Rows without id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [[lowered(v) for v in c.to_pylist()] for c in batch.columns[1:]]
            both = np.frombuffer(b"".join(record_digest(list(f)) for f in zip(*fields)), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "hi", "lo"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), *columns).mapInArrow(run, f"id {kind}, hi long, lo long")
