"""Records of evaluation splits that occur again in the training split, alike or almost alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.neardup import similar_pairs
from querymill.llm.records import record_hashes
from querymill.operators.databases import resolved


def same_pairs(train: DataFrame, held_out: DataFrame, id_column: str = "id", columns: tuple[str, ...] = ("question", "query")) -> DataFrame:
    """(train_id, eval_id) of records whose fields agree, in either order, once canonicalised."""
    a, b = (record_hashes(df, id_column, list(columns)).distinct() for df in (train, held_out))
    return a.withColumnRenamed("id", "train_id").join(b.withColumnRenamed("id", "eval_id"), ["hi", "lo"]).select("train_id", "eval_id")


def overlaps(train: DataFrame, held_out: DataFrame, id_column: str = "id", columns: tuple[str, ...] = ("question", "query"), threshold: float = 0.75) -> DataFrame:
    """(id_a, id_b), smaller first: pairs of a training and an evaluation record that are the same or similar.

    Same: equal hashes of the canonicalised fields. Similar: as in neardup.similar_pairs. Ids are
    unique over both tables; rows that repeat an id count once; null ids are no records, null fields
    are empty, other columns are ignored and empty tables give no pairs.
    """
    same = same_pairs(train, held_out, id_column, columns).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))
    return same.unionByName(similar_pairs(train, held_out, id_column, columns, threshold))


def report(pairs: DataFrame, train: DataFrame, splits: dict[str, DataFrame], catalog: DataFrame, id_column: str = "id", source: str = "db_id") -> DataFrame:
    """(split, eval_db, train_db, pairs, records): overlaps per evaluation split and the databases of both records.

    The databases are the registered ones that the records' spellings stand for, null where they stand
    for none. A record delivered several times has one source: the least. records: evaluation records.
    """

    def sourced(df: DataFrame, name: str, *more) -> DataFrame:
        rows = df.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id"), *more).agg(F.min(source).alias("db"))
        return resolved(rows.withColumnRenamed("db", "db_id"), catalog).withColumnRenamed("db_id", name)

    held_out = reduce(DataFrame.unionByName, [df.withColumn("_split", F.lit(name)).select(id_column, source, "_split") for name, df in splits.items()])
    evals = sourced(held_out, "eval_db", F.col("_split").alias("split"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("id_a").alias("eval_id"), F.col("id_b").alias("train_id")), F.struct(F.col("id_b").alias("eval_id"), F.col("id_a").alias("train_id")))).alias("x")).select("x.*")
    both = sides.join(evals.withColumnRenamed("id", "eval_id"), "eval_id").join(sourced(train, "train_db").withColumnRenamed("id", "train_id"), "train_id")
    return both.groupBy("split", "eval_db", "train_db").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("records"))
