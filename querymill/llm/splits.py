"""Splits that keep related records together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.llm.components import components
from querymill.operators.databases import database_key, spellings
from querymill.session import cut

#: Components that hold at least this share of the records are placed one by one, largest first;
#: there can't be more than 1 / LARGE of them.
LARGE = 0.001
#: Rounds in which the weights of the rendezvous are corrected, and the error at which they stop.
ROUNDS, CLOSE = 12, 2e-4
#: Rounds without a gain after which the correction ends.
PATIENCE = 2


def roots(catalog: DataFrame, id_column: str = "db_id", parent_column: str = "derived_from") -> DataFrame:
    """(db_id, root): the member of each catalog row's component that is derived from no other.

    Components come from Hash-to-Min over the derivations. The root is the smallest registered member
    without a parent that is itself registered; in a cycle it is the smallest member.
    """
    rows = catalog.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("db_id"), F.col(parent_column).alias("parent"))
    found = components(rows.select("db_id", F.coalesce("parent", "db_id").alias("parent")), "db_id", "parent")
    heads = rows.join(found, rows.db_id == found.node).groupBy("component").agg(F.coalesce(F.min(F.when(F.col("parent").isNull() | (F.col("parent") == F.col("db_id")), F.col("db_id"))), F.min("db_id")).alias("root"))
    return rows.select("db_id").distinct().join(found, F.col("db_id") == F.col("node")).join(heads, "component").select("db_id", "root")


def resolve(records: DataFrame, catalog: DataFrame, id_column: str = "id", source: str = "db_id") -> DataFrame:
    """(id, written, root) of each record; root is null where its source stands for no registered database.

    A source equal to a registered name is that database; otherwise it is the one with the same
    database_key, provided only one has it. Rows that repeat an id count once, with the least source.
    """
    recs = records.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(source).alias("written")).groupBy("id").agg(F.min("written").alias("written"))
    return recs.join(spellings(recs, roots(catalog)).select("written", "root"), "written", "left").select("id", "written", "root")


def misnamed(records: DataFrame, catalog: DataFrame, id_column: str = "id", source: str = "db_id") -> DataFrame:
    """(id, db_id): records whose source is not written as the root of its group, with that root."""
    return resolve(records, catalog, id_column, source).where("root is not null and written <> root").select("id", F.col("root").alias("db_id"))


def rendezvous(component: Column, weights: dict[str, float], seed: int = 0) -> Column:
    """The split of highest weighted rendezvous score -w / ln(h), h being a hash of component and split."""
    scored = []
    for name, weight in sorted(weights.items()):
        h = (F.shiftrightunsigned(F.xxhash64(component, F.lit(name), F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
        scored.append(F.struct((F.lit(-float(weight)) / F.log(h)).alias("score"), F.lit(name).alias("name")))
    return F.greatest(*scored)["name"] if len(scored) > 1 else F.lit(next(iter(weights)))


def place_large(sizes: list[tuple[str, int]], targets: dict[str, float]) -> dict[str, str]:
    """Each large component, the largest first, goes to the split that lacks most; ties by name."""
    lack = dict(targets)
    out = {}
    for component, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = max(sorted(lack), key=lambda s: lack[s])
        out[component] = best
        lack[best] -= n
    return out


def assign(groups: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(component, split) for groups (component, n): shares by records as near to the targets as whole groups allow.

    Components of at least LARGE of all records are at most 1 / LARGE and are placed largest first.
    The rest is assigned by weighted rendezvous hashing to what the splits still lack; the weights are
    corrected by the shares they give, which needs one small aggregate a round. Shares are scaled to
    sum to 1; splits of share 0 get nothing. No groups, no rows.
    """
    shares = {k: v for k, v in shares.items() if v and v > 0}
    if not shares:
        raise ValueError("no split has a positive share")
    total = groups.agg(F.sum("n")).first()[0] or 0
    targets = {k: v / math.fsum(shares.values()) * total for k, v in shares.items()}
    large = [(r[0], r[1]) for r in groups.where(F.col("n") >= max(1.0, total * LARGE)).select("component", "n").collect()]
    placed = place_large(large, targets)
    lack = {k: max(v - sum(n for c, n in large if placed[c] == k), 0.0) for k, v in targets.items()}
    spark = groups.sparkSession
    table = spark.createDataFrame(list(placed.items()), T.StructType([T.StructField("component", T.StringType()), T.StructField("split", T.StringType())]))
    rest = groups.join(table, "component", "left_anti")
    want = {k: v for k, v in lack.items() if v > 0}
    if not want:
        want = targets
    weights = dict(want)
    best, error, worse = dict(weights), None, 0
    for _ in range(ROUNDS if len(want) > 1 and total else 0):
        got = dict(rest.groupBy(rendezvous(F.col("component"), weights, seed).alias("split")).agg(F.sum("n")).collect())
        off = max(abs(got.get(k, 0) - want[k]) for k in want) / total
        if error is None or off < error:
            best, error, worse = dict(weights), off, 0
        else:
            worse += 1
        if error <= CLOSE or worse == PATIENCE:
            break
        weights = {k: weights[k] * min(4.0, max(0.25, want[k] / max(got.get(k, 0), 1))) for k in weights}
    return rest.select("component", rendezvous(F.col("component"), best, seed).alias("split")).unionByName(table)


def split(records: DataFrame, catalog: DataFrame, shares: dict[str, float], id_column: str = "id", source: str = "db_id", seed: int = 0) -> DataFrame:
    """(id, split): every record gets a split; records of one database group never differ in it.

    A group is a catalog root with all databases derived from it. Records of an unregistered source
    form a group by their source's database_key, records without a source one group each. Rows that
    repeat an id count once; a null id is no record; an empty table gives no rows.
    """
    found = resolve(records, catalog, id_column, source)
    keyed = found.select("id", F.coalesce(F.concat(F.lit("db:"), "root"), F.concat(F.lit("name:"), F.coalesce(database_key(F.col("written")), F.when(F.col("written").isNotNull() & (F.trim("written") != ""), F.col("written")))), F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("component"))
    splits = assign(cut(keyed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))), shares, seed)
    return keyed.join(splits, "component").select("id", "split")
