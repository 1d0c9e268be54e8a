"""How far two raters' verdicts agree: confusion, precision, accept or reject, kappa, samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Verdicts that mean a statement is accepted, and those that mean it isn't.
ACCEPTED, REJECTED = ("CORRECT",), ("PARTIALLY_CORRECT", "INCORRECT", "UNANSWERABLE")


def normal(verdict: Column) -> Column:
    """A valid verdict, Mixed for what contains it, Unknown for the rest."""
    v = F.upper(F.trim(verdict))
    return F.when(v.isin(*ACCEPTED, *REJECTED), v).when(verdict.contains("Mixed"), "Mixed").otherwise("Unknown")


def rated(verdicts: DataFrame) -> DataFrame:
    """(id, original, human), once each, of the rows a human has rated."""
    return verdicts.where("human is not null").select("id", normal(F.col("original")).alias("original"), normal(F.col("human")).alias("human")).distinct()


def human_verdict(note: Column) -> Column:
    """The verdict a reviewer wrote into a note: a marked note, HUMAN (..), HUMAN X, then a bare verdict."""
    valid = "(CORRECT|PARTIALLY_CORRECT|INCORRECT|UNANSWERABLE)"
    patterns = [rf"(?i)note[^:]*:\s*\**{valid}\b", rf"HUMAN\s*\(\s*{valid}\s*\)", rf"HUMAN\W+{valid}\b", rf"\b{valid}\b"]
    return F.coalesce(*[F.nullif(F.upper(F.regexp_extract(note, p, 1)), F.lit("")) for p in patterns])


def majority_of(text: Column) -> Column:
    """C4: the verdict of the unique maximum in a text such as "3 CORRECT, 1 INCORRECT", null for a tie or none."""
    counts = F.array(*[F.struct(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"(\d+)\s*(?:x\s*)?(?<![A-Z_]){v}\b", 1), F.lit("")), F.lit("999999")), F.lit(0)).cast("int").alias("n"), F.lit(v).alias("v")) for v in (*ACCEPTED, *REJECTED)])
    top = F.array_max(counts)["n"]
    return F.when((top > 0) & (F.size(F.filter(counts, lambda x: x["n"] == top)) == 1), F.array_max(counts)["v"])


def confusion(pairs: DataFrame) -> DataFrame:
    """(original, human, items), with totals where a side is null."""
    return pairs.rollup("original", "human").agg(F.count(F.lit(1)).alias("items"))


def precision(pairs: DataFrame) -> DataFrame:
    """By original verdict, how often the human agrees."""
    return pairs.groupBy("original").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("original") == F.col("human")).alias("agreed")).withColumn("precision", F.round(F.try_divide(F.col("agreed").cast("double"), F.col("items")), 6))


def binary(pairs: DataFrame) -> DataFrame:
    """Accept or reject, both classes: accuracy, precision, recall and F1; verdicts that are neither don't count."""
    known = [*ACCEPTED, *REJECTED]
    p = pairs.where(F.col("original").isin(known) & F.col("human").isin(known)).select(F.col("original").isin(*ACCEPTED).alias("o"), F.col("human").isin(*ACCEPTED).alias("h"))
    n = p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o") & F.col("h")).alias("aa"), F.count_if(F.col("o") & ~F.col("h")).alias("ar"), F.count_if(~F.col("o") & F.col("h")).alias("ra"), F.count_if(~F.col("o") & ~F.col("h")).alias("rr"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    def row(name: str, hit: str, wrong: str, lost: str) -> Column:
        pr, rc = ratio(F.col(hit), F.col(hit) + F.col(wrong)), ratio(F.col(hit), F.col(hit) + F.col(lost))
        return F.struct(F.lit(name).alias("class"), F.col("n").alias("items"), F.round(ratio(F.col("aa") + F.col("rr"), F.col("n")), 6).alias("accuracy"), F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(ratio(2 * pr * rc, pr + rc), 6).alias("f1"))

    return n.select(F.explode(F.array(row("accept", "aa", "ar", "ra"), row("reject", "rr", "ra", "ar"))).alias("x")).select("x.*")


def kappa(pairs: DataFrame, a: str = "original", b: str = "human") -> DataFrame:
    """Cohen's kappa over all labels; 1 if chance agreement is certain, 0 without items."""
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, "label").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("c"))
    total = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).cast("double").alias("agreed"))
    po, pe = F.col("agreed") / F.col("n"), F.coalesce("c", F.lit(0.0)) / (F.col("n") * F.col("n"))
    value = F.when(F.coalesce("n", F.lit(0.0)) == 0, 0.0).when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))
    return total.crossJoin(chance).select(F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("items"), F.round(value, 6).alias("kappa"))


def disagreement(pairs: DataFrame) -> DataFrame:
    """C11: how often the two differ; Mixed never agrees."""
    return pairs.agg(F.count(F.lit(1)).alias("items"), F.count_if((F.col("original") != F.col("human")) | (F.col("original") == "Mixed")).alias("differing")).withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("differing").cast("double"), F.col("items")), F.lit(0.0)), 6))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int = 50, seed: int = 42) -> DataFrame:
    """N rows of each stratum, chosen by a hash of key and seed: the same on every run and cluster.

    The rows kept per task are cut before the shuffle by the group limit that Catalyst derives from the rank.
    """
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("_r") <= n).drop("_r")


def complement(n: int, ids: DataFrame, column: str = "id") -> DataFrame:
    """The numbers 1 to n that are not among ids."""
    return ids.sparkSession.range(1, n + 1).withColumnRenamed("id", column).join(ids.select(column).distinct(), column, "left_anti")


def with_default(items: DataFrame, reported: DataFrame, key: str = "id", verdict: str = "verdict", default: str = "CORRECT") -> DataFrame:
    """Items with the reported verdict, the default for those that no report names."""
    return items.join(reported.select(key, verdict), key, "left").withColumn(verdict, F.coalesce(verdict, F.lit(default)))


def plain_sql(sql: Column) -> Column:
    """SQL in lower case with single blanks, for comparison."""
    return F.lower(F.trim(F.regexp_replace(sql, r"(?U)\s+", " ")))


def lookup_by_position(df: DataFrame, order: list[str], positions: DataFrame) -> DataFrame:
    """Rows of df by their 1-based position in the given order.

    Only the asked positions' rows travel: blocks of the order are counted first, so no task numbers all rows.
    """
    blocks = df.sparkSession.sparkContext.defaultParallelism * 4
    ranged = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    from querymill.session import write_shared

    ranged = write_shared(ranged, "positions")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_first", "_start")
    numbered = ranged.join(F.broadcast(starts), "_p").withColumn("position", F.col("_start") + F.col("_i") - F.col("_first") + 1)
    return numbered.join(positions.select("position").distinct(), "position").drop("_p", "_i", "_first", "_start")


# reports as a source --------------------------------------------------------------------------------
_NOTE = re.compile(r"(?:NOTE:\s*)?(\d+(?:\s*,\s*\d+)*)\s*-\s*(?:mark as\s+)?(\w+)", re.I)
_ITEM = re.compile(r"### Item: `([^`]+)`(?:\s*\(DB: `([^`]*)`\))?")
_HUMAN = re.compile(r"\*\*HUMAN\*\*\s*\(?([A-Z_]+)")
_VOTER = re.compile(r"\s+-\s+\*\*([\w.-]+)\*\*")
_COUNT = re.compile(r"(\d+)\s*(CORRECT|PARTIALLY_CORRECT|INCORRECT|UNANSWERABLE)\b")
_VALID = (*ACCEPTED, *REJECTED)


class _Block:
    """An item of a report while its lines are read; each way to a verdict ranks before the next."""

    WAYS = ("human", "bare", "majority")

    def __init__(self, item: str, db: str | None, section: str) -> None:
        self.item, self.db, self.section = item, db, section
        self.verdicts: dict[str, str] = {}
        self.details = self.voted = False

    def read(self, line: str) -> None:
        if (m := _HUMAN.search(line)) and m.group(1) in _VALID:
            self.verdicts.setdefault("human", m.group(1))
        if "Voter Details:" in line:
            self.details = True
        elif self.details and not self.voted and (m := _VOTER.match(line)):
            self.voted = True  # a verdict where the first voter's name would be
            if m.group(1) in _VALID:
                self.verdicts["bare"] = m.group(1)
        if "Voter Breakdown:" in line:
            counts = {v: int(n) for n, v in _COUNT.findall(line)}
            most = max(counts.values(), default=0)
            if most and sum(n == most for n in counts.values()) == 1:
                self.verdicts["majority"] = next(v for v, n in counts.items() if n == most)

    def row(self, noted: dict[str, str]) -> tuple:
        if self.item in noted:
            return self.item, self.db, self.section, noted[self.item], "note"
        way = next((w for w in self.WAYS if w in self.verdicts), None)
        return self.item, self.db, self.section, self.verdicts.get(way), way


def report_items(text: str) -> list[tuple]:
    """(item_id, db_id, section, human, way) of the items of a Markdown report, and of ids that only a note names.

    A note such as "595, 680 - mark as correct" decides for its ids; else the verdict marked HUMAN, one in
    the first voter's place, or the unique maximum of the voters. way: which of them it was, null for none.
    """
    noted: dict[str, str] = {}
    blocks: list[_Block] = []
    section = ""
    for line in text.splitlines():
        if line.startswith("## "):
            section = line[3:].strip()
        elif m := _ITEM.match(line):
            blocks.append(_Block(m.group(1), m.group(2), section))
        elif (m := _NOTE.match(line)) and m.group(2).upper() in _VALID:
            noted |= dict.fromkeys(re.findall(r"\d+", m.group(1)), m.group(2).upper())
        elif blocks:
            blocks[-1].read(line)
    known = {b.item for b in blocks}
    return [b.row(noted) for b in blocks] + [(i, None, None, v, "note") for i, v in noted.items() if i not in known]


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """report_items() of Markdown reports, each read whole in one task: they are written for people to read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(name, *row) for name, text in zip(batch["name"], batch["value"]) for row in report_items(text)], columns=["report", "item_id", "db_id", "section", "human", "way"])

    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return texts.mapInPandas(run, "report string, item_id string, db_id string, section string, human string, way string")
