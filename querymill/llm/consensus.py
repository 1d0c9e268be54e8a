"""Consensus verdicts of voters who disagree: a community confusion model fitted by variational updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.session import write_shared

#: The verdicts of a vote.
VERDICTS = ("CORRECT", "PARTIALLY_CORRECT", "INCORRECT", "UNANSWERABLE")
#: Types of voters, votes that a community's matrix counts for in each of its members, most rounds, and
#: the change of any expected confusion below which they end.
COMMUNITIES, STRENGTH, ROUNDS, CLOSE = 4, 12.0, 60, 1e-4
#: Voters whose matrices a task holds, 200 bytes each; more than this many are refused rather than sampled.
MOST_VOTERS = 100_000


def verdict_code(verdict: Column) -> Column:
    """0 to 3 for a verdict of VERDICTS in any letter case, with any blanks or separators; null for others."""
    plain = F.regexp_replace(F.upper(verdict), "[^A-Z]+", "")
    names = F.create_map(*[F.lit(x) for i, v in enumerate(VERDICTS) for x in (v.replace("_", ""), i)])
    return names[F.when(plain != "", plain)]


def usable_votes(voters: DataFrame) -> DataFrame:
    """(item, voter, panel, code): of each model and item the latest vote, by ts, among those with a verdict.

    Rows that occur twice are one vote; of different verdicts at the same ts the last in the order of
    receipt, then of VERDICTS, counts. Votes without item or model are none. panel is false.
    """
    votes = voters.select(F.col("item_id").alias("item"), F.col("model").alias("voter"), verdict_code(F.col("verdict")).alias("code"), "ts", "received_at")
    votes = votes.where("item is not null and voter is not null and code is not null")
    last = votes.groupBy("item", "voter").agg(F.max_by("code", F.struct("ts", "received_at", "code")).alias("code"))
    return last.select("item", "voter", F.lit(False).alias("panel"), "code")


def panel_votes(verdicts: DataFrame) -> DataFrame:
    """(item, voter, panel, code) of the original and human verdicts; "Mixed" and null are no vote, of several the last in the order of VERDICTS.

    panel is true, so that a model that happens to be called human or original is a voter of its own.
    """
    sides = F.array(*[F.struct(F.lit(name).alias("voter"), F.col(name).alias("v")) for name in ("original", "human")])
    long = verdicts.where("id is not null").select(F.col("id").cast("string").alias("item"), F.explode(sides).alias("x"))
    coded = long.select("item", "x.voter", F.lit(True).alias("panel"), verdict_code(F.col("x.v")).alias("code")).where("code is not null")
    return coded.groupBy("item", "voter", "panel").agg(F.max("code").alias("code"))


@dataclass
class Model:
    """Posterior of the community confusion model. logs: (voters, truth, vote) expected log probabilities."""

    voters: list[tuple[bool, str]]
    prior: np.ndarray
    logs: np.ndarray
    confusion: np.ndarray
    types: np.ndarray
    counts: np.ndarray
    rounds: int


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    x = x.copy()
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def _dirichlet_logs(a: np.ndarray) -> np.ndarray:
    return _digamma(a) - _digamma(a.sum(-1, keepdims=True))


def posterior(codes: np.ndarray, owner: np.ndarray, items: int, logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """(items, truth) probabilities, of votes given as code = 4 voter + verdict and the item each is on."""
    score = np.tile(prior, (items, 1))
    np.add.at(score, owner, logs.transpose(0, 2, 1).reshape(-1, len(VERDICTS))[codes])
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def maximise(counts: np.ndarray, prior: np.ndarray, types: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logs, confusion, types) from expected counts (voters, truth, vote): one variational sweep.

    A community's matrix is the Dirichlet posterior of its members' counts; a voter belongs to the
    communities by how well their matrices explain the counts; its own matrix has its communities' as
    a prior worth STRENGTH votes a row, so that few votes lean on the type and many speak for themselves.
    """
    k = len(VERDICTS)
    weak = np.full((k, k), 1.0) + np.eye(k) * 3.0
    if types is None:  # communities start as bands of voters from the most to the least agreeing
        right = np.trace(counts, axis1=1, axis2=2) / np.maximum(counts.sum((1, 2)), 1e-9)
        rank = np.argsort(np.argsort(-right, kind="stable"), kind="stable")
        types = np.full((len(counts), COMMUNITIES), 0.1)
        types[np.arange(len(counts)), rank * COMMUNITIES // max(1, len(counts))] = 1.0
        types /= types.sum(1, keepdims=True)
    for _ in range(3):
        shared = weak + np.einsum("am,akl->mkl", types, counts)
        score = np.einsum("akl,mkl->am", counts, _dirichlet_logs(shared)) + _dirichlet_logs(1.0 + types.sum(0))
        score = np.exp(score - score.max(1, keepdims=True))
        types = score / score.sum(1, keepdims=True)
    mean = shared / shared.sum(-1, keepdims=True)
    own = STRENGTH * np.einsum("am,mkl->akl", types, mean) + counts
    return _dirichlet_logs(own), own / own.sum(-1, keepdims=True), types


def fit(patterns: DataFrame, voters: list[tuple[bool, str]]) -> Model:
    """The model, from patterns (codes, n): how many items have exactly these votes.

    A round is one pass over the patterns; each task returns its expected counts, 16 numbers a voter,
    which are summed before they reach the driver.
    """
    k, spark = len(VERDICTS), patterns.sparkSession
    size = len(voters)

    def expected(logs: np.ndarray | None, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast((logs, prior))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            logs, prior = shared.value
            sums, truth = np.zeros((size * k, k)), np.zeros(k)
            for batch in batches:
                if not len(batch):
                    continue
                lengths = batch["codes"].map(len).to_numpy()
                codes, owner = np.concatenate(batch["codes"].to_list()), np.repeat(np.arange(len(batch)), lengths)
                n = batch["n"].to_numpy(dtype=float)
                if logs is None:  # the first round counts each item's votes as its truth
                    p = np.full((len(batch), k), 0.25)
                    np.add.at(p, (owner, codes % k), 1.0)
                    p /= p.sum(1, keepdims=True)
                else:
                    p = posterior(codes, owner, len(batch), logs, prior)
                p *= n[:, None]
                np.add.at(sums, codes, p[owner])
                truth += p.sum(0)
            used = np.flatnonzero(sums.any(1))
            yield pd.DataFrame({"code": [*used, -1], **{f"p{j}": [*sums[used, j], truth[j]] for j in range(k)}})

        rows = patterns.mapInPandas(run, "code long, " + ", ".join(f"p{j} double" for j in range(k))).groupBy("code").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(k)]).toPandas()
        shared.destroy()
        table = np.zeros((size * k + 1, k))
        table[rows["code"].to_numpy()] = rows[[f"p{j}" for j in range(k)]].to_numpy()
        return table[:-1].reshape(size, k, k).transpose(0, 2, 1), table[-1]

    counts, truth = expected(None, np.zeros(k))
    logs, confusion, types = maximise(counts, truth, None)
    for done in range(1, ROUNDS + 1):
        prior = _dirichlet_logs(1.0 + truth)
        counts, truth = expected(logs, prior)
        before = confusion
        logs, confusion, types = maximise(counts, truth, types)
        if np.abs(confusion - before).max() < CLOSE:
            break
    return Model(voters, _dirichlet_logs(1.0 + truth), logs, confusion, types, counts, done)


def _prepared(voters: DataFrame, verdicts: DataFrame | None) -> tuple[DataFrame, list[tuple[bool, str]]]:
    """(items with their sorted codes, the voters as (panel, name))."""
    votes = usable_votes(voters)
    if verdicts is not None:
        votes = votes.unionByName(panel_votes(verdicts))
    votes = write_shared(votes, "votes")  # read for the names and for the items
    names = sorted((r["panel"], r["voter"]) for r in votes.select("panel", "voter").distinct().limit(MOST_VOTERS + 1).collect())
    if len(names) > MOST_VOTERS:
        raise ValueError(f"more than {MOST_VOTERS} voters")
    numbers = voters.sparkSession.createDataFrame([(p, n, i) for i, (p, n) in enumerate(names)], "panel boolean, voter string, number int")
    coded = votes.join(numbers, ["panel", "voter"]).select("item", (F.col("number") * len(VERDICTS) + F.col("code")).alias("code"), F.col("code").alias("v"), "panel")
    model = ~F.col("panel")
    items = coded.groupBy("item").agg(
        F.sort_array(F.collect_list("code")).alias("codes"),
        F.count_if(model).alias("votes"),
        F.countDistinct(F.when(model, F.col("v"))).alias("different"),
        *[F.count_if(model & (F.col("v") == i)).alias(f"n{i}") for i in range(len(VERDICTS))],
    )
    return write_shared(items, "voted-items"), names


def _fitted(voters: DataFrame, verdicts: DataFrame | None) -> tuple[DataFrame, Model]:
    items, names = _prepared(voters, verdicts)
    if not names:
        k = len(VERDICTS)
        return items, Model([], np.zeros(k), np.zeros((0, k, k)), np.zeros((0, k, k)), np.zeros((0, COMMUNITIES)), np.zeros((0, k, k)), 0)
    # the rounds read the patterns, which are far fewer than the items, and group nothing again
    return items, fit(write_shared(items.groupBy("codes").agg(F.count(F.lit(1)).alias("n")), "vote-patterns"), names)


def consensus(voters: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(item_id, verdict, confidence, agreement, votes, different) of every item with a usable vote of a model.

    verdict: the most probable truth, given the votes and the voters' confusion; ties go to the first of
    VERDICTS. confidence: its probability. agreement: the share of pairs of model votes that agree, 1 for
    a single vote. Items that only the panel judged, null items and votes without verdict give no row;
    empty tables give none; other columns are ignored.
    """
    items, model = _fitted(voters, verdicts)
    shared = voters.sparkSession.sparkContext.broadcast((model.logs, model.prior))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs, prior = shared.value
        for batch in batches:
            if not len(batch):
                continue
            owner = np.repeat(np.arange(len(batch)), batch["codes"].map(len).to_numpy())
            p = posterior(np.concatenate(batch["codes"].to_list()), owner, len(batch), logs, prior)
            n = batch[[f"n{i}" for i in range(len(VERDICTS))]].to_numpy(dtype=float)
            total = n.sum(1)
            agreement = np.where(total > 1, (n * (n - 1)).sum(1) / np.maximum(total * (total - 1), 1), 1.0)
            yield pd.DataFrame({"item_id": batch["item"], "verdict": [VERDICTS[i] for i in p.argmax(1)], "confidence": p.max(1), "agreement": agreement, "votes": batch["votes"], "different": batch["different"]})

    return items.where("votes > 0").mapInPandas(run, "item_id string, verdict string, confidence double, agreement double, votes long, different long")


def disputed(voters: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(item_id, verdict): the consensus of the items whose usable votes are not all equal."""
    return consensus(voters, verdicts).where("different > 1").select("item_id", "verdict")


def reliability(voters: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(voter, panel, labels, reliability, community, membership): how often each voter is expected to be right.

    reliability weighs the diagonal of the voter's confusion matrix by how frequent the truths are among
    all items; it leans on the voter's community where labels are few.
    """
    _, model = _fitted(voters, verdicts)
    truth = np.exp(model.prior)
    rows = []
    for i, (panel, name) in enumerate(model.voters):
        right = float((np.diag(model.confusion[i]) * truth).sum() / truth.sum())
        rows.append((name, panel, int(round(model.counts[i].sum())), right, int(model.types[i].argmax()), float(model.types[i].max())))
    return voters.sparkSession.createDataFrame(rows, "voter string, panel boolean, labels long, reliability double, community int, membership double")
