"""Mixtures in which each source has a target share of the tokens."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querymill.llm import tokens as tk
from querymill.session import write_shared

#: How far a share may be from its target to count as met: documents are whole.
MET = 0.002
#: Blocks that each source's documents are dealt into, so that no task orders a whole source.
BLOCKS = 512


def temperature_weights(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and normalised: 1 keeps them, 0 makes them equal. Shares of 0 stay 0."""
    raised = {k: v**exponent if v > 0 else 0.0 for k, v in shares.items()}
    total = math.fsum(raised.values())
    return {k: v / total if total else 0.0 for k, v in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(holds, low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The least x between low and high for which holds(x), a property that once true stays true; high if none."""
    if holds(low):
        return low
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def exponent_for_entropy(shares: dict[str, float], target: float, most: float = 16.0) -> float:
    """The exponent at which temperature_weights has the target entropy, which falls as the exponent grows."""
    return bisect(lambda x: entropy(temperature_weights(shares, x)) <= target, 0.0, most)


@dataclass
class Plan:
    """Tokens of each source, the exponent they come from, and their sum as it was asked for.

    temperature: the exponent of the token shares that gave the target entropy, null for given targets.
    """

    quota: dict[str, float]
    exponent: float
    budget: float
    temperature: float | None = None


def plan(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int], budget: int | None = None) -> Plan:
    """Quotas by temperature: target shares, drawn towards the sources' own token shares as far as repetition limits force it.

    The weights are w_s ~ t_s (q_s / t_s)^x with targets t and token shares q, repeats included: at
    exponent 0 the targets, at 1 what there is. The exponent is bisected to the least at which no
    source's quota exceeds what its greatest repeats give. Without a budget it is the largest that
    exponent 0 allows: targets are then met to a document. Sources of no tokens, no target or no repeats
    get nothing, and the others share their part in proportion.
    """
    capacity = {s: sizes.get(s, 0) * max(repeats.get(s, 1), 0) for s in targets}
    goal = {s: t for s, t in targets.items() if t and t > 0 and capacity[s] > 0}
    if not goal:
        return Plan({s: 0.0 for s in targets}, 0.0, 0.0)
    goal = temperature_weights(goal, 1.0)
    shares = temperature_weights({s: float(capacity[s]) for s in goal}, 1.0)
    if budget is None:
        budget = min(capacity[s] / t for s, t in goal.items())
    budget = min(budget, sum(capacity[s] for s in goal))

    def weights(x: float) -> dict[str, float]:
        return temperature_weights({s: t * (shares[s] / t) ** x for s, t in goal.items()}, 1.0)

    x = bisect(lambda x: all(w * budget <= capacity[s] * (1 + 1e-9) for s, w in weights(x).items()))
    chosen = weights(x)
    return Plan({s: chosen.get(s, 0.0) * budget for s in targets}, x, float(budget))


def entropy_targets(sizes: dict[str, int], target: float) -> tuple[dict[str, float], float]:
    """(target shares, exponent) by temperature alone: the sources' token shares, raised to the exponent that gives the target entropy."""
    shares = temperature_weights({s: float(n) for s, n in sizes.items()}, 1.0)
    x = exponent_for_entropy(shares, target)
    return temperature_weights(shares, x), x


def _order(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit(seed))


def counted(docs: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, block) of the documents of sources with a target, written once; those without tokens are left out."""
    rows = tk.count(docs.select("doc_id", "source", "text"), ["doc_id", "source"], "text", path).where("tokens > 0 and source is not null")
    wanted = targets.where("source is not null").select("source").distinct()
    return write_shared(rows.join(wanted, "source", "left_semi").withColumn("block", F.pmod(_order(seed + 1), F.lit(BLOCKS)).cast("int")), "mix")


def realise(used: DataFrame, sums: DataFrame, sizes: dict[str, int], quota: dict[str, float], seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, copies) along a permutation of each source: ordered blocks, ordered within."""
    if not any(quota.values()):
        return used.where("false").select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    left = F.create_map(*[F.lit(x) for s, q in sorted(quota.items()) for x in (s, float(q))])[F.col("source")]
    whole = F.create_map(*[F.lit(x) for s, n in sorted(sizes.items()) for x in (s, float(n))])[F.col("source")]
    along = Window.partitionBy("source", "block").orderBy(_order(seed), "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = used.withColumn("within", F.sum("tokens").over(along)).join(starts, ["source", "block"])
    passes = F.floor(left / whole + F.lit(1e-9))
    # a document whose middle lies within the last, partial pass is used once more
    more = (F.col("start") + F.col("within") - F.col("tokens") / 2 <= left - passes * whole).cast("int")
    return placed.select("doc_id", "source", "tokens", (passes.cast("int") + more).alias("copies")).where("copies > 0")


def mixture(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0, path: str | None = None, entropy_of: float | None = None) -> tuple[DataFrame, Plan]:
    """The documents of the mixture with how often each is used, and the plan they follow.

    budget: tokens, or, as a float, so many times all tokens of the sources; by default the most at which
    the targets can be met. entropy_of: instead of the target shares, those by temperature
    that have this entropy. Every source's documents are dealt into BLOCKS blocks by a hash and ordered
    by another hash within them; a source's quota is taken pass by pass along this permutation, in whole
    documents, the last of which has its middle within the quota. No source is put in order in one task:
    blocks are ordered separately and their sums, BLOCKS rows a source, give each block its start.
    Documents without tokens (null or empty) or of a source without target are not used. Repeated
    doc_ids are documents of their own.
    """
    used = counted(docs, targets, path, seed)
    sums = used.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    sizes = dict(sums.groupBy("source").agg(F.sum("n")).collect())
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("t"), F.max(F.coalesce(F.col("max_repeats"), F.lit(1))).alias("m")).collect()
    goal, temperature = {r["source"]: r["t"] for r in rows}, None
    if entropy_of is not None:
        shares, temperature = entropy_targets(sizes, entropy_of)
        goal = dict.fromkeys(goal, 0.0) | shares
    tokens = budget * sum(sizes.values()) if isinstance(budget, float) else budget
    made = replace(plan(sizes, goal, {r["source"]: r["m"] for r in rows}, tokens), temperature=temperature)
    return realise(used, sums, sizes, made.quota, seed), made


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies) of mixture()."""
    return mixture(docs, targets, budget, seed, path)[0]


def report(mixed: DataFrame, targets: DataFrame, made: Plan | None = None) -> DataFrame:
    """(source, target_share, share, tokens, documents, most_copies, met) for every source with a target, met or not.

    met: the share is within MET of the target. With the plan, its exponent, budget and temperature are added.
    """
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    out = goal.join(reached, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0))
    out = out.select("source", "target_share", share.alias("share"), "tokens", "documents", "most_copies").withColumn("met", F.coalesce(F.abs(F.col("share") - F.col("target_share")) < MET, F.lit(False)))
    return out if made is None else out.withColumns({"exponent": F.lit(made.exponent), "budget": F.lit(made.budget), "temperature": F.lit(made.temperature).cast("double")})
