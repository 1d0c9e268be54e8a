"""Votes of language models on items: prompts, replies, counts, consensus, unanimity, status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts in the order in which ties are resolved, with what each is worth.
VERDICTS = {"CORRECT": 1.0, "PARTIALLY_CORRECT": 0.5, "INCORRECT": 0.0, "UNANSWERABLE": 0.0}


def prompt(template: str, dialect: str = "sqlite") -> Column:
    """The template with dialect, schema, question and SQL of a row (columns ddl, question, sql) filled in."""
    out = F.replace(F.lit(template), F.lit("{{dialect}}"), F.lit(dialect))
    for slot, column in (("ddl_schema", "ddl"), ("natural_question", "question"), ("sql_to_revise", "sql")):
        out = F.replace(out, F.lit("{{" + slot + "}}"), F.coalesce(F.col(column), F.lit("")))
    return out


def reply(text: Column) -> Column:
    """struct(verdict, explanation, error) of a model's reply.

    The JSON object between the outermost braces counts, fences around it don't. A missing or unknown
    verdict is INCORRECT, a reply without JSON is FAILED with an error.
    """
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    j = F.from_json(body, "verdict string, explanation string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = (body == "") | j.isNull() | j["_bad"].isNotNull()
    v = F.upper(F.trim(j["verdict"]))
    return F.struct(
        F.when(bad, "FAILED").when(v.isin(*VERDICTS), v).otherwise("INCORRECT").alias("verdict"),
        F.when(~bad, F.when(v.isNotNull() & ~v.isin(*VERDICTS), F.concat(F.lit("unknown verdict "), v)).otherwise(j["explanation"])).alias("explanation"),
        F.when(bad, "reply is no JSON").alias("error"),
    )


def ask(items: DataFrame, voters: DataFrame, call: Callable[[str, str, str], str], template: str, dialect: str = "sqlite") -> DataFrame:
    """Every voter's reply on every item: (item_id, model, provider, weight, verdict, explanation, error).

    voters: (model, provider, weight), a configuration of a few rows, paired with each item. call(provider,
    model, prompt) → reply runs in the tasks; an error it raises is a failed vote, not a failed job.
    """
    few = voters.select("model", "provider", F.coalesce("weight", F.lit(1.0)).alias("weight")).collect()
    pairs = F.array(*[F.struct(F.lit(v["model"]).alias("model"), F.lit(v["provider"]).alias("provider"), F.lit(float(v["weight"])).alias("weight")) for v in few])
    asked = items.select(F.col("id").alias("item_id"), prompt(template, dialect).alias("prompt"), F.explode(pairs).alias("v")).select("item_id", "prompt", "v.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for provider, model, text in zip(batch["provider"], batch["model"], batch["prompt"]):
                try:
                    texts.append(call(provider, model, text))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a provider raises is its vote's error
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"item_id": batch["item_id"], "model": batch["model"], "provider": batch["provider"], "weight": batch["weight"], "text": texts, "failure": errors})

    out = asked.mapInPandas(run, "item_id string, model string, provider string, weight double, text string, failure string")
    r = reply(F.col("text"))
    return out.select("item_id", "model", "provider", "weight", r["verdict"].alias("verdict"), r["explanation"].alias("explanation"), F.coalesce("failure", r["error"]).alias("error"))


def expand_voters(providers: list[dict], known: tuple[str, ...] = ("openai", "anthropic", "gemini", "ollama", "stub")) -> list[dict]:
    """A voter for each model of each provider; weight 1 and temperature 0 unless given, unknown providers left out.

    A model is a name or a dict with a name and settings of its own, which win over its provider's.
    """
    out = []
    for p in providers:
        if str(p.get("name", "")).lower() not in known:
            continue
        for m in p.get("models") or ([p["model"]] if p.get("model") else []):
            own = m if isinstance(m, dict) else {"name": m}
            out.append({"provider": p["name"].lower(), "model": own["name"], "weight": float(own.get("weight", p.get("weight", 1.0))), "temperature": float(own.get("temperature", p.get("temperature", 0.0)))})
    return out


def invalid(providers: int) -> Column:
    """Why an item can't be judged, null if it can: what it lacks of sql, question, dbId, ddl, or a lack of voters."""
    lacks = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return F.coalesce(*[F.when(lacks(c), f"empty {c}") for c in ("sql", "question", "dbId", "ddl")], F.lit("no providers") if not providers else F.lit(None).cast("string"))


def stub(provider: str, model: str, text: str) -> str:
    """A voter that needs no network: a verdict that depends on model and prompt only."""
    import hashlib

    verdict = list(VERDICTS)[hashlib.sha256(f"{provider}\0{model}\0{text}".encode()).digest()[0] % len(VERDICTS)]
    return '{"verdict": "%s", "explanation": "stub"}' % verdict


def normal_verdict(verdict: Column) -> Column:
    """A verdict in the spelling of VERDICTS, whatever its case and separators; others as they are."""
    v = F.regexp_replace(F.upper(F.trim(verdict)), r"[\s-]+", "_")
    return F.when(v.isin(*VERDICTS, "FAILED"), v).otherwise(verdict)


def aggregate(votes: DataFrame) -> DataFrame:
    """One row per item_id from votes (item_id, verdict, weight, error).

    Failed votes have an error or no known verdict. weighted_score: the weighted mean worth of the valid
    votes, 0 without any. consensus_verdict: the most frequent verdict, ties in the order of VERDICTS, if
    more than half of the valid votes have it, else null.
    """
    v = normal_verdict(F.col("verdict"))
    good = F.col("error").isNull() & v.isin(*VERDICTS)
    worth = F.create_map(*[F.lit(x) for k, s in VERDICTS.items() for x in (k, s)])
    names = {k: f"voters_{k.lower()}" for k in VERDICTS}
    w = F.when(good, F.coalesce("weight", F.lit(1.0)))
    out = votes.where("item_id is not null").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("total_voters"), *[F.count_if(F.coalesce(good & (v == k), F.lit(False))).alias(n) for k, n in names.items()], F.count_if(~F.coalesce(good, F.lit(False))).alias("voters_failed"), F.sum(w * worth[v]).alias("_s"), F.sum(w).alias("_w")
    )
    valid = F.col("total_voters") - F.col("voters_failed")
    most = F.greatest(*names.values())
    top = F.coalesce(*[F.when(F.col(n) == most, k) for k, n in names.items()])
    out = out.withColumn("weighted_score", F.round(F.coalesce(F.try_divide("_s", "_w"), F.lit(0.0)), 3)).drop("_s", "_w")
    out = out.withColumn("consensus_reached", (valid > 0) & (most * 2 > valid)).withColumn("consensus_verdict", F.when(F.col("consensus_reached"), top))
    out = out.withColumn("is_unanimous", (valid > 0) & (most == valid))
    kind = F.when(F.col("is_unanimous"), "Unanimous").otherwise("Majority")
    c = F.col("consensus_verdict")
    return out.withColumn("status", F.when(valid == 0, "failed").when(c == "CORRECT", "ok").when(c == "PARTIALLY_CORRECT", "warns").when(c.isNotNull(), "errors").otherwise("warns")).withColumn(
        "err",
        F.when(valid == 0, "All voters failed")
        .when(c == "PARTIALLY_CORRECT", F.concat(kind, F.lit(" PARTIALLY_CORRECT")))
        .when(c.isin("INCORRECT", "UNANSWERABLE"), F.format_string("%s %s (%d/%d)", kind, c, most, valid))
        .when(c.isNull(), F.concat(F.lit("Mixed: "), F.array_join(F.array_compact(F.array(*[F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {k}"))) for k, n in names.items()])), ", "))),
    )


def summary(judged: DataFrame) -> DataFrame:
    """Q12, Q28: items by outcome, with the unanimous ones and the share of all."""
    outcome = F.when(F.col("status") == "failed", "FAILED").when(F.col("consensus_reached"), F.col("consensus_verdict")).otherwise("MIXED")
    n = judged.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("is_unanimous")).alias("unanimous"))
    from pyspark.sql.window import Window

    return n.withColumn("share", F.round(F.col("items") * F.lit(100.0).cast("double") / F.sum("items").over(Window.partitionBy()), 1))


def breakdown(votes: DataFrame) -> DataFrame:
    """Q29: combinations of verdicts on items without consensus: one column a model that voted on one of them.

    The models come from the votes. Items with fewer than two models' verdicts don't count; a model
    without a verdict on an item is null there. A model that voted twice counts with the least verdict.
    """
    v = normal_verdict(F.col("verdict"))
    mixed = aggregate(votes).where("not consensus_reached and status <> 'failed'").select("item_id")
    good = votes.where(F.col("error").isNull() & v.isin(*VERDICTS) & F.col("model").isNotNull()).join(mixed, "item_id", "left_semi")
    models = sorted(r["model"] for r in good.select("model").distinct().collect())
    wide = good.groupBy("item_id").pivot("model", models).agg(F.min(v)) if models else good.select("item_id")
    several = wide.where(sum((F.col(f"`{m}`").isNotNull().cast("int") for m in models), F.lit(0)) >= 2)
    return several.groupBy(*[F.col(f"`{m}`") for m in models]).agg(F.count(F.lit(1)).alias("items")).where("items > 0")


def verdict_texts(votes: DataFrame) -> DataFrame:
    """breakdown() with one column for all models: (verdicts, items), verdicts being "model: VERDICT" of each, by name."""
    wide = breakdown(votes)
    models = [c for c in wide.columns if c != "items"]
    parts = [F.when(F.col(f"`{m}`").isNotNull(), F.concat(F.lit(f"{m}: "), F.col(f"`{m}`"))) for m in models]
    return wide.select(F.array_join(F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>"), ", ").alias("verdicts"), "items")


def failed_items(judged: DataFrame) -> DataFrame:
    """Q35: every item that could not be judged, in numerical order, with why and how many voters failed."""
    kept = [c for c in ("item_id", "db_id", "err", "voters_failed", "total_voters") if c in judged.columns]
    return judged.where("status = 'failed'").select(*kept).orderBy(F.expr("try_cast(item_id as bigint)").asc_nulls_last(), "item_id")


def listing(judged: DataFrame, verdict: str | None, only_divided: bool = False, k: int | None = None) -> DataFrame:
    """Q30 to Q35: items of a consensus (None: mixed), numerically ordered; k for the reports that show the first k."""
    rows = judged.where("consensus_verdict is null and status <> 'failed'") if verdict is None else judged.where(F.col("consensus_verdict") == verdict)
    rows = rows.where("not is_unanimous") if only_divided else rows
    rows = rows.select("item_id", "consensus_verdict", "weighted_score", "total_voters", "voters_failed")
    return rows.orderBy(F.expr("try_cast(item_id as bigint)").asc_nulls_last(), "item_id").limit(k) if k else rows
