"""Mixing to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic); the cells' weights are scaled in
turn to each dimension's target shares until all agree, and every document is kept with
its cell's probability by a hash of its id, so the sample is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.runtime import materialize

DIMS = ("source", "lang", "topic")
#: Default targets are the margins of the cells' tokens to this power, which lifts what is rare.
TEMPER = 0.7
#: Share of all tokens that the sample is to hold.
BUDGET = 0.5
TOLERANCE, MOST_SWEEPS = 1e-6, 100
_COLLECTED_CELLS = 20_000
_SPREAD = 64
_SEED = 20240601


def topic_of(text: F.Column) -> F.Column:
    """A topic from the text's make-up, by shares of its characters; documents carry none of their own."""
    size = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(F.regexp_count(text, F.lit("[|\\t;]")) * 50 > size, "table")
        .when(F.regexp_count(text, F.lit("[#*$%&<>{}=_]")) * 50 > size, "markup")
        .when(F.regexp_count(text, F.lit("[0-9]")) * 50 > size, "figures")
        .when(size < 600, "note")
        .otherwise("prose")
    )


def _tokens(text: F.Column) -> F.Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _dimensioned(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, tokens; a null dimension is a value of its own, the empty string."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), topic_of(text).alias("topic"), _tokens(text).alias("tokens"))


def default_targets(cells: DataFrame, dim: str) -> DataFrame:
    """value, target: tempered tokens by ``dim``, unscaled. All dimensions' targets come from one table, so they never contradict each other."""
    return cells.groupBy(F.col(dim).alias("value")).agg(F.sum(F.pow("tokens", F.lit(TEMPER))).alias("target"))


def _given(spark: SparkSession, shares: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(shares.items()), "value string, target double")


def rake_rows(cells: list[tuple], targets: list[dict[str, float]], tolerance: float = TOLERANCE, most: int = MOST_SWEEPS) -> tuple[list[float], float]:
    """Weights of cells (a value for each dimension, then tokens), and the largest error left of any share. Targets sum to one each."""
    total = sum(c[-1] for c in cells)
    weights, error = [c[-1] / total for c in cells], 1.0
    for _ in range(most):
        for d, target in enumerate(targets):
            sums: dict[str, float] = {}
            for c, w in zip(cells, weights, strict=True):
                sums[c[d]] = sums.get(c[d], 0.0) + w
            weights = [w * target.get(c[d], 0.0) / sums[c[d]] if sums[c[d]] > 0 else 0.0 for c, w in zip(cells, weights, strict=True)]
        error = 0.0
        for d, target in enumerate(targets):
            sums = dict.fromkeys(target, 0.0)
            for c, w in zip(cells, weights, strict=True):
                sums[c[d]] = sums.get(c[d], 0.0) + w
            error = max([error, *(abs(s - target.get(v, 0.0)) for v, s in sums.items())])
        if error <= tolerance:
            break
    return weights, error


def rake_frame(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, most: int = MOST_SWEEPS) -> tuple[DataFrame, float]:
    """As ``rake_rows``, for more cells than a driver should hold: a sweep is a join and a sum for each dimension, then a written table.

    Sums are combined before they are shuffled, so a value with most of the cells fills no task, and Spark broadcasts them only where they turn out small.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    now, worst = cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), 1.0
    for _ in range(most):
        for dim, target in targets.items():
            sums = now.groupBy(dim).agg(F.sum("weight").alias("_sum"))
            scale = sums.join(target.withColumnRenamed("value", dim), dim, "left").select(dim, F.when(F.col("_sum") > 0, F.coalesce("target", F.lit(0.0)) / F.col("_sum")).otherwise(0.0).alias("_scale"))
            now = now.join(scale, dim).withColumn("weight", F.col("weight") * F.col("_scale")).drop("_scale")
        now = materialize(now)
        off = [now.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("s")).join(t, "value", "left").select(F.abs(F.col("s") - F.coalesce("target", F.lit(0.0))).alias("e")) for d, t in targets.items()]
        worst = 0.0
        for e in off:
            worst = max(worst, e.agg(F.max("e")).first()[0] or 0.0)
        if worst <= tolerance:
            break
    return now, worst


def _scaled(targets: DataFrame) -> DataFrame:
    total = targets.agg(F.sum("target")).first()[0]
    return targets.select("value", (F.col("target") / F.lit(float(total or 1.0))).alias("target"))


def _budget_scale(cells: DataFrame, budget: float) -> float:
    """The factor by which weight per token share becomes a probability, so that those capped at one make up the budget with the rest."""
    factor = budget
    total = float(cells.agg(F.sum("tokens")).first()[0])
    share = F.col("tokens") / F.lit(total)
    reachable = cells.filter(F.col("weight") > 0).agg(F.sum(share)).first()[0] or 0.0
    aim = min(budget, reachable)
    for _ in range(60):
        full = F.col("weight") * factor >= share
        capped, free = cells.agg(F.sum(F.when(full, share).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        new = (aim - capped) / free
        if new <= factor * (1 + 1e-12):
            break
        factor = new
    return factor


def weigh_cells(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """source, lang, topic, tokens, weight, probability for each cell with tokens, and the largest error that raking left of any share."""
    spark = cells.sparkSession
    goals = {d: _scaled(_given(spark, targets[d]) if targets and d in targets else default_targets(cells, d)) for d in DIMS}
    if cells.limit(_COLLECTED_CELLS + 1).count() <= _COLLECTED_CELLS:
        rows = sorted(tuple(r) for r in cells.select(*DIMS, "tokens").collect())
        if not rows:
            return cells.withColumns({"weight": F.lit(0.0), "probability": F.lit(0.0), "raking_error": F.lit(0.0)})
        weights, error = rake_rows(rows, [{r[0]: r[1] for r in g.collect()} for g in goals.values()])
        total = sum(r[-1] for r in rows)
        shares = [r[-1] / total for r in rows]
        factor = fit_budget(weights, shares, budget)
        rated = [(*r, w, min(1.0, factor * w / s), error) for r, w, s in zip(rows, weights, shares, strict=True)]
        return spark.createDataFrame(rated, "source string, lang string, topic string, tokens long, weight double, probability double, raking_error double")
    now, error = rake_frame(cells, {d: materialize(g) for d, g in goals.items()})
    total = float(now.agg(F.sum("tokens")).first()[0])
    scale = F.lit(_budget_scale(now, budget)) * F.lit(total)
    return now.withColumns({"probability": F.least(F.lit(1.0), scale * F.col("weight") / F.col("tokens")), "raking_error": F.lit(float(error))})


def fit_budget(weights: list[float], shares: list[float], budget: float) -> float:
    """The factor f for which the sum of min(share, f x weight) is the budget, or all that has weight."""
    aim = min(budget, sum(s for w, s in zip(weights, shares, strict=True) if w > 0))
    left, weight = aim, sum(weights)
    for ratio, w, s in sorted((s / w, w, s) for w, s in zip(weights, shares, strict=True) if w > 0):
        if weight <= 0 or left / weight <= ratio:
            break
        left, weight = left - s, weight - w
    return left / weight if weight > 1e-15 else float("inf")


def _rated(docs: DataFrame, targets: dict | None, budget: float) -> tuple[DataFrame, DataFrame, bool]:
    """Measured documents, rated cells, and whether these are few enough to be broadcast."""
    measured = _dimensioned(docs)
    cells = materialize(measured.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).filter(F.col("tokens") > 0))
    rated = materialize(weigh_cells(cells, targets, budget))
    return measured, rated, rated.limit(_COLLECTED_CELLS + 1).count() <= _COLLECTED_CELLS


def _with_cells(left: DataFrame, rated: DataFrame, few: bool) -> DataFrame:
    if few:
        return left.join(F.broadcast(rated), [*DIMS], "left")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD)))
    copies = rated.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SPREAD - 1).cast("long"))))
    return salted.join(copies, [*DIMS, "_salt"], "left").drop("_salt")


def _drawn() -> F.Column:
    """Uniform in [0, 1) by document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(_SEED), F.col("doc_id")), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, raking_error, kept for each row of ``docs``.

    ``targets`` gives shares by value for any of source, lang and topic (values without
    one get none); other dimensions get the margins of the tempered cells. Where given
    targets contradict each other, the last sweep stands, and raking_error tells by how
    much a share is missed at most. A document without words has
    no tokens, no say, and stays with its cell's probability, or the budget where its
    cell has no tokens at all. Nulls are a value of their own, written as the empty
    string. Rows that repeat an id are drawn alike. An empty table gives an empty result.
    """
    measured, rated, few = _rated(docs, targets, budget)
    both = _with_cells(measured, rated.withColumnRenamed("tokens", "cell_tokens"), few)
    probability = F.coalesce("probability", F.lit(float(budget)))
    return both.select("doc_id", *DIMS, "tokens", (F.col("weight") * F.col("tokens") / F.col("cell_tokens")).alias("weight"), probability.alias("probability"), F.coalesce("raking_error", F.lit(0.0)).alias("raking_error"), (_drawn() < probability).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with their columns as they were. No text is moved while the cells are few.

    Nulls and texts without words are treated as in ``mix``; rows that repeat an id stay or
    go together; an empty table gives an empty result.
    """
    _, rated, few = _rated(docs, targets, budget)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), topic_of(text).alias("topic")
    )
    both = _with_cells(packed, rated.select(*DIMS, "probability"), few)
    return both.filter(_drawn() < F.coalesce("probability", F.lit(float(budget)))).select("_row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its weight and whether it is sampled; nulls, repeats and empty tables as in ``mix``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
