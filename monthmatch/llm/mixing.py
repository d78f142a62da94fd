"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells source x language x topic are raked: scaled along one
dimension after the other until every marginal has its target share. A cell's
fitted weight per token, over the largest of all cells, is the probability with
which each of its documents is sampled, so the expected tokens have the target
marginals. How many they are is then set by that one cell; with a budget of
tokens it is not: documents of cells that need more are repeated or, without
repeats, taken whole, and the other cells fill the budget. Everything is
DataFrame operations; only cells are iterated on.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.common import new_folder, saved, text_or_empty, unit_hash

#: Targets of the registered query: a value's share is in proportion to this
#: power of its tokens. Below 1, large values are sampled down; close to 1, so
#: that a few rare cells do not press the probabilities of all others down.
POWERS = {"source": 0.7, "lang": 0.9, "topic": 0.95}
#: Budget of the registered query and the pipeline, as a share of the corpus's own tokens.
BUDGET_SHARE = 0.8
ROUNDS = 20
TOLERANCE = 1e-8


def form_topic(text: Column) -> Column:
    """A topic by the form of a text, for corpora without one of their own."""
    length = F.length(text)
    pipes = length - F.length(F.replace(text, F.lit("|"), F.lit("")))
    lines = length - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(length == 0, "empty")
        .when(pipes * 50 >= length, "table")
        .when(lines * 100 >= length, "list")
        .when(length >= 8000, "book")
        .when(length >= 1500, "article")
        .otherwise("note")
    )


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.octet_length(text) / 4).cast("long"))


def power_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a dimension's values, in proportion to a power of their tokens."""
    return cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    folder: str,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Cells with ``weight``, whose sums along each dimension are in proportion to the targets.

    ``targets`` has a frame (value, ``share``) for each dimension. A value
    without a target, or with a null or negative one, gets no weight. Ends when
    a whole round changes no total by more than ``tolerance``, or after
    ``rounds``; targets that contradict each other stay fitted to the last
    dimension. If totals still change then, a warning tells by how much. Each
    step is written to ``folder`` and read again, so that no plan holds two.
    """
    shares = {}
    for dimension, target in targets.items():
        positive = F.when(F.col("share") > 0, F.col("share").cast("double")).otherwise(0.0)
        total = target.agg(F.sum(positive)).first()[0] or 1.0
        shares[dimension] = saved(
            target.groupBy(dimension).agg((F.sum(positive) / F.lit(total)).alias("__share")),
            folder,
            f"target-{dimension}",
        )
    cells = cells.withColumns({"weight": F.col("tokens").cast("double"), "__off": F.lit(0.0)})
    off = None
    for k in range(rounds):
        cells = cells.withColumn("__off", F.lit(0.0))
        for dimension, share in shares.items():
            factor = (
                cells.groupBy(dimension)
                .agg(F.sum("weight").alias("__sum"))
                .join(share, dimension, "left")
                .select(
                    dimension,
                    # A value without weight and without a target is as it should be.
                    F.when(F.col("__sum") > 0, F.coalesce("__share", F.lit(0.0)) / F.col("__sum"))
                    .when(F.col("__share") > 0, 0.0)
                    .otherwise(1.0)
                    .alias("__factor"),
                )
            )
            cells = cells.join(factor, dimension).withColumns(
                {
                    "weight": F.col("weight") * F.col("__factor"),
                    "__off": F.greatest("__off", F.abs(F.col("__factor") - 1)),
                }
            ).drop("__factor")
            # The next dimension looks at the cells twice, so each is written.
            cells = saved(cells, folder, f"round-{k}-{dimension}")
        off = cells.agg(F.max("__off")).first()[0]
        if off is None or off <= tolerance:
            break
    else:
        if off is not None:
            warnings.warn(f"after {rounds} rounds a total is still off by {off:.3g} of itself", stacklevel=2)
    return cells.drop("__off")


def _scale_to(fitted: DataFrame, budget: float) -> float:
    """The factor of weights that fills a budget when no cell gives more tokens than it has.

    Cells that would have to give more are taken whole, and the others scaled
    to what is left; that takes in more cells, until it does not. The factor
    only grows, and what comes to the driver is two sums a step.
    """
    scale = 0.0
    while True:
        whole = F.col("weight") * F.lit(scale) >= F.col("tokens")
        taken, rest = fitted.agg(
            F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)), F.sum(F.when(~whole, F.col("weight")))
        ).first()
        wider = (budget - taken) / rest if rest else scale
        if wider <= scale * (1 + 1e-12):
            return scale
        scale = wider


def mix_sources(
    docs: DataFrame,
    dimensions: Mapping[str, Column] | None = None,
    targets: Mapping[str, DataFrame] | None = None,
    powers: Mapping[str, float] = POWERS,
    identity: Sequence[str] = ("doc_id",),
    budget: float | None = None,
    budget_share: float | None = None,
    repeats: bool = True,
) -> DataFrame:
    """Append ``topic``, ``tokens``, ``probability`` and ``sampled`` to every document.

    Dimensions are ``source``, ``lang`` and the topic by form unless given as
    expressions; targets follow ``powers`` of the corpus's own tokens unless
    given. Null values of a dimension count as the value ''; null texts as
    empty, with one token. A document is sampled if a number in [0, 1) hashed
    from ``identity`` is below its cell's probability, so that a second run and
    repeated rows decide alike. With a ``budget``, so many tokens are expected in
    all, however rare the rarest cell: ``probability`` is the expected number of
    copies, and ``copies`` its whole part or, with the probability of the rest,
    one more. ``budget_share`` gives the budget as a share of the corpus's own
    tokens. Without ``repeats`` no document is taken twice: cells that have
    fewer tokens than they should give are taken whole, with probability 1, and
    the others, in the proportions that raking found, fill the budget; a budget
    of all tokens or more takes everything that has weight. Columns of these
    names are replaced, all other columns and all rows stay. An empty table
    gives an empty result.
    """
    if budget is not None and budget_share is not None:
        raise ValueError("either a budget or a share of the tokens")
    if any(b is not None and b <= 0 for b in (budget, budget_share)):
        raise ValueError("the budget must be positive")
    spark = docs.sparkSession
    folder = new_folder(spark)
    text = text_or_empty()
    exprs = dimensions or {"source": F.col("source"), "lang": F.col("lang"), "topic": form_topic(text)}
    names = list(exprs)
    keys = {f"__{n}": F.coalesce(e.cast("string"), F.lit("")) for n, e in exprs.items()}
    marked = docs.withColumns({**keys, "__tokens": token_estimate(text)})
    cells = saved(
        marked.groupBy([F.col(f"__{n}").alias(n) for n in names]).agg(F.sum("__tokens").alias("tokens")),
        folder,
        "cells",
    )
    wanted = dict(targets or {})
    for n in names:
        if n not in wanted:
            wanted[n] = power_targets(cells, n, powers.get(n, 1.0))
    fitted = rake(cells, {n: wanted[n] for n in names}, folder)
    ratio = F.col("weight") / F.col("tokens")
    if budget_share is not None:
        budget = (fitted.agg(F.sum("tokens")).first()[0] or 1) * budget_share
    if budget is None:
        chance = ratio / F.lit(fitted.agg(F.max(ratio)).first()[0] or 1.0)
    elif repeats:
        chance = ratio / F.lit((fitted.agg(F.sum("weight")).first()[0] or 1.0) / budget)
    else:
        chance = F.least(F.lit(1.0), ratio * F.lit(_scale_to(fitted, budget)))
    chances = saved(
        fitted.select(*[F.col(n).alias(f"__{n}") for n in names], chance.alias("__chance")),
        folder,
        "chances",
    )
    counted = budget is not None and repeats
    made = ("topic", "tokens", "probability", "sampled") + (("copies",) if counted else ())
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    topic = F.col(f"__{names[-1]}")
    chance, number = F.col("__chance"), unit_hash(*[F.col(c) for c in identity])
    copies = (F.floor(chance) + (number < chance - F.floor(chance)).cast("long")).cast("long")
    return marked.join(chances, [f"__{n}" for n in names]).select(
        *kept,
        topic.alias("topic"),
        F.col("__tokens").alias("tokens"),
        chance.alias("probability"),
        ((copies > 0) if counted else (number < chance)).alias("sampled"),
        *((copies.alias("copies"),) if counted else ()),
    )
