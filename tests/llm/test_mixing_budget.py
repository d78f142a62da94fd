"""Mixing to a budget of tokens, and what raking tells of targets that it did not reach."""

from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from monthmatch.llm.mixing import mix_sources, rake

POWERS = {"source": 0.7, "lang": 1.0, "topic": 1.0}


def test_a_rare_cell_does_not_set_what_is_kept_of_the_others(spark):
    hot = spark.range(20_000).selectExpr(
        "id AS doc_id", "repeat('some text of a size ', 20) AS text", "'hot' AS source", "'en' AS lang"
    )
    rare = spark.createDataFrame([(20_000, "a short text", None, "en")], "doc_id long, text string, source string, lang string")
    docs = hot.unionByName(rare)
    total = mix_sources(docs).agg(F.sum("tokens")).first()[0]
    few = mix_sources(docs, powers=POWERS).filter("sampled").count()
    assert few < 2000
    got = mix_sources(docs, powers=POWERS, budget=total).cache()
    assert got.count() == 20_001
    tokens = {r.source: r.t for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("t")).collect()}
    assert sum(tokens.values()) == pytest.approx(total, rel=0.02)
    own = {r.source: r.t for r in got.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    share = own[None] ** 0.7 / (own[None] ** 0.7 + own["hot"] ** 0.7)
    one = got.filter("source IS NULL").first()
    assert one.probability * one.tokens == pytest.approx(share * total)
    assert one.copies in (int(one.probability), int(one.probability) + 1) and one.copies > 1
    assert got.filter("copies < 0 OR sampled <> (copies > 0)").count() == 0
    assert mix_sources(docs.limit(0), budget=100.0).count() == 0


def test_without_repeats_rare_cells_are_whole_and_the_others_fill_the_budget(spark):
    sizes = {"hot": 6000, "warm": 1500, "rare": 200, None: 3}
    docs = spark.createDataFrame(
        [(k, "some text of a size " * 20, s, "en") for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))],
        "doc_id long, text string, source string, lang string",
    )
    got = mix_sources(docs, powers=POWERS, budget_share=0.7, repeats=False).cache()
    assert got.count() == sum(sizes.values()) and "copies" not in got.columns
    chance = {r.source: r.p for r in got.groupBy("source").agg(F.max("probability").alias("p")).collect()}
    # By bisection: the scale at which what cells give, at most all they have, is the budget.
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(n, mid * n**0.7) for n in sizes.values()) < 0.7 * sum(sizes.values()) else (low, mid)
    for source, n in sizes.items():
        assert chance[source] == pytest.approx(min(1.0, low * n**-0.3))
    assert chance[None] == 1 and chance["rare"] == 1 and chance["hot"] < chance["warm"]
    kept = got.filter("sampled").agg(F.sum("tokens")).first()[0]
    assert kept == pytest.approx(0.7 * got.agg(F.sum("tokens")).first()[0], rel=0.03)
    assert got.filter("probability = 1 AND NOT sampled").count() == 0


def test_budgets_at_the_borders(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "'a text' AS text", "if(id < 40, 'a', 'b') AS source", "'en' AS lang")
    assert mix_sources(docs, budget_share=1.0, repeats=False).filter("sampled").count() == 50
    assert mix_sources(docs, budget=1e9, repeats=False).filter("probability = 1").count() == 50
    assert mix_sources(docs.limit(0), budget_share=0.5, repeats=False).count() == 0
    none = spark.createDataFrame([("a", 0.0)], "source string, share double")
    assert mix_sources(docs, targets={"source": none}, budget_share=0.5, repeats=False).filter("sampled").count() == 0
    for wrong in ({"budget": 0.0}, {"budget_share": -1.0}, {"budget": 5.0, "budget_share": 0.5}):
        with pytest.raises(ValueError):
            mix_sources(docs, **wrong)


def test_targets_out_of_reach_are_told(spark, tmp_path):
    cells = spark.createDataFrame([("a", "x", 100), ("b", "y", 50), ("c", "y", 7)], "s string, l string, tokens long")
    shares = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "s string, share double")
    against = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "l string, share double")
    with pytest.warns(UserWarning, match="still off"):
        rake(cells, {"s": shares, "l": against}, f"{tmp_path}/a", rounds=3)
    agreed = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "l string, share double")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = rake(cells, {"s": shares, "l": agreed}, f"{tmp_path}/b", rounds=3)
    assert {r.s: round(r.weight, 9) for r in got.collect()} == {"a": 0.25, "b": 0.75, "c": 0.0}
