"""Stored rows against recomputed ones, twins, and checks that must fail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hooks:
    """Column expressions that recompute a row from its scene; ``supported`` marks what they can judge."""

    decision: Column
    margin: Column
    quarantined: Column
    answer: Column
    candidates: Column
    supported: Column


def exact_rerender_check(rows: DataFrame, keys: list[str], hooks: Hooks, tolerance: float = 1e-9) -> DataFrame:
    """First difference between the stored and the recomputed row; a null on one side only is one."""
    different = (
        F.when(~F.coalesce(hooks.supported, F.lit(False)), "unsupported")
        .when(~F.col("decision").eqNullSafe(hooks.decision), "decision")
        .when(~F.coalesce(F.abs(F.col("margin") - hooks.margin) <= tolerance, F.col("margin").eqNullSafe(hooks.margin)), "margin")
        .when(~F.col("quarantined").eqNullSafe(hooks.quarantined), "quarantined")
        .when(~F.col("answer").eqNullSafe(hooks.answer), "answer")
        .when(~F.col("candidates").eqNullSafe(hooks.candidates), "candidates")
        .otherwise("ok")
    )
    return rows.select(*keys, different.alias("outcome"))


def tally(checked: DataFrame, group: str) -> DataFrame:
    outcome = F.col("outcome")
    return checked.groupBy(group).agg(
        F.count_if(outcome == "ok").alias("ok"),
        F.count_if(~outcome.isin("ok", "unsupported")).alias("failed"),
        F.count_if(outcome == "unsupported").alias("unsupported"),
    )


def symmetry_invariance(scenes: DataFrame, keys: list[str], twins: Column, picture: Column, twin_picture: Column, gold: Column, twin_gold: Column) -> DataFrame:
    """A twin that looks the same must have the same gold; one that looks different is no twin.

    ``twins`` is an array of ``struct(name, ...)`` built per row, so twins are
    exploded beside their scene and nothing is joined.
    """
    paired = scenes.withColumn("twin", F.explode(twins))
    outcome = (
        F.when(picture != twin_picture, "false_twin").when(~gold.eqNullSafe(twin_gold), "gold_flips").otherwise("ok")
    )
    return paired.select(*keys, F.col("twin.name").alias("twin"), outcome.alias("outcome"))


def corruption_coverage(rows: DataFrame, group: str, ident: str, hooks: Hooks, keys: list[str]) -> DataFrame:
    """Flip one answer and blank one picture per group; each must be caught.

    Only the first row of a group is changed, found by a partial aggregation.
    """
    first = rows.groupBy(group).agg(F.min(F.struct(ident, *[k for k in keys if k not in (group, ident)])).alias("__pick"))
    chosen = rows.join(first, group).filter(
        F.struct(ident, *[k for k in keys if k not in (group, ident)]) == F.col("__pick")
    ).drop("__pick")
    other = F.element_at(F.filter("candidates", lambda c: ~c.eqNullSafe(F.col("answer"))), 1)
    wrong = chosen.withColumn("answer", other).withColumn("__m", F.lit("wrong_answer"))
    blank = chosen.withColumn("decision", F.lit(None).cast("string")).withColumn("__m", F.lit("blank_image"))
    mutated = wrong.unionByName(blank)
    checked = exact_rerender_check(mutated, [group, "__m"], hooks)
    return checked.groupBy(group, F.col("__m").alias("mutation")).agg(
        F.bool_or(~F.col("outcome").isin("ok", "unsupported")).alias("caught")
    )


def verify_shapes(truth: DataFrame, found: DataFrame, errors: DataFrame, gaps: DataFrame, scene: str, *, canvas: float, tolerances: dict[str, float]) -> DataFrame:
    """Rule table per scene: count, radius area, border, centre and radius errors, gap."""
    border = (F.col("x") - F.col("r") < 0) | (F.col("y") - F.col("r") < 0) | (F.col("x") + F.col("r") > canvas) | (F.col("y") + F.col("r") > canvas)
    pi = 3.141592653589793
    area_gap = F.abs(F.col("area") - pi * F.col("r") * F.col("r"))
    area_tol = tolerances["area_fraction"] * pi * F.col("r") * F.col("r") + tolerances["area_edge"] * 2 * pi * F.col("r")
    # both sides are counted in one aggregation; a side without a row counts as missing
    no = F.lit(False)
    sides = truth.select(scene, F.lit(True).alias("true"), no.alias("at_border"), no.alias("bad_area")).unionByName(
        found.select(scene, no.alias("true"), border.alias("at_border"), (area_gap > area_tol).alias("bad_area"))
    )
    counts = sides.groupBy(scene).agg(
        F.nullif(F.count_if("true"), F.lit(0)).alias("expected"), F.nullif(F.count_if(~F.col("true")), F.lit(0)).alias("found"),
        F.count_if("at_border").alias("at_border"), F.count_if("bad_area").alias("bad_area"),
    )
    joined = counts.join(errors, scene, "left").join(gaps, scene, "left")
    rules = F.array_compact(
        F.array(
            F.when(~F.col("expected").eqNullSafe(F.col("found")), "count"),
            F.when(F.col("bad_area") > 0, "area"),
            F.when(F.col("at_border") > 0, "border"),
            F.when(F.col("max_centre_error") > tolerances["centre"], "centre"),
            F.when(F.col("max_radius_error") > tolerances["radius"], "radius"),
            F.when(F.col("gap") <= 0, "gap"),
        )
    )
    return joined.select(scene, F.array_join(rules, ",").alias("failures"), (F.size(rules) == 0).alias("ok"))


def two_circle_verdict(m: Column, m_hat: Column, arc: Column, *, minimum_arc: float, tolerance: float, label_band: float, low_band: float) -> Column:
    """High-confidence fits must match margin and label; a low-confidence fit only has to agree in sign far from contact."""
    flip = (m_hat <= 0) != (m <= 0)
    high = arc >= minimum_arc
    return (
        F.when(high & (F.abs(m_hat - m) > tolerance), "margin")
        .when(high & (F.abs(m) > label_band) & flip, "label_flip")
        .when(~high & (F.abs(m) > low_band) & flip, "low_confidence_flip")
        .otherwise("ok")
    )
