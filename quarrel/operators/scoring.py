"""Penalties, grades and the health score: closed forms over one summary row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 20  # points a dimension can cost


def ratio_penalty(weighted: Column, total: Column, saturate: float, budget: int = BUDGET, floor: bool = False) -> Column:
    """Linear up to the budget at the saturating ratio, half away from zero; 0 of nothing. floor: at least 1 if anything counts."""
    raw = F.when(total > 0, F.round(F.least(weighted / total / saturate, F.lit(1.0)) * budget)).otherwise(0.0)
    return F.when(weighted > 0, F.greatest(raw, F.lit(1.0))).otherwise(raw).cast("long") if floor else raw.cast("long")


def health(penalties: list[Column], budgets: list[int]) -> Column:
    """100 less the share of the budgets of the dimensions that ran (null penalties did not)."""
    spent = sum((F.coalesce(p, F.lit(0)) for p in penalties), F.lit(0))
    able = sum((F.when(p.isNotNull(), b).otherwise(0) for p, b in zip(penalties, budgets, strict=True)), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(able > 0, 100 - F.round(100.0 * spent / able)).otherwise(100))).cast("long")


def linear_penalty(value: Column, start: float, saturate: float, budget: int = BUDGET) -> Column:
    """Nothing up to the start, then linear to the budget at saturation; missing data (NaN, null) costs nothing."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value.cast("double") - start) / (saturate - start)))
    return F.when(value.isNull() | F.isnan(value.cast("double")), 0).otherwise(F.round(share * budget)).cast("long")


def duplication_penalty(percent: Column) -> Column:
    return linear_penalty(percent, 0, 60)


def coupling_penalty(high: Column, medium: Column, total: Column) -> Column:
    return ratio_penalty(high + 0.3 * medium, total, 0.4)


def parse_error_penalty(skipped: Column, total: Column) -> Column:
    """One unread file costs an A (11 points), nothing read leaves less than a D (56)."""
    share = F.least(F.lit(1.0), F.try_divide(skipped.cast("double"), total.cast("double")))
    return F.when((skipped > 0) & (total > 0), F.greatest(F.round(share * 56), F.lit(11))).otherwise(0).cast("long")


def dead_code_penalty(critical: Column, warning: Column, info: Column, files: Column) -> Column:
    """Weighted findings a file, full at three; files are those that the search for dead code read, one at least."""
    rate = (critical + 0.5 * warning + 0.2 * info) / F.greatest(files, F.lit(1))
    return linear_penalty(rate, 0, 3)


def complexity_penalty(high: Column, medium: Column, total: Column) -> Column:
    """At least a point if any function is complex."""
    return ratio_penalty(high + 0.5 * medium, total, 0.3, floor=True)


def cohesion_penalty(high: Column, medium: Column, classes: Column) -> Column:
    return ratio_penalty(high + 0.3 * medium, classes, 0.4)


def total_score(penalties: dict[str, Column], budgets: dict[str, int], parse_errors: Column) -> Column:
    """health() of the dimensions that ran, less the penalty for files that could not be read; 0 at least."""
    left = health(list(penalties.values()), [budgets[k] for k in penalties]) - F.greatest(parse_errors, F.lit(0))
    return F.greatest(F.lit(0), left).cast("long")


def fallback_score(average: Column, dead: Column, high: Column) -> Column:
    """A coarse score for when the figures do not fit together."""
    return (F.lit(100) - F.when(average > 10, 10).otherwise(0) - F.when(dead > 0, 5).otherwise(0) - F.when(high > 0, 5).otherwise(0)).cast("long")


def is_healthy(score: Column) -> Column:
    return score >= 70


def dimensions(rows: DataFrame, key: str, scores: dict[str, Column]) -> DataFrame:
    """key, dimension, score, state (clean from 90, weak below 75) and place among the weak of the key (null elsewhere), a row for each enabled
    dimension; scores that are null did not run."""
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("dimension"), c.cast("long").alias("score")) for i, (n, c) in enumerate(scores.items())])).alias("d")
    each = rows.select(key, listed).select(key, "d.*").where("score is not null")
    state = F.when(F.col("score") >= 90, "clean").when(F.col("score") < 75, "weak").otherwise("fair")
    place = F.row_number().over(Window.partitionBy(key, "state").orderBy("score", "i"))  # as many rows as there are dimensions
    return each.withColumn("state", state).withColumn("place", F.when(F.col("state") == "weak", place)).drop("i")


def architecture_penalty(compliance: Column) -> Column:
    return linear_penalty(1 - compliance, 0, 1, 12)


def dependency_penalty(total: Column, in_cycles: Column, depth: Column, deviation: Column) -> Column:
    """Cycles (10 at most: their share, or the logarithm of their modules), depth beyond the expected (3) and deviation (3)."""
    cycles = F.least(F.lit(10.0), F.greatest(F.log2(in_cycles + 1), 10 * F.least(F.lit(1.0), F.try_divide(in_cycles.cast("double"), total.cast("double")))))
    over = depth - F.greatest(F.lit(3), F.ceil(F.log2(total + 1)) + 1)
    some = F.when((total > 0) & (in_cycles > 0), F.round(cycles)).otherwise(0)
    deep = F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(3), over))).otherwise(0)
    return (some + deep + F.round(3 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), deviation)))).cast("long")


def to_base(penalty: Column, most: int) -> Column:
    """A penalty of `most` at most on the scale of the budget."""
    return F.greatest(F.lit(0), F.least(F.lit(BUDGET), F.round(penalty * (1.0 * BUDGET) / most))).cast("long")


def penalty_score(penalty: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.round(penalty * 100.0 / most))).cast("long")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def scale(files: Column) -> Column:
    return F.when(files < 10, "micro").when(files < 50, "small").when(files < 200, "medium").when(files < 1000, "large").otherwise("enterprise")
