"""Numbers within a relative tolerance of each other: a band join, and one-to-one matches of the nearest."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import stored


def band_pairs(left: DataFrame, right: DataFrame, on: list[str], tolerance: float = 0.02) -> DataFrame:
    """left: on, left, a; right: on, right, b. Pairs with |a - b| <= tolerance * |b| and their gap |a - b|.

    Numbers fall into buckets of equal width in their logarithm, so a partner lies in the same bucket or the next one to either side:
    an equality join on group, sign and bucket, where the left side goes to three buckets, and the condition after it. A zero is near a zero
    only. Nulls, infinities and NaN are near nothing."""
    if not 0 < tolerance < 1:
        raise ValueError("tolerance lies between 0 and 1")
    width = -math.log1p(-tolerance) * 1.0001  # a little over the widest ratio, for what rounding does at the edges

    def placed(df: DataFrame, value: str, reach: int) -> DataFrame:
        x = F.col(value).cast("double")
        bucket = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(x)) / width)).cast("long")
        near = F.when(x == 0, F.array(bucket)).otherwise(F.sequence(bucket - reach, bucket + reach))
        finite = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return finite.withColumns({"sign": F.signum(x).cast("int"), "bucket": F.explode(near)})

    pairs = placed(left, "a", 1).join(placed(right, "b", 0), [*on, "sign", "bucket"])
    gap = F.abs(F.col("a") - F.col("b"))
    return pairs.where(gap <= tolerance * F.abs("b")).select(*on, "left", "right", "a", "b", gap.alias("gap"))


def one_to_one(pairs: DataFrame, on: list[str]) -> DataFrame:
    """The pairs that remain if the nearest pair of each group is taken, its two sides go, and so on; equal gaps by left, then right.

    All pairs that are each other's best are taken in one round, which gives the same: nothing that is nearer to either side is left. Rounds
    go on until no pair is."""
    left, taken = stored(pairs), None
    while not left.isEmpty():
        best = [left.groupBy(*on, side).agg(F.min(F.struct("gap", other)).alias(f"{side}_best")) for side, other in (("left", "right"), ("right", "left"))]
        mutual = (F.col("left_best") == F.struct("gap", "right")) & (F.col("right_best") == F.struct("gap", "left"))
        round_ = stored(left.join(best[0], [*on, "left"]).join(best[1], [*on, "right"]).where(mutual).select(*pairs.columns))
        taken = round_ if taken is None else taken.union(round_)
        left = stored(left.join(round_.select(*on, "left"), [*on, "left"], "left_anti").join(round_.select(*on, "right"), [*on, "right"], "left_anti").select(*pairs.columns))
    return pairs.limit(0) if taken is None else taken


def matched_sides(left: DataFrame, right: DataFrame, on: list[str], tolerance: float = 0.02) -> DataFrame:
    """on, left, right, gap of the one-to-one matches. Numbers that share an id count as one, with the least gap."""
    pairs = band_pairs(left, right, on, tolerance).groupBy(*on, "left", "right").agg(F.min("gap").alias("gap"))
    return one_to_one(pairs, on)
