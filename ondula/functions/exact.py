"""Exact sums of doubles over rows: the same bits for every order and partitioning.

A double is a whole number of units of 2**-1074.  ``parts`` writes it as four whole amounts, of the
20-bit limb of that number in which it begins and of the three below, in column expressions alone: scaling by
a power of two, the remainder by 1 and the floor of doubles are exact.  Amounts are added as whole numbers
by the limb they begin in, before the shuffle and after it, so nothing depends on order; a group has
at most 105 limbs.  Only then is the total rounded, once, to the nearest double (ties to even).

Amounts of a group merge by addition, so totals of tables that were accumulated apart
(by day, say) are totals of their union.  A limb of a group holds about 4e12 rows; beyond, the job
fails rather than wrap.

Nulls don't count; a group without values has a null sum.  A NaN, or infinities of both signs, give
NaN; an infinity gives itself; a total beyond the doubles gives infinity.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMB_BITS, LOWEST, LIMBS = 20, -1074, 105
#: Limbs that stand for values without parts; their first amount counts rows.
NAN, PLUS, MINUS = -1, -2, -3
AMOUNTS = ("_a0", "_a1", "_a2", "_a3")


def parts(df: DataFrame, v: str = "_v") -> DataFrame:
    """The rows with ``_limb`` and four signed amounts in place of the column of doubles; all null for null."""
    size, value = F.abs(v), F.col(v)
    usual = (size > 0) & (size < float("inf"))
    limb = F.greatest(F.lit(0), F.least(F.lit(LIMBS - 1), F.floor((F.log2(size) - LOWEST) / LIMB_BITS))).cast("int")
    special = F.when(F.isnan(v), NAN).when(value == float("inf"), PLUS).when(value == float("-inf"), MINUS).when(value == 0, 0)
    held = df.withColumn("_limb", F.when(usual, limb).otherwise(special))
    # log2 may miss the limb by one at its edge: the first amount is then a bit longer, or none.
    held = held.withColumn("_x", F.when(usual, size / F.pow(F.lit(2.0), (F.col("_limb") * LIMB_BITS + LOWEST).cast("double"))))
    x, amounts = F.col("_x"), []
    for _ in AMOUNTS:
        amount = F.floor(x)
        amounts.append(F.when(usual, F.when(value < 0, -amount).otherwise(amount)))
        x = x % 1.0 * float(1 << LIMB_BITS)
    amounts[0] = F.when(usual, amounts[0]).when(F.col("_limb") < 0, 1)
    return held.withColumns({a: F.when(value.isNotNull(), F.coalesce(c, F.lit(0))).cast("bigint") for a, c in zip(AMOUNTS, amounts)}).drop(v, "_x")


def accumulate(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, _which (place in ``values``), _limb, four amounts: a table that merges with others by ``union``.

    A group without values keeps a row of null limb.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("_which"), F.col(f"`{c}`").cast("double").alias("_v")) for i, c in enumerate(values)])
    each = df.select(*keys, F.inline(listed)) if len(values) > 1 else df.select(*keys, F.lit(0).alias("_which"), F.col(f"`{values[0]}`").cast("double").alias("_v"))
    return parts(each).groupBy(*keys, "_which", "_limb").agg(*[F.sum(a).alias(a) for a in AMOUNTS])


def rounded(sums: list[dict]) -> float | None:
    """The double nearest to the total of a group's amounts."""
    sums = [s for s in sums if s["_limb"] is not None]
    if not sums:
        return None
    there = {s["_limb"] for s in sums}
    if NAN in there or {PLUS, MINUS} <= there:
        return float("nan")
    if there & {PLUS, MINUS}:
        return float("inf" if PLUS in there else "-inf")
    # Limbs below the lowest are empty; three more make every shift a whole one.
    total = sum(s[a] << LIMB_BITS * (s["_limb"] - k + 3) for s in sums for k, a in enumerate(AMOUNTS))
    try:
        return total / (1 << 3 * LIMB_BITS - LOWEST)  # a quotient of whole numbers is rounded once
    except OverflowError:
        return float("inf" if total > 0 else "-inf")


@F.arrow_udf(T.DoubleType())
def _rounded(amounts: pa.Array) -> pa.Array:
    return pa.array([rounded(a) for a in amounts.to_pylist()], pa.float64())


def total(accumulated: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and the exact sum of each value, from accumulated tables."""
    sums_of = F.struct("_limb", *AMOUNTS)
    lists = [F.collect_list(F.when(F.col("_which") == i, sums_of)).alias(f"_{i}") for i in range(len(values))]
    held = accumulated.groupBy(*keys).agg(*lists)
    return held.select(*keys, *[_rounded(f"_{i}").alias(c) for i, c in enumerate(values)])


def sums(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and the exact sum of each value column, rounded to the nearest double."""
    return total(accumulate(df, keys, values), keys, values)
