"""Exact quantiles of groups of any size: ranks are found by histograms that narrow, values are never gathered.

A quantile of type 7 lies between two order statistics.  Each wanted rank of a group holds
an interval of values that contains it.  A pass counts the group's values inside the interval by
bucket, in one aggregation that combines before the shuffle, and keeps the bucket that holds
the rank, with the least and greatest value met in it as the new interval.  The first pass, which all ranks
share, takes sign and binary exponent as the bucket, the next ones equal parts of the interval, so
the interval shrinks by 4096 at least while it has several values: at most six passes, whatever the values.  An
interval ends when its values are equal, or when the values inside are few (1024), which are then sorted.

A bucket's number never falls as the value rises (logarithm, difference and quotient are monotone
even when rounded), which is all that exactness needs.  A task holds a count for each group, rank and bucket it meets.

Nulls don't count.  A group with a NaN has NaN; one without values has nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ondula.functions import features
from ondula.sources import tables

BUCKETS, FEW = 4096, 1024
#: Buckets above those of every finite double, of infinity and of NaN.
BEYOND, NOT_A_NUMBER = 3000, 9999


def magnitude(v: Column) -> Column:
    """Sign and binary exponent as one number that never falls as v rises."""
    level = F.when(F.abs(v) == float("inf"), BEYOND).otherwise(F.floor(F.log2(F.abs(v))) + 1100)
    return F.when(v == 0, 0).when(v > 0, level).otherwise(-level).cast("int")


def _meet(values: DataFrame, states: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Each value with the intervals of its group that contain it."""
    s = states.withColumnsRenamed({k: f"s_{k}" for k in keys})
    on = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    return values.join(F.broadcast(s) if small else s, on).drop(*[f"s_{k}" for k in keys])


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Counted buckets with ``upto``: the values of their group (and rank) in them and in those before."""
    return rows.withColumn("upto", F.sum("c").over(W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))


def order_statistics(values: DataFrame, states: DataFrame, keys: list[str], steps: tables.Folder, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """keys, k, value: the values of rank k (from 0) of each group.

    values: keys (of other names than the columns here) and v, without nulls and NaN.  states: keys, k, and an interval low..high of
    a group's values that holds rank k, as rank r (from 0) of the ``inside`` values in it.
    """
    open_, rest = f"low < high AND inside > {few}", f"low < high AND inside <= {few}"
    texts = [k for k in keys if states.schema[k].dataType.typeName() in ("string", "binary")]
    size = sum((F.octet_length(k) for k in texts), F.lit(tables.ROW_BYTES + 8 * (len(keys) + 5)))
    done = []
    while True:
        states = steps.write(states)
        n_open, n_rest, taken = states.agg(F.count_if(F.expr(open_)), F.count_if(F.expr(rest)), F.sum(F.coalesce(size, F.lit(tables.ROW_BYTES)))).first()
        small = (taken or 0) <= tables.BROADCAST_BYTES
        done.append(states.where("low = high").select(*keys, "k", F.col("low").alias("value")))
        if n_rest:
            gathered = _meet(values, states.where(rest), keys, small).groupBy(*keys, "k", "r").agg(F.sort_array(F.collect_list("v")).alias("all"))
            done.append(gathered.select(*keys, "k", F.get("all", F.col("r").cast("int")).alias("value")))
        if not n_open:
            break
        bucket = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets).alias("bucket")
        counted = _meet(values, states.where(open_), keys, small).groupBy(*keys, "k", "r", bucket).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        found = _numbered(counted, *keys, "k").where("upto > r AND upto - c <= r")
        states = found.select(*keys, "k", (F.col("r") - F.col("upto") + F.col("c")).alias("r"), "low", "high", F.col("c").alias("inside"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """keys, n, quantiles (array, in the order of shares): interpolated between order statistics (type 7) of each group's values."""
    if not shares or not all(0 <= p <= 1 for p in shares):
        raise ValueError("Quantiles need shares from 0 to 1.")
    names, keys = keys, [f"key_{i}" for i in range(len(keys))]  # the keys' own names may be those of columns below
    held = df.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(names, keys)], F.col(f"`{value}`").cast("double").alias("v"))
    n = F.col("n")
    at = lambda p: F.floor((n - 1) * F.lit(float(p)))
    next_ = lambda p: F.least(at(p) + 1, n - 1)

    def between(p: float) -> Column:
        a, b = F.try_element_at("m", at(p)), F.try_element_at("m", next_(p))
        inside = F.when(a == b, a).otherwise(a + ((n - 1) * F.lit(float(p)) - at(p)) * (b - a))
        return F.when(~F.col("sound"), F.lit(float("nan"))).when(n > 0, inside)

    with tables.Folder(df.sparkSession) as steps:
        bucket = F.when(F.isnan("v"), NOT_A_NUMBER).otherwise(magnitude(F.col("v"))).alias("bucket")
        first = steps.write(held.groupBy(*keys, bucket).agg(F.count("v").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")))
        groups = first.groupBy(*keys).agg(F.sum("c").alias("n"), (F.coalesce(F.max("bucket"), F.lit(0)) < NOT_A_NUMBER).alias("sound"))
        whole = W.partitionBy(*keys)
        sizes = first.where("bucket IS NOT NULL").withColumns({"n": F.sum("c").over(whole), "last": F.max("bucket").over(whole)})
        levels = _numbered(sizes.where(F.col("last") < NOT_A_NUMBER), *keys)
        both = F.array_distinct(F.array(*[x for p in shares for x in (at(p), next_(p))]))
        here = F.explode(F.filter(both, lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("c")))).alias("k")
        states = levels.select(*keys, here, "upto", "c", "low", "high").select(*keys, "k", (F.col("k") - F.col("upto") + F.col("c")).alias("r"), "low", "high", F.col("c").alias("inside"))
        found = order_statistics(held.where("v IS NOT NULL AND NOT isnan(v)"), states, keys, steps, buckets, few)
        rows = found.select(*keys, F.struct("k", "value").alias("s"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("sound"))
        rows = rows.unionByName(groups.select(*keys, F.lit(None).cast(rows.schema["s"].dataType).alias("s"), "n", "sound"))
        met = rows.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.bool_and("sound").alias("sound"), F.map_from_entries(F.collect_list("s")).alias("m"))
        return tables.write(met.select(*[F.col(b).alias(a) for a, b in zip(names, keys)], "n", F.array(*[between(p) for p in shares]).alias("quantiles")))


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: NaN where a value is NaN or there is none, as ``features.summarise`` has it, for groups of any size."""
    out = quantiles(df, keys, value, [0.5])
    return out.select(*keys, F.coalesce(F.get("quantiles", 0), F.lit(features.NAN)).alias("median"))


def floors(df: DataFrame, keys: list[str], value: str, p: float = 0.01) -> DataFrame:
    """keys, eps: the quantile of the positive finite values, kept off zero, or the fallback, as ``features.eps_quantile`` has it."""
    v = F.col(f"`{value}`").cast("double")
    out = quantiles(df.withColumn(value, F.when(features.positive_finite(v), v)), keys, value, [p])
    found = F.get("quantiles", 0)
    return out.select(*keys, F.when(found.isNull(), features.NO_POSITIVE_EPS).otherwise(F.greatest(found, F.lit(features.LEAST_EPS))).alias("eps"))
