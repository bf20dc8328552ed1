"""Signals as rows (keys, x): from list columns, from event rows, or synthetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the generator.
LCG_MUL, LCG_ADD = 6364136223846793005, 1442695040888963407


def from_arrays(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    return df.select(*keys, F.col(values).cast("array<double>").alias("x"))


def from_rows(df: DataFrame, keys: list[str], order: str | Column, value: str | Column) -> DataFrame:
    """Samples in rows to signals: one shuffle on the keys. A signal's samples become one row."""
    order = F.col(order) if isinstance(order, str) else order
    value = F.col(value) if isinstance(value, str) else value
    sample = F.struct(order.alias("at"), value.cast("double").alias("v"))
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(sample)), lambda s: s.v).alias("x"))


def binned(df: DataFrame, keys: list[str], ts: str, value: str, start: str, bins: int, seconds: int) -> DataFrame:
    """Sums of ``value`` in equal bins from ``start``, empty bins zero: signals of ``bins`` samples.

    Bins are summed before anything is gathered, so a busy key costs its bins, not its events.
    Rows outside the span, or without a time or value, don't count.
    """
    at = F.floor((F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / seconds).cast("int")
    sums = df.withColumn("bin", at).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*keys, "bin").agg(F.sum(value).alias("v"))
    return _filled(sums, keys, bins)


def spanned(df: DataFrame, keys: list[str], ts: str, value: str, bins: int) -> DataFrame:
    """Sums of ``value`` in ``bins`` equal bins over all times of the table, from its first second to its last, empty bins zero.

    One aggregate finds the span; bins are the fewest whole seconds long that reach its end, so no
    row with a time and a value falls outside.
    """
    held = df.withColumn("second", F.unix_timestamp(F.col(ts).cast("timestamp"))).where(F.col("second").isNotNull() & F.col(value).isNotNull())
    span = held.agg(F.min("second").alias("first"), F.ceil((F.max("second") + 1 - F.min("second")) / bins).alias("width"))
    at = F.floor((F.col("second") - F.col("first")) / F.col("width")).cast("int")
    sums = held.crossJoin(F.broadcast(span)).withColumn("bin", at).groupBy(*keys, "bin").agg(F.sum(value).alias("v"))
    return _filled(sums, keys, bins)


def _filled(sums: DataFrame, keys: list[str], bins: int) -> DataFrame:
    held = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))


def synthetic(n: int, seed: int) -> list[float]:
    """Reproducible noise on a sawtooth, from a 64-bit congruential generator."""
    s, out = seed, []
    for i in range(n):
        s = (s * LCG_MUL + LCG_ADD) % 2**64
        out.append((s >> 11) / 2.0**52 - 1 + (i % 97 - 48) / 64)
    return out


def synthetic_signals(spark: SparkSession, n: int, seeds: list[int]) -> DataFrame:
    """seed, x: each signal is generated by its own task."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("seed"), pa.array([synthetic(n, s) for s in b.column("seed").to_pylist()], pa.list_(pa.float64()))], names=["seed", "x"])

    return spark.createDataFrame([(s,) for s in seeds], "seed long").mapInArrow(run, "seed long, x array<double>")


def synthetic_of(df: DataFrame, keys: list[str], seed: str, n: int) -> DataFrame:
    """keys, x: the synthetic signal of each row's seed (whole, taken modulo 2^64; null gives none), made where the row is, a batch of rows at a time."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    saw = (np.arange(n) % 97 - 48) / 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state = b.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            x = np.empty((len(state), n))
            for i in range(n):
                state = state * np.uint64(LCG_MUL) + np.uint64(LCG_ADD)  # wraps at 2^64
                x[:, i] = (state >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1 + saw[i]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("keys"), lists], names=["keys", "x"])

    held = df.where(F.col(f"`{seed}`").isNotNull()).select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("keys"), F.col(f"`{seed}`").cast("long").alias("seed"))
    schema = T.StructType().add(held.schema["keys"]).add("x", T.ArrayType(T.DoubleType()))
    return held.mapInArrow(run, schema).select(*[F.col(f"keys.`{k}`") for k in keys], "x")
