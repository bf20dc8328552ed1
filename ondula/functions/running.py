"""Running sums over samples in rows, and what they find: tail mass, first index, support in time, hashes of a signal's bits.

A signal's samples are rows (keys, i, value), so a signal may be longer than an array can be.  A running sum needs a
signal's rows together and in order: one shuffle on the keys, one sort that may spill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Fixed values of the hash: FNV-1a of 64 bits.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def tail_sums(samples: DataFrame, keys: list[str], order: str, value: str, name: str = "tail") -> DataFrame:
    """The rows with the sum of the values from each one to its signal's last. Nulls don't count; repeated places stand in any order."""
    back = W.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    return samples.withColumn(name, F.sum(value).over(back))


def first_index(samples: DataFrame, keys: list[str], order: str, condition: Column, name: str = "first") -> DataFrame:
    """keys and the least place at which the condition holds; null where it never does."""
    return samples.groupBy(*keys).agg(F.min(F.when(condition, F.col(order))).alias(name))


def amplitudes(df: DataFrame, keys: list[str], response: str) -> DataFrame:
    """keys, i, amplitude: the first half of the inverse Fourier transform's moduli, as shares of their sum over the whole length.

    ``response``: real arrays of any lengths, without nulls inside; null and empty ones give no rows, as does one without any mass.
    """
    held = df.select(F.struct(*keys).alias("keys"), F.col(f"`{response}`").cast("array<double>").alias("h"))
    held = held.where("size(h) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h in batch.column("h"):
                moduli = np.abs(np.fft.ifft(h.values.to_numpy(zero_copy_only=False)))
                total = moduli.sum()
                out.append((moduli[: max(1, len(moduli) // 2)] / total) if total > 0 else moduli[:0])
            yield pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(out, pa.list_(pa.float64()))], names=["keys", "a"])

    schema = T.StructType().add(held.schema["keys"]).add("a", T.ArrayType(T.DoubleType()))
    return held.mapInArrow(run, schema).select("keys.*", F.posexplode("a").alias("i", "amplitude"))


def temporal_support(samples: DataFrame, keys: list[str], loss: float) -> DataFrame:
    """keys, mass (of all samples), support: the least N such that at most ``loss`` lies from place N - 1 on; null if there is none.

    samples: keys, i, amplitude, as ``amplitudes`` gives them.
    """
    tails = tail_sums(samples, keys, "i", "amplitude")
    return tails.groupBy(*keys).agg(F.max("tail").alias("mass"), (F.min(F.when(F.col("tail") <= loss, F.col("i"))) + 1).alias("support"))


def fold_bits(lists: pa.Array) -> list[int | None]:
    """FNV-1a of the little-endian bytes of each list's doubles; null for null. A batch's lists are folded side by side, byte by byte."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.ascontiguousarray(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), "<f8").view(np.uint8)
    starts = 8 * np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    order = np.argsort(-sizes, kind="stable")  # the longest first, so those that go on are a prefix
    left, at = 8 * sizes[order], starts[order]
    h, prime = np.full(len(sizes), FNV_BASIS, np.uint64), np.uint64(FNV_PRIME)
    live = len(sizes)
    for k in range(int(left[0]) if live else 0):
        while live and left[live - 1] <= k:
            live -= 1
        h[:live] = (h[:live] ^ flat[at[:live] + k]) * prime
    out = np.empty(len(sizes), np.uint64)
    out[order] = h
    return [int(v) if ok else None for v, ok in zip(out, lists.is_valid().to_pylist())]


@F.arrow_udf(T.StringType())
def _bit_hash(lists: pa.Array) -> pa.Array:
    return pa.array([None if v is None else f"{v:016x}" for v in fold_bits(lists)], pa.string())


def bit_hash(signal: Column) -> Column:
    """16 hexadecimal digits that tell a signal's doubles bit by bit (so 0.0 from -0.0); a null inside counts as NaN."""
    return _bit_hash(signal.cast("array<double>"))
