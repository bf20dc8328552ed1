"""Event-time windows to signals: the same stateless transform behind watermarked aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_signals(events: DataFrame, keys: list[str], ts: str, value: str, window: str, bins: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """keys, start, x: sums in ``bins`` bins of ``seconds`` of each window, zero where empty.

    Two aggregations follow each other, in a stream as in a batch: values are summed by window and bin, then the
    sums of a window are gathered by bin.  So the plan does not grow with the number of bins, state is a sum per bin that has
    events, never the events, and only sums meet.  A stream needs append mode and emits a window once the watermark has
    passed it, in the batch after its sums are final.  Events past the last bin of a window, or without a time, don't
    count; a bin of nulls only is zero.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    span = F.window("_ts", window)
    bin_ = F.floor((F.unix_timestamp("_ts") - F.unix_timestamp(span.start)) / seconds).cast("int")
    sums = timed.groupBy(*keys, span.alias("_w"), bin_.alias("_bin")).agg(F.sum(value).alias("_v"))
    again = F.window(F.window_time("_w"), window)
    each = F.when((F.col("_bin") < bins) & F.col("_v").isNotNull(), F.struct("_bin", "_v"))
    held = sums.groupBy(*keys, again.alias("_span")).agg(F.map_from_entries(F.collect_list(each)).alias("_m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return held.select(*keys, F.col("_span.start").alias("start"), x.alias("x"))
