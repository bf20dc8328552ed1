"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + ":" + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Timed besides, and not part of the sum: forms on tables, sums and ranks.
TABLES = ("exact_sums_embeddings", "rank_quantiles", "joint_renorm_tables", "joint_with_s1", "features_events", "bit_hashes")
RUNS = 5
HEADLINE = ("features_embeddings", "scatter_embeddings", "joint_events", "renorm_embeddings", "summaries", "eps_quantile", "dft_power")


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ondula import queries
    from ondula.operators.scattering import Scattering1D, ScatteringJTFS
    from ondula.sources.signals import synthetic_signals

    warnings.simplefilter("ignore")
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    spread: dict[str, list[float]] = {}

    def timed(name: str, make) -> float:
        """The best of the runs; the slowest and the middle one go to ``spread``."""
        took = []
        for _ in range(RUNS):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        took.sort()
        spread[name] = [round(took[RUNS // 2], 3), round(took[-1], 3)]
        return round(took[0], 3)

    found = {name: timed(name, lambda: queries.QUERIES[name](spark, SF)) for name in HEADLINE}
    more = {name: timed(name, lambda: queries.QUERIES[name](spark, SF)) for name in TABLES}
    # The three harness shapes, in signals per second.
    rates = {}
    for name, op, count in (("events_720_J6_Q4", Scattering1D(720, 6, Q=(4, 1)), 2000), ("movement_900_J7_Q8_T180", ScatteringJTFS(900, 7, Q=(8, 1), T=180), 64), ("audio_32000_J9_Q8", Scattering1D(32000, 9, Q=8), 32)):
        base = synthetic_signals(spark, op.time.n, [1]).crossJoin(spark.range(count)).repartition(int(CPUS)).select("id", "x").cache()
        base.count()
        found[name] = timed(name, lambda: op.transform(base).agg(F.sum(F.size("coef"))))
        rates[name] = round(count / found[name], 1)
        base.unpersist()
    print(json.dumps({"metric": "headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "tables": more, "median_and_slowest": spread, "signals_per_sec": rates, "sf": SF}))


if __name__ == "__main__":
    main()
