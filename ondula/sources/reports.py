"""Self-check: hashes of plans and of transforms of synthetic signals, as a table and as text."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.functions import exact
from ondula.plans.joint_plan import JointPlan
from ondula.plans.time_plan import TimePlan

NUMERICS_VERSION = "ondula-1"

#: Name, length, depth, other arguments, frequency arguments (None: time only), seed.
CASES = (
    ("kinematic-1800-J8-Tsec1", 1800, 8, {"Q": (8, 1), "T_sec": 1, "sr": 30}, None, 1),
    ("audio-32000-J9-Q8", 32000, 9, {"Q": 8}, None, 2),
    ("global-2048-J6", 2048, 6, {"Q": (8, 1), "T": "global"}, None, 3),
    ("unaveraged-1500-J6", 1500, 6, {"Q": (4, 2), "T": 0}, None, 4),
    ("strided-4096-J7", 4096, 7, {"Q": (8, 2), "stride": 16}, None, 5),
    ("order1-3000-J6-Q12", 3000, 6, {"Q": 12, "max_order": 1}, None, 6),
    ("jtfs-time-4096-J6", 4096, 6, {"Q": 8}, {}, 7),
    ("jtfs-joint-4096-J6", 4096, 6, {"Q": 8}, {"format": "joint", "out_type": "list"}, 8),
    ("jtfs-F0-4096-J6", 4096, 6, {"Q": 8}, {"F": 0}, 9),
    ("jtfs-speech-16000-J10", 16000, 10, {"Q": 8}, {}, 10),
    ("jtfs-video-900-J7", 900, 7, {"Q": (8, 1), "T_sec": 6, "sr": 30}, {}, 15),
)


def fnv1a(values) -> int:
    """FNV-1a of the little-endian bytes of doubles."""
    h = 0xCBF29CE484222325
    for b in b"".join(struct.pack("<d", v) for v in values):
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def plans() -> dict[str, TimePlan | JointPlan]:
    out = {}
    for name, n, j, kw, fr, _ in CASES:
        time = TimePlan(n, j, **kw)
        out[name] = time if fr is None else JointPlan(time, **fr)
    return out


def shape(plan: TimePlan | JointPlan) -> tuple[int, int, int]:
    """(paths, time samples of a path, padded length of the last axis) of a plan with a local average."""
    time = plan if isinstance(plan, TimePlan) else plan.time
    start, end = time.borders[time.log2_stride]
    return len(plan.paths), end - start, time.n_padded if plan is time else plan.n_padded_fr


#: The case whose first order and renormalised coefficients are hashed, as in the reference.
RENORMED = "jtfs-video-900-J7"
SUMMARIES = ("Mean", "Sd", "Median", "Max")
#: Fixed values of this engine's own numerics: case, quantity, number, sum, root of the sum of squares, largest absolute value.
RECORD = """
kinematic-1800-J8-Tsec1 Max 234 779.6525993131835 52.34471236915031 5.225942770575031
kinematic-1800-J8-Tsec1 Mean 234 582.1448642409462 39.07742188466145 3.5525900641225956
kinematic-1800-J8-Tsec1 Median 234 582.7622196738657 39.105771828197646 3.4832744353851024
kinematic-1800-J8-Tsec1 Sd 234 98.47041150922584 7.073978047168676 1.691683180040207
kinematic-1800-J8-Tsec1 coefs 26442 497.5638547552572 5.3944868631826886 0.24771437503466942
audio-32000-J9-Q8 Max 300 893.6357122197219 52.740208421830864 3.9419810058684863
audio-32000-J9-Q8 Mean 300 780.9082002139329 46.459037593602936 3.474799121116008
audio-32000-J9-Q8 Median 300 782.6237789060102 46.584742938231074 3.4817039866800834
audio-32000-J9-Q8 Sd 300 56.454597679331485 3.811813539916885 0.6934671540670515
audio-32000-J9-Q8 coefs 18900 285.6093446194908 3.8541598578337877 0.2413615541234377
global-2048-J6 coefs 126 5780.546520693583 1193.2198843725544 422.3201157575644
unaveraged-1500-J6 coefs 37928 1514.4552876925964 31.977934834126557 1.7177146447597291
strided-4096-J7 Max 350 1529.3985979115005 83.83729274656021 5.898556077808156
strided-4096-J7 Mean 350 1342.104041489229 74.56669439170082 5.342368216154272
strided-4096-J7 Median 350 1344.938458773534 74.87355110686825 5.457409112814263
strided-4096-J7 Sd 350 106.34423462033983 6.64775922003964 2.4336707485938964
strided-4096-J7 coefs 89600 1104.6942879025935 7.85729352705696 0.2685397863586039
order1-3000-J6-Q12 coefs 2491 133.88158992213425 3.0622675223226716 0.2260372830066801
jtfs-time-4096-J6 coefs 9728 38.427466949725904 0.9231279304294472 0.14539078695181423
jtfs-time-4096-J6 shape 304 9880.0 789.1413054706995 64.0
jtfs-joint-4096-J6 coefs 9728 37.23783337573415 0.9225510716379177 0.09368327470038902
jtfs-joint-4096-J6 shape 84 2840.0 415.5045126108741 64.0
jtfs-F0-4096-J6 coefs 48832 220.90743509748162 1.5681014550106576 0.11984538707490618
jtfs-F0-4096-J6 shape 1526 49595.0 1768.052883824463 64.0
jtfs-speech-16000-J10 coefs 6630 16.532708817469302 0.5007340181271739 0.05423976038162708
jtfs-speech-16000-J10 shape 884 7072.0 316.0569568922665 15.0
jtfs-video-900-J7 renorm 1477 62.80207452486677 1.785615009952847 0.082979149242977
jtfs-video-900-J7 s1 322 18.700126398980903 1.1745680736108044 0.22028473494318745
"""


def quantities(spark: SparkSession, names: list[str] | None = None, partitions: int | None = None) -> Iterator[tuple[str, DataFrame, str, dict[str, Column]]]:
    """(case, table, its order, {quantity: array of its values in a row}).

    Coefficients of every case but one; summaries of locally averaged second-order cases; shapes of joint cases; first order
    and renormalised coefficients of ``RENORMED``.  ``partitions`` deals the signals out anew before the transforms.
    """
    from ondula.operators.scattering import Scattering1D, ScatteringJTFS
    from ondula.sources.signals import synthetic_signals

    coef = F.col("coef")
    for name, n, j, kw, fr, seed in CASES:
        if names and name not in names:
            continue
        op = Scattering1D(n, j, **kw) if fr is None else ScatteringJTFS(n, j, **kw, **fr)
        x = synthetic_signals(spark, n, [seed])
        x = x.repartition(partitions) if partitions else x
        if name == RENORMED:
            coefs, s1 = op.transform_with_s1(x)
            yield name, s1, "band", {"s1": coef}
            yield name, op.renorm(coefs, s1, ["seed"]), "path_idx", {"renorm": coef}
        elif fr is not None:
            yield name, op.transform(x), "path_idx", {"shape": F.array("rows", "cols").cast("array<double>"), "coefs": coef}
        else:
            yield name, op.transform(x), "path_idx", {"coefs": coef}
            if op.time.local and any(p["order"] == 2 for p in op.paths):
                yield name, op.features(x, ["seed"]), "path_idx", {k: F.array(k.lower()) for k in SUMMARIES}


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def golden_report(spark: SparkSession, names: list[str] | None = None, digits: int = 8, partitions: int | None = None) -> DataFrame:
    """name, quantity, hash: of values rounded to ``digits``, each case in tasks of its own."""
    parts = []
    for name, df, at, each in quantities(spark, names, partitions):
        hashed = lambda v: F.xxhash64(F.sort_array(F.collect_list(F.struct(at, F.transform(v, lambda x: F.round(x, digits)).alias("v")))))  # noqa: E731, B023
        row = df.agg(F.array(*[F.struct(F.lit(k).alias("quantity"), hashed(v).alias("hash")) for k, v in each.items()]).alias("q"))
        parts.append(row.select(F.lit(name).alias("name"), F.inline("q")))
    return _united(parts)


def measured_report(spark: SparkSession, names: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """name, quantity, n, total, norm, most: number, sum, root of the sum of squares and largest absolute value of each quantity."""
    parts = []
    for name, df, _, each in quantities(spark, names, partitions):
        for k, v in each.items():
            x = df.select(F.explode(v).alias("x"))
            sums = [F.count("x").alias("n"), F.sum("x").alias("total"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.max(F.abs("x")).alias("most")]
            parts.append(x.agg(*sums).select(F.lit(name).alias("name"), F.lit(k).alias("quantity"), "n", "total", "norm", "most"))
    return _united(parts)


def recorded() -> dict[tuple[str, str], tuple[float, ...]]:
    """(case, quantity) -> (n, total, norm, most) as recorded."""
    rows = [line.split() for line in RECORD.strip().splitlines()]
    return {(r[0], r[1]): tuple(map(float, r[2:])) for r in rows}


def strayed(rows, relative: float = 1e-9) -> list[str]:
    """Quantities of a measured report that are away from their record by more than ``relative`` of their norm, or that one of both lacks."""
    want, got = recorded(), {(r["name"], r["quantity"]): (r["n"], r["total"], r["norm"], r["most"]) for r in rows}
    apart = lambda a, b: a[0] != b[0] or any(abs(x - y) > relative * max(1.0, b[0] ** 0.5 * b[2]) for x, y in zip(a[1:], b[1:]))
    return sorted(f"{n}\t{q}" for n, q in want.keys() | got.keys() if (n, q) not in want or (n, q) not in got or apart(got[n, q], want[n, q]))


def report_text(rows) -> str:
    """One tab-separated line per quantity under the version."""
    return "\n".join([f"numerics\t{NUMERICS_VERSION}"] + [f"{r.name}\t{r.quantity}\t{r.hash}" for r in sorted(rows)])


def differences(report: str, record: str) -> list[str]:
    """Lines of one report that the other lacks."""
    mine, other = set(report.splitlines()), set(record.splitlines())
    return sorted(mine ^ other)


def verify(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """What strays from the record, and differences between two runs of which the second deals its signals to other partitions; none is a pass."""
    wrong = [x for x in strayed(measured_report(spark, names).collect()) if not names or x.split("\t")[0] in names]
    first = report_text(golden_report(spark, names).collect())
    return wrong + differences(first, report_text(golden_report(spark, names, partitions=3).collect()))


def table_report(coefs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, path_idx, n, total, squares, most of a table of coefficients: sums are exact, so the report is the same bits for every partitioning."""
    keys = [*(keys or []), "path_idx"]
    each = coefs.select(*keys, F.explode("coef").alias("total")).withColumn("squares", F.col("total") * F.col("total"))
    most = each.groupBy(*keys).agg(F.count("total").alias("n"), F.max(F.abs("total")).alias("most"))
    named = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    sums = exact.sums(each, keys, ["total", "squares"]).select(*named, "total", "squares")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return most.join(sums, reduce(and_, same)).select(*keys, "n", "total", "squares", "most")


def table_differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """path_idx, only_one, lengths, apart, worst: of two tables of coefficients, by path.

    Rows that one table lacks, rows of another length, values further apart than the tolerance, and the largest distance (of values
    that both have).  Keys and path name a row of each table; NaN is as far from a number as can be, and near NaN.
    """
    named = [*keys, "path_idx"]
    other = b.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(named)], F.col("coef").alias("_coef"))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(named)]
    met = a.select(*named, "coef").join(other, reduce(and_, same), "full")
    path = F.coalesce("path_idx", f"_k{len(keys)}").alias("path_idx")
    gap = F.zip_with("coef", "_coef", lambda x, y: F.when(F.isnan(x) & F.isnan(y) | (x == y), 0.0).when(F.isnan(x) | F.isnan(y), float("inf")).otherwise(F.abs(x - y)))
    one, fit = F.col("coef").isNull() | F.col("_coef").isNull(), F.size("coef") == F.size("_coef")
    gaps = F.when(~one & fit, gap)
    row = met.select(path, one.cast("long").alias("one"), (~one & ~fit).cast("long").alias("other"), F.coalesce(F.size(F.filter(gaps, lambda g: g > tolerance)), F.lit(0)).alias("far"), F.array_max(gaps).alias("worst"))
    return row.groupBy("path_idx").agg(F.sum("one").alias("only_one"), F.sum("other").alias("lengths"), F.sum("far").alias("apart"), F.coalesce(F.max("worst"), F.lit(0.0)).alias("worst"))
