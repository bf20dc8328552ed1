"""Time scattering and joint time-frequency scattering of DataFrames of signals.

A transform is one narrow, stateless stage: a row holds a signal in a list column, an Arrow
batch becomes a matrix, and each path leaves as rows (keys, path_idx, coef).  The schema
and the path table are known from the plan before any job.  Filters on keys belong before
the transform, as Spark cannot push them through it; ``select_paths`` prunes paths, and the
filters that only they need, inside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ondula.functions import features
from ondula.operators import kernels
from ondula.plans.filters import Filter
from ondula.plans.joint_plan import JointPlan
from ondula.plans.time_plan import TimePlan
from ondula.sources import tables

#: Values of the padded spectra that a matrix of signals may hold, so memory does not depend on Arrow's batch size.
MOST_VALUES = 1 << 21

_INT, _DBL = ("path_idx", "order", "n1", "n2", "n_fr", "j1", "j2", "j_fr", "spin"), ("xi1", "xi2", "xi_fr", "sigma1", "sigma2", "sigma_fr")


def checked(n: int, column: pa.Array, on_error: str) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of usable signals, and which rows they are."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy().astype(np.int64)
    whole = lengths == n
    flat = column.filter(pa.array(whole)).flatten().cast(pa.float64())
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, n)
    finite = np.isfinite(x).all(axis=1)
    if on_error == "raise":
        if not whole.all():
            raise ValueError(f"The signal has {int(lengths[~whole][0])} samples; this operator was built for {n}.")
        if not finite.all():
            raise ValueError("The signal contains non-finite values.")
    rows = np.flatnonzero(whole)
    return x[finite], rows[finite]


def _batches(n: int, width: int, on_error: str, emit: Callable[[np.ndarray], Iterator[tuple[list, np.ndarray]]], names: list[str]):
    """A mapInArrow function: for each slice of usable signals, ``emit`` yields (constant columns, [signal, ...] values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MOST_VALUES // width)
        for batch in batches:
            x, rows = checked(n, batch.column("x"), on_error)
            for at in range(0, len(rows), step):
                keys = batch.column("keys").take(pa.array(rows[at : at + step]))
                for constants, y in emit(x[at : at + step]):
                    count = len(y)
                    flat = np.ascontiguousarray(y.reshape(count, -1))
                    offsets = pa.array(np.arange(count + 1) * flat.shape[1], pa.int32())
                    coef = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
                    fixed = [pa.array(np.full(count, c, np.int32)) for c in constants]
                    yield pa.RecordBatch.from_arrays([keys, *fixed, coef], names=names)

    return run


class _Operator:
    plan: TimePlan | JointPlan
    time: TimePlan
    on_error: str
    #: Paths to give, all for None.
    wanted: set[int] | None = None

    @property
    def paths(self) -> list[dict]:
        return self.plan.paths

    @property
    def warnings(self) -> list[str]:
        return list(self.time.warnings)

    def paths_df(self, spark: SparkSession) -> DataFrame:
        """The path table: one row per path, one-based filter indices, nulls where a path has no such filter."""
        names = list(self.paths[0])
        kind = lambda c: T.IntegerType() if c in _INT else T.DoubleType() if c in _DBL else T.StringType()
        schema = T.StructType([T.StructField(c, kind(c)) for c in names])
        return spark.createDataFrame([tuple(p[c] for c in names) for p in self.paths], schema)

    def select_paths(self, labels: list[str] | None = None, order: int | None = None, indices: list[int] | None = None):
        """The same operator for some paths only; filters that none of them needs are not applied."""
        for i in indices or ():
            self.path(i)
        chosen = {p["path_idx"] for p in self.paths if (labels is None or p["label"] in labels) and (order is None or p["order"] == order) and (indices is None or p["path_idx"] in indices)}
        if labels and (unknown := set(labels) - {p["label"] for p in self.paths}):
            raise ValueError(f"No such path: {', '.join(sorted(unknown))}.")
        other = object.__new__(type(self))
        other.__dict__ = self.__dict__ | {"wanted": chosen if self.wanted is None else chosen & self.wanted}
        return other

    def path(self, index: int | str) -> dict:
        """The metadata of a path by its place in the output, or by its label."""
        if isinstance(index, str):
            found = [p for p in self.paths if p["label"] == index]
            if not found:
                raise KeyError(f"No such path: {index}.")
            return found[0]
        if not 0 <= index < len(self.paths):
            raise IndexError(f"There are {len(self.paths)} paths, from 0; {index} is none of them.")
        return self.paths[index]

    def _banks(self) -> list[tuple[str, list[Filter]]]:
        return [("phi", [self.time.phi]), ("psi1", list(self.time.psi1)), ("psi2", list(self.time.psi2))]

    def filters_df(self, spark: SparkSession) -> DataFrame:
        """bank, idx, xi, sigma, j, h (the response at full length)."""
        rows = [(name, i, f.xi, f.sigma, f.j, f.h.tolist()) for name, bank in self._banks() for i, f in enumerate(bank, 1)]
        return spark.createDataFrame(rows, "bank string, idx int, xi double, sigma double, j int, h array<double>")

    def _input(self, df: DataFrame, signal_col: str) -> DataFrame:
        keys = [c for c in df.columns if c != signal_col]
        held = F.struct(*[F.col(f"`{c}`") for c in keys]) if keys else F.struct(F.lit(0).alias("row"))
        return df.select(held.alias("keys"), F.col(f"`{signal_col}`").cast("array<double>").alias("x"))

    def _map(self, df: DataFrame, signal_col: str, emit, constants: list[str], width: int) -> DataFrame:
        held = self._input(df, signal_col)
        schema = T.StructType().add(held.schema["keys"])
        for c in constants:
            schema = schema.add(c, T.IntegerType())
        schema = schema.add("coef", T.ArrayType(T.DoubleType()))
        keys = [c for c in df.columns if c != signal_col]
        run = _batches(self.time.n, width, self.on_error, emit, ["keys", *constants, "coef"])
        return held.mapInArrow(run, schema).select(*[F.col(f"keys.`{c}`") for c in keys], *constants, "coef")


class Scattering1D(_Operator):
    """Time scattering of signals of n samples.

    ``on_error``: "raise" fails the job on a signal of another length or with a null or a
    value that isn't finite; "skip" returns no rows for it.
    """

    def __init__(self, n, J, Q=8, T=None, T_sec=None, max_order=2, stride=None, sr=None, on_error="raise"):
        self.plan = self.time = TimePlan(n, J, Q, T, T_sec, max_order, stride, sr)
        self.on_error = on_error
        self.time.warn()

    def transform(self, df: DataFrame, signal_col: str = "x", renorm_eps: float | None = None) -> DataFrame:
        """Keys, path_idx, coef (array of double), a row per signal and path; with ``renorm_eps`` renormalised in the same stage."""
        plan, wanted = self.plan, self.wanted
        if renorm_eps is not None:
            features.check_eps(renorm_eps)

        def emit(x):
            paths = kernels.scatter_time(plan, x, wanted)
            for i, y in paths if renorm_eps is None else kernels.over_parents(plan, paths, renorm_eps):
                yield [i], y

        return self._map(df, signal_col, emit, ["path_idx"], 16 * plan.n_padded)

    def renorm(self, coefs: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
        """Of coefficients in a table; ``transform`` with ``renorm_eps`` does it without a join."""
        return features.renorm(coefs, self.paths_df(coefs.sparkSession), keys, eps)

    def features(self, df: DataFrame, keys: list[str], signal_col: str = "x", renorm_eps: float = 1e-12, quantile: float = 0.01) -> DataFrame:
        """Keys, path_idx, mean, sd, median, max: renorm, a floor per signal, log compression and four summaries per path, in the stage of the transform.

        A signal's paths never leave its task before they are summarised, so nothing is shuffled.
        ``features.pipeline`` does the same with coefficients in a table.
        """
        features.check_eps(renorm_eps)
        plan, wanted = self.plan, self.wanted

        def emit(x):
            held = list(kernels.over_parents(plan, kernels.scatter_time(plan, x, wanted), renorm_eps))
            for i, y in kernels.summarised(held, quantile, features.LEAST_EPS, features.NO_POSITIVE_EPS):
                yield [i], y

        width = 16 * plan.n_padded + sum(plan.n_padded >> (plan.log2_stride if plan.local else max(p["j2"] or p["j1"] or 0, 0)) for p in plan.paths)
        each = self._map(df.select(*keys, signal_col), signal_col, emit, ["path_idx"], width)
        return each.select(*keys, "path_idx", *[F.get("coef", i).alias(k) for i, k in enumerate(("mean", "sd", "median", "max"))])


    def feature_arrays(self, df: DataFrame, signal_col: str = "x", name: str = "features", renorm_eps: float = 1e-12, quantile: float = 0.01) -> DataFrame:
        """The rows with an array of mean, sd, median and max of every path, in path order; no row leaves its task."""
        features.check_eps(renorm_eps)
        plan, wanted = self.plan, self.wanted

        def emit(x):
            held = list(kernels.over_parents(plan, kernels.scatter_time(plan, x, wanted), renorm_eps))
            summaries = sorted(kernels.summarised(held, quantile, features.LEAST_EPS, features.NO_POSITIVE_EPS), key=lambda p: p[0])
            yield [], np.concatenate([y for _, y in summaries], axis=1)

        width = 16 * plan.n_padded + sum(plan.n_padded >> (plan.log2_stride if plan.local else max(p["j2"] or p["j1"] or 0, 0)) for p in plan.paths)
        held = df.drop(name).withColumn("_signal", F.col(f"`{signal_col}`"))
        return self._map(held, "_signal", emit, [], width).withColumnRenamed("coef", name)


class ScatteringJTFS(_Operator):
    """Joint time-frequency scattering. With global or no time average S1 stays padded and untrimmed."""

    def __init__(self, n, J, J_fr=3, Q=8, Q_fr=1, T=None, T_sec=None, F=None, stride=None, stride_fr=None, format="time", sr=None, out_type="array", on_error="raise"):
        self.time = TimePlan(n, J, Q, T, T_sec, 2, stride, sr)
        self.plan = JointPlan(self.time, J_fr, Q_fr, F, stride_fr, format, out_type)
        self.on_error = on_error
        self.time.warn()

    def _banks(self):
        return [*super()._banks(), ("phi_fr", [self.plan.phi_fr]), ("psi_fr", list(self.plan.psi_fr))]

    def _width(self) -> int:
        return 4 * self.time.n_padded * (len(self.time.psi1) + self.plan.n_padded_fr // 4)

    def _needed(self) -> tuple[set[int] | None, bool]:
        """The branches that the wanted paths lie in, None for all, and whether order 0 is wanted."""
        if self.wanted is None:
            return None, True
        return {self.plan.layout[i - 1][0] for i in self.wanted if i}, 0 in self.wanted

    def transform(self, df: DataFrame, signal_col: str = "x", renorm_eps: float | None = None) -> DataFrame:
        """Keys, path_idx, rows, cols, coef (row-major); with ``renorm_eps`` renormalised in the same stage."""
        plan, wanted, (branches, zero) = self.plan, self.wanted, self._needed()
        if renorm_eps is not None:
            self._can_renorm(renorm_eps)

        def emit(x):
            order0, s1, found = kernels.scatter_joint(plan, x, branches, zero, renorm_eps is not None)
            if renorm_eps is not None:
                found = kernels.renormed(plan, s1, found, renorm_eps)
            for i, y in kernels.joint_paths(plan, order0, found, wanted):
                yield [i, y.shape[1], y.shape[2]], y

        return self._map(df, signal_col, emit, ["path_idx", "rows", "cols"], self._width())

    def transform_tagged(self, df: DataFrame, signal_col: str = "x", renorm_eps: float | None = None) -> DataFrame:
        """Keys, part, path_idx, rows, cols, coef from one pass: rows of part 0 are paths, of part 1 bands of S1 (path_idx: the band, from one)."""
        plan, wanted, (branches, zero) = self.plan, self.wanted, self._needed()
        if renorm_eps is not None:
            self._can_renorm(renorm_eps)

        def emit(x):
            order0, s1, found = kernels.scatter_joint(plan, x, branches, zero)
            if renorm_eps is not None:
                found = kernels.renormed(plan, s1, found, renorm_eps)
            for i, y in kernels.joint_paths(plan, order0, found, wanted):
                yield [0, i, y.shape[1], y.shape[2]], y
            for band in range(s1.shape[1]):
                yield [1, band + 1, 1, s1.shape[2]], s1[:, band]

        return self._map(df, signal_col, emit, ["part", "path_idx", "rows", "cols"], self._width())

    def transform_with_s1(self, df: DataFrame, signal_col: str = "x", renorm_eps: float | None = None) -> tuple[DataFrame, DataFrame]:
        """Coefficients and S1: the cascade runs once, into a table in the shared folder of which both are parts."""
        held = tables.write(self.transform_tagged(df, signal_col, renorm_eps))
        keys = [c for c in df.columns if c != signal_col]
        bands_of = held.where("part = 1").select(*keys, F.col("path_idx").alias("band"), "coef")
        return held.where("part = 0").select(*keys, "path_idx", "rows", "cols", "coef"), bands_of

    def s1(self, df: DataFrame, signal_col: str = "x") -> DataFrame:
        """Keys, band (from one), coef: first-order coefficients, the denominators of renorm. No joint filter is applied."""
        plan = self.plan

        def emit(x):
            s1 = kernels.scatter_joint(plan, x, set(), False)[1]
            for band in range(s1.shape[1]):
                yield [band + 1], s1[:, band]

        return self._map(df, signal_col, emit, ["band"], self._width())

    def _can_renorm(self, eps: float) -> None:
        features.check_eps(eps)
        if not self.time.local:
            raise ValueError("Joint renormalisation needs local time averaging, as its denominators are local; summaries over time can follow it.")

    def renorm(self, coefs: DataFrame, s1: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
        """Joint coefficients over S1, from tables: both sides of a signal meet in one task, by a cogroup on the keys.

        S1 moves once a signal, and its denominators are made once a branch.  Fails the job where a signal of ``coefs``
        lacks bands of S1; S1 without coefficients gives nothing.  Keys must name a signal: one copy of each path and band.
        """
        self._can_renorm(eps)
        plan = self.plan
        order = ["path_idx", "rows", "cols", "coef"]
        schema = T.StructType([coefs.schema[k] for k in keys]).add("path_idx", T.IntegerType()).add("rows", T.IntegerType()).add("cols", T.IntegerType()).add("coef", T.ArrayType(T.DoubleType()))
        arrow = to_arrow_schema(schema)

        def signal(paths: pa.Table, bands: pa.Table) -> pa.Table:
            if not paths.num_rows:
                return arrow.empty_table()
            if sorted(bands.column("_band").to_pylist()) != list(range(1, len(plan.time.psi1) + 1)):
                raise ValueError("Renormalisation needs each first-order band of a signal once.")
            first = _matrix(bands.sort_by("_band").column("_s1").combine_chunks())
            denominators: dict[int, np.ndarray] = {}
            rows, cols, values = [], [], []
            coef = paths.column("coef").combine_chunks()
            flat, at = np.asarray(coef.flatten()), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(coef).to_numpy())])
            for n, (i, r, c) in enumerate(zip(*(paths.column(k).to_pylist() for k in order[:3]))):
                y = flat[at[n] : at[n + 1]].reshape(r, c)
                branch, row = plan.layout[i - 1] if i else (None, None)
                if i and plan.branches[branch].n2:
                    if branch not in denominators:
                        denominators[branch] = kernels.denominator(plan, plan.branches[branch], first[None])[0]
                    d = denominators[branch]
                    d = d[row : row + 1] if row is not None else d
                    y = y[: len(d)] / (d[: len(y)] + eps)
                rows.append(y.shape[0])
                cols.append(y.shape[1])
                values.append(y.ravel())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32())
            made = [paths.column("path_idx"), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))]
            return pa.table([*[paths.column(k) for k in keys], *made], schema=arrow)

        # Both may be parts of one table: the right side's columns get names, and so identities, of their own.
        other = s1.select(*[F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("band").alias("_band"), F.col("coef").alias("_s1"))
        return coefs.select(*keys, *order).groupBy(*keys).cogroup(other.groupBy(*other.columns[: len(keys)])).applyInArrow(signal, schema)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def bands(coefs: DataFrame, keys: list[str]) -> DataFrame:
    """Joint coefficients exploded: keys, path_idx, band, t, value."""
    each = coefs.select(*keys, "path_idx", "cols", F.posexplode("coef").alias("at", "value"))
    return each.select(*keys, "path_idx", F.floor(F.col("at") / F.col("cols")).cast("int").alias("band"), (F.col("at") % F.col("cols")).alias("t"), "value")
