"""The engine in SQL: scalar functions, and table functions that transform batches of signals.

``scattering`` and ``joint_scattering`` take a table of any columns beside the signal ``x`` and carry them through; their
schema and their errors are known when the statement is analysed.  ``scatter`` and ``scatter_joint`` work on Arrow
batches of (id bigint, x), the fastest way in, whose arguments are seen by tasks only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ondula.plans.joint_plan import JointPlan
from ondula.plans.time_plan import TimePlan

#: Values of the padded spectra that waiting signals may have.
MOST_VALUES = 1 << 21
#: Options of the table functions, besides n and J; the joint one has more.
OPTIONS = ("Q", "T", "T_sec", "max_order", "stride", "sr")
JOINT_OPTIONS = ("J_fr", "Q_fr", "F", "stride_fr", "format", "out_type", "renorm_eps")

SCALARS = {
    "log_compress(v DOUBLE, eps DOUBLE)": ("DOUBLE", "signum(v) * ln(1 + abs(v) / eps)"),
    "sigma_psi(xi DOUBLE, q INT)": ("DOUBLE", "xi * (1 - power(2, -1 / q)) / (1 + power(2, -1 / q)) / sqrt(2 * ln(sqrt(2)))"),
    "xi_max(q INT)": ("DOUBLE", "greatest(1 / (1 + power(2, 3 / q)), 0.35D)"),
    "dyadic_subsampling(xi DOUBLE, sigma DOUBLE)": ("INT", "CAST(floor(-log2(least(abs(xi) + 5 * sigma, 0.5D))) - 1 AS INT)"),
    "pad_reflect(x ARRAY<DOUBLE>, l INT, r INT)": ("ARRAY<DOUBLE>", "concat(reverse(slice(x, 2, l)), x, slice(reverse(x), 2, r))"),
    "eps_quantile(x ARRAY<DOUBLE>, p DOUBLE)": ("DOUBLE", """element_at(transform(array(array_sort(filter(x, v -> v > 0 AND NOT isnan(v) AND v < double('infinity')))), s -> CASE WHEN size(s) = 0 THEN 1e-6D ELSE greatest(2.220446049250313e-16D,
      get(s, int(floor((size(s) - 1) * p))) + ((size(s) - 1) * p - floor((size(s) - 1) * p)) * (get(s, least(int(floor((size(s) - 1) * p)) + 1, size(s) - 1)) - get(s, int(floor((size(s) - 1) * p))))) END), 1)"""),
    "summarise(x ARRAY<DOUBLE>, kind STRING)": ("DOUBLE", """element_at(transform(array(struct(array_sort(x) AS s, size(x) AS n, try_divide(aggregate(x, 0D, (a, v) -> a + v), size(x)) AS m)), r -> CASE
      WHEN kind = 'mean' THEN if(r.n > 0, r.m, double('NaN'))
      WHEN kind = 'max' THEN if(r.n > 0, array_max(r.s), double('NaN'))
      WHEN kind = 'sd' THEN if(r.n > 1, sqrt(aggregate(r.s, 0D, (a, v) -> a + (v - r.m) * (v - r.m)) / (r.n - 1)), double('NaN'))
      WHEN kind = 'median' THEN if(r.n = 0 OR exists(r.s, v -> isnan(v)), double('NaN'), (get(r.s, int((r.n - 1) / 2)) + get(r.s, int(r.n / 2))) / 2)
      ELSE raise_error(concat('Unknown summary ', kind)) END), 1)"""),
    "periods(sigma DOUBLE)": ("INT", "CAST(ceil(sqrt(-2 * sigma * sigma * ln(1e-7D)) + 1) AS INT)"),
}


def _checked(options: dict, allowed: tuple[str, ...]) -> dict:
    if unknown := set(options) - set(allowed):
        raise ValueError(f"Unknown option {', '.join(sorted(unknown))}; allowed are {', '.join(allowed)}.")

    def value(k: str, v: str):
        if k == "Q":
            return tuple(int(x) for x in v.split(","))
        if k in ("format", "out_type") or v == "global":
            return v
        return int(v) if k in ("max_order", "J_fr", "Q_fr") else float(v)

    return {k: value(k, v) for k, v in options.items()}


def plan_of(n: int, j: int, options: dict) -> TimePlan:
    """A plan from SQL options, given as text; unknown names are errors."""
    return TimePlan(n, j, **_checked(options, OPTIONS))


def joint_plan_of(n: int, j: int, options: dict) -> tuple[JointPlan, float | None]:
    """A joint plan and the eps of its renormalisation, if any, from SQL options."""
    found = _checked(options, tuple(o for o in OPTIONS if o != "max_order") + JOINT_OPTIONS)
    eps = found.pop("renorm_eps", None)
    time = TimePlan(n, j, **{k: v for k, v in found.items() if k in OPTIONS})
    return JointPlan(time, **{k: v for k, v in found.items() if k not in OPTIONS}), eps


def _first(column: pa.Array):
    """The value of an argument that is the same for all rows."""
    found = column[0].as_py()
    return dict(found) if isinstance(found, list) else found


@arrow_udtf(returnType="id bigint, path_idx int, label string, coef array<double>")
class Scatter:
    """``SELECT * FROM scatter(TABLE(SELECT id, x FROM signals), 720, 6, map('Q', '4,1'))``, a batch of signals at a time."""

    def eval(self, table, n, j, options):
        from ondula.operators import kernels
        from ondula.operators.scattering import checked

        key = (_first(n), _first(j), tuple(sorted((_first(options) or {}).items())))
        if getattr(self, "key", None) != key:
            self.key, self.plan = key, plan_of(*key[:2], dict(key[2]))
        x, rows = checked(key[0], table.column("x"), "raise")
        if len(x):
            for i, y in kernels.scatter_time(self.plan, x):
                yield _paths(table, rows, i, self.plan.paths[i]["label"], {}, y)


@arrow_udtf(returnType="id bigint, path_idx int, label string, rows int, cols int, coef array<double>")
class ScatterJoint:
    """``SELECT * FROM scatter_joint(TABLE(SELECT id, x FROM signals), 900, 7, map('Q', '8,1', 'J_fr', '3', 'format', 'joint'))``."""

    def eval(self, table, n, j, options):
        from ondula.operators import kernels
        from ondula.operators.scattering import checked

        key = (_first(n), _first(j), tuple(sorted((_first(options) or {}).items())))
        if getattr(self, "key", None) != key:
            self.key, (self.plan, self.eps) = key, joint_plan_of(*key[:2], dict(key[2]))
        x, rows = checked(key[0], table.column("x"), "raise")
        if len(x):
            zero, s1, branches = kernels.scatter_joint(self.plan, x)
            if self.eps is not None:
                branches = kernels.renormed(self.plan, s1, branches, self.eps)
            for i, y in kernels.joint_paths(self.plan, zero, branches):
                yield _paths(table, rows, i, self.plan.paths[i]["label"], {"rows": y.shape[1], "cols": y.shape[2]}, y)


def _paths(table: pa.RecordBatch, rows, i: int, label: str, fixed: dict[str, int], y) -> pa.Table:
    """A path of each signal."""
    flat = y.reshape(len(y), -1)
    cols = {"id": table.column("id").take(pa.array(rows)).cast(pa.int64()), "path_idx": pa.array([i] * len(y), pa.int32()), "label": pa.array([label] * len(y))}
    cols |= {k: pa.array([v] * len(y), pa.int32()) for k, v in fixed.items()}
    return pa.table(cols | {"coef": pa.array(list(flat), pa.list_(pa.float64()))})


@dataclass
class Planned(AnalyzeResult):
    """What analysis found: the schema, and the arguments that a task builds its plan from."""

    arguments: tuple = field(default=())


def _analysed(table: AnalyzeArgument, n: AnalyzeArgument, j: AnalyzeArgument, options: AnalyzeArgument | None, joint: bool) -> Planned:
    """The schema of a call, its keys carried through. Every error in the arguments is raised here, before there is a job."""
    if not table.isTable:
        raise ValueError("The first argument has to be a table: TABLE(SELECT ...).")
    fields = {f.name: f for f in table.dataType.fields}
    if "x" not in fields:
        raise ValueError(f"The table has no column x of signals, but {', '.join(fields)}.")
    if not isinstance(fields["x"].dataType, T.ArrayType) or not isinstance(fields["x"].dataType.elementType, T.NumericType):
        raise ValueError(f"Column x has to be an array of numbers, not {fields['x'].dataType.simpleString()}.")
    if any(a is not None and (not a.isConstantExpression or a.value is None) for a in (n, j, options)):
        raise ValueError("Length, J and options have to be constants.")
    given = dict(options.value) if options is not None else {}
    # Building the plan checks the rest.
    joint_plan_of(n.value, j.value, given) if joint else plan_of(n.value, j.value, given)
    made = [("path_idx", T.IntegerType()), ("label", T.StringType())]
    made += [("rows", T.IntegerType()), ("cols", T.IntegerType())] if joint else []
    made += [("coef", T.ArrayType(T.DoubleType()))]
    if clash := {c for c, _ in made} & fields.keys():
        raise ValueError(f"The result has columns of its own named {', '.join(sorted(clash))}; rename the table's.")
    keys = [f for name, f in fields.items() if name != "x"]
    return Planned(schema=T.StructType([*keys, *(T.StructField(*c) for c in made)]), arguments=(n.value, j.value, tuple(sorted(given.items()))))


class _Buffered:
    """Rows wait until they fill a matrix, so a plan works on many signals at once."""

    def __init__(self, planned: Planned):
        self.n, j, options = planned.arguments
        self._plan(j, dict(options))
        self.held, self.most = [], max(1, MOST_VALUES // self.width)

    def eval(self, row, n, j, options=None):
        self.held.append(row)
        if len(self.held) >= self.most:
            yield from self._flush()

    def terminate(self):
        yield from self._flush()

    def _flush(self):
        held, self.held = self.held, []
        if held:
            from ondula.operators.scattering import checked

            x, _ = checked(self.n, pa.array([r.x for r in held], pa.list_(pa.float64())), "raise")
            at = [i for i, c in enumerate(held[0].__fields__) if c != "x"]
            keys = [tuple(r[i] for i in at) for r in held]
            for i, label, fixed, y in self._paths(x):
                for key, values in zip(keys, y.reshape(len(keys), -1).tolist()):
                    yield (*key, i, label, *fixed, values)


@udtf(useArrow=True)
class ScatterTable(_Buffered):
    """``SELECT * FROM scattering(TABLE(SELECT name, day, x FROM signals), 720, 6, map('Q', '4,1'))``: any columns, x the signal."""

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument, j: AnalyzeArgument, options: AnalyzeArgument = None) -> Planned:
        return _analysed(table, n, j, options, False)

    def _plan(self, j, options):
        self.plan = plan_of(self.n, j, options)
        self.width = 16 * self.plan.n_padded

    def _paths(self, x):
        from ondula.operators import kernels

        for i, y in kernels.scatter_time(self.plan, x):
            yield i, self.plan.paths[i]["label"], (), y


@udtf(useArrow=True)
class JointTable(_Buffered):
    """``SELECT * FROM joint_scattering(TABLE(SELECT name, x FROM signals), 900, 7, map('Q', '8,1', 'format', 'joint'))``."""

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument, j: AnalyzeArgument, options: AnalyzeArgument = None) -> Planned:
        return _analysed(table, n, j, options, True)

    def _plan(self, j, options):
        self.plan, self.eps = joint_plan_of(self.n, j, options)
        self.width = 4 * self.plan.time.n_padded * (len(self.plan.time.psi1) + self.plan.n_padded_fr // 4)

    def _paths(self, x):
        from ondula.operators import kernels

        zero, s1, branches = kernels.scatter_joint(self.plan, x, s1=self.eps is not None)
        if self.eps is not None:
            branches = kernels.renormed(self.plan, s1, branches, self.eps)
        for i, y in kernels.joint_paths(self.plan, zero, branches):
            yield i, self.plan.paths[i]["label"], (y.shape[1], y.shape[2]), y


def register(spark: SparkSession) -> None:
    """Temporary functions of this session. Inside lambdas of SQL's transform() use the Column builders instead."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("scatter", Scatter)
    spark.udtf.register("scatter_joint", ScatterJoint)
    spark.udtf.register("scattering", ScatterTable)
    spark.udtf.register("joint_scattering", JointTable)
