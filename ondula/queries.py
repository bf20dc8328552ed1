"""The engine's queries on the test tables, each with SQL that says the same."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.functions import arrays, exact, features, ranks, running
from ondula.functions import sql as functions
from ondula.operators.scattering import Scattering1D, ScatteringJTFS, bands
from ondula.plans import filters, oracle
from ondula.sources import reports, signals
from ondula.streaming.windows import windowed_signals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KINDS = ("mean", "sd", "median", "max")
#: Bins of the events' signals, from the first second of the table to its last.
BINS = 64


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.from_arrays(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding").withColumnRenamed("vec_id", "id")


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.spanned(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", BINS).withColumnRenamed("event_type", "id")


EMBEDDINGS = "SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings"
EVENTS = f"""SELECT id, list(coalesce(v, 0.0) ORDER BY bin) AS x FROM (SELECT DISTINCT event_type AS id FROM events WHERE value IS NOT NULL AND ts IS NOT NULL) k CROSS JOIN generate_series(0, {BINS - 1}) b(bin)
  LEFT JOIN (SELECT event_type AS id, CAST(floor((floor(epoch(ts)) - s0) / width) AS BIGINT) AS bin, sum(value) AS v
    FROM events, (SELECT floor(epoch(min(ts))) AS s0, ceil((floor(epoch(max(ts))) + 1 - floor(epoch(min(ts)))) / {BINS}) AS width FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)
    WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL) s USING (id, bin) GROUP BY id"""

def rounded(v: Column | str, digits: int = 6) -> Column:
    return F.round(v, digits) + F.lit(0.0)


def coefficients(coefs: DataFrame) -> DataFrame:
    return coefs.select("id", "path_idx", F.posexplode("coef").alias("t", "v")).select("id", "path_idx", "t", rounded("v").alias("value"))


def quiet(make):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return make()


# Padding, periodisation, Fourier sums


@query("pad_reflect", "SELECT id, unnest(generate_series(0, 127))::INT AS t, unnest(list_concat(list_reverse(x[2:33]), x, list_reverse(x[32:63]))) AS value FROM (" + EMBEDDINGS + ")")
def pad_reflect(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", F.posexplode(arrays.pad_reflect(F.col("x"), 32, 32)).alias("t", "value"))


@query("unpad_round_trip", "SELECT id, unnest(generate_series(0, 63))::INT AS t, unnest(x) AS value FROM (" + EMBEDDINGS + ")")
def unpad_round_trip(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", F.posexplode(arrays.unpad(arrays.pad_reflect(F.col("x"), 32, 32), 32, 96)).alias("t", "value"))


@query("border_levels", "WITH RECURSIVE b AS (SELECT 0 AS level, 664 AS s, 1384 AS e UNION ALL SELECT level + 1, s // 2 + s % 2, e // 2 + e % 2 FROM b WHERE level < 6) SELECT level::INT AS level, s::INT AS s, e::INT AS e FROM b")
def border_levels(spark, sf_dir):
    plan = Scattering1D(720, 6, Q=(4, 1)).time
    return spark.createDataFrame([(k, s, e) for k, (s, e) in enumerate(plan.borders)], "level int, s int, e int")


@query("fftfreq", "SELECT i::INT AS i, CASE WHEN i <= 63 THEN i / 128.0::DOUBLE ELSE (i - 128) / 128.0::DOUBLE END AS freq FROM generate_series(0, 127) g(i)")
def fftfreq(spark, sf_dir):
    return spark.range(1).select(F.posexplode(arrays.fftfreq(128)).alias("i", "freq"))


@query("periodize_sum", "SELECT id, i::INT AS i, round(sum(x[b * 16 + i + 1]), 6) + 0.0 AS value FROM (" + EMBEDDINGS + "), generate_series(0, 15) g(i), generate_series(0, 3) h(b) GROUP BY id, i")
def periodize_sum(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", F.posexplode(arrays.periodize(F.col("x"), 4)).alias("i", "v")).select("id", "i", rounded("v").alias("value"))


@query("filter_periodize", "SELECT id, i::INT AS i, round(sum(x[b * 32 + i + 1] * (b * 32 + i) / 64.0) / 2, 6) + 0.0 AS re, round(sum(-x[64 - b * 32 - i] * (b * 32 + i) / 64.0) / 2, 6) + 0.0 AS im FROM (" + EMBEDDINGS + "), generate_series(0, 31) g(i), generate_series(0, 1) h(b) GROUP BY id, i")
def filter_periodize(spark, sf_dir):
    z = F.zip_with("x", F.reverse("x"), lambda a, b: arrays.conj(arrays.complex_(a, b)))
    ramp = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / 64.0)
    each = embeddings(spark, sf_dir).select("id", F.posexplode(arrays.filter_periodize(z, ramp, 2)).alias("i", "z"))
    return each.select("id", "i", rounded("z.re").alias("re"), rounded("z.im").alias("im"))


@query("complex_arithmetic", "SELECT vec_id AS id, round(a * c - b * d, 6) + 0.0 AS re, round(a * d + b * c, 6) + 0.0 AS im, round(sqrt(a * a + b * b), 6) + 0.0 AS norm, round((a - c) / 2, 6) + 0.0 AS half FROM (SELECT vec_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c, embedding[4]::DOUBLE d FROM embeddings)")
def complex_arithmetic(spark, sf_dir):
    x = F.col("x")
    a, b = arrays.complex_(x[0], x[1]), arrays.complex_(x[2], x[3])
    held = embeddings(spark, sf_dir).select("id", arrays.multiply(a, b).alias("p"), arrays.norm(a).alias("n"), arrays.unscale(arrays.subtract(a, b), 2.0).alias("h"))
    return held.select("id", rounded("p.re").alias("re"), rounded("p.im").alias("im"), rounded("n").alias("norm"), rounded("h.re").alias("half"))


@query("complex_arithmetic_all", "SELECT id, k::INT AS k, round(a * c - b * d, 6) + 0.0 AS re, round(a * d + b * c, 6) + 0.0 AS im, round(sqrt(a * a + b * b), 6) + 0.0 AS norm, round((a - c) / 2, 6) + 0.0 AS half FROM (SELECT id, k, x[4 * k + 1] AS a, x[4 * k + 2] AS b, x[4 * k + 3] AS c, x[4 * k + 4] AS d FROM (" + EMBEDDINGS + "), generate_series(0, 15) g(k))")
def complex_arithmetic_all(spark, sf_dir):
    """Each four values of a vector are two complex numbers, as the first four are in ``complex_arithmetic``."""
    four = embeddings(spark, sf_dir).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 4).cast("int") - 1), lambda k: F.slice("x", 4 * k + 1, 4))).alias("k", "x"))
    x = F.col("x")
    a, b = arrays.complex_(x[0], x[1]), arrays.complex_(x[2], x[3])
    held = four.select("id", "k", arrays.multiply(a, b).alias("p"), arrays.norm(a).alias("n"), arrays.unscale(arrays.subtract(a, b), 2.0).alias("h"))
    return held.select("id", "k", rounded("p.re").alias("re"), rounded("p.im").alias("im"), rounded("n").alias("norm"), rounded("h.re").alias("half"))


@query("ordered_sum", "SELECT id, round(list_sum(x), 6) + 0.0 AS value FROM (" + EMBEDDINGS + ")")
def ordered_sum(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", rounded(arrays.ordered_sum(F.col("x"))).alias("value"))


_DFT = "SELECT id, k::INT AS k, round(power(sum(x[t + 1] * cos(2 * pi() * ((k * t) % 64) / 64)), 2) + power(sum(x[t + 1] * sin(2 * pi() * ((k * t) % 64) / 64)), 2), 6) + 0.0 AS power FROM (" + EMBEDDINGS + "), generate_series(0, 63) g(k), generate_series(0, 63) h(t) GROUP BY id, k"


@query("dft_power", _DFT)
def dft_power(spark, sf_dir):
    """Power spectra by the fast transform, an Arrow batch at a time."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, 64)
            p = np.abs(np.fft.fft(x, axis=1)) ** 2
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(p), pa.list_(pa.float64()))], names=["id", "p"])

    return embeddings(spark, sf_dir).mapInArrow(run, "id long, p array<double>").select("id", F.posexplode("p").alias("k", "v")).select("id", "k", rounded("v").alias("power"))


def _there_and_back(x: Column) -> Column:
    return arrays.dft(arrays.dft(arrays.as_complex(x), BINS), BINS, inverse=True)


@query("dft_round_trip", "SELECT event_type AS id, 1 AS ok FROM (SELECT DISTINCT event_type FROM events)")
def dft_round_trip(spark, sf_dir):
    back = _there_and_back(F.col("x"))
    near = F.forall(F.zip_with(back, "x", lambda z, v: F.abs(z.re - v) + F.abs(z.im) < 1e-6 * (1 + F.abs(v))), lambda b: b)
    return event_signals(spark, sf_dir).select("id", near.cast("int").alias("ok"))


@query("dft_round_trip_values", f"SELECT id, unnest(generate_series(0, {BINS - 1}))::INT AS t, round(unnest(x), 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM ({EVENTS})")
def dft_round_trip_values(spark, sf_dir):
    each = event_signals(spark, sf_dir).select("id", F.posexplode(_there_and_back(F.col("x"))).alias("t", "z"))
    return each.select("id", "t", rounded("z.re").alias("re"), rounded("z.im").alias("im"))


# Filters, schedules, paths

_SCHEDULE = """WITH RECURSIVE p AS (SELECT 6 AS j, 4 AS q, 0.1 / 64 AS least, power(2, 1 / 4.0) AS step, greatest(1 / (1 + power(2, 3 / 4.0)), 0.35) AS xi0),
s AS (SELECT *, xi0 * (1 - 1 / step) / (1 + 1 / step) / sqrt(2 * ln(sqrt(2.0))) AS sigma0 FROM p),
a AS (SELECT 1 AS i, xi0 AS xi, sigma0 AS sigma, step, least, q FROM s UNION ALL SELECT i + 1, xi / step, sigma / step, step, least, q FROM a WHERE sigma > least * step),
l AS (SELECT * FROM a ORDER BY i DESC LIMIT 1),
f AS (SELECT i, xi, sigma FROM a UNION ALL SELECT l.i + m, l.xi - m * l.xi / l.q, l.least FROM l, generate_series(1, 3) g(m))
SELECT i::INT AS idx, round(xi, 9) + 0.0 AS xi, round(sigma, 9) + 0.0 AS sigma, CAST(floor(-log2(least(abs(xi) + 5 * sigma, 0.5))) - 1 AS INT) AS j FROM f"""


@query("filter_schedule", _SCHEDULE)
def filter_schedule(spark, sf_dir):
    rows = [(i, xi, s, filters.subsampling(xi, s)) for i, (xi, s) in enumerate(filters.schedule(6, 4), 1)]
    return spark.createDataFrame(rows, "idx int, xi double, sigma double, j int").select("idx", rounded("xi", 9).alias("xi"), rounded("sigma", 9).alias("sigma"), "j")


_SPUN = quiet(lambda: ScatteringJTFS(64, 3, J_fr=2, Q=4, format="joint"))


def _bank_sql(name: str, n: int, banks) -> str:
    return f"WITH {oracle.kernels('g', n, banks)} SELECT h.bank::INT AS bank, h.idx::INT AS idx, w::INT AS w, round(h / l, 9) + 0.0 AS h FROM g_h h JOIN g_l USING (bank, idx)"


_PLAN64 = quiet(lambda: Scattering1D(64, 3, Q=1))


@query("filter_bank", _bank_sql("g", 128, oracle._time_banks(_PLAN64.time)))
def filter_bank(spark, sf_dir):
    number = F.when(F.col("bank") == "phi", 0).when(F.col("bank") == "psi1", 1).otherwise(2)
    each = _PLAN64.filters_df(spark).select(number.alias("bank"), F.when(F.col("bank") == "phi", 0).otherwise(F.col("idx")).alias("idx"), F.posexplode("h").alias("w", "h"))
    return each.select("bank", "idx", "w", rounded("h", 9).alias("h"))


@query("path_table", f"""WITH f(bank, idx, j) AS (VALUES {oracle._values([(1, i, f.j) for i, f in enumerate(Scattering1D(720, 6, Q=(4, 1)).time.psi1, 1)] + [(2, i, f.j) for i, f in enumerate(Scattering1D(720, 6, Q=(4, 1)).time.psi2, 1)])}),
p AS (SELECT 0 AS ord, NULL AS n1, NULL AS n2, 'S0' AS label UNION ALL SELECT 1, idx, NULL, 'S1_' || idx FROM f WHERE bank = 1 UNION ALL SELECT 2, a.idx, b.idx, 'S2_' || a.idx || '_' || b.idx FROM f a JOIN f b ON a.bank = 1 AND b.bank = 2 AND b.j > a.j)
SELECT (row_number() OVER (ORDER BY ord, n1, n2) - 1)::INT AS path_idx, ord::INT AS "order", n1::INT AS n1, n2::INT AS n2, label FROM p""")
def path_table(spark, sf_dir):
    return Scattering1D(720, 6, Q=(4, 1)).paths_df(spark).select("path_idx", "order", "n1", "n2", "label")


@query("joint_path_table", oracle.joint_paths_sql(_SPUN.plan))
def joint_path_table(spark, sf_dir):
    return _SPUN.paths_df(spark)


# Time scattering


def _scatter(name: str, make, source, sql_source: str):
    op = quiet(make)

    @query(name, oracle.time_sql(op.time, sql_source))
    def run(spark, sf_dir):
        return coefficients(quiet(make).transform(source(spark, sf_dir)))


_scatter("scatter_embeddings", lambda: Scattering1D(64, 3, Q=1), embeddings, EMBEDDINGS)
_scatter("scatter_order1", lambda: Scattering1D(64, 2, Q=(2, 1), max_order=1), embeddings, EMBEDDINGS)
_scatter("scatter_global", lambda: Scattering1D(64, 3, Q=1, T="global"), event_signals, EVENTS)
_scatter("scatter_unaveraged", lambda: Scattering1D(64, 3, Q=1, T=0), event_signals, EVENTS)
_scatter("scatter_stride", lambda: Scattering1D(64, 3, Q=1, stride=2), event_signals, EVENTS)
_scatter("scatter_events", lambda: Scattering1D(64, 3, Q=(4, 1), T=5), event_signals, EVENTS)

_WIDE = quiet(lambda: Scattering1D(64, 3, Q=(4, 2), T=8))


@query("scatter_derived", oracle.derived_time_sql(3, (4, 2), 8, 64, (_WIDE.time.n_padded, _WIDE.time.pad[0]), EVENTS))
def scatter_derived(spark, sf_dir):
    """The SQL makes centres, widths, levels and pairs of filters from J, Q and T itself."""
    return coefficients(_WIDE.transform(event_signals(spark, sf_dir)))


_COEFS = oracle.time_sql(_PLAN64.time, EMBEDDINGS, digits=14)


_EVENT_COEFS = oracle.time_sql(_PLAN64.time, EVENTS, digits=14)


@query("scatter_selected", f"SELECT id, path_idx, t, round(value, 6) + 0.0 AS value FROM ({_EVENT_COEFS}) WHERE path_idx = 2")
def scatter_selected(spark, sf_dir):
    return coefficients(_PLAN64.select_paths(labels=["S1_2"]).transform(event_signals(spark, sf_dir)))


@query("floors_events", f"WITH c AS ({_EVENT_COEFS}) SELECT id, round(greatest(quantile_cont(value, 0.25) FILTER (WHERE value > 0), 2.220446049250313e-16), 6) + 0.0 AS eps FROM c GROUP BY id")
def floors_events(spark, sf_dir):
    return features.floors(_PLAN64.transform(event_signals(spark, sf_dir)), ["id"], 0.25).select("id", rounded("eps").alias("eps"))


@query("event_bins", f"SELECT id, unnest(generate_series(0, {BINS - 1}))::INT AS t, round(unnest(x), 6) + 0.0 AS value FROM ({EVENTS})")
def event_bins(spark, sf_dir):
    return event_signals(spark, sf_dir).select("id", F.posexplode("x").alias("t", "v")).select("id", "t", rounded("v").alias("value"))


_META = f"p(path_idx, ord, n1) AS (VALUES {oracle._values([(p['path_idx'], p['order'], p['n1']) for p in _PLAN64.paths])})"


def _renorm_sql(coefs: str) -> str:
    return f"""WITH c AS MATERIALIZED ({coefs}), {_META}, cp AS (SELECT * FROM c JOIN p USING (path_idx)),
r AS MATERIALIZED (SELECT a.id, a.path_idx, a.t, CASE WHEN a.ord = 2 THEN a.value / (b.value + 1e-3) ELSE a.value END AS v FROM cp a LEFT JOIN cp b ON a.ord = 2 AND b.ord = 1 AND a.id = b.id AND a.n1 = b.n1 AND a.t = b.t)"""


_RENORM, _RENORM_EVENTS = _renorm_sql(_COEFS), _renorm_sql(_EVENT_COEFS)


@query("renorm_embeddings", _RENORM + " SELECT id, path_idx, t, round(v, 6) + 0.0 AS value FROM r")
def renorm_embeddings(spark, sf_dir):
    return coefficients(_PLAN64.transform(embeddings(spark, sf_dir), renorm_eps=1e-3))


@query("renorm_events", _RENORM_EVENTS + " SELECT id, path_idx, t, round(v, 6) + 0.0 AS value FROM r")
def renorm_events(spark, sf_dir):
    """Of coefficients in a table: second-order rows meet their parents by a join."""
    return coefficients(_PLAN64.renorm(_PLAN64.transform(event_signals(spark, sf_dir)), ["id"], 1e-3))


_LOGS = """, e AS (SELECT id, CASE WHEN max(v) > 0 THEN greatest(quantile_cont(v, 0.01) FILTER (WHERE v > 0), 2.220446049250313e-16) ELSE 1e-6 END AS eps FROM r GROUP BY id),
k AS (SELECT id, path_idx, sign(v) * ln(1 + abs(v) / eps) AS v FROM r JOIN e USING (id))
SELECT id, path_idx, round(avg(v), 5) + 0.0 AS mean, round(stddev_samp(v), 5) + 0.0 AS sd, round(median(v), 5) + 0.0 AS median, round(max(v), 5) + 0.0 AS max FROM k GROUP BY id, path_idx"""
_FEATURES = _RENORM + _LOGS


@query("features_embeddings", _FEATURES)
def features_embeddings(spark, sf_dir):
    out = _PLAN64.features(embeddings(spark, sf_dir), ["id"], renorm_eps=1e-3)
    return out.select("id", "path_idx", *[rounded(k, 5).alias(k) for k in KINDS])


@query("features_events", _RENORM_EVENTS + _LOGS)
def features_events(spark, sf_dir):
    """The same steps on coefficients in a table, a signal's paths gathered in one row."""
    coefs = _PLAN64.transform(event_signals(spark, sf_dir))
    out = features.pipeline(coefs, _PLAN64.paths_df(spark), ["id"], renorm_eps=1e-3)
    return out.select("id", "path_idx", *[rounded(k, 5).alias(k) for k in KINDS])


# Joint scattering


def _joint(name: str, make, renorm_eps: float | None = None):
    op = quiet(make)

    @query(name, oracle.joint_sql(op.plan, EVENTS, renorm_eps=renorm_eps))
    def run(spark, sf_dir):
        out = bands(quiet(make).transform(event_signals(spark, sf_dir), renorm_eps=renorm_eps), ["id"])
        return out.select("id", "path_idx", "band", "t", rounded("value").alias("value"))


_joint("joint_events", lambda: ScatteringJTFS(64, 3, J_fr=2, Q=4, format="joint"))
_joint("joint_global_frequency", lambda: ScatteringJTFS(64, 3, J_fr=2, Q=4, F="global", format="joint"))
_joint("joint_unaveraged_frequency", lambda: ScatteringJTFS(64, 3, J_fr=2, Q=4, F=0, format="joint", out_type="list"))
_joint("joint_renorm", lambda: ScatteringJTFS(64, 3, J_fr=2, Q=4, format="joint"), 1e-3)
_joint("joint_renorm_global", lambda: ScatteringJTFS(64, 3, J_fr=2, Q=4, F="global", format="joint"), 1e-3)


_joint("joint_renorm_unaveraged", lambda: ScatteringJTFS(64, 3, J_fr=2, Q=4, F=0, format="joint", out_type="list"), 1e-3)
_TIMED = quiet(lambda: ScatteringJTFS(64, 3, J_fr=2, Q=4))


@query("joint_time_format", oracle.time_format_sql(_TIMED.plan, EVENTS))
def joint_time_format(spark, sf_dir):
    return coefficients(_TIMED.transform(event_signals(spark, sf_dir)))


_S1 = quiet(lambda: Scattering1D(64, 3, Q=4))


@query("joint_s1", f"SELECT id, path_idx AS band, t, value FROM ({oracle.time_sql(_S1.time, EVENTS)}) WHERE path_idx BETWEEN 1 AND {len(_S1.time.psi1)}")
def joint_s1(spark, sf_dir):
    s1 = _SPUN.s1(event_signals(spark, sf_dir))
    return s1.select("id", "band", F.posexplode("coef").alias("t", "v")).select("id", "band", "t", rounded("v").alias("value"))


def _joint_sql(op: ScatteringJTFS, where: str = "", renorm_eps: float | None = None) -> str:
    return f"SELECT id, path_idx, band, t, value FROM ({oracle.joint_sql(op.plan, EVENTS, renorm_eps=renorm_eps)}){where}"


_FINE = quiet(lambda: ScatteringJTFS(64, 3, J_fr=2, Q=(4, 2), Q_fr=2, format="joint"))


@query("joint_derived", oracle.joint_sql(_FINE.plan, EVENTS, derived=True))
def joint_derived(spark, sf_dir):
    """The SQL makes filters, branches and their order from J, Q, J_fr and Q_fr itself."""
    out = bands(_FINE.transform(event_signals(spark, sf_dir)), ["id"])
    return out.select("id", "path_idx", "band", "t", rounded("value").alias("value"))


_FEW = [2, 7, 0, len(_SPUN.paths) - 1]


@query("joint_selected", _joint_sql(_SPUN, f" WHERE path_idx IN ({', '.join(map(str, _FEW))})"))
def joint_selected(spark, sf_dir):
    """A few joint paths; filters that none of them needs are not applied."""
    out = bands(_SPUN.select_paths(indices=_FEW).transform(event_signals(spark, sf_dir)), ["id"])
    return out.select("id", "path_idx", "band", "t", rounded("value").alias("value"))


_S1_OF_EVENTS = f"SELECT id, path_idx AS band, t, value FROM ({oracle.time_sql(_S1.time, EVENTS)}) WHERE path_idx BETWEEN 1 AND {len(_S1.time.psi1)}"


@query("joint_with_s1", f"SELECT 0 AS part, id, path_idx, band, t, value FROM ({_joint_sql(_SPUN)}) UNION ALL SELECT 1, id, band, 0, t, value FROM ({_S1_OF_EVENTS})")
def joint_with_s1(spark, sf_dir):
    """Joint coefficients and S1 of one pass over the signals."""
    held = _SPUN.transform_tagged(event_signals(spark, sf_dir))
    each = held.select("part", "id", "path_idx", "cols", F.posexplode("coef").alias("at", "v"))
    return each.select("part", "id", "path_idx", F.floor(F.col("at") / F.col("cols")).cast("int").alias("band"), (F.col("at") % F.col("cols")).cast("int").alias("t"), rounded("v").alias("value"))


@query("joint_renorm_tables", _joint_sql(_SPUN, renorm_eps=1e-3))
def joint_renorm_tables(spark, sf_dir):
    """Renormalisation of stored coefficients and S1, a cogroup of both tables."""
    coefs, s1 = _SPUN.transform_with_s1(event_signals(spark, sf_dir))
    out = bands(_SPUN.renorm(coefs, s1, ["id"], 1e-3), ["id"])
    return out.select("id", "path_idx", "band", "t", rounded("value").alias("value"))


@query("joint_labelled", f"""SELECT c.id, p.label, p."order", c.band, c.t, c.value FROM ({_joint_sql(_SPUN)}) c JOIN ({oracle.joint_paths_sql(_SPUN.plan)}) p USING (path_idx)""")
def joint_labelled(spark, sf_dir):
    """Joint coefficients with the labels of their paths."""
    out = bands(_SPUN.transform(event_signals(spark, sf_dir)), ["id"])
    paths = F.broadcast(_SPUN.paths_df(spark).select("path_idx", "label", "order"))  # a row for each path
    return out.join(paths, "path_idx").select("id", "label", "order", "band", "t", rounded("value").alias("value"))


# Reports on tables of coefficients


@query("coefficient_report", f"SELECT path_idx, count(*) AS n, round(sum(value), 5) + 0.0 AS total, round(sum(value * value), 3) + 0.0 AS squares, round(max(abs(value)), 6) + 0.0 AS most FROM ({_EVENT_COEFS}) GROUP BY path_idx")
def coefficient_report(spark, sf_dir):
    """Number, exact sums and largest size of each path's coefficients."""
    out = reports.table_report(_PLAN64.transform(event_signals(spark, sf_dir)))
    return out.select("path_idx", "n", rounded("total", 5).alias("total"), rounded("squares", 3).alias("squares"), rounded("most").alias("most"))


_COARSE = "SELECT id, list_transform(x, lambda v: round(v, -2)) AS x FROM (" + EVENTS + ")"
_APART = 50.0


@query("coefficient_differences", f"""WITH a AS MATERIALIZED ({_EVENT_COEFS}), b AS MATERIALIZED ({oracle.time_sql(_PLAN64.time, _COARSE, digits=14)})
SELECT path_idx, 0::BIGINT AS only_one, 0::BIGINT AS lengths, count(*) FILTER (WHERE abs(a.value - b.value) > {_APART}) AS apart, round(max(abs(a.value - b.value)), 5) + 0.0 AS worst FROM a JOIN b USING (id, path_idx, t) GROUP BY path_idx""")
def coefficient_differences(spark, sf_dir):
    """What rounding the samples to hundreds does to the coefficients of each path."""
    plain = event_signals(spark, sf_dir)
    coarse = plain.withColumn("x", F.transform("x", lambda v: F.round(v, -2)))
    out = reports.table_differences(_PLAN64.transform(plain), _PLAN64.transform(coarse), ["id"], _APART)
    return out.select("path_idx", "only_one", "lengths", "apart", rounded("worst", 5).alias("worst"))


@query("synthetic_of_keys", """WITH RECURSIVE s AS (SELECT vec_id AS id, 0 AS i, (vec_id::HUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 AS s FROM embeddings UNION ALL SELECT id, i + 1, (s * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM s WHERE i < 63)
SELECT id, i::INT AS t, round((s // 2048)::DOUBLE / 4503599627370496 - 1 + (i % 97 - 48) / 64.0::DOUBLE, 9) + 0.0 AS value FROM s""")
def synthetic_of_keys(spark, sf_dir):
    """A reproducible signal for each row of the table, seeded by its key."""
    seeds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return signals.synthetic_of(seeds, ["id"], "id", 64).select("id", F.posexplode("x").alias("t", "v")).select("id", "t", rounded("v", 9).alias("value"))


_NAMES = [(p["path_idx"], repr(p["label"])) for p in _PLAN64.paths]
_NAMED = ", ".join(f"('{k}')" for k in KINDS)


@query("features_named", _RENORM_EVENTS + _LOGS.replace("SELECT id, path_idx, round(avg(v), 5)", f", fe AS (SELECT id, path_idx, round(avg(v), 5)") + f""")
SELECT id, kind || ' ' || label AS name, CASE kind WHEN 'mean' THEN mean WHEN 'sd' THEN sd WHEN 'median' THEN median ELSE max END AS value FROM fe JOIN (VALUES {oracle._values(_NAMES)}) l(path_idx, label) USING (path_idx), (VALUES {_NAMED}) n(kind)""")
def features_named(spark, sf_dir):
    """A signal's features with their names: summary and path."""
    names = F.array(*[F.lit(f"{k} {p['label']}") for p in _PLAN64.paths for k in KINDS])
    held = _PLAN64.feature_arrays(event_signals(spark, sf_dir), "x", "f", 1e-3)
    each = held.select("id", F.inline(F.arrays_zip(names.alias("name"), F.col("f").alias("v"))))
    return each.toDF("id", "name", "v").select("id", "name", rounded("v", 5).alias("value"))


# Sums and ranks that no order or group size changes


def _exact_sum(source: str, key: str, value: str) -> str:
    """Sum in whole units of 2^-80, rounded to 53 bits by whole-number arithmetic, ties to even."""
    return f"""WITH s AS (SELECT {key} AS id, count({value}) AS n, sum(CAST({value}::DOUBLE * power(2, 80) AS HUGEINT))::HUGEINT AS s FROM {source} GROUP BY 1),
a AS (SELECT id, n, s, abs(s)::HUGEINT AS a FROM s),
b AS (SELECT *, (SELECT count(*) FROM generate_series(0, 125) g(k) WHERE (a.a >> k) > 0)::INT AS bits FROM a),
c AS (SELECT *, greatest(bits - 53, 1) AS d FROM b),
q AS (SELECT *, a >> d AS q, a - ((a >> d) << d) AS r, 1::HUGEINT << (d - 1) AS half FROM c)
SELECT id, n, CASE WHEN s < 0 THEN -1 ELSE 1 END * (q + CASE WHEN r > half OR (r = half AND q % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE * power(2.0, d - 80) + 0.0 AS total FROM q"""


@query("exact_sums_events", _exact_sum("events", "event_type", "value"))
def exact_sums_events(spark, sf_dir):
    """Sums rounded once: not a digit is lost, so the values are compared as they are."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "id")
    n = events.groupBy("id").agg(F.count("value").alias("n")).withColumnRenamed("id", "n_id")
    out = exact.sums(events, ["id"], ["value"]).join(n, F.col("id").eqNullSafe(F.col("n_id")))
    return out.select("id", "n", F.col("value").alias("total"))


@query("exact_sums_embeddings", _exact_sum("(SELECT label, unnest(embedding) AS v FROM embeddings)", "label", "v"))
def exact_sums_embeddings(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.explode("embedding").alias("v"))
    n = each.groupBy("id").agg(F.count("v").alias("n")).withColumnRenamed("id", "n_id")
    out = exact.sums(each, ["id"], ["v"]).join(n, F.col("id").eqNullSafe(F.col("n_id")))
    return out.select("id", "n", F.col("v").alias("total"))


_SHARES = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


def _quantile_rows(out: DataFrame, *keys: str) -> DataFrame:
    return out.select(*keys, "n", F.posexplode("quantiles").alias("i", "v")).select(*keys, "n", "i", rounded("v").alias("value"))


@query("rank_quantiles", f"SELECT n, unnest(generate_series(0, {len(_SHARES) - 1}))::INT AS i, round(unnest(q), 6) + 0.0 AS value FROM (SELECT count(l_extendedprice) AS n, quantile_cont(l_extendedprice, {_SHARES}) AS q FROM lineitem)")
def rank_quantiles(spark, sf_dir):
    """All rows as one group."""
    return _quantile_rows(ranks.quantiles(table(spark, sf_dir, "lineitem"), [], "l_extendedprice", _SHARES))


@query("rank_quantiles_embeddings", f"SELECT id, n, unnest(generate_series(0, {len(_SHARES) - 1}))::INT AS i, round(unnest(q), 6) + 0.0 AS value FROM (SELECT label AS id, count(v) AS n, quantile_cont(v::DOUBLE, {_SHARES}) AS q FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY label)")
def rank_quantiles_embeddings(spark, sf_dir):
    """All values of all vectors of a label as one group."""
    each = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.explode("embedding").alias("v"))
    return _quantile_rows(ranks.quantiles(each, ["id"], "v", _SHARES), "id")


@query("rank_floors", "SELECT label AS id, round(coalesce(greatest(quantile_cont(v::DOUBLE, 0.1) FILTER (WHERE v > 0), 2.220446049250313e-16), 1e-6), 9) + 0.0 AS eps, round(median(v::DOUBLE), 9) + 0.0 AS median FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY label")
def rank_floors(spark, sf_dir):
    """Floor and median of groups of any size."""
    each = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.explode("embedding").alias("v"))
    middle = ranks.medians(each, ["id"], "v").withColumnRenamed("id", "m_id")
    out = ranks.floors(each, ["id"], "v", 0.1).join(middle, F.col("id").eqNullSafe(F.col("m_id")))
    return out.select("id", rounded("eps", 9).alias("eps"), rounded("median", 9).alias("median"))


# Running sums and hashes of signals

_LOSS = 0.1


@query("temporal_support", f"""WITH a AS (SELECT id, t, sqrt(power(sum(x[k + 1] * cos(2 * pi() * ((k * t) % 64) / 64)), 2) + power(sum(x[k + 1] * sin(2 * pi() * ((k * t) % 64) / 64)), 2)) AS a FROM ({EMBEDDINGS}), generate_series(0, 63) g(k), generate_series(0, 63) h(t) GROUP BY id, t),
s AS (SELECT id, t, a / sum(a) OVER (PARTITION BY id) AS a FROM a),
r AS (SELECT id, t, sum(a) OVER (PARTITION BY id ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS tail FROM s WHERE t < 32)
SELECT id, round(max(tail), 6) + 0.0 AS mass, (min(t) FILTER (WHERE tail <= {_LOSS}) + 1)::INT AS support FROM r GROUP BY id""")
def temporal_support(spark, sf_dir):
    """How far in time a vector reaches that is taken as a filter's response: tail mass by a running sum, and the first place where little is left."""
    out = running.temporal_support(running.amplitudes(embeddings(spark, sf_dir), ["id"], "x"), ["id"], _LOSS)
    return out.select("id", rounded("mass").alias("mass"), "support")


@query("bit_hashes", f"""WITH b AS (SELECT id, i, CASE WHEN s < 0 THEN s + 18446744073709551616 ELSE s END AS u FROM (SELECT id, unnest(generate_series(1, len(x))) AS i, CAST(CAST(unnest(x) AS BIT) AS BIGINT)::HUGEINT AS s FROM ({EMBEDDINGS}))),
f AS (SELECT id, list((u >> (8 * k)) & 255 ORDER BY i, k) AS bytes FROM b, generate_series(0, 7) g(k) GROUP BY id)
SELECT id, lower(printf('%016x', list_reduce(bytes, lambda h, v: (xor(h, v) * {running.FNV_PRIME}) % 18446744073709551616, {running.FNV_BASIS}::HUGEINT)::UBIGINT)) AS hash FROM f""")
def bit_hashes(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", running.bit_hash(F.col("x")).alias("hash"))


@query("scattering_function", f"SELECT 'v' || id AS name, (id % 7)::INT AS day, label, t, value FROM ({oracle.time_sql(_PLAN64.time, EMBEDDINGS)}) JOIN (VALUES {oracle._values([(p['path_idx'], repr(p['label'])) for p in _PLAN64.paths])}) l(path_idx, label) USING (path_idx)")
def scattering_function(spark, sf_dir):
    """The table function, with keys of any names and types."""
    functions.register(spark)
    keys = embeddings(spark, sf_dir).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), (F.col("id") % 7).cast("int").alias("day"), "x")
    keys.createOrReplaceTempView("ondula_signals")
    out = spark.sql("SELECT name, day, label, posexplode(coef) AS (t, v) FROM scattering(TABLE(SELECT * FROM ondula_signals), 64, 3, map('Q', '1'))")
    return out.select("name", "day", "label", "t", rounded("v").alias("value"))


# Signals and column features

@query("signals_from_rows", "SELECT l_orderkey AS id, unnest(generate_series(0, len(x) - 1))::INT AS t, unnest(x) AS value FROM (SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS x FROM lineitem GROUP BY l_orderkey)")
def signals_from_rows(spark, sf_dir):
    return signals.from_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_extendedprice").select(F.col("l_orderkey").alias("id"), F.posexplode("x").alias("t", "value"))


@query("windowed_bins", """WITH s AS (SELECT event_type, date_trunc('day', ts) AS start, CAST(floor(epoch(ts - date_trunc('day', ts)) / 10800) AS INT) AS t, sum(value) AS v FROM events GROUP BY ALL),
w AS (SELECT DISTINCT event_type, start FROM s) SELECT event_type AS id, epoch(start)::BIGINT AS start, b.t::INT AS t, round(coalesce(v, 0.0), 6) + 0.0 AS value FROM w CROSS JOIN generate_series(0, 7) b(t) LEFT JOIN s USING (event_type, start, t)""")
def windowed_bins(spark, sf_dir):
    out = windowed_signals(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", "1 day", 8, 10800)
    return out.select(F.col("event_type").alias("id"), F.unix_timestamp("start").alias("start"), F.posexplode("x").alias("t", "v")).select("id", "start", "t", rounded("v").alias("value"))


@query("synthetic_signal", "WITH RECURSIVE s AS (SELECT 0 AS i, (7::HUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 AS s UNION ALL SELECT i + 1, (s * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM s WHERE i < 255) SELECT i::INT AS t, round((s // 2048)::DOUBLE / 4503599627370496 - 1 + (i % 97 - 48) / 64.0::DOUBLE, 9) + 0.0 AS value FROM s")
def synthetic_signal(spark, sf_dir):
    return signals.synthetic_signals(spark, 256, [7]).select(F.posexplode("x").alias("t", "v")).select("t", rounded("v", 9).alias("value"))


@query("log_compress", "SELECT c_custkey AS id, round(sign(c_acctbal) * ln(1 + abs(c_acctbal) / 100), 9) + 0.0 AS value FROM customer")
def log_compress(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), rounded(features.log_compress(F.col("c_acctbal"), 100.0), 9).alias("value"))


@query("eps_quantile", "SELECT p_size, round(CASE WHEN max(p_retailprice) > 0 THEN greatest(quantile_cont(p_retailprice, 0.3) FILTER (WHERE p_retailprice > 0), 2.220446049250313e-16) ELSE 1e-6 END, 6) + 0.0 AS eps FROM part GROUP BY p_size")
def eps_quantile(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_size").agg(rounded(features.eps_quantile(F.col("p_retailprice"), 0.3)).alias("eps"))


_SUMMARY = "round(avg(l_extendedprice) / 2.718281828::DOUBLE, 4) + 0.0 AS mean, round(coalesce(stddev_samp(l_extendedprice), 'NaN'::DOUBLE) / 2.718281828::DOUBLE, 4) + 0.0 AS sd, round(median(l_extendedprice) / 2.718281828::DOUBLE, 4) + 0.0 AS median, round(max(l_extendedprice) / 2.718281828::DOUBLE, 4) + 0.0 AS max"


@query("summaries", f"SELECT l_partkey AS id, {_SUMMARY} FROM lineitem GROUP BY l_partkey")
def summaries(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"))
    return out.agg(*[rounded(features.summarise(F.col("l_extendedprice"), k) / 2.718281828, 4).alias(k) for k in KINDS])


@query("array_summaries", f"SELECT l_orderkey AS id, {_SUMMARY} FROM lineitem GROUP BY l_orderkey")
def array_summaries(spark, sf_dir):
    x = signals.from_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_extendedprice")
    return x.select(F.col("l_orderkey").alias("id"), *[rounded(features.summarise_array(F.col("x"), k) / 2.718281828, 4).alias(k) for k in KINDS])


@query("self_check")
def self_check(spark, sf_dir):
    return reports.golden_report(spark)


def _recorded_sql() -> str:
    rows = [(n, q, int(v[0]), *[round(x, 6) + 0.0 for x in v[1:]]) for (n, q), v in sorted(reports.recorded().items())]
    listed = ", ".join(f"('{n}', '{q}', {c}::BIGINT, {a!r}::DOUBLE, {b!r}::DOUBLE, {d!r}::DOUBLE)" for n, q, c, a, b, d in rows)
    return f"SELECT * FROM (VALUES {listed}) r(name, quantity, n, total, norm, most)"


@query("self_check_recorded", _recorded_sql())
def self_check_recorded(spark, sf_dir):
    """Sums of all quantities of all cases against their record."""
    return reports.measured_report(spark).select("name", "quantity", "n", *[rounded(c).alias(c) for c in ("total", "norm", "most")])
