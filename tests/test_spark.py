"""The DataFrame surface: operators, errors, features, SQL, streams, machine learning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula import queries
from ondula.functions import arrays, features, sql
from ondula.operators import kernels
from ondula.operators.ml import ScatteringFeatures
from ondula.operators.scattering import Scattering1D, ScatteringJTFS, bands
from ondula.plans.joint_plan import JointPlan
from ondula.sources import reports, signals
from ondula.streaming.windows import windowed_signals

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module")
def frame(spark):
    x = np.random.default_rng(0).normal(size=(6, 128))
    return spark.createDataFrame([(i, f"c{i % 2}", r.tolist()) for i, r in enumerate(x)], "id long, channel string, x array<double>")


def test_transform_is_the_kernel_for_each_row(spark, frame):
    op = Scattering1D(128, 4, Q=(2, 1))
    out = op.transform(frame).toPandas()
    x = np.stack(frame.orderBy("id").toPandas().x)
    want = dict(kernels.scatter_time(op.time, x))
    assert len(out) == 6 * len(op.paths)
    for r in out.itertuples():
        np.testing.assert_allclose(r.coef, want[r.path_idx][r.id], atol=1e-13)
    assert out.groupby("id").channel.first().tolist() == ["c0", "c1"] * 3


def test_transform_has_no_shuffle(frame):
    plan = Scattering1D(128, 4, Q=1).transform(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_selected_paths_are_the_same_values(frame):
    op = Scattering1D(128, 4, Q=(2, 1))
    some = op.select_paths(order=2).transform(frame).toPandas()
    every = op.transform(frame).toPandas()
    every = every[every.path_idx.isin(some.path_idx)]
    assert len(some) == len(every) > 0
    key = ["id", "path_idx"]
    for a, b in zip(some.sort_values(key).coef, every.sort_values(key).coef):
        np.testing.assert_array_equal(a, b)
    with pytest.raises(ValueError, match="No such path"):
        op.select_paths(labels=["S9"])


@pytest.mark.parametrize("bad", [[1.0] * 127, [float("nan")] * 128, [float("inf")] + [0.0] * 127, None, [None] + [0.0] * 127])
def test_bad_signals(spark, bad):
    df = spark.createDataFrame([(1, [0.5] * 128), (2, bad)], "id long, x array<double>")
    with pytest.raises(Exception, match="samples|non-finite"):
        Scattering1D(128, 4, Q=1).transform(df).collect()
    out = Scattering1D(128, 4, Q=1, on_error="skip").transform(df)
    assert {r.id for r in out.collect()} == {1}


def test_empty_table(spark, frame):
    op = Scattering1D(128, 4, Q=1)
    assert op.transform(frame.where("false")).count() == 0
    assert op.features(frame.where("false"), ["id"]).count() == 0


def test_joint_renorm_by_join_is_renorm_in_the_stage(frame):
    for kw in ({}, {"format": "joint"}, {"F": "global"}, {"F": 0}):
        op = ScatteringJTFS(128, 4, J_fr=2, Q=2, **kw)
        one = op.transform(frame, renorm_eps=1e-6).select("id", "path_idx", "rows", "coef").toPandas()
        coefs, s1 = op.transform_with_s1(frame)
        two = op.renorm(coefs, s1, ["id"], 1e-6).toPandas().merge(one, on=["id", "path_idx"], suffixes=("", "_one"))
        assert len(two) == len(one)
        for r in two.itertuples():
            np.testing.assert_allclose(r.coef, r.coef_one, rtol=1e-12)
    with pytest.raises(ValueError, match="local time averaging"):
        ScatteringJTFS(128, 4, J_fr=2, Q=2, T="global").transform(frame, renorm_eps=1e-6)


def test_bands(frame):
    op = ScatteringJTFS(128, 4, J_fr=2, Q=2, format="joint")
    out = op.transform(frame)
    assert bands(out, ["id"]).count() == out.agg(F.sum(F.col("rows") * F.col("cols"))).first()[0]


def test_features_ignore_amplitude(frame):
    op = Scattering1D(128, 4, Q=(2, 1))
    a = op.renorm(op.transform(frame), ["id"]).toPandas()
    b = op.renorm(op.transform(frame.withColumn("x", F.transform("x", lambda v: v * 50))), ["id"]).toPandas()
    m = a.merge(b, on=["id", "path_idx"])
    order = {p["path_idx"]: p["order"] for p in op.paths}
    for r in m.itertuples():
        if order[r.path_idx] == 2:
            np.testing.assert_allclose(r.coef_x, r.coef_y, rtol=1e-8)


def test_pipeline_is_its_steps(spark, frame):
    op = Scattering1D(128, 4, Q=(2, 1))
    got = op.features(frame, ["id"]).toPandas().sort_values(["id", "path_idx"])
    normed = op.renorm(op.transform(frame).select("id", "path_idx", "coef"), ["id"])
    packed = normed.join(features.floors(normed, ["id"]), "id").withColumn("coef", features.log_compress_array(F.col("coef"), F.col("eps")))
    want = packed.select("id", "path_idx", F.explode("coef").alias("v")).groupBy("id", "path_idx").agg(*[features.summarise(F.col("v"), k).alias(k) for k in features.SUMMARIES])
    want = want.toPandas().sort_values(["id", "path_idx"])
    for k in features.SUMMARIES:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-12)


def test_renorm_needs_parents(spark, frame):
    op = Scattering1D(128, 4, Q=(2, 1))
    coefs = op.transform(frame).join(op.paths_df(spark).where("order <> 1").select("path_idx"), "path_idx")
    with pytest.raises(Exception, match="no first-order parent"):
        op.renorm(coefs.select("id", "path_idx", "coef"), ["id"]).collect()


def _one(spark, value, **kw):
    return spark.createDataFrame([(value,)], "v array<double>").select(*[features.summarise_array(F.col("v"), k).alias(k) for k in features.SUMMARIES]).first()


def test_summaries(spark):
    r = _one(spark, [3.0, 1.0, 4.0, 1.0, 5.0, 9.0])
    assert (r.mean, r.max, r.median) == (23 / 6, 9.0, 3.5) and abs(r.sd - 2.9944392908634274) < 1e-12
    assert all(math.isnan(v) for v in _one(spark, []))
    one = _one(spark, [2.0])
    assert one.mean == one.max == one.median == 2.0 and math.isnan(one.sd)
    assert all(math.isnan(v) for v in _one(spark, [1.0, 2.0, float("nan")]))


def test_floor(spark):
    of = lambda v, p: spark.createDataFrame([(x,) for x in v], "v double").agg(features.eps_quantile(F.col("v"), p).alias("e")).first().e
    assert abs(of([10.0, 3.0, 1.0, 4.0, 2.0, -1.0, 0.0], 0.3) - 2.2) < 1e-12
    assert of([-1.0, 0.0, float("nan"), float("inf")], 0.3) == 1e-6
    assert of([1e-300], 0.5) == 2.220446049250313e-16
    with pytest.raises(ValueError):
        features.eps_quantile(F.col("v"), 1.5)


@pytest.mark.parametrize("eps", [0, -1.0, float("nan"), float("inf")])
def test_eps_must_be_positive(eps):
    with pytest.raises(ValueError, match="eps must be"):
        features.log_compress(F.lit(1.0), eps)


def test_unknown_summary():
    with pytest.raises(ValueError, match="Unknown summary"):
        features.summarise(F.lit(1.0), "mode")


def test_reflect_padding(spark):
    got = spark.range(1).select(arrays.pad_reflect(F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)]), 2, 3).alias("x")).first().x
    assert got == [3, 2, 1, 2, 3, 4, 3, 2, 1]


def test_sql_surface(spark, frame):
    sql.register(spark)
    frame.createOrReplaceTempView("sig")
    got = spark.sql("SELECT * FROM scatter(TABLE(SELECT id, x FROM sig), 128, 4, map('Q', '2,1'))").toPandas()
    want = Scattering1D(128, 4, Q=(2, 1)).transform(frame).toPandas()
    m = got.merge(want, on=["id", "path_idx"])
    assert len(m) == len(want) == len(got)
    assert all(np.allclose(a, b, atol=1e-13) for a, b in zip(m.coef_x, m.coef_y))
    r = spark.sql("SELECT log_compress(-3D, 1D) a, xi_max(1) b, dyadic_subsampling(0.35D, 0.01D) c, periods(0.1D) d").first()
    assert (round(r.a, 9), r.b, r.c, r.d) == (round(-math.log(4), 9), 0.35, 0, 2)
    with pytest.raises(ValueError, match="Unknown option"):
        sql.plan_of(128, 4, {"depth": "2"})


def test_sql_surface_of_joint_scattering(spark, frame):
    sql.register(spark)
    frame.createOrReplaceTempView("sig")
    options = "map('Q', '4', 'J_fr', '2', 'format', 'joint', 'renorm_eps', '0.001')"
    got = spark.sql(f"SELECT * FROM scatter_joint(TABLE(SELECT id, x FROM sig), 128, 3, {options})").toPandas()
    want = ScatteringJTFS(128, 3, J_fr=2, Q=4, format="joint").transform(frame, renorm_eps=1e-3).toPandas()
    m = got.merge(want, on=["id", "path_idx", "rows", "cols"])
    assert len(m) == len(want) == len(got)
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(m.coef_x, m.coef_y))
    with pytest.raises(ValueError, match="Unknown option"):
        sql.joint_plan_of(128, 3, {"max_order": "2"})


def test_sql_summaries_and_floors_are_the_columns(spark):
    sql.register(spark)
    nan = float("nan")
    held = spark.createDataFrame([(x,) for x in ([3.0, 1.0, 4.0, 1.0, 5.0, 9.0], [], [2.0], [1.0, 2.0, nan], [-1.0, 0.0, float("inf")], [1e-300], [10.0, 3.0, 1.0, 4.0, 2.0, -1.0, 0.0])], "x array<double>")
    held.createOrReplaceTempView("arrays")
    for k in features.SUMMARIES:
        r = spark.sql(f"SELECT summarise(x, '{k}') AS a, x FROM arrays").withColumn("b", features.summarise_array(F.col("x"), k)).toPandas()
        np.testing.assert_allclose(r.a, r.b, rtol=1e-12)
    r = spark.sql("SELECT eps_quantile(x, 0.3D) AS a, x FROM arrays").collect()
    assert [x.a for x in r] == [pytest.approx(spark.createDataFrame([(v,) for v in x.x] or [(-1.0,)], "v double").agg(features.eps_quantile(F.col("v"), 0.3)).first()[0]) for x in r]
    with pytest.raises(Exception, match="Unknown summary"):
        spark.sql("SELECT summarise(x, 'mode') FROM arrays").collect()


def test_paths_by_index_and_label():
    op = Scattering1D(128, 4, Q=(2, 1))
    assert op.path(0)["label"] == "S0" and op.path("S1_2") == op.path(2)
    for wrong in (-1, len(op.paths)):
        with pytest.raises(IndexError, match="paths"):
            op.path(wrong)
    with pytest.raises(KeyError, match="No such path"):
        op.path("S9")


def test_features_skip_bad_signals_and_unaveraged_paths(spark):
    op = Scattering1D(64, 3, Q=1, on_error="skip")
    rows = [(1, [float(i % 7) for i in range(64)]), (2, [1.0]), (3, None), (4, [float("nan")] * 64), (5, [0.0] * 64)]
    got = op.features(spark.createDataFrame(rows, "id long, x array<double>"), ["id"]).toPandas()
    assert set(got.id) == {1, 5} and (got[got.id == 5]["mean"] == 0).all()
    with pytest.raises(Exception, match="parent"):
        Scattering1D(64, 3, Q=1, T=0).features(spark.createDataFrame(rows[:1], "id long, x array<double>"), ["id"]).collect()


def test_measures_keep_to_their_record(spark, monkeypatch):
    small = ["global-2048-J6", "strided-4096-J7", "jtfs-video-900-J7"]
    rows = [r.asDict() for r in reports.measured_report(spark, small, partitions=2).collect()]
    kept = {k: v for k, v in reports.recorded().items() if k[0] in small}
    monkeypatch.setattr(reports, "recorded", lambda: kept)
    assert len(rows) == 8 and reports.strayed(rows) == []
    rows[1]["total"] *= 1 + 1e-6
    assert reports.strayed(rows) == [f"{rows[1]['name']}\t{rows[1]['quantity']}"]
    assert len(reports.strayed(rows[:-1])) == 2


def test_stream_is_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    make = lambda df: windowed_signals(df, ["event_type"], "ts", "value", "1 day", 64, 1350)
    q = Scattering1D(64, 3, Q=1).transform(make(stream)).writeStream.format("memory").queryName("scattered").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.event_type, r.start, r.path_idx): r.coef for r in spark.table("scattered").collect()}
    want = {(r.event_type, r.start, r.path_idx): r.coef for r in Scattering1D(64, 3, Q=1).transform(make(events)).collect()}
    assert got and set(got) <= set(want)
    assert all(np.allclose(v, want[k]) for k, v in got.items())


def test_ml_transformer(frame):
    out = ScatteringFeatures(inputCol="x", outputCol="f", operator=Scattering1D(128, 4, Q=1)).transform(frame)
    assert all(len(r.f) == 4 * len(Scattering1D(128, 4, Q=1).paths) for r in out.collect())


def test_report(spark):
    assert reports.fnv1a([]) == 0xCBF29CE484222325
    assert reports.verify(spark, ["unaveraged-1500-J6"]) == []
    shapes = {k: reports.shape(p) for k, p in reports.plans().items() if isinstance(p, JointPlan)}
    assert shapes["jtfs-F0-4096-J6"] == (763, 64, 120)


def test_binned_signals_ignore_rows_without_time_or_value(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:30", 1.0), ("a", "2024-01-01 00:01:30", 2.0), ("a", None, 9.0), ("a", "2023-01-01 00:00:00", 9.0), (None, "2024-01-01 00:00:10", 4.0), ("a", "2024-01-01 00:00:40", None)], "k string, ts string, v double")
    got = {r.k: r.x for r in signals.binned(df, ["k"], "ts", "v", "2024-01-01", 3, 60).collect()}
    assert got == {"a": [1.0, 2.0, 0.0], None: [4.0, 0.0, 0.0]}


def test_spanned_signals_hold_first_and_last_second(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:30", 1.0), ("a", "2024-01-01 00:03:29", 2.0), ("b", "2024-01-01 00:01:30", 8.0), ("a", None, 9.0), ("a", "2030-01-01 00:00:00", None)], "k string, ts string, v double")
    got = {r.k: r.x for r in signals.spanned(df, ["k"], "ts", "v", 3).collect()}
    assert got == {"a": [1.0, 0.0, 2.0], "b": [0.0, 8.0, 0.0]}
    assert signals.spanned(df.where("false"), ["k"], "ts", "v", 3).count() == 0


def test_self_check_has_the_quantities_of_the_reference(spark):
    rows = queries.QUERIES["self_check"](spark, "").collect()
    want = [(n, "coefs") for n, *_ in reports.CASES if n != "jtfs-video-900-J7"]
    want += [(n, k) for n in ("kinematic-1800-J8-Tsec1", "audio-32000-J9-Q8", "strided-4096-J7") for k in ("Mean", "Sd", "Median", "Max")]
    want += [(n, "shape") for n, *_ in reports.CASES if n.startswith("jtfs") and n != "jtfs-video-900-J7"]
    want += [("jtfs-video-900-J7", "s1"), ("jtfs-video-900-J7", "renorm")]
    assert sorted((r.name, r.quantity) for r in rows) == sorted(want) and len(want) == 28
    assert len({r.hash for r in rows}) == 28
    assert reports.verify(spark, ["strided-4096-J7", "jtfs-video-900-J7"]) == []


def test_verify_deals_the_signals_out_anew(spark, monkeypatch):
    seen = []
    report = reports.golden_report
    monkeypatch.setattr(reports, "golden_report", lambda *a, **k: seen.append(report(*a, **k)) or seen[-1])
    assert reports.verify(spark, ["unaveraged-1500-J6"]) == []
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in seen]
    dealt = [p.find("RepartitionByExpression") if "RepartitionByExpression" in p else p.find("Repartition 3") for p in plans]
    assert dealt[0] < 0 <= dealt[1] and plans[1].rfind("MapInArrow", 0, dealt[1]) >= 0  # under the transform
