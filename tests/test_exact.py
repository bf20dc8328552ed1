"""Exact sums, rank selection, running sums, bit hashes, and what is built on one pass, on tables and on analysis."""

import math
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ondula.functions import exact, features, ranks, running, sql
from ondula.operators import kernels
from ondula.operators.ml import ScatteringFeatures
from ondula.operators.scattering import Scattering1D, ScatteringJTFS
from ondula.plans import filters
from ondula.sources import reports, signals, tables
from ondula.streaming.windows import windowed_signals

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def doubles():
    draw = random.Random(1)
    kinds = [lambda: draw.gauss(0, 1), lambda: draw.uniform(-1, 1) * 2.0 ** draw.randint(-1074, 1020), lambda: 5e-324 * draw.randint(0, 5), lambda: 2.0 ** draw.randint(-1074, 1023)]
    kinds += [lambda: draw.choice([0.0, -0.0, 1e308, -1e308, None]), lambda: math.ldexp(1 - 2**-53, draw.randint(-1000, 1000))]
    rows = [(draw.randrange(6), draw.choice(kinds)()) for _ in range(6000)]
    rows += [(7, None), (8, math.nan), (8, 1.0), (9, math.inf), (9, 1.0), (10, math.inf), (10, -math.inf), (11, 1.7e308), (11, 1.7e308), (12, -1.7e308), (12, -1.7e308)]
    return rows + [(None, 0.1), (None, 0.2), (None, 0.3), (13, -0.0)]


def groups(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(v)
    return out


def nearest(values):
    values = [v for v in values if v is not None]
    if not values:
        return None
    if any(map(math.isnan, values)) or math.inf in values and -math.inf in values:
        return math.nan
    if (big := {v for v in values if math.isinf(v)}):
        return big.pop()
    total = sum(map(Fraction, values))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def same(a, b):
    return a == b or a is not None and b is not None and math.isnan(a) and math.isnan(b)


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_sums_are_the_nearest_doubles(spark, doubles, parts):
    df = spark.createDataFrame(doubles, "limb int, v double").repartition(parts)
    got = {r.limb: r.v for r in exact.sums(df, ["limb"], ["v"]).collect()}
    want = {k: nearest(v) for k, v in groups(doubles).items()}
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)


def test_sums_of_the_table_are_the_same_bits_whatever_the_partitions(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = {struct.pack("<d", exact.sums(events.repartition(p), [], ["value"]).first()[0]) for p in (1, 7, 50)}
    assert got == {struct.pack("<d", math.fsum(r.value for r in events.collect()))}


def test_accumulated_tables_merge(spark, doubles):
    df = spark.createDataFrame([(k, v, 2.0 * k if k is not None else None) for k, v in doubles if v is None or abs(v) < 1e300], "k int, v double, w double")
    day = [exact.accumulate(df.where(c), ["k"], ["v", "w"]) for c in ("k % 2 = 0", "k % 2 = 1 OR k IS NULL", "k = 3")]
    got = {r.k: (r.v, r.w) for r in exact.total(day[0].unionByName(day[1]).unionByName(day[2]), ["k"], ["v", "w"]).collect()}
    rows = df.collect()
    rows += [r for r in rows if r.k == 3]
    for k in {r.k for r in rows}:
        assert same(got[k][0], nearest([r.v for r in rows if r.k == k])) and same(got[k][1], nearest([r.w for r in rows if r.k == k]))


def test_sums_of_nothing(spark):
    none = spark.createDataFrame([], "k int, v double")
    assert exact.sums(none, ["k"], ["v"]).collect() == [] and exact.sums(none, [], ["v"]).first()[0] is None


def quantile(values, p):
    s = sorted(values)
    h = (len(s) - 1) * p
    a, b = s[int(h)], s[min(int(h) + 1, len(s) - 1)]
    return a if a == b else a + (h - int(h)) * (b - a)


@pytest.mark.parametrize("buckets, few", [(4096, 1024), (4, 3), (2, 1)])
def test_quantiles_are_exact(spark, doubles, buckets, few):
    shares = [0, 0.01, 0.5, 0.77, 1]
    df = spark.createDataFrame(doubles, "low int, v double")
    got = {r.low: (r.n, r.quantiles) for r in ranks.quantiles(df, ["low"], "v", shares, buckets, few).collect()}
    for k, values in groups(doubles).items():
        values = [v for v in values if v is not None]
        n, q = got[k]
        assert n == len(values)
        if not values:
            assert q == [None] * 5
        elif any(map(math.isnan, values)):
            assert all(map(math.isnan, q))
        else:
            assert all(same(a, quantile(values, p)) for a, p in zip(q, shares))


def test_one_group_of_all_rows_is_never_gathered(spark, monkeypatch):
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice")
    values = [r[0] for r in items.collect()]
    met = []
    plain = ranks._meet
    monkeypatch.setattr(ranks, "_meet", lambda v, s, *a: met.append(s.agg(F.sum("inside")).first()[0]) or plain(v, s, *a))
    row = ranks.quantiles(items, [], "l_extendedprice", [0.5], few=16).first()
    assert row.n == len(values) and row.quantiles == [quantile(values, 0.5)]
    assert met[0] > len(values) / 10 and met[-1] <= 32 and len(met) <= 7


def test_large_tables_of_states_are_joined(spark, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.sqrt("id").alias("v"))
    got = {r.k: r.quantiles for r in ranks.quantiles(df, ["k"], "v", [0.3], 8, 10).collect()}
    for k in range(3):
        assert got[k] == [quantile([math.sqrt(i) for i in range(3000) if i % 3 == k], 0.3)]


def test_medians_and_floors_agree_with_the_aggregates(spark, doubles):
    df = spark.createDataFrame([(k, v) for k, v in doubles if v is None or v == 0 or 1e-280 < abs(v) < 1e280], "k int, v double")
    a = {r.k: r.median for r in ranks.medians(df, ["k"], "v").collect()}
    b = {r.k: r.m for r in df.groupBy("k").agg(features.summarise(F.col("v"), "median").alias("m")).collect()}
    assert a.keys() == b.keys() and all(same(a[k], b[k]) or math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)
    a = {r.k: r.eps for r in ranks.floors(df, ["k"], "v", 0.2).collect()}
    b = {r.k: r.m for r in df.groupBy("k").agg(features.eps_quantile(F.col("v"), 0.2).alias("m")).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a) and 1e-6 in a.values()


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "k int, v double")
    assert ranks.quantiles(none, ["k"], "v", [0.5]).collect() == []
    assert tuple(ranks.quantiles(none, [], "v", [0.5]).first()) == (0, [None]) and math.isnan(ranks.medians(none, [], "v").first()[0])
    with pytest.raises(ValueError, match="shares"):
        ranks.quantiles(none, [], "v", [1.5])


# Running sums, bits


def test_support_in_rows_is_the_plans(spark):
    n = 256
    responses = [(i, filters.gauss(n, s).tolist()) for i, s in enumerate([0.1, 0.03, 0.01, 0.002])]
    df = spark.createDataFrame(responses, "id int, h array<double>")
    got = {r.id: r.support for r in running.temporal_support(running.amplitudes(df, ["id"], "h"), ["id"], filters.SUPPORT_LOSS).collect()}
    assert got == {i: filters.temporal_support(np.array(h)) for i, h in responses} and None in got.values()
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0])], "id int, h array<double>")
    assert {r.id for r in running.amplitudes(odd, ["id"], "h").collect()} == {4}


def test_tails_and_first_places(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 0, 4.0), ("a", 1, None), ("b", 0, 1.0)], "k string, i int, v double")
    tails = running.tail_sums(df, ["k"], "i", "v")
    assert {(r.k, r.i): r.tail for r in tails.collect()} == {("a", 2): 1.0, ("a", 1): 1.0, ("a", 0): 5.0, ("b", 0): 1.0}
    assert {r.k: r.first for r in running.first_index(tails, ["k"], "i", F.col("tail") < 3).collect()} == {"a": 1, "b": 0}
    assert {r.k: r.first for r in running.first_index(tails, ["k"], "i", F.col("tail") < 0).collect()} == {"a": None, "b": None}


def test_hashes_fold_every_byte(spark):
    draw = random.Random(2)
    lists = [[draw.gauss(0, 1) for _ in range(draw.randint(0, 40))] for _ in range(200)] + [[0.0], [-0.0], [], None, [math.inf, -1e-320]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, x array<double>").repartition(3)
    got = {r.id: r.h for r in df.select("id", running.bit_hash(F.col("x")).alias("h")).collect()}
    assert got == {i: None if x is None else f"{reports.fnv1a(x):016x}" for i, x in enumerate(lists)}
    assert got[200] != got[201]


# One pass, tables, pruning


@pytest.fixture(scope="module")
def joint():
    return ScatteringJTFS(128, 4, J_fr=2, Q=4, format="joint", T=32)


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(3)
    return spark.createDataFrame([(f"s{i}", i % 3, draw.normal(size=128).tolist()) for i in range(12)], "name string, day int, x array<double>").repartition(3)


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): np.array(r.coef) for r in df.collect()}


def test_both_outputs_come_from_one_stage(joint, frame):
    keys = ("name", "day", "part", "path_idx")
    tagged = joint.transform_tagged(frame)
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = rows_of(tagged, *keys)
    coefs, s1 = joint.transform_with_s1(frame)
    for part, alone in ((0, rows_of(joint.transform(frame), "name", "day", "path_idx")), (1, rows_of(joint.s1(frame), "name", "day", "band"))):
        mine = {k[:2] + k[3:]: v for k, v in got.items() if k[2] == part}
        assert mine.keys() == alone.keys() and all(np.array_equal(mine[k], alone[k]) for k in mine)
        stored = rows_of((coefs, s1)[part], "name", "day", ("path_idx", "band")[part])
        assert stored.keys() == alone.keys() and all(np.array_equal(stored[k], alone[k]) for k in stored)


@pytest.mark.parametrize("kw", [{}, {"F": "global"}, {"F": 0, "out_type": "list"}, {"format": "time"}])
def test_renormalised_tables_equal_the_stages(frame, kw):
    op = ScatteringJTFS(128, 4, **{"J_fr": 2, "Q": 4, "format": "joint", "T": 32, **kw})
    coefs, s1 = op.transform_with_s1(frame)
    got = rows_of(op.renorm(coefs.repartition(5), s1.repartition(4), ["name", "day"], 1e-3), "name", "day", "path_idx")
    want = rows_of(op.transform(frame, renorm_eps=1e-3), "name", "day", "path_idx")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-15) for k in want)


def test_a_signal_without_its_bands_fails(joint, frame):
    coefs, s1 = joint.transform_with_s1(frame)
    with pytest.raises(Exception, match="each first-order band"):
        joint.renorm(coefs, s1.where("band > 1"), ["name", "day"]).collect()
    assert joint.renorm(coefs.where("name = 's1'"), s1, ["name", "day"]).count() == len(joint.paths)


@pytest.mark.parametrize("kw", [{"format": "joint"}, {"format": "time"}, {"format": "joint", "T": 0}, {"format": "joint", "T": "global"}])
def test_pruned_cascade(frame, monkeypatch, kw):
    op = ScatteringJTFS(128, 4, **{"J_fr": 2, "Q": 4, "T": 32, **kw})
    x = np.random.default_rng(4).normal(size=(3, 128))
    zero, s1, every = kernels.scatter_joint(op.plan, x)
    full = dict(kernels.joint_paths(op.plan, zero, every))
    used, plain = [], kernels.filtered
    monkeypatch.setattr(kernels, "filtered", lambda z, h, k, axis=1: used.append(h.tobytes()) or plain(z, h, k, axis))
    for wanted in ({0}, {1}, {len(op.paths) - 1}, {0, 3, len(op.paths) // 2}):
        some = op.select_paths(indices=sorted(wanted))
        del used[:]
        branches, order0 = some._needed()
        zero, _, found = kernels.scatter_joint(op.plan, x, branches, order0, False)
        got = dict(kernels.joint_paths(op.plan, zero, found, wanted))
        assert got.keys() == wanted and all(np.array_equal(got[i], full[i]) for i in wanted)
        under = {n for b in branches for n in (op.plan.branches[b].bands if op.plan.branches[b].n2 else range(1, len(op.time.psi1) + 1))}
        assert {n for n, f in enumerate(op.time.psi1, 1) if f.h.tobytes() in used} == under
        # The first frequential filter may be the low-pass that averages, too.
        spins = {op.plan.branches[b].n_fr for b in branches} - {1}
        assert {n for n, f in enumerate(op.plan.psi_fr, 1) if n > 1 and f.h.tobytes() in used} == spins


def test_joint_paths_by_index_and_label(joint, frame):
    label = joint.paths[5]["label"]
    assert joint.path(5) == joint.path(label) == joint.paths[5]
    with pytest.raises(IndexError, match="none of them"):
        joint.path(len(joint.paths))
    with pytest.raises(IndexError):
        joint.select_paths(indices=[1, 10_000])
    with pytest.raises(KeyError):
        joint.path("J9")
    with pytest.raises(ValueError, match="No such path"):
        joint.select_paths(labels=["J9"])
    got = rows_of(joint.select_paths(labels=[label]).transform(frame, renorm_eps=1e-3), "name", "day", "path_idx")
    want = rows_of(joint.transform(frame, renorm_eps=1e-3).where("path_idx = 5"), "name", "day", "path_idx")
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in got)


# Analysis of table functions, transformer, windows


def test_table_functions_carry_keys_and_check_at_analysis(spark, frame, joint):
    sql.register(spark)
    frame.createOrReplaceTempView("sig_any")
    call = "SELECT * FROM scattering(TABLE(SELECT * FROM sig_any), 128, 4, map('Q', '2'))"
    out = spark.sql(call)
    assert out.columns == ["name", "day", "path_idx", "label", "coef"] and out.schema["name"].dataType.simpleString() == "string"
    got, want = rows_of(out, "name", "day", "path_idx"), rows_of(Scattering1D(128, 4, Q=2).transform(frame), "name", "day", "path_idx")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)
    out = spark.sql("SELECT * FROM joint_scattering(TABLE(SELECT * FROM sig_any), 128, 4, map('Q', '4', 'J_fr', '2', 'format', 'joint', 'T', '32', 'renorm_eps', '0.001'))")
    got, want = rows_of(out, "name", "day", "path_idx"), rows_of(joint.transform(frame, renorm_eps=1e-3), "name", "day", "path_idx")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)
    for wrong, says in (("128, 4, map('q', '2')", "Unknown option q"), ("128, 9", "Use J <= 7"), ("128, 4, map('T', '500')", "exceeds the signal length"), ("day, 4", "day")):
        with pytest.raises(AnalysisException, match=says):
            spark.sql(f"SELECT * FROM scattering(TABLE(SELECT * FROM sig_any), {wrong})")
    for wrong, says in (("SELECT name FROM sig_any", "no column x"), ("SELECT name AS x FROM sig_any", "array of numbers"), ("SELECT name AS coef, x FROM sig_any", "rename")):
        with pytest.raises(AnalysisException, match=says):
            spark.sql(f"SELECT * FROM scattering(TABLE({wrong}), 128, 4)")


def test_a_pipeline_is_saved_and_loaded(spark, frame, tmp_path):
    many = frame.unionByName(frame.where("day = 1"))
    stage = ScatteringFeatures(inputCol="x", outputCol="f", n=128, J=4, Q=(2, 1), T=16, renorm_eps=1e-3, quantile=0.1, indices=[0, 1, 2, 5])
    model = Pipeline(stages=[stage]).fit(many)
    model.write().overwrite().save(str(tmp_path / "pipe"))
    loaded = PipelineModel.load(str(tmp_path / "pipe"))
    plain = lambda df: sorted((r.name, r.day, tuple(r.x), tuple(r.f.toArray())) for r in df.collect())
    got = plain(model.transform(many))
    assert got == plain(loaded.transform(many)) and len(got) == many.count() and len(got[0][3]) == 16
    assert loaded.stages[0].operator().wanted == {0, 1, 2, 5}
    assert loaded.transform(many)._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    op = Scattering1D(128, 4, Q=(2, 1), T=16).select_paths(indices=[0, 1, 2, 5])
    want = op.features(frame, ["name"], renorm_eps=1e-3, quantile=0.1).where("name = 's1'").orderBy("path_idx").collect()
    assert np.allclose([x for r in got if r[0] == "s1" for x in r[3]][:16], [v for r in want for v in (r["mean"], r["sd"], r["median"], r["max"])])
    assert plain(ScatteringFeatures(inputCol="x", outputCol="f", operator=op, renorm_eps=1e-3, quantile=0.1).transform(many)) == got


def test_plan_of_windows_is_free_of_their_bins(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    plans = [windowed_signals(events, ["event_type"], "ts", "value", "1 day", b, 86400 // b)._jdf.queryExecution().executedPlan().toString() for b in (8, 960)]
    assert abs(len(plans[0]) - len(plans[1])) < 50
    row = windowed_signals(events, ["event_type"], "ts", "value", "1 day", 960, 90).first()
    assert len(row.x) == 960


def test_reports_of_tables_are_the_same_bits(spark, frame):
    coefs = Scattering1D(128, 4, Q=2).transform(frame)
    one, two = ({tuple(r) for r in reports.table_report(coefs.repartition(p), ["day"]).collect()} for p in (1, 9))
    assert one == two and len(one) == 3 * coefs.select("path_idx").distinct().count()
    r = next(iter(one))
    values = [v for c in coefs.where(f"day = {r[0]} AND path_idx = {r[1]}").collect() for v in c.coef]
    assert r[2:] == (len(values), math.fsum(values), math.fsum(v * v for v in values), max(map(abs, values)))


def test_differences_of_tables(spark):
    a = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0]), (3, 0, [math.nan, 1.0, math.nan]), (4, 1, [5.0]), (None, 1, [math.inf])], "id int, path_idx int, coef array<double>")
    b = spark.createDataFrame([(1, 0, [1.0, 2.5]), (2, 0, [1.0, 1.0]), (3, 0, [math.nan, math.nan, 1.0]), (5, 2, []), (None, 1, [math.inf])], "id int, path_idx int, coef array<double>")
    got = {r.path_idx: tuple(r)[1:] for r in reports.table_differences(a, b, ["id"], 0.1).collect()}
    assert got == {0: (0, 1, 3, math.inf), 1: (1, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    assert reports.table_differences(a, a, ["id"], 0.0).where("only_one + lengths + apart > 0").count() == 0
    assert reports.table_differences(a.where("false"), a.where("false"), ["id"], 0.0).count() == 0


def test_synthetic_signals_of_rows(spark):
    seeds = spark.createDataFrame([("a", 7), ("b", -3), ("c", None), ("d", 2**63 - 1), ("a", 7)], "x string, s long").repartition(2)
    got = sorted((r[0], tuple(r[1])) for r in signals.synthetic_of(seeds.withColumnRenamed("x", "key"), ["key"], "s", 120).collect())
    assert got == sorted((k, tuple(signals.synthetic(120, s))) for k, s in (("a", 7), ("b", -3), ("d", 2**63 - 1), ("a", 7)))
