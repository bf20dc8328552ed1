"""Every query with SQL against DuckDB on the same tables."""

import glob
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ondula import queries

SF = "/root/testdata/sf0.001"
#: On 500 embeddings the convolution joins take DuckDB long; their plans are also run on events.
SLOW = {"scatter_embeddings", "features_embeddings"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {p.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return c


def rows(table):
    names = sorted(table.column_names)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted(repr(tuple(map(plain, r))) for r in zip(*[table[n].to_pylist() for n in names]))


@pytest.mark.parametrize("name", [q for q in queries.SQL if q not in SLOW])
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    want = duck.sql(queries.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4000 and set(e.oracle_sql()) <= set(e.queries())


def test_bins_count_every_event(spark, duck):
    total = duck.sql("SELECT sum(value) FROM events").limit(1).fetchall()[0][0]
    got = queries.QUERIES["event_bins"](spark, SF).toPandas()
    assert math.isclose(got.value.sum(), total, rel_tol=1e-9) and set(got.t) == set(range(queries.BINS))


def test_round_trip_checks_every_sample(spark, monkeypatch):
    """A transform that spoils a signal's last sample must show."""
    dft = queries.arrays.dft
    spoil = lambda x, n, inverse=False: F.transform(dft(x, n, inverse), lambda z, i: queries.arrays.complex_(z.re + F.when(i == 63, 1e6).otherwise(0.0), z.im)) if inverse else dft(x, n)
    assert {r.ok for r in queries.QUERIES["dft_round_trip"](spark, SF).collect()} == {1}
    monkeypatch.setattr(queries.arrays, "dft", spoil)
    assert {r.ok for r in queries.QUERIES["dft_round_trip"](spark, SF).collect()} == {0}


def test_complex_arithmetic_covers_the_vector(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert queries.QUERIES["complex_arithmetic_all"](spark, SF).count() == 16 * n
