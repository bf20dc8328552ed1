"""Joins beyond the broadcast limit: the results of the plain ones, and only rows that meet the other side move."""

import random

import pytest
from pyspark.sql import functions as F

from ondula.llm import common
from ondula.llm import op1_pareto_mix as o1
from ondula.llm import op3_host_rules as o3
from ondula.llm import op5_line_runs as o5
from ondula.llm import op7_count_rtree as o7
from ondula.llm import op9_exact_dedup as o9

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, a repeated passage, a host of bad documents, repeated rows and nulls."""
    draw = random.Random(11)
    line = lambda n: " ".join(f"w{draw.randrange(3000)}" for _ in range(n))
    passage = line(60)
    texts = [line(120) for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[1] + " end"] * 3 + [f"{line(70)}\n{passage}\n{line(70)}" for _ in range(6)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    bad = [(200 + i, " ".join(["# same words again"] * 40), None, "bad", None) for i in range(20)]
    near = [(300 + i, line(100) + " #" * 8, None, "bad", None) for i in range(4)]
    return spark.createDataFrame(rows + rows[:2] * 3 + bad + near + [(None, None, None, None, None), (400, "", None, "a", 0)], DOCS).repartition(4).cache()


@pytest.fixture
def large(monkeypatch):
    """Every side counts as larger than a broadcast."""
    for f in (common.join_few, common.maybe_broadcast):
        monkeypatch.setattr(f, "__defaults__", (-1,))


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("n", [0, 40])
def test_join_few_is_the_plain_join(spark, how, n):
    draw = random.Random(n)
    key = lambda: draw.choice([None, *range(60)])
    left = spark.createDataFrame([(key(), key(), f"text {i}") for i in range(3000)], "a long, b long, text string")
    right = spark.createDataFrame([(key(), key(), i) for i in range(n)], "a long, b long, v long")
    assert rows(common.join_few(left, right, ["a", "b"], how, -1)) == rows(left.join(right, ["a", "b"], how))


def test_few_rows_are_marked(spark):
    left = spark.range(200_000).select(F.col("id").alias("a"))
    right = spark.range(0, 200_000, 100).select(F.col("id").alias("a"))
    found = common.tag(left, right, ["a"])
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    marked = {r.a for r in found.where("_marked").collect()}
    # All that meet right, and hardly another: 2,000 of 2^28 slots are marked.
    assert marked >= set(range(0, 200_000, 100)) and len(marked) < 2010


def test_bitmap_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "SLOT_BITS", 16)
    found = common.marks(spark.range(300_000), ["id"])
    assert found.count() == 1 << 16 - common.CHUNK_BITS
    assert found.select(F.size("_bits").alias("n")).distinct().collect() == [(1 << common.CHUNK_BITS - 6,)]


QUERIES = {
    "exact_dedup": o9.exact_dedup,
    "line_dedup": lambda docs: o5.line_dedup(docs).select("row.*", "text", "n_lines", F.array_sort("deleted").alias("deleted")).drop("text"),
    "line_texts": lambda docs: o5.line_dedup(docs).select("row.doc_id", F.col("text").alias("left")),
    "stage 3": lambda docs: o3.stage(docs.sparkSession, docs, ""),
    "stage 5": lambda docs: o5.stage(docs.sparkSession, docs, ""),
    "stage 7": lambda docs: o7.stage(docs.sparkSession, docs, ""),
    "stage 1": lambda docs: o1.stage(docs.sparkSession, docs, ""),
}


@pytest.mark.parametrize("name", QUERIES)
def test_large_sides_change_no_result(docs, request, name):
    plain = rows(QUERIES[name](docs))
    request.getfixturevalue("large")
    assert plain and rows(QUERIES[name](docs)) == plain


def test_judged_hosts_are_those_that_are_not_open(docs):
    verdicts = o3.hosts(o3.features(docs))
    found = {r.verdict for r in verdicts.collect()}
    assert "open" in found and found - {"open"}
    every = rows(o3.judge(o3.features(docs), common.cut(verdicts)).where("kept").select("row.*"))
    assert rows(o3.stage(docs.sparkSession, docs, "")) == every
