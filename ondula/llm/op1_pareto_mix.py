"""Mixing sources to target weights by Pareto order sampling.

A source's target is shared out over its documents as expected copies, in proportion to a
document's weight and at most ``most`` each (``rates``).  The default weight is the square
root of the document's words, so that long documents stand for their source more often than
fragments; any positive column will do.  The whole part of a document's copies is certain.
The fraction is its inclusion probability p, so inclusion is unequal within a source: with a
uniform number u hashed from the row, ``u / (1 - u) / (p / (1 - p))`` ranks the documents of
a source, and the lowest ranks are taken until their words fill what the whole copies left
of the target.  The sample has a fixed size in words, up to the document at its edge.

Weights are rounded to 64 steps an octave, so the price of a source's weights comes from
sums by (source, step).  The ranks of a source are cut without sorting a source in one task:
words are summed by (source, bucket of the rank), sums are accumulated over the buckets, and
only the one bucket that holds the edge is ranked row by row.  Sources may be as many as
hosts: they are numbered and get their targets in tables; only totals reach the driver.

Defined results: a null or blank text has size 0 and takes 0.  A null source is a source
of its own, ordered last; sources order by code point.  A null weight, or one that isn't
positive, counts as 1.  Ties of rank order by id, then by a hash of the text.  Repeated rows
(equal id, source and text) are separate documents: they are numbered (``apart``), each number
has its own u, and ``stage`` returns as many rows as they take, all of one of them.  A very long text is one
document: the sum may miss the target by half of the one at the edge.  An empty table gives
an empty result; other columns are ignored, whatever their names, and carried by ``stage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondula.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BUCKETS, STEPS = 4096, 64
#: Fractions of a copy below this are none.
EPSILON = 1e-9


def numbered(sums: DataFrame, s: common.Scratch) -> DataFrame:
    """source, n, place: ``sums`` (source, n) numbered from 0 in code point order, null ("") last, without one sort of all."""
    last = (F.col("source") == "").cast("int").alias("last")
    held = s.cut(sums.select("source", "n", last).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()))
    parts = held.groupBy("part").agg(F.count("*").alias("c"))  # one row for each partition
    before = parts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    return held.withColumn("within", within).join(before, "part").select("source", "n", (F.col("before") + F.col("within")).alias("place"))


def goals(rows: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, none above ``most`` times its size, the excess shared again.

    Each round prices a unit of weight and finds the sources that reach their bound at that price; only three sums
    reach the driver, and a round that finds none ends it.
    """
    with common.Scratch(rows.sparkSession) as s:
        places = numbered(rows.groupBy("source").agg(F.sum("size").alias("n")), s)
        listed = F.array(*[F.lit(float(w)) for w in weights])
        held = s.cut(places.select("source", "n", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int")).alias("w")))
        goal, price, bound = share * (held.agg(F.sum("n")).first()[0] or 0), 0.0, -1
        while True:
            full = F.col("w") * price > F.col("n") * most
            r = held.where("n > 0").agg(F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("n"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count_if(full).alias("c")).first()
            if r.c == bound or not r.w:
                break
            price, bound = (goal - most * r.n) / r.w, r.c
        target = F.when(F.col("n") > 0, F.least(F.col("n") * most, F.col("w") * price)).otherwise(0.0)
        return common.cut(held.select("source", F.col("n").alias("source_size"), target.alias("target")))


def uniform(seed: int, *columns: Column) -> Column:
    """A number strictly between 0 and 1, from a hash of the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


#: What repeated rows have in common.
SAME = ["source", "first", "tie"]


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` (written) with ``first``, the hashed u, ``repeated``, and a u of its own for each of repeated rows.

    Rows are numbered within a value and a task, and the tasks of a value are summed, so that a value with a third
    of all rows is in no one task.  Repeated rows are alike: whichever gets a number, the result is the same.
    """
    rows = rows.withColumn("first", F.col("u")).withColumn("repeated", F.lit(False))
    repeated = common.cut(rows.groupBy(*SAME).agg(F.count("*").alias("c")).where("c > 1").select(*SAME))
    if repeated.isEmpty():
        return rows
    twice = common.maybe_broadcast(repeated)
    with common.Scratch(rows.sparkSession) as s:
        held = s.cut(rows.withColumn("part", F.spark_partition_id()).join(twice, SAME, "left_semi"))
        counts = held.groupBy(*SAME, "part").agg(F.count("*").alias("c"))
        before = counts.select(*SAME, "part", (F.sum("c").over(Window.partitionBy(*SAME).orderBy("part")) - F.col("c")).alias("before"))
        within = F.row_number().over(Window.partitionBy(*SAME, "part").orderBy("id")) - 1
        placed = held.withColumn("within", within).join(before, [*SAME, "part"]).withColumn("place", F.col("within") + F.col("before"))
        own = placed.withColumn("repeated", F.lit(True)).withColumn("u", F.when(F.col("place") > 0, uniform(3, F.col("u"), F.col("tie"), F.col("place"))).otherwise(F.col("u")))
        return common.cut(rows.join(twice, SAME, "left_anti").unionByName(own.select(*rows.columns)))


def rates(rows: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """``goals`` with price: expected copies for a unit of weight, such that copies of at most ``most`` reach the target."""
    each = rows.where("size > 0").groupBy("source", "weight").agg(F.sum("size").alias("n"))
    falling = Window.partitionBy("source").orderBy(F.desc("weight"))
    above = F.coalesce(F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("n") * F.col("weight")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    # The heavier ones are full; the price must not fill this one.
    price = (F.col("target") - most * above) / below
    fits = each.join(common.maybe_broadcast(goals), "source").withColumn("price", price).where(F.col("price") * F.col("weight") <= most + EPSILON)
    return common.cut(goals.join(common.maybe_broadcast(common.cut(fits.groupBy("source").agg(F.max_by("price", "weight").alias("price")))), "source", "left"))


def ranked(rows: DataFrame, priced: DataFrame, most: float = MOST) -> DataFrame:
    """``rows`` (source, size, weight, u, ...) with whole, p, rank and bucket. priced: of ``rates``."""
    copies = F.when(F.col("size") > 0, F.least(F.lit(most), F.coalesce(F.col("price") * F.col("weight"), F.lit(0.0)))).otherwise(0.0)
    joined = rows.join(common.maybe_broadcast(priced), "source").withColumn("expected", copies).withColumn("whole", F.floor(F.col("expected") + EPSILON).cast("long"))
    rest = F.col("expected") - F.col("whole")
    joined = joined.withColumn("p", F.when(rest > EPSILON, rest).otherwise(0.0))
    rank = F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
    # The rank mapped to 0..1 without changing the order.
    return joined.withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))


def edges(rows: DataFrame, priced: DataFrame) -> DataFrame:
    """source, edge, last: the bucket where a source's sample ends, and the last (rank, id, tie) that it takes there."""
    held = ranked(rows, priced)
    sums = held.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("target") - F.sum("certain").over(Window.partitionBy("source"))
    words = F.when(F.col("bucket").isNotNull(), F.col("words")).otherwise(0)
    before = sums.withColumn("left", left).withColumn("words", words).withColumn("before", F.sum("words").over(run) - F.col("words"))
    found = before.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))).select("source", F.col("bucket").alias("edge"), (F.col("left") - F.col("before")).alias("room"))
    found = common.cut(found)
    inside = held.join(common.maybe_broadcast(found), "source").where("bucket = edge")
    # Taken while at least half of it fits: the sum ends within half a document of the target.
    run = Window.partitionBy("source").orderBy("rank", "id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("fits", F.sum("size").over(run) - F.col("size") / 2 <= F.col("room")).where("fits")
    last = fits.groupBy("source").agg(F.max(F.struct("rank", "id", "tie")).alias("last"))
    return common.cut(found.select("source", "edge").join(last, "source", "left"))


def mix(rows: DataFrame, priced: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with ``copies``, whole copies and the sampled one together. Needs one row per source besides the row itself."""
    held = ranked(rows, priced).join(common.maybe_broadcast(ends), "source", "left")
    taken = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.struct("rank", "id", "tie") <= F.col("last")))
    return held.withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0))


def keys(seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """id, source (a key that is never null), u and tie of a document."""
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    tie = F.xxhash64(F.lit(seed + 1), F.col(text_col))
    return [F.col(id_col).alias("id"), source.alias("source"), uniform(seed, F.col(id_col), F.col(text_col)).alias("u"), tie.alias("tie")]


def weighed(size: Column, weight: Column | None = None) -> Column:
    """A document's weight, rounded to ``STEPS`` an octave."""
    weight = F.sqrt(size) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(1.0)
    return F.pow(F.lit(2.0), F.round(F.log2(F.greatest(weight, F.lit(1e-9))) * STEPS) / STEPS)


def sized(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """``keys``, size in words and weight of each document, repeated ones told ``apart``; written."""
    size = F.size(common.words(F.col(text_col))).cast("long")
    held = docs.select(*keys(seed, id_col, text_col, source_col), size.alias("size"), (F.lit(1.0) if weight is None else weight).alias("given"))
    return apart(common.cut(held.select("id", "source", "u", "tie", "size", weighed(F.col("size"), None if weight is None else F.col("given")).alias("weight"))))


def op1_pareto_mix(spark, sf_dir: str) -> DataFrame:
    rows = sized(common.read(spark, sf_dir, "documents"))
    priced = rates(rows, goals(rows))
    found = mix(rows, priced, edges(rows, priced))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"), F.col("expected"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` mixed to the targets: a row for each time the mix takes it. Texts are read twice; those of repeated rows are shuffled."""
    rows = sized(docs)
    repeated = common.cut(rows.where("repeated").select(*SAME).distinct())
    priced = rates(rows, goals(rows))
    ends = edges(rows, priced)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    size = F.size(common.words(F.col("text"))).cast("long")
    again = docs.select(row, *keys(1, "doc_id", "text", "source"), size.alias("size")).withColumn("weight", weighed(F.col("size")))
    if repeated.isEmpty():
        taken = mix(again, priced, ends).select("row", "copies")
    else:
        again = again.withColumn("first", F.col("u"))
        single = mix(common.join_few(again, repeated, SAME, "left_anti"), priced, ends).select("row", "copies")
        sums = common.cut(mix(common.join_few(rows, repeated, SAME, "left_semi"), priced, ends).groupBy(*SAME).agg(F.sum("copies").alias("copies")))
        one = common.join_few(again, repeated, SAME, "left_semi").groupBy(*SAME).agg(F.first("row").alias("row"))
        taken = single.unionByName(one.join(sums, SAME).select("row", "copies"))
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
