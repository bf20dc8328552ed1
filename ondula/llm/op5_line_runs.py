"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

The text is the sequence of all documents' lines, in the order of their ids.  Only lines
that occur twice can be in a repeated run, so suffixes start at those lines only and stop
where the next line is unique.  A line's first rank is the number of occurrences of lines
before it in hash order.  A round joins each suffix's rank with the rank ``2^k`` lines on;
the pairs are counted, and a suffix's new rank is its old one plus the occurrences of
smaller pairs in its group, which is its place in the suffix array to depth ``2^(k+1)``.
Suffixes alone in their group leave.

Suffixes with equal ranks over L lines are an LCP interval of depth L or more.  A run of
lines is deleted where it has ``min_words`` words or more and stood earlier in the order
(id, then the document's hash, then the line).  Each maximal run of that kind is the union
of the shortest such windows that start or end at its lines, so doubling stops at the
longest of these windows, which has at most ``min_words`` lines: depth, not document
length, bounds the rounds.

Ranks and counts are pre-aggregated, places in a group of one rank are summed in two levels
(``before``), and suffix joins use (document, line), so one common line never gathers in a
task; only the joins on a rank meet a common line, and Spark splits those.

Defined results: null and empty texts have no lines.  Lines without a word are outside the
sequence and stay.  Lines are equal when their 64-bit hashes are.  Rows with equal id and
text are one document and lose the same lines.  Null ids come first in the order.  A very
long text is one document of many lines; a line of any length is one hash.  An empty table
gives an empty result; other columns are carried in a struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.llm import common

MIN_WORDS = 50
DOC = ["k1", "k2"]


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 (the document), id, line (its number), i (its place among lines with a word), h, words."""
    numbered = F.filter(F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x"))), lambda s: s.x.rlike(r"[^\x20\x09-\x0D]"))
    keyed = docs.select(*keys(id_col, text_col), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = common.once(keyed, DOC).select("k1", "k2", "id", F.posexplode(numbered).alias("i", "s"))
    return each.select("k1", "k2", "id", F.col("s.line").alias("line"), "i", F.xxhash64("s.x").alias("h"), F.size(common.words(F.col("s.x"))).alias("words"))


def keys(id_col: str, text_col: str) -> list:
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.xxhash64(F.lit(7), F.col(text_col), F.col(id_col)).alias("k2")]


#: Buckets of the two levels of ``before``, as a power of two.
BUCKETS = 12


def before(counts: DataFrame, by: list[str], value: str, n: str, bucket: Column) -> DataFrame:
    """``counts`` with before: the sum of n over smaller values of the same ``by``, in two levels: buckets of values, then values of a bucket.

    ``bucket`` must not fall where the value grows. No window holds more than the buckets of a
    group, or the values of one bucket, however many values a group has.
    """
    order = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    held = counts.withColumn("bucket", bucket)
    within = F.coalesce(F.sum(n).over(order(*by, "bucket").orderBy(value)), F.lit(0))
    sums = held.groupBy(*by, "bucket").agg(F.sum(n).alias("all"))
    base = sums.select(*by, "bucket", F.coalesce(F.sum("all").over(order(*(by or [F.lit(0)])).orderBy("bucket")), F.lit(0)).alias("base"))
    met = held.withColumn("within", within).join(base, [*by, "bucket"])
    return met.withColumn("before", F.col("base") + F.col("within")).drop("bucket", "base", "within")


def line_ranks(found: DataFrame, s: common.Scratch) -> DataFrame:
    """h, r of each line that occurs twice: occurrences of repeated lines before it in hash order."""
    counts = s.cut(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    return before(counts, [], "h", "n", F.shiftright("h", 64 - BUCKETS)).select("h", F.col("before").alias("r"))


def windows(words: np.ndarray, min_words: int) -> list[list[int]]:
    """For each start the lengths of the shortest windows of ``min_words`` words that start there, or that end at some line and start there."""
    out: list[set[int]] = [set() for _ in words]
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + min_words)
    for s, e in enumerate(ends):
        if e < len(total):
            out[s].add(int(e - s))
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    for t, s in enumerate(starts):
        if s >= 0:
            out[s].add(int(t + 1 - s))
    return [sorted(x) for x in out]


def suffixes(repeated: DataFrame, min_words: int) -> DataFrame:
    """k1, k2, id, i, r, lengths: a row per repeated line, with the windows that start at it."""
    kind = repeated.schema["id"].dataType.simpleString()
    docs = repeated.groupBy("k1", "k2", "id").agg(F.sort_array(F.collect_list(F.struct("i", "words", "r"))).alias("s"))
    flat = docs.select("k1", "k2", "id", F.col("s.i").alias("i"), F.col("s.words").alias("words"), F.col("s.r").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, words, ranks = (b.column(c).flatten().to_numpy() for c in ("i", "words", "r"))
            n = np.array([len(x) for x in b.column("i")], np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            # Blocks of lines that follow each other in one document.
            cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) != 1)) + 1
            found = [w for block in np.split(words, cut) for w in windows(block, min_words)] if len(words) else []
            whole = [b.column(c).take(pa.array(doc)) for c in ("k1", "k2", "id")]
            yield pa.RecordBatch.from_arrays([*whole, pa.array(at), pa.array(ranks), pa.array(found, pa.list_(pa.int32()))], names=["k1", "k2", "id", "i", "r", "lengths"])

    return flat.mapInArrow(run, f"k1 long, k2 long, id {kind}, i int, r long, lengths array<int>")


def double(held: DataFrame, step: int, s: common.Scratch) -> DataFrame:
    """Ranks to twice the depth, of suffixes that are still not alone. held: written."""
    half = held.select(*DOC, (F.col("i") - step).alias("i"), F.col("r").alias("r2"))
    both = held.join(half, [*DOC, "i"])
    pairs = s.cut(both.groupBy("r", "r2").agg(F.count("*").alias("n")))
    bits = int(held.agg(F.max("r")).first()[0] or 0).bit_length()
    placed = s.cut(before(pairs, ["r"], "r2", "n", F.shiftright("r2", max(0, bits - BUCKETS))).where("n > 1").select("r", "r2", "before"))
    return both.join(placed, ["r", "r2"]).select(*DOC, "id", "i", (F.col("r") + F.col("before")).alias("r"), "lengths")


def intervals(held: DataFrame, step: int) -> DataFrame:
    """k1, k2, id, i, length, ra, rb of the windows of step..2*step-1 lines: equal ranks at both ends are equal windows."""
    mine = held.select(*DOC, "id", "i", F.col("r").alias("ra"), F.explode(F.filter("lengths", lambda x: (x >= step) & (x < 2 * step))).alias("length"))
    if step == 1:
        return mine.withColumn("rb", F.col("ra"))
    last = held.select(*DOC, F.col("i").alias("j"), F.col("r").alias("rb"))
    return mine.withColumn("j", F.col("i") + F.col("length") - step).join(last, [*DOC, "j"]).drop("j")


def later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k1, k2, deleted: the numbers of the lines of each document that stood earlier in a run of ``min_words`` words. Written."""
    with common.Scratch(docs.sparkSession) as s:
        found = s.cut(lines(docs, id_col, text_col))
        ranks = s.cut(line_ranks(found, s))
        repeated = s.cut(found.join(common.maybe_broadcast(ranks), "h").drop("h"))
        held = s.cut(suffixes(repeated, min_words))
        longest = held.select(F.max(F.array_max("lengths"))).first()[0] or 0
        every, step = intervals(held, 1), 1
        while 2 * step <= longest:
            held = s.cut(double(held, step, s))
            step *= 2
            every = every.unionByName(intervals(held, step))
        every = s.cut(every)
        same = ["length", "ra", "rb"]
        place = F.struct("id", *DOC, "i")
        # Written, so that the join below has both sides dealt for it alone and Spark can split a common passage.
        first = s.cut(every.groupBy(*same).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
        later = every.join(first, same).where(place > F.col("first"))
        runs = later.select(*DOC, F.explode(F.sequence("i", F.col("i") + F.col("length") - 1)).alias("i")).distinct().join(repeated.select(*DOC, "i", "line"), [*DOC, "i"])
        return common.cut(runs.groupBy(*DOC).agg(F.collect_list("line").alias("deleted")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (the input's columns), ``text`` without the deleted lines, ``n_lines`` and ``deleted`` (line numbers)."""
    edits = later_runs(docs, id_col, text_col, min_words)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = common.join_few(docs.select(row, *keys(id_col, text_col)), edits, DOC, "left").drop(*DOC)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, gone = [], [], []
            for text, deleted in zip(b.column("row").field(place).to_pylist(), b.column("deleted").to_pylist()):
                parts = text.split("\n") if text else []
                counts.append(len(parts))
                gone.append(sorted(deleted or []))
                if deleted:
                    out = set(deleted)
                    text = "\n".join([x for i, x in enumerate(parts) if i not in out])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["row", "text", "n_lines", "deleted"])

    schema = T.StructType().add(held.schema["row"]).add("text", "string").add("n_lines", "long").add("deleted", T.ArrayType(T.IntegerType()))
    return held.mapInArrow(run, schema)


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("row.doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), "deleted", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without repeated runs; a document that loses every word goes, as all of it stood before."""
    found = line_dedup(docs)
    kept = found.where((F.size("deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    cols = [F.col("text") if c == "text" else F.when(F.size("deleted") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return kept.select(*cols)


#: Runs are islands on the diagonals of equal lines: both documents go on line by line.
SQL = r"""
WITH n AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM n WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
p AS (SELECT a.doc_id, b.doc_id AS other, a.i, a.i - b.i AS diagonal, a.line, a.words FROM l a JOIN l b ON a.x = b.x AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY i) AS island FROM p),
w AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, other, diagonal, island) AS total FROM r),
g AS (SELECT doc_id, list(DISTINCT line::INT ORDER BY line::INT) AS gone FROM w WHERE total >= 50 GROUP BY doc_id),
k AS (SELECT n.doc_id, string_agg(x, chr(10) ORDER BY line) FILTER (WHERE NOT list_contains(gone, line)) AS kept FROM n JOIN g USING (doc_id) GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(len(gone), 0) AS n_deleted, coalesce(gone, []::INT[]) AS deleted,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(kept, '') END AS text FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
