"""LM scoring by cross-entropy difference.

Two bigram models of the same order and smoothing share one vocabulary, the ids of a
public tokenizer with an edge symbol: the target model counts the documents labelled good
and not toxic, the background model counts every document.  A document's score is its
loss per token under the target less that under the background: low is like the target.

Counts cover all documents.  Tasks count their own bigrams before the shuffle.  The joined
model has a row per distinct bigram; its commonest bigrams, ``MOST_ROWS`` at most, are
broadcast as sorted arrays.  Where the model has more, each document's other bigrams, which
are the rare ones, are joined with the rest of it by shuffle, with the same scores.

P(b | a) = (c(ab) + M q(b)) / (c(a) + M), q(b) = (c(b) + 1) / (N + V), for each model.

Defined results: a null or blank text is its end symbol alone.  Null ids have no label.
Repeated rows count and return each; a document labelled twice is good if any label says
so.  Without a good document the target is uniform.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import common, tokens

VOCABULARY = 49408
EDGE, SYMBOLS = VOCABULARY, VOCABULARY + 1
#: Weight of the unigrams; bigrams that a broadcast may hold; bigrams held by a counting task.
WEIGHT, MOST_ROWS, HELD = 32.0, 2_000_000, 250_000


def keys(ids: bytes) -> np.ndarray:
    """Bigram keys of a text: edge, tokens, edge."""
    a = np.empty(len(ids) // 4 + 2, np.int64)
    a[0] = a[-1] = EDGE
    a[1:-1] = np.frombuffer(ids, "<u4")
    return a[:-1] * SYMBOLS + a[1:]


def bigrams(docs: DataFrame, path: str) -> DataFrame:
    """key, background, target: counts by task. docs: id, text, good."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([p[i] for p in parts]), len(key)).astype(np.int64) for i in (1, 2)]
        return key, sums[0], sums[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, parts, size = tokens.tokenizer(path), [], 0
        for batch in batches:
            good = np.array([bool(g) for g in batch.column("good").to_pylist()])
            for at, texts in tokens.slices(batch, "text"):
                each = [keys(i) for i in model.ids(texts)]
                mine = np.repeat(good[at : at + len(each)], [len(k) for k in each])
                k, back = np.unique(np.concatenate(each), return_inverse=True)
                parts.append((k, np.bincount(back, minlength=len(k)), np.bincount(back, mine, len(k)).astype(np.int64)))
                size += len(k)
                if size > 4 * HELD:
                    parts = [merge(parts)]
                    size = len(parts[0][0])
                    if size > HELD:  # more than a task holds: the shuffle adds the rest
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["key", "background", "target"])
                        parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merge(parts)], names=["key", "background", "target"])

    held = docs.select("text", "good").mapInArrow(run, "key long, background long, target long")
    return held.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Unigrams:
    """Per symbol: log-free parts of the smoothed probabilities, for target (0) and background (1)."""

    def __init__(self, model: DataFrame):
        first, second = np.zeros((2, SYMBOLS)), np.zeros((2, SYMBOLS))
        for column, into in ((F.floor(F.col("key") / SYMBOLS), first), (F.col("key") % SYMBOLS, second)):
            sums = model.groupBy(column.cast("long").alias("s")).agg(F.sum("target").alias("t"), F.sum("background").alias("b")).toArrow()  # at most one row per symbol
            s = sums["s"].to_numpy()
            into[0, s], into[1, s] = sums["t"].to_numpy(), sums["b"].to_numpy()
        self.context = first + WEIGHT
        self.base = WEIGHT * (second + 1) / (second.sum(axis=1, keepdims=True) + SYMBOLS)

    def losses(self, key: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Loss of bigrams under both models; counts[model, i]."""
        a, b = key // SYMBOLS, key % SYMBOLS
        return np.log(self.context[:, a]) - np.log(counts + self.base[:, b])


def train(docs: DataFrame, path: str) -> tuple[DataFrame, Unigrams]:
    model = common.cut(bigrams(docs, path))
    return model, Unigrams(model)


class Common:
    """Losses of the bigrams in ``rows`` (key, target, background), of others only where ``whole`` says that they have no counts."""

    def __init__(self, rows: DataFrame, unigrams: Unigrams, whole: bool):
        table = rows.orderBy("key").toArrow()
        self.key, self.unigrams, self.whole = table["key"].to_numpy(), unigrams, whole
        self.losses = unigrams.losses(self.key, np.stack([table["target"].to_numpy(), table["background"].to_numpy()])).astype(np.float64)

    def __call__(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses under both models and whether they are known; unknown ones are 0."""
        found, same = np.zeros((2, len(distinct))), np.zeros(len(distinct), bool)
        if len(self.key):
            i = np.minimum(np.searchsorted(self.key, distinct), len(self.key) - 1)
            same = self.key[i] == distinct
            found = np.where(same, self.losses[:, i], 0.0)
        if self.whole and not same.all():
            found[:, ~same] = self.unigrams.losses(distinct[~same], np.zeros((2, int((~same).sum()))))
            same[:] = True
        return found, same


def commonest(model: DataFrame, most_rows: int) -> int:
    """Least background count such that at most ``most_rows`` bigrams have it: 1 if all may stay. Counts by quarter octave reach the driver."""
    step = F.floor(F.log2(F.col("background").cast("double")) * 4)
    left = most_rows
    held = sorted(((r.s, r.c, r.m) for r in model.groupBy(step.alias("s")).agg(F.count("*").alias("c"), F.min("background").alias("m")).collect()), reverse=True)
    least = None
    for _, c, m in held:
        left -= c
        if left < 0:
            return (least if least is not None else m + 1) or 1
        least = m
    return 1


def score(docs: DataFrame, model: DataFrame, unigrams: Unigrams, path: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """id, n_tokens, loss_target, loss_background, score, per token, of every row of docs (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    least = commonest(model, most_rows)
    if least > 1:
        return _score_by_join(docs, model, unigrams, path, kind, least)
    held = docs.sparkSession.sparkContext.broadcast(Common(model, unigrams, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, losses = tokens.tokenizer(path), held.value
        for batch in batches:
            for at, texts in tokens.slices(batch, "text"):
                each = [keys(i) for i in words.ids(texts)]
                distinct, back = np.unique(np.concatenate(each), return_inverse=True)
                n = np.array([len(k) for k in each])
                sums = np.add.reduceat(losses(distinct)[0][:, back], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=1) / n
                yield _rows(batch.column("id").slice(at, len(each)), n, sums)

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n_tokens long, loss_target double, loss_background double, score double")


def _rows(ids: pa.Array, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[0] - sums[1])], names=["id", "n_tokens", "loss_target", "loss_background", "score"])


def _score_by_join(docs: DataFrame, model: DataFrame, unigrams: Unigrams, path: str, kind: str, least: int) -> DataFrame:
    """The same scores where the model is larger than a broadcast: bigrams of background count ``least`` are added up in the document's task, rarer ones meet the model by shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(Common(model.where(F.col("background") >= least), unigrams, False))
    held = docs.sparkSession.sparkContext.broadcast(unigrams)
    names = ["id", "row", "key", "n", "t", "b"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, row = tokens.tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, texts in tokens.slices(batch, "text"):
                each = [np.unique(keys(i), return_counts=True) for i in words.ids(texts)]
                which = np.repeat(np.arange(len(each)), [len(k) for k, _ in each])
                key, n = (np.concatenate(x) for x in zip(*each))
                loss, same = known.value(key)
                ids, rows = batch.column("id").slice(at, len(each)), np.arange(len(each)) + (task << 40) + row
                row += len(each)
                sums = [np.bincount(which, x, len(each)) for x in (n * same, loss[0] * n, loss[1] * n)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows), pa.nulls(len(each), pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=names)
                rare = np.flatnonzero(~same)
                none = np.zeros(len(rare))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which[rare])), pa.array(rows[which[rare]]), pa.array(key[rare]), pa.array(n[rare]), pa.array(none), pa.array(none)], names=names)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = b.column("key").to_numpy(), b.column("n").to_numpy()
            loss = held.value.losses(key, np.stack([b.column("target").to_numpy(), b.column("background").to_numpy()])) * n
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), b.column("n"), pa.array(loss[0]), pa.array(loss[1])], names=["id", "row", "n", "t", "b"])

    pairs = docs.select("id", "text").mapInArrow(explode, f"id {kind}, row long, key long, n long, t double, b double")
    pairs = common.cut(pairs)  # read twice: a document's own sums, and its rare bigrams
    rare = pairs.where("key IS NOT NULL").select("id", "row", "key", "n").join(model.where(F.col("background") < least), "key", "left").fillna(0, ["target", "background"])
    priced = rare.mapInArrow(price, f"id {kind}, row long, n long, t double, b double").unionByName(pairs.where("key IS NULL").drop("key"))
    sums = priced.groupBy("row", "id").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    return sums.select("id", F.col("n").alias("n_tokens"), (F.col("t") / F.col("n")).alias("loss_target"), (F.col("b") / F.col("n")).alias("loss_background"), ((F.col("t") - F.col("b")) / F.col("n")).alias("score"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, text, good: labelled of good quality and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select(F.col("doc_id").alias("id")).distinct().withColumn("good", F.lit(True))
    held = docs.select(F.col("doc_id").alias("id"), "text")
    return held.join(common.maybe_broadcast(good), "id", "left").withColumn("good", F.coalesce("good", F.lit(False)))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.default_vocabulary()
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model, unigrams = train(labelled(docs, common.read(spark, sf_dir, "labels")), path)
    return score(docs.withColumnRenamed("doc_id", "id"), model, unigrams, path).withColumnRenamed("id", "doc_id")
