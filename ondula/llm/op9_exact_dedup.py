"""Exact dedup by a Golomb-coded fingerprint exchange.

Every sender, a task that reads the fingerprints of its rows, sorts the distinct ones and
sends each owner of a fingerprint range one Golomb-Rice coded message, so only codes cross
the network.  Fingerprints are as short as the number of rows allows: ``SPARE_BITS`` more
than it takes to number them, about two bytes each when coded.  An owner decodes its
messages, finds fingerprints that came twice, and answers each message with a bitmap.  The
bitmaps select the suspects of the messages, and only texts with such a fingerprint are
shuffled and compared byte for byte; unique texts stay where they are, but for one in
``2^SPARE_BITS`` that a short fingerprint makes a suspect.

A copy that is common inside one sender is sent once with a flag, so an owner gets at most
one value per sender for it and no group of copies can fill an owner.  Owners are as many as
keep ``OWNED`` fingerprints each, whatever the size of the table.

Defined results: a null text counts as empty; the empty texts form one group.  Rows are
never merged: a row that is repeated with the same id gets its own output row, and each
row that bears ``keep_id`` is marked kept.  Ties on length go to the smallest id, null
ids last.  Ids may be of any type that can be ordered.  A very long text is compared whole.
An empty table gives an empty result; columns besides id and text are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm import common

#: Bits of a fingerprint beyond those that number the rows; fingerprints of one owner.
SPARE_BITS, OWNED = 10, 1 << 22


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Rice parameter and code of sorted distinct uint64 values: gaps as unary quotients, then as many rests of b bits."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    b = max(0, (int(values[-1]) // len(values)).bit_length() - 1)
    stop = np.cumsum((gaps >> np.uint64(b)).astype(np.int64) + 1) - 1
    bits = np.zeros(int(stop[-1]) + 1 + b * len(values), np.uint8)
    bits[stop] = 1
    shifts = np.arange(b, dtype=np.uint64)[::-1]
    bits[int(stop[-1]) + 1 :] = ((gaps[:, None] >> shifts) & np.uint64(1)).ravel()
    return b, np.packbits(bits).tobytes()


def golomb_decode(n: int, b: int, code: bytes) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    stop = np.flatnonzero(bits)[:n]
    quotient = (np.diff(stop, prepend=-1) - 1).astype(np.uint64)
    rest = bits[stop[-1] + 1 : stop[-1] + 1 + b * n].reshape(n, b).astype(np.uint64) << np.arange(b, dtype=np.uint64)[::-1]
    return np.cumsum((quotient << np.uint64(b)) + rest.sum(axis=1, dtype=np.uint64), dtype=np.uint64)


def _pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unpack(code: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(code, np.uint8), count=n).astype(bool)


def messages(prints: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """owner, sender, n, b, code, twice: of each task one message to each owner, of its distinct fingerprints less the owner's first. prints: fp, of ``bits`` bits."""
    low = np.uint64(bits - owner_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column("fp").to_numpy() for b in batches]
        values, times = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
        values = values.astype(np.uint64)
        owners, first = np.unique(values >> low, return_index=True)
        sender = TaskContext.get().partitionId()
        rows = []
        for owner, i, j in zip(owners.tolist(), first, [*first[1:], len(values)]):
            b, code = golomb_encode(values[i:j] - (np.uint64(owner) << low))
            rows.append((owner, sender, j - i, b, code, _pack(times[i:j] > 1)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["owner", "sender", "n", "b", "code", "twice"])

    return prints.mapInArrow(run, "owner long, sender long, n long, b int, code binary, twice binary")


def _answer(table: pa.Table) -> pa.Table:
    """Per owner: a bitmap for each message, set where the fingerprint came more than once in all."""
    got = table.to_pydict()
    parts = [golomb_decode(n, b, c) for n, b, c in zip(got["n"], got["b"], got["code"])]
    flags = [_unpack(t, n) for n, t in zip(got["n"], got["twice"])]
    _, back, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    duplicate = (times > 1)[back] | np.concatenate(flags)
    edges = np.cumsum([0, *map(len, parts)])
    maps = [_pack(duplicate[i:j]) for i, j in zip(edges, edges[1:])]
    return pa.table({"owner": pa.array(got["owner"], pa.int64()), "sender": pa.array(got["sender"], pa.int64()), "dup": pa.array(maps, pa.binary())})


def suspects(prints: DataFrame, bits: int, owner_bits: int, s: common.Scratch) -> DataFrame:
    """fp: the fingerprints that came more than once, written. prints: fp."""
    low = np.uint64(bits - owner_bits)
    sent = s.cut(messages(prints, bits, owner_bits))
    answers = s.cut(sent.groupBy("owner").applyInArrow(_answer, "owner long, sender long, dup binary"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                dup = _unpack(m["dup"], m["n"])
                if dup.any():
                    found = golomb_decode(m["n"], m["b"], m["code"])[dup] + (np.uint64(m["owner"]) << low)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], names=["fp"])

    return s.cut(sent.join(answers, ["owner", "sender"]).mapInArrow(read, "fp long").distinct())


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha (binary SHA-256 of the text without white space).

    Texts are equal when identical after deletion of ASCII white space; the row with the most
    code points, then the smallest id, is kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = df.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.length("text").alias("chars"), common.without(F.col("text"), common.SPACES).alias("norm"))
    hashed = F.xxhash64("norm")
    printed = common.cut(plain.select("id", hashed.alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    with common.Scratch(df.sparkSession) as s:
        rows = printed.count()
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        owner_bits = (max(width, -(-rows // OWNED)) - 1).bit_length()
        bits = min(max(rows.bit_length() + SPARE_BITS, owner_bits + 1), 62)
        short = lambda h: F.shiftrightunsigned(h, 64 - bits)
        twice = suspects(printed.select(short(F.col("hash")).alias("fp")), bits, owner_bits, s)
        met = common.join_few(plain.withColumn("fp", short(hashed)), twice, ["fp"], "left_semi")
        # Grouping by the text itself is the byte comparison; copies within a partition merge before the shuffle.
        same = met.groupBy("norm", "chars").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        order = F.struct((-F.col("chars")).alias("c"), F.col("least").isNull().alias("no"), F.col("least"))
        groups = same.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "n", order.alias("o")).groupBy("sha").agg(F.sum("n").alias("size"), F.min("o").alias("o"))
        # Written, so that the join has both sides dealt for it alone and Spark can split a large group.
        groups = common.cut(groups.where("size > 1").select("sha", F.lit(True).alias("met"), "size", F.col("o.least").alias("first")))
    return _joined(printed, groups)


def _joined(printed: DataFrame, groups: DataFrame) -> DataFrame:
    met = lambda yes, no: F.when(F.col("met"), yes).otherwise(no)
    size: Column = F.coalesce("size", F.lit(1)).cast("long")
    held = printed.join(common.maybe_broadcast(groups), "sha", "left")
    return held.select("id", met(F.col("first"), F.col("id")).alias("keep_id"), size.alias("group_size"), met(F.col("first").eqNullSafe(F.col("id")), F.lit(True)).alias("kept"), "sha")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(common.read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, keep_id IS NOT DISTINCT FROM doc_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
