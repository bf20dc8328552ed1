"""What the training-data operators share: reading, cutting lineage, ASCII white space.

A word is ``[^\\x20\\x09-\\x0D]+`` everywhere: a run of characters other than the six
ASCII white-space characters.  Other Unicode spaces belong to words.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space characters, and as a regular expression's run.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Broadcast nothing larger than this many bytes; beyond it the callers shuffle. Bytes that a row of a hashed relation takes besides its values.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one only where none is named and one machine runs all."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ondula-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows as a table written in the shared folder: lineage ends here, lost executors cost nothing."""
    return _write(df, f"{shared_dir(df.sparkSession)}/ondula/{uuid.uuid4().hex}")


class Scratch:
    """``with Scratch(spark) as s``: tables written by ``s.cut`` in a folder of the shared one, deleted when the block ends.

    What outlives the block is written by the ``cut`` above.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/ondula/{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return _write(df, f"{self.path}/{self.n}")

    def __exit__(self, *_: object) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def without(text: Column, characters: str) -> Column:
    """The text with every one of these characters deleted, inside whole-stage code."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RUN)
    return F.array_remove(parts, "")


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value: 8 for a number, the length of a text, the sum of a struct's fields or an array's elements."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(0)) + 8
        return F.greatest(F.size(value), F.lit(0)) * 8 + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(0))
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df, a written table, take at most ``limit`` bytes when broadcast."""
    each = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES)).cast("long")
    return (df.agg(F.sum(each)).first()[0] or 0) <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if small(df, limit) else df


#: Slots of the bitmap of ``marks``, and those of one of its rows, as powers of two: 32 MB in 65,536 rows at most.
SLOT_BITS, CHUNK_BITS = 28, 12


def _slot(keys: list[str]) -> tuple[Column, Column, Column]:
    """Row, word and bit of a key's slot in the bitmap."""
    slot = F.shiftrightunsigned(F.xxhash64(*keys), 64 - SLOT_BITS)
    return F.shiftright(slot, CHUNK_BITS), F.shiftright(slot, 6).bitwiseAND(F.lit((1 << CHUNK_BITS - 6) - 1)).cast("int"), slot.bitwiseAND(F.lit(63)).cast("int")


def marks(right: DataFrame, keys: list[str]) -> DataFrame:
    """_chunk, _bits (words of 64 slots): the slots of right's keys, written. Its size has a bound, however many keys there are."""
    chunk, word, bit = _slot(keys)
    words = right.select(chunk.alias("_chunk"), word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    words = words.groupBy("_chunk", "w").agg(F.bit_or("b").alias("b"))
    held = words.groupBy("_chunk").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    each = F.sequence(F.lit(0), F.lit((1 << CHUNK_BITS - 6) - 1))
    return cut(held.select("_chunk", F.transform(each, lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("_bits")))


def tag(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with _marked: whether a key of right has the row's slot. Nothing is shuffled."""
    chunk, word, bit = _slot(keys)
    held = left.withColumn("_chunk", chunk).join(F.broadcast(marks(right, keys)), "_chunk", "left")
    marked = F.coalesce(F.bit_get(F.get("_bits", word), bit) == 1, F.lit(False))
    return held.withColumn("_marked", marked).drop("_chunk", "_bits")


def join_few(left: DataFrame, right: DataFrame, keys: list[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``left.join(right, keys, how)`` for rows of left that carry texts. right: a written table; how: inner, left, left_semi or left_anti.

    A right of at most ``limit`` bytes is broadcast.  Beyond it the bitmap of its keys is, and only rows of left whose slot is
    marked are shuffled: those that meet right, and of the others a share of at most right's keys in ``2^SLOT_BITS``.  The
    rest stay where they are read.
    """
    if small(right, limit):
        return left.join(F.broadcast(right), keys, how)
    tagged = tag(left, right, keys)
    some = tagged.where("_marked").drop("_marked").join(right, keys, how)
    if how in ("inner", "left_semi"):
        return some
    return some.unionByName(tagged.where("NOT _marked").drop("_marked"), allowMissingColumns=True)


def once(docs: DataFrame, keys: list[str], repeated: DataFrame | None = None) -> DataFrame:
    """``docs`` with one of the rows of each value of the keys. repeated: the values with several rows, a written table if known.

    Only keys are shuffled, and the rows of repeated ones.
    """
    if repeated is None:
        repeated = cut(docs.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").select(*keys))
    if repeated.isEmpty():
        return docs
    twice = repeated.select(*keys)
    return join_few(docs, twice, keys, "left_anti").unionByName(join_few(docs, twice, keys, "left_semi").dropDuplicates(keys))
