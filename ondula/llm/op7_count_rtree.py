"""N-gram Jaccard join over a count-vector R-tree.

A document is the set of its word shingles, as 64-bit hashes.  Shingles are hashed into
groups and a set's group counts are its point, at three grains of the same hash: every hash
a group of its own, at most 512 groups (for boxes), and about one shingle to a group (up to
32,768).  The overlap of two sets is at most the sum of the smaller of their coordinates, and
for two nodes of the tree at most that of their largest coordinates.

* Upper nodes (``members``) are boxes that have no width in one block of coordinates.  Two
  sets of sizes up to e that reach Jaccard t differ in at most ``r = 2 e (1 - t) / (1 + t)``
  shingles, so of more than r blocks at least one has equal counts in both: a set descends to
  the nodes named by (size class, block, the block's counts at the finest grain), for its own
  class and, if a partner can be that large, the next.  A set that fills more than r blocks shares a filled one with each
  partner, so its empty blocks name no node.  For the same reason r + 1 filled ones are enough, and each set keeps its
  least frequented (``rarest``): in one order of all nodes, two sets that share one still do.
* Sets that meet in a node of more than ``HOT`` leave it for nodes of ``FINE`` times as many blocks, told from their texts
  again: a set that differs from a family's core in more than r blocks then leaves all that the family has in common.
* The first join pairs the sets of a node with the one that lies in the most frequented nodes, the nearest to the core of
  its family, and what links is one component.
* In the nodes that still hold several components, sets lie in leaves of about ``LEAF`` in
  tree order (component, size), with size range and largest coordinates (``descend``).  Pairs
  of nodes go down from the root, 16 children to a node; a pair of one component, or whose
  sizes or summed minima are too small, is dropped with all below it.
* Sets that share one node often share hundreds.  Each row of a node carries the ``SKETCH``
  first open nodes of its set, the most frequented first, and a pair that has a common one before
  the node at hand leaves it to that one (``own_pairs``): near copies just under the threshold are met once, not in
  each node.  Only sets with a pair of their own in a node travel there with a point, which is
  bounded at about one shingle a group, whatever the set's size (``near_points``).
* Surviving pairs are verified on the whole sets, read again from the texts (``verify``).
  Names, points and pairs are all that is written or shuffled before.

No pair of copies is ever listed: identical sets are one point, and a group of near copies
is one component after the first join.  Hot nodes are split in leaves, and hot stars by the
shingles of their partners, so no task holds more than two leaves of points, or
``MOST`` shingles and two texts.

Defined results: a null or blank text has no shingles and is alone; fewer words than a
shingle are one shingle of their own kind; null ids are ignored by the smallest id unless
all are null; repeated rows each return.  An empty table gives an empty result.  A very long
text is one set, hashed whole; other columns are ignored, whatever their names, and carried
by ``stage``.  Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ondula.llm import common, graph, tokens

#: Jaccard threshold in hundredths; words of a shingle.
PERCENT, WORDS = 90, 3
#: Coordinates of a node's box; sets of a leaf; children of an inner node, as a power of two; sets from which a node is hot.
BOX, LEAF, FAN, HOT = 64, 256, 4, 64
#: Blocks of the fine nodes of sets that lie in hot ones, times the shingles that may differ.
FINE = 4
#: First open nodes of a set that go with it.
SKETCH = 32
#: Shingles that are verified together.
MOST = 1 << 17
#: Bytes of text hashed at once; a byte takes about a hundred while it is.
SLICE = 1 << 18

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and the number of words of each text."""
    joined = b"\n".join(texts).lower()  # bytes: ASCII letters only
    a = np.frombuffer(joined, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[a]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([space[1:], [True]])) + 1
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, edges))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    length = ends - starts
    letters = a[inside]
    at = np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)
    powers = np.full(int(length.max()), _POWER)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_BYTE[letters] * powers[at], np.cumsum(length) - length)
    return mix(sums + length.astype(np.uint64) * _STEP), counts


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    chain = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        chain = mix(chain * _STEP + words[i : len(words) - k + 1 + i])
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(chain[at : at + n - k + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for w in words[at : at + n]:
                x = mix(x * _STEP + w)
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def size_classes(most: int, percent: int) -> np.ndarray:
    """Largest size of each class: sizes of one class, or of two that follow, may link; others can't."""
    ends, e = [], 0
    while e < most:
        e = (e + 1) * 100 // percent * 100 // percent
        ends.append(e)
    return np.array([*ends, (e + 1) * 100 // percent * 100 // percent], np.int64)


def cells(sets: list[np.ndarray], percent: int, scale: int = 1) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each set: names of its upper nodes, whether of the next size class, and how many filled blocks of that class it may do without.

    scale: times the shingles that may differ there are so many blocks, and a fifth more.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = size_classes(int(sizes.max(initial=1)), percent)
    own = np.searchsorted(ends, sizes)
    every = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    high, value = mix(every + _STEP) >> np.uint64(32), mix(every ^ _MIX1)
    parts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in sets]
    for shift in (0, 1):
        tag = own + shift
        differ = 2 * ends[tag] * (100 - percent) // (100 + percent)
        used = (differ > 0) & (sizes > 0)  # nothing may differ: only identical sets link
        if shift:
            used &= sizes * 100 // percent > ends[own]  # no partner is of the next class
        blocks = np.where(used, scale * differ + differ // 5 + 1, 0)
        first = np.cumsum(blocks) - blocks
        wide = np.repeat(blocks, sizes).astype(np.uint64)
        used = wide > 0
        index = (np.repeat(first, sizes)[used] + ((high[used] * wide[used]) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        sums = np.zeros(int(blocks.sum()), np.uint64)
        np.add.at(sums, index, value[used])
        place = np.arange(len(sums)) - np.repeat(first, blocks)
        names = mix(mix(sums + np.repeat(tag, blocks).astype(np.uint64) * _MIX1) + (place * scale + scale - 1).astype(np.uint64) * _MIX2)
        # Empty blocks say nothing: they count only for a set that fills no more blocks than may differ.
        of = np.repeat(np.arange(len(sets)), blocks)
        filled = np.zeros(len(sums), bool)
        filled[index] = True
        spare = np.bincount(of, filled, len(sets)).astype(np.int64) - differ - 1
        keep = filled | (spare < 0)[of]
        for p, c, n in zip(parts, np.split(names[keep], np.cumsum(np.bincount(of[keep], minlength=len(sets)))[:-1]), spare):
            p.append((c, np.full(len(c), shift), np.full(len(c), n)))
    return [tuple(np.concatenate(x) for x in zip(*p)) for p in parts]


def set_name(s: np.ndarray) -> int:
    return int(mix(np.array([len(s)], np.uint64) * _STEP + mix(s + _MIX2).sum(dtype=np.uint64)).view(np.int64)[0])


def point(s: np.ndarray, bits: int) -> np.ndarray:
    """Counts of a set in ``2^bits`` groups, cut at 255."""
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def grains(n: int) -> tuple[int, int]:
    """Bits of the middle and the fine grain of a set of n."""
    fine = min(max(int(n - 1).bit_length(), 6), 15)
    return min(fine, 9), fine


def overlap(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Bound of the overlap: summed minima of the last axis, and the smaller of what cut coordinates leave out."""
    cut = np.minimum(n_a - a.sum(axis=-1, dtype=np.int64), n_b - b.sum(axis=-1, dtype=np.int64))
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64) + cut


def coarser(p: np.ndarray, size: int) -> np.ndarray:
    """The point in fewer groups, each the sum of neighbours."""
    return p if len(p) == size else p.reshape(size, -1).sum(axis=1, dtype=np.uint32)


def enough(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with which sizes a and b link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """id, k1, k2, name (of the set, null if empty), n, mid, fine (its points, of the first row of a set in a task)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at, texts in tokens.slices(batch, "text", SLICE):
                names: list[int | None] = []
                points: list[tuple[bytes | None, bytes | None]] = []
                sizes = []
                for s in shingle_sets(texts, k):
                    names.append(set_name(s) if len(s) else None)
                    sizes.append(len(s))
                    fresh = len(s) and names[-1] not in seen
                    points.append(tuple(point(s, bits).tobytes() for bits in grains(len(s))) if fresh else (None, None))
                    seen.add(names[-1])
                same = [batch.column(c).slice(at, len(texts)) for c in ("id", "k1", "k2")]
                cols = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(p, pa.binary()) for p in zip(*points))]
                yield pa.RecordBatch.from_arrays(same + cols, names=["id", "k1", "k2", "name", "n", "mid", "fine"])

    return docs.select("id", "k1", "k2", "text").mapInArrow(run, f"id {kind}, k1 long, k2 long, name long, n long, mid binary, fine binary")


def nodes(docs: DataFrame, percent: int, k: int, scale: int = 1) -> DataFrame:
    """cell, name, shift, spare: the upper nodes of each set, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in tokens.slices(batch, "text", SLICE):
                fresh = {n: s for s in shingle_sets(texts, k) if len(s) and (n := set_name(s)) not in seen}
                seen.update(fresh)
                found = cells(list(fresh.values()), percent, scale)
                if found:
                    names = np.repeat(np.fromiter(fresh, np.int64, len(fresh)), [len(f[0]) for f in found])
                    cell, shift, spare = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(names), pa.array(shift, pa.int32()), pa.array(spare)], names=["cell", "name", "shift", "spare"])

    return docs.select("text").mapInArrow(run, "cell long, name long, shift int, spare long")


def rarest(held: DataFrame, s: common.Scratch) -> DataFrame:
    """cell, name, c (sets of the node): ``held`` (written, of ``nodes``) without the ``spare`` most frequented nodes of each set.

    One order of all nodes serves all sets; those of a single set, held or not, come first in it.
    """
    counts = common.maybe_broadcast(s.cut(held.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1")))
    place = F.row_number().over(Window.partitionBy("name", "shift").orderBy(F.desc("c"), "cell"))
    return held.join(counts, "cell").withColumn("place", place).where("place > spare").select("cell", "name", "c")


def members(docs: DataFrame, found: DataFrame, percent: int, k: int, s: common.Scratch, hot: int = HOT) -> DataFrame:
    """cell, name, c, written: the nodes with two different sets, of each set the least frequented it needs.

    The nodes of all sets are told twice rather than written: first to find those with two
    sets, which tasks add up before the shuffle, then to keep their members.
    """
    every = nodes(docs, percent, k)
    shared = every.groupBy("cell").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("cell")
    held = s.cut(rarest(s.cut(every.join(common.maybe_broadcast(s.cut(shared)), "cell", "left_semi").distinct()), s))
    large = s.cut(held.groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("cell"))
    if large.isEmpty():
        return held
    large = common.maybe_broadcast(large)
    crowd = common.maybe_broadcast(s.cut(held.join(large, "cell", "left_semi").select("name").distinct()))
    keys = found.where("fine IS NOT NULL").join(crowd, "name", "left_semi").groupBy("name").agg(F.min(F.struct("k1", "k2")).alias("r")).select("r.*")
    fine = nodes(common.join_few(docs, s.cut(keys), ["k1", "k2"], "inner"), percent, k, FINE).distinct()
    return s.cut(held.join(large, "cell", "left_anti").unionByName(rarest(s.cut(fine), s)))


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (u, v) whose points at the fine grain allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.stack([b.column("n_u").to_numpy(), b.column("n_v").to_numpy()])
            need, keep = enough(n[0], n[1], percent), np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("p_u").to_pylist(), b.column("p_v").to_pylist())):
                p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(p), len(q))
                keep[i] = n[:, i].min() >= need[i] and overlap(coarser(p, size), coarser(q, size), n[0, i], n[1, i]) >= need[i]
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(keep)), b.column("v").filter(pa.array(keep))], names=["u", "v"])

    u, v = (sets.select(F.col("name").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"p_{x}")) for x in "uv")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "n_u", "n_v", "p_u", "p_v").mapInArrow(run, "u long, v long")


def verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int, k: int, s: common.Scratch) -> DataFrame:
    """The links among ``pairs`` (u, v; written): each u meets its partners, in as many parts as their shingles need."""

    def run(table: pa.Table) -> pa.Table:
        found = {n: x for n, x in zip(table["name"].to_pylist(), [x for batch in table.to_batches() for _, t in tokens.slices(batch, "text", SLICE) for x in shingle_sets(t, k)])}
        centre = next((n for n, c in zip(table["name"].to_pylist(), table["centre"].to_pylist()) if c), None)
        mine = found.pop(centre, np.empty(0, np.uint64))
        linked = [n for n, x in found.items() if len(np.intersect1d(mine, x, assume_unique=True)) >= enough(len(mine), len(x), percent)]
        return pa.table({"u": pa.array([centre] * len(linked), pa.int64()), "v": pa.array(linked, pa.int64())})

    sized = pairs.join(sets.select(F.col("name").alias("v"), "n"), "v")
    parts = s.cut(sized.groupBy("u").agg(F.ceil(F.sum("n") / MOST).alias("parts")))
    dealt = s.cut(pairs.join(parts, "u").select("u", "v", F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("parts"))).alias("unit")))
    named = dealt.select("unit", F.col("v").alias("name"), F.lit(False).alias("centre")).unionByName(dealt.select("unit", F.col("u").alias("name"), F.lit(True).alias("centre")).distinct())
    wanted = s.cut(named.join(sets.select("name", "k1", "k2"), "name"))
    met = common.join_few(docs, wanted, ["k1", "k2"], "inner")
    return met.select("unit", "name", "centre", "text").groupBy("unit").applyInArrow(run, "u long, v long")


def _lone(least: str, most: str) -> Column:
    """The component of a node, null if it holds several."""
    return F.when(F.col(least) == F.col(most), F.col(least))


def boxes(rows: DataFrame) -> DataFrame:
    """cell, leaf, low, high, least, most (components), box (largest coordinates): a row per leaf of ``rows``."""

    def run(table: pa.Table) -> pa.Table:
        box = np.max([coarser(np.frombuffer(p, np.uint8), BOX) for p in table["mid"].to_pylist()], axis=0)
        n, comp = table["n"].to_numpy(), table["comp"].to_numpy()
        one = [table["cell"][0].as_py(), table["leaf"][0].as_py(), int(n.min()), int(n.max()), int(comp.min()), int(comp.max()), box.tolist()]
        return pa.table({c: pa.array([v]) for c, v in zip(("cell", "leaf", "low", "high", "least", "most", "box"), one)})

    return rows.select("cell", "leaf", "n", "comp", "mid").groupBy("cell", "leaf").applyInArrow(run, "cell long, leaf long, low long, high long, least long, most long, box array<long>")


def descend(leaves: DataFrame, percent: int, s: common.Scratch) -> DataFrame:
    """cell, a, b (a <= b): pairs of leaves that may hold a link, by going down from the roots. leaves: written, of ``boxes``."""
    top = leaves.agg(F.max("leaf")).first()[0] or 0
    height = -(-int(top).bit_length() // FAN)

    def level(h: int) -> DataFrame:
        if not h:
            return leaves
        most = F.array(*[F.max(F.col("box")[i]) for i in range(BOX)])
        return leaves.groupBy("cell", F.shiftright("leaf", FAN * h).alias("leaf")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"), most.alias("box"))

    pairs = leaves.select("cell", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for h in range(height - 1, -1, -1):
        children = lambda c: F.explode(F.sequence(F.shiftleft(c, FAN), F.shiftleft(c, FAN) + (1 << FAN) - 1)).alias(c)
        below = pairs.select("cell", children("a"), "b").select("cell", "a", children("b")).where("a <= b")
        here = s.cut(level(h))
        a, b = (here.select("cell", *[F.col(c).alias(x if c == "leaf" else f"{c}_{x}") for c in ("leaf", "low", "high", "least", "most", "box")]) for x in "ab")
        met = below.join(a, ["cell", "a"]).join(b, ["cell", "b"])
        apart = _lone("least_a", "most_a").isNull() | ~_lone("least_a", "most_a").eqNullSafe(_lone("least_b", "most_b"))
        sizes = (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
        minima = F.aggregate(F.zip_with("box_a", "box_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda x, y: x + y)
        # A cut coordinate is at its limit of 255: such boxes bound nothing.
        whole = (F.array_max("box_a") < 255) & (F.array_max("box_b") < 255)
        enough_ = minima * (100 + percent) >= percent * (F.col("low_a") + F.col("low_b"))
        pairs = s.cut(met.where(apart & sizes & (~whole | enough_)).select("cell", "a", "b"))
    return pairs


def leafed(rows: DataFrame) -> DataFrame:
    """``rows`` with leaf: of a node's sets in tree order (large components, then size), about ``LEAF`` to a leaf.

    Sets of one component and size are dealt by hash, so a leaf's place needs counts only.
    """
    own = rows.groupBy("cell", "comp").agg(F.count("*").alias("c")).select("cell", "comp", F.when(F.col("c") >= LEAF // 4, F.col("comp")).alias("own"))
    held = rows.join(own, ["cell", "comp"]).withColumn("own", F.coalesce("own", F.lit(-(1 << 63))))
    counts = held.groupBy("cell", "own", "n").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("cell").orderBy("own", "n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    place = F.floor((F.col("before") + F.pmod(F.xxhash64("name"), F.col("c"))) / LEAF).cast("long")
    return held.join(counts.withColumn("before", before), ["cell", "own", "n"]).withColumn("leaf", place).drop("own", "c", "before")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys, of batches in order of the key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for i, j in zip(edges, edges[1:]):
            if held and held[0].column(key)[0].as_py() != keys[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def own_pairs(t: pa.Table, percent: int) -> np.ndarray:
    """Which pairs (row i, column j < i) of a unit's rows are to be bounded in it.

    They are of different components and sides, of sizes that may link, and have no common node
    before this one among their first: they would meet there.  A unit's sides 0 and 1 are two
    leaves, which meet each other; side -1 is one leaf, whose sets meet among themselves.
    """
    comp, n, side = (t[c].to_numpy() for c in ("comp", "n", "side"))
    first, order = t["first"].combine_chunks(), t["orders"].combine_chunks().flatten().to_numpy()
    value, of = first.flatten().to_numpy(), np.repeat(np.arange(len(n)), first.value_lengths().to_numpy())
    here = t["order"][0].as_py()
    before = (order < here) | ((order == here) & (value < t["cell"][0].as_py()))
    nodes_, column = np.unique(value[before], return_inverse=True)
    has = np.zeros((len(n), len(nodes_)), np.float32)
    has[of[before], column] = 1
    met = has @ has.T > 0
    sized = np.minimum.outer(n, n) * 100 >= np.maximum.outer(n, n) * percent
    sides = (side < 0)[:, None] | (side[:, None] != side)
    return np.tril((comp[:, None] != comp) & sides & sized & ~met, -1)


#: order: of the node, less what it holds; first, orders: the first nodes of the set and theirs.
UNIT = "unit long, cell long, order long, side int, name long, comp long, n long, first array<long>, orders array<long>"


def met_here(units: DataFrame, percent: int) -> DataFrame:
    """The rows of ``units`` (of ``UNIT``) that have a pair of their own there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "unit"):
            pairs = own_pairs(t, percent)
            yield from t.filter(pa.array(pairs.any(axis=0) | pairs.any(axis=1))).to_batches()

    return units.repartition(F.col("unit")).sortWithinPartitions("unit").mapInArrow(run, UNIT)


def near_points(units: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of ``units`` (of ``UNIT``, and fine) whose points allow a link; mostly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "unit"):
            name, n, pairs = t["name"].to_numpy(), t["n"].to_numpy(), own_pairs(t, percent)
            raw = [np.frombuffer(p, np.uint8) for p in t["fine"].to_pylist()]
            size = min(map(len, raw))
            grains_ = [np.stack([coarser(p, g) for p in raw]) for g in sorted({min(size, 1 << 9), size})]
            out = []
            for i in np.flatnonzero(pairs.any(axis=1)):
                js = np.flatnonzero(pairs[i])
                for points in grains_:
                    js = js[overlap(points[js], points[i], n[js], n[i]) >= enough(n[js], n[i], percent)]
                out.append(np.stack([np.minimum(name[js], name[i]), np.maximum(name[js], name[i])]))
            if out:
                u, v = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return units.repartition(F.col("unit")).sortWithinPartitions("unit").mapInArrow(run, "u long, v long")


def tree_join(held: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, s: common.Scratch) -> DataFrame:
    """u, v: pairs of different components that share an upper node and that leaves and points allow, each once. held: members; roots: node, root."""
    comp = F.coalesce("root", "name").alias("comp")
    parts = s.cut(held.join(common.maybe_broadcast(roots.withColumnRenamed("node", "name")), "name", "left").select("cell", "name", comp))
    open_ = parts.groupBy("cell").agg(F.count("*").alias("c"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("c > 2 AND least <> most")
    open_ = s.cut(open_.select("cell", "c"))  # of two sets, the first join has seen the pair
    open_rows = parts.join(common.maybe_broadcast(open_), "cell")
    first = open_rows.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("order"), "cell"))), 1, SKETCH).alias("f"))
    sketched = s.cut(first.join(sets.select("name", "n"), "name").select("name", "n", F.col("f.cell").alias("first"), F.col("f.order").alias("orders")))
    sketches = common.maybe_broadcast(sketched)
    units = open_rows.where(F.col("c") <= LEAF).withColumn("order", -F.col("c")).join(sketches, "name").select(F.col("cell").alias("unit"), "cell", "order", F.lit(-1).alias("side"), "name", "comp", "n", "first", "orders")
    if not open_.where(F.col("c") > LEAF).isEmpty():
        # Leaves are numbered on short rows: their plan reads them several times.
        short = s.cut(open_rows.where(F.col("c") > LEAF).select("cell", "name", "comp", (-F.col("c")).alias("order")).join(sketches, "name").drop("first", "orders"))
        large = s.cut(leafed(short).join(sketches.select("name", "first", "orders"), "name"))
        pairs = descend(s.cut(boxes(large.join(sets.select("name", "mid"), "name"))), percent, s)
        same = F.col("a") == F.col("b")
        for leaf, side, met in (("a", F.when(same, -1).otherwise(0), pairs), ("b", F.lit(1), pairs.where(~same))):
            unit = F.xxhash64("cell", "a", "b").alias("unit")
            units = units.unionByName(large.join(common.maybe_broadcast(met.withColumn("leaf", F.col(leaf))), ["cell", "leaf"]).select(unit, "cell", "order", side.alias("side"), "name", "comp", "n", "first", "orders"))
    return near_points(met_here(units, percent).join(sets.select("name", "fine"), "name"), percent).distinct()


def links(found: DataFrame, docs: DataFrame, percent: int, k: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root of the components of linked sets, by ``cut``. found: a written table of describe(); docs: k1, k2, text."""
    with common.Scratch(docs.sparkSession) as s:
        held = members(docs, found, percent, k, s)
        weights = common.maybe_broadcast(s.cut(held.groupBy("name").agg(F.sum("c").alias("w"))))
        centre = F.min_by("name", F.struct(-F.col("w"), "name")).alias("u")
        first = s.cut(held.join(weights, "name").groupBy("cell").agg(F.count("*").alias("n"), centre).where("n > 1").select("cell", "u"))
        stars = s.cut(held.join(common.maybe_broadcast(first), "cell").where("name <> u").select("u", F.col("name").alias("v")).distinct())
        involved = s.cut(stars.select(F.explode(F.array("u", "v")).alias("name")).distinct())
        drawn = found.where("fine IS NOT NULL").join(common.maybe_broadcast(involved), "name", "left_semi")
        sets = s.cut(drawn.groupBy("name").agg(F.min_by(F.struct("k1", "k2", "n", "mid", "fine"), F.struct("k1", "k2")).alias("r")).select("name", "r.*"))
        near = s.cut(verify(docs, sets, s.cut(bounded(stars, sets, percent)), percent, k, s))
        roots = graph.components(near, s.cut)
        far = s.cut(tree_join(held, roots, sets, percent, s))
        return graph.components(near.unionByName(verify(docs, sets, far, percent, k, s)), cut)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the two hashes that name a row."""
    text, id_ = F.col(text_col), F.col(id_col)
    return docs.select(id_.alias("id"), text.alias("text"), F.xxhash64(id_, text).alias("k1"), F.xxhash64(F.lit(7), text, id_).alias("k2"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """id, k1, k2, n, component: the smallest id of those that links reach, of every row."""
    held = keyed(docs, id_col, text_col)
    with common.Scratch(docs.sparkSession) as s:
        found = s.cut(describe(held, k))
        roots = links(found, held, percent, k, s.cut)
        names = found.where("name is not null").groupBy("name").agg(F.min("id").alias("least"))
        rooted = s.cut(names.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name")))
        least = s.cut(rooted.groupBy("root").agg(F.min("least").alias("component")))
        labels = s.cut(rooted.join(least, "root").select("name", "component"))
        labelled = found.select("id", "k1", "k2", "n", "name").join(labels, "name", "left")
        return common.cut(labelled.select("id", "k1", "k2", "n", F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component")).alias("component")))


def op7_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(common.read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id, with the columns of ``docs``. Shingles of five words, Jaccard 0.8."""
    found = jaccard_components(docs, percent=80, k=5)
    filled = found.where("n > 0")
    # Of several rows with the component's id (repeated ids), the one of the smallest hashes.
    stays = filled.where(F.col("id").eqNullSafe(F.col("component"))).groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("k"))
    goes = common.cut(filled.select("k1", "k2").distinct().join(stays.select("k.k1", "k.k2"), ["k1", "k2"], "left_anti"))
    twice = common.cut(found.groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1").select("k1", "k2"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text, id_ = F.col("text"), F.col("doc_id")
    held = common.join_few(docs.select(row, F.xxhash64(id_, text).alias("k1"), F.xxhash64(F.lit(7), text, id_).alias("k2")), goes, ["k1", "k2"], "left_anti")
    return common.once(held, ["k1", "k2"], twice).select("row.*")


#: All pairs that share a shingle, which only a small table allows.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
twoway AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, other) AS (SELECT x, y FROM twoway UNION SELECT r.doc_id, b.y FROM reach r JOIN twoway b ON r.other = b.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""
