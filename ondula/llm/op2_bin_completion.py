"""Best-fit packing by bin completion.

Texts become pieces of at most ``capacity`` tokens, counted by length.  There are at most
``capacity`` lengths, so the packing is planned on that one histogram, whatever the size
of the corpus, and covers all pieces at once.

Branch and bound (``plan``): around the longest piece left, the undominated fillings of the
room beside it are enumerated, least waste first.  Which sums the lengths can reach is a bit
set, so a filling of the least waste is found without failing branches; a filling is dominated
where a length outside it could take the place of some of its pieces.  A filling is repeated
while its lengths last.  The first descent is the best-fit solution and the incumbent.  Where
it meets the lower bound it is least.  Otherwise the search opens its last ``OPEN`` patterns
again, goes back from the end, and drops a branch whose waste, or whose bound on the sequences
of the rest, cannot beat the incumbent, until the bound is met, nothing is left, which proves
a plan of at most ``OPEN`` patterns least, or ``NODES`` sequences are tried.  ``plan`` gives
the lower bound beside the sequences, so the gap is known.

Pieces find their places by rank: a task numbers its pieces of each length, sums by task
and length shift these numbers, and (length, rank) selects the pattern, the sequence and
the offset.  Nothing is sorted and no text is shuffled.

Defined results: a null or empty text is one piece of the end token.  Repeated rows are
packed each.  A text of more than ``capacity`` tokens, however long, is cut into pieces of
``capacity`` and a last one.  Pieces of one length are interchangeable, so ties need no rule.
An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ondula.llm import common, tokens

CAPACITY, END_ID = 4096, 1
#: Patterns of the first solution that the search opens again, and sequences (with their repeats) that it tries.
OPEN, NODES = 48, 3000


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32, task, rank (within the task and length)."""
    path = vocabulary or tokens.default_vocabulary()
    end = end_id.to_bytes(4, "little")
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
    kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task, seen = tokens.tokenizer(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at, texts in tokens.slices(batch, "text"):
                out: list[tuple] = []
                for i, ids in enumerate(model.ids(texts)):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        code = ids[k : k + 4 * capacity]
                        n = len(code) // 4
                        out.append((at + i, k // (4 * capacity), k // 4, n, zlib.crc32(code), task, int(seen[n])))
                        seen[n] += 1
                rows, *rest = zip(*out)
                cols = [batch.column("id").take(pa.array(rows))] + [pa.array(c, t) for c, t in zip(rest, kinds[1:])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = held.schema["id"].dataType.simpleString()
    return held.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long")


Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


def _spread(sums: int, x: int, times: int) -> int:
    """The sums (a bit set) with up to ``times`` more pieces of length x."""
    step = 1
    while times > 0:
        step = min(step, times)
        sums |= sums << (step * x)
        times -= step
        step *= 2
    return sums


def reachable(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """For each place in ``lengths`` the sums up to ``room`` of the pieces from there on, as bit sets."""
    mask, sums = (1 << (room + 1)) - 1, [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        x = lengths[i]
        sums[i] = _spread(sums[i + 1], x, min(counts[x], room // x)) & mask
    return sums


def _exact(target: int, start: int, counts: dict[int, int], lengths: list[int], sums: list[int]) -> Iterator[Filling]:
    """Fillings of exactly ``target``, those of longer pieces first. Every branch ends in one."""
    if not target:
        yield ()
        return
    for i in range(start, len(lengths)):
        if not sums[i] >> target & 1:
            return
        x = lengths[i]
        for n in range(min(counts[x], target // x), 0, -1):
            if sums[i + 1] >> (target - n * x) & 1:
                for rest in _exact(target - n * x, i + 1, counts, lengths, sums):
                    yield ((x, n), *rest)


def _dominated(filling: Filling, waste: int, present: int) -> bool:
    """Whether a length outside the filling is as long as some of its pieces together, or longer by no more than the waste. present: bit set of the lengths."""
    inside, sums = 0, 1
    for x, n in filling:
        inside |= 1 << x
        sums = _spread(sums, x, n)
    reach, step = sums, 1
    while waste > 0:  # the sums and up to ``waste`` above each
        step = min(step, waste)
        reach |= reach << step
        waste -= step
        step *= 2
    return bool(reach & present & ~inside)


def fillings(room: int, counts: dict[int, int], most_waste: int) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of the undominated fillings of the room, least waste first, none above ``most_waste``."""
    if room in counts:  # one piece that closes the sequence dominates every other filling
        yield 0, ((room, 1),)
        return
    lengths = sorted((x for x in counts if x <= room), reverse=True)
    pair = next((((x, 1), (room - x, 1)) if 2 * x > room else ((x, 2),) for x in lengths if 2 * x >= room and counts.get(room - x, 0) > (2 * x == room)), None)
    if pair:  # two that close it: found without the sums
        yield 0, pair
    sums = reachable(counts, lengths, room)
    present = sum(1 << x for x in lengths)
    for waste in range(min(room, most_waste) + 1):
        if sums[0] >> (room - waste) & 1:
            for f in _exact(room - waste, 0, counts, lengths, sums):
                if f != pair and not _dominated(f, waste, present):
                    yield waste, f


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can do without: for each k, pieces longer than capacity - k are alone with those under k left out, and those over half are one each."""
    if not counts:
        return 0
    lengths, n = np.array(sorted(counts.items())).T
    many, words = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(lengths * n)])
    k = np.concatenate([[0], lengths[2 * lengths <= capacity]])
    alone, low = np.searchsorted(lengths, capacity - k + 1), np.searchsorted(lengths, k)
    half = int(np.searchsorted(lengths, capacity // 2 + 1))
    wide = many[alone] - many[half]  # over half, not alone
    left = words[half] - words[low] - (wide * capacity - (words[alone] - words[half]))
    return int(np.max(many[-1] - many[alone] + wide + np.maximum(0, -(-left // capacity))))


def _less(counts: dict[int, int], filling: Filling, times: int) -> dict[int, int]:
    out = dict(counts)
    for x, n in filling:
        out[x] -= n * times
        if not out[x]:
            del out[x]
    return out


def _around(longest: int, rest: Filling) -> Filling:
    return ((longest, 1 + rest[0][1]), *rest[1:]) if rest and rest[0][0] == longest else ((longest, 1), *rest)


def descend(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """The first solution: the best filling around the longest piece, as often as its lengths last, again and again."""
    left, out = dict(counts), []
    for longest in sorted(counts, reverse=True):
        while longest in left:
            spare = _less(left, ((longest, 1),), 1)
            f = _around(longest, next(fillings(capacity - longest, spare, capacity))[1])
            out.append((f, min(left[x] // n for x, n in f)))
            left = _less(left, *out[-1])
    return out


def search(counts: dict[int, int], capacity: int, best: list[tuple[Filling, int]], lower: int, nodes: int) -> list[tuple[Filling, int]]:
    """``best`` or a packing of ``counts`` in fewer sequences, by branch and bound. One open generator for each pattern of the path."""
    total, least, tries = sum(x * n for x, n in counts.items()), sum(times for _, times in best), 0

    def children(left: dict[int, int], waste: int) -> Iterator[tuple[dict[int, int], int, Filling, int]]:
        longest = max(left)
        spare = _less(left, ((longest, 1),), 1)
        for more, rest in fillings(capacity - longest, spare, (least - 1) * capacity - total - waste):
            f = _around(longest, rest)
            for times in range(min(left[x] // n for x, n in f), 0, -1):
                yield _less(left, f, times), waste + more * times, f, times

    path: list[tuple[Filling, int]] = []
    stack, used = [children(counts, 0)] if counts else [], 0
    while stack and least > lower and tries < nodes:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if path:
                used -= path.pop()[1]
            continue
        tries += 1
        left, waste, f, times = child
        if waste > (least - 1) * capacity - total or used + times + lower_bound(left, capacity) >= least:
            continue
        if left:
            path.append((f, times))
            used += times
            stack.append(children(left, waste))
        else:
            best, least = [*path, (f, times)], used + times
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[Filling, int]], int]:
    """[(a sequence's lengths, number of such sequences)] for all pieces of the histogram, and the lower bound on sequences."""
    counts = {x: n for x, n in counts.items() if n}
    lower, first = lower_bound(counts, capacity), descend(counts, capacity)
    head, tail = first[:-OPEN], first[-OPEN:]
    if sum(times for _, times in first) > lower:
        open_: dict[int, int] = {}
        for f, times in tail:
            for x, n in f:
                open_[x] = open_.get(x, 0) + n * times
        tail = search(open_, capacity, tail, max(lower - sum(times for _, times in head), lower_bound(open_, capacity)), nodes)
    return head + tail, lower


class Places:
    """Sequence and offset by (length, rank): a table of at most a few entries per length and pattern."""

    def __init__(self, patterns: list[tuple[Filling, int]]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, times in patterns:
            offset = 0
            for x, n in pattern:
                low = used.get(x, 0)
                rows.append(((x << 40) + low, sequence, n, offset))
                used[x] = low + n * times
                offset += n * x
            sequence += times
        rows.sort()
        self.key, self.sequence, self.each, self.offset = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 4

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = (length << 40) + rank
        i = np.searchsorted(self.key, want, side="right") - 1
        j = want - self.key[i]
        return self.sequence[i] + j // self.each[i], self.offset[i] + j % self.each[i] * length


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table of cut_pieces) with sequence_id and offset."""
    sums = common.cut(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)[0]))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = pieces.join(common.maybe_broadcast(shifts), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value(b.column("length").to_numpy(), b.column("rank").to_numpy())
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    return placed.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_bin_completion(spark, sf_dir: str) -> DataFrame:
    return stage(spark, common.read(spark, sf_dir, "documents"), sf_dir)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(common.cut(cut_pieces(docs))).withColumnRenamed("id", "doc_id")
