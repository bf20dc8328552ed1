"""Periodic runs of words by a Lyndon stack under both orders.

A run is a stretch of consecutive words with smallest period q and of at least
``max(6, 4 * q)`` words that no neighbouring word extends keeping q.  Each run has a root, a
Lyndon word under one of the two orders of the words, which is the longest Lyndon word at its
place.  So the words are scanned from right to left under both orders: a stack of next
smaller suffixes gives the longest Lyndon word at each place, its length is a candidate
period, and the candidate is extended both ways.

Suffixes are compared and candidates extended by longest common extensions (LCE): prefix
hashes, galloping and bisection find where two places part.  Different hashes prove different
words; equal ones are proved by comparing the words themselves, once for each distance, so a
collision changes no result.  No suffix array is built.

Only stretches that can hold a run are scanned: within a run each word but those of its last
period recurs within q, so for q in (2**(k-1), 2**k] at least 3q words in a row have their
next occurrence within 2**k.  Such stretches, prolonged by 2**k, hold every run whole.

Nothing is shuffled, and a text is worked on whole, in memory in proportion to its words.
Defined results: null, empty and blank texts have no words and no runs and collapse to the
empty text; repeated rows each return; an empty table gives an empty result; other columns are
ignored; runs are ordered by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import common, tokens

#: Least words of a run, and least whole periods in it.
LEAST_WORDS, LEAST_PERIODS = 6, 4
PRIME, BASE = (1 << 31) - 1, 1_000_003
RUNS = "array<struct<start:long,length:long,period:long>>"

_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** (0 .. n - 1), modulo PRIME."""
    global _POWERS
    while len(_POWERS) < n:
        over = np.uint64(pow(BASE, len(_POWERS), PRIME))
        _POWERS = np.concatenate([_POWERS, _POWERS * over % np.uint64(PRIME)])
    return _POWERS[:n]


class Extensions:
    """Longest common extensions of places in one array of word ids."""

    def __init__(self, ids: np.ndarray):
        self.words, self.ids, self.n = ids, ids.tolist(), len(ids)
        power = powers(self.n + 1)
        self.power = power.tolist()
        # A sum of n terms below 2**31 stays below 2**63.
        sums = np.cumsum((ids.astype(np.uint64) + np.uint64(1)) % np.uint64(PRIME) * power[: self.n] % np.uint64(PRIME))
        self.sums = [0, *(sums % np.uint64(PRIME)).tolist()]
        #: Distance -> (first place, end): equal words all through, and none at the end.
        self.proved: dict[int, tuple[int, int]] = {}

    def alike(self, i: int, j: int, size: int) -> bool:
        """Whether the hashes of ``size`` words from i and from j > i agree."""
        s = self.sums
        return ((s[i + size] - s[i]) * self.power[j - i] - s[j + size] + s[j]) % PRIME == 0

    def equal(self, i: int, j: int, size: int) -> bool:
        return size == 0 or self.alike(i, j, size) and np.array_equal(self.words[i : i + size], self.words[j : j + size])

    def forward(self, i: int, j: int) -> int:
        """How many words from i on equal those from j > i on."""
        held = self.proved.get(j - i)
        if held is not None:
            first, end = held
            if first <= i <= end:
                return end - i
            if i < first and self.equal(i, j, first - i):
                self.proved[j - i] = i, end
                return end - i
        size = self._search(i, j, self.n - j, 1)
        self.proved[j - i] = i, i + size
        return size

    def backward(self, i: int, j: int) -> int:
        """How many words up to i equal those up to j > i, both included."""
        return self._search(i, j, i + 1, -1)

    def _search(self, i: int, j: int, most: int, way: int) -> int:
        """The largest size whose stretches are equal; way: 1 from the places on, -1 up to them."""
        at = (lambda size: (i, j)) if way > 0 else (lambda size: (i - size + 1, j - size + 1))
        good, step = 0, 1
        while good < most and self.alike(*at(min(good + step, most)), min(good + step, most)):
            good = min(good + step, most)
            step *= 2
        bad = min(good + step, most + 1)
        while bad - good > 1:
            middle = (good + bad) // 2
            if self.alike(*at(middle), middle):
                good = middle
            else:
                bad = middle
        a, b = at(good)
        if not np.array_equal(self.words[a : a + good], self.words[b : b + good]):
            # Hashes met by chance: the words themselves say where the places part.
            parts = np.flatnonzero(self.words[a : a + good] != self.words[b : b + good])
            return int(parts[0]) if way > 0 else good - 1 - int(parts[-1])
        return good


def scan(e: Extensions, low: int, high: int, flip: bool, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs whose root lies in [low, high) under one order: (start, period) -> length."""
    ids, n = e.ids, e.n
    smaller = [0] * (high - low)
    last: dict[int, tuple[int, int]] = {}
    for i in range(high - 1, low - 1, -1):
        x, j = ids[i], i + 1
        while j < high:
            y = ids[j]
            if x == y:
                size = e.forward(i, j)
                if j + size >= high:
                    break
                before = (ids[i + size] < ids[j + size]) is not flip
            else:
                before = (x < y) is not flip
            if not before:
                break
            j = smaller[j - low]
        smaller[i - low] = j
        q = j - i
        # A run of four periods has a root after its first word with two more periods behind it.
        if i + 3 * q <= n and ids[j] == x:
            held = last.get(q)
            if held is not None and held[0] <= i and j <= held[1]:
                continue
            size = e.forward(i, j)
            if size < 2 * q:
                continue
            start = i - (e.backward(i - 1, j - 1) if i else 0)
            end = j + size
            last[q] = start, end
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found[start, q] = end - start


def stretches(ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Parts [first, end) that hold every run of period ``most`` at most, ordered and apart. Ids differ between texts."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    same = sorted_ids[1:] == sorted_ids[:-1]
    gap = np.full(n, n, np.int64)
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    parts, q = [], 1
    while q < 2 * most:
        least = max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * (q // 2 + 1))
        near = np.concatenate([[0], (gap <= q).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(near))
        firsts, ends = turns[::2], turns[1::2]
        long = ends - firsts >= least
        parts += zip(firsts[long].tolist(), np.minimum(ends[long] + q, n).tolist())
        q *= 2
    out: list[tuple[int, int]] = []
    for first, end in sorted(parts):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((first, end))
    return out


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text's words."""
    bounds = np.cumsum([0, *map(len, texts)])
    ids = np.empty(bounds[-1], np.int64)
    for words, at in zip(texts, bounds.tolist()):
        first: dict[bytes, int] = {}  # a word's id is its first place in the slice, so no two texts share one
        ids[at : at + len(words)] = list(map(first.setdefault, words, count(at)))
    parts: dict[int, list[tuple[int, int]]] = {}
    for first, end in stretches(ids, int(np.diff(bounds).max(initial=0)) // LEAST_PERIODS):
        # Words of different texts are never near, but a prolonged stretch may reach into the next one.
        for text in range(int(np.searchsorted(bounds, first, "right")) - 1, int(np.searchsorted(bounds, end, "left"))):
            low, high = max(first, bounds[text]) - bounds[text], min(end, bounds[text + 1]) - bounds[text]
            if high - low >= LEAST_WORDS:
                parts.setdefault(text, []).append((int(low), int(high)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, inside in parts.items():
        e, found = Extensions(ids[bounds[text] : bounds[text + 1]] - bounds[text]), {}
        for low, high in inside:
            scan(e, low, high, False, found)
            scan(e, low, high, True, found)
        out[text] = [(start, found[start, q], q) for start, q in sorted(found)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for start, length, q in runs:
        keep[start + q : start + length] = bytes(length - q)
    return b" ".join(compress(words, keep))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (array of start, length, period) and collapsed (the text without repeated periods) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_words", "runs", "collapsed"]
        for batch in batches:
            for at, texts in tokens.slices(batch, "text"):
                words = [t.split() for t in texts]  # bytes split at the six ASCII spaces
                found = runs_of(words)
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), each)
                left = pa.array(map(collapse, words, found), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(map(len, words), pa.int64()), lists, left], names=names)

    held = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return held.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def repeated(text: Column, a: Column, p: Column) -> Column:
    """The text's words with each word i >= a replaced by word a + (i - a) % p, joined by one space."""
    w = common.words(text)
    tail = F.size(w) - a
    period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
    copies = F.flatten(F.array_repeat(period, F.ceil(tail / p).cast("int")))
    return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(copies, F.lit(1), tail.cast("int"))), " ")


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with planted periods, of which about a tenth repeat a stretch of their words to the end. A null id is planted none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = F.size(common.words(F.col("text")))
    a = g % n
    planted = F.when((h % 10 == 0) & (n > 0), repeated(F.col("text"), a, 1 + F.floor((n - a) / (3 + g % 8)))).otherwise(F.col("text"))
    out = periodic_runs(common.read(spark, sf_dir, "documents").select("doc_id", planted.alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return out.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
