"""Byte-level BPE, encoded by a rank queue with a hierarchical bitmap, and decoded.

A pre-token's bytes form a linked list.  Each adjacent pair that the ranks know stands in
the bucket of its rank.  A bitmap of three levels marks the buckets in use, so the lowest
rank is found by one find-first-set a level.  A bucket's pairs merge from left to right;
an entry whose place has another rank by now is stale and skipped.  A merge makes at most
two new pairs, each pushed to its bucket; where one of them ranks below the bucket at
hand, the rest of the bucket waits.  So a pre-token of n bytes takes about n steps, however
long it is.  Distinct new pre-tokens of a slice share one list, parted by ends that no pair
spans, and with it one queue.

Only the text's own words are split: a text is read in stretches that end before white
space after another character, where every match of the pattern ends too.

Nothing is shuffled.  A worker holds the ids of up to 800,000 short pre-tokens, one slice of
about 2 MB or one text, and some 100 bytes a byte of its longest pre-token.
Defined results: null and empty texts have no ids; bytes that are no UTF-8 count as U+FFFD;
repeated rows each return; an empty table gives an empty result; other columns are ignored.
Ids without a token fail the decoding job; null ids decode to nothing.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import common, tokens

#: Pre-tokens held per worker, those that stay when it is full, and the longest one held.
MOST, KEPT, LONGEST = 800_000, 400_000, 64
#: Bytes of new pre-tokens that share one list, and characters of a text split at once.
TOGETHER, STRETCH = 256 << 10, 1 << 20
#: Bits of an id in the key of a pair; bits of a bitmap word.
ID_BITS, WORD_BITS = 24, 6
WORD_MASK = (1 << WORD_BITS) - 1
GAP = regex.compile(r"\S\s")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of list positions by rank, and which of them hold any, in three levels of bits."""

    def __init__(self, ranks: int):
        blocks = (ranks >> WORD_BITS) + 1
        self.low, self.middle, self.top = [0] * blocks, [0] * ((blocks >> WORD_BITS) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def wait(self, rank: int, rest: list[int]) -> None:
        """What is left of a bucket goes back, beside what has come to its rank meanwhile."""
        if rank in self.buckets:
            self.buckets[rank] += rest
        elif rest:
            self.put(rank, rest)

    def put(self, rank: int, bucket: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = bucket
        block = rank >> WORD_BITS
        self.low[block] |= 1 << (rank & WORD_MASK)
        self.middle[block >> WORD_BITS] |= 1 << (block & WORD_MASK)
        self.top |= 1 << (block >> WORD_BITS)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its bucket, which leaves the queue."""
        if not self.top:
            return None
        over = (self.top & -self.top).bit_length() - 1
        bits = self.middle[over]
        block = over << WORD_BITS | (bits & -bits).bit_length() - 1
        bits = self.low[block]
        rank = block << WORD_BITS | (bits & -bits).bit_length() - 1
        self.low[block] = bits & bits - 1
        if not self.low[block]:
            self.middle[over] &= ~(1 << (block & WORD_MASK))
            if not self.middle[over]:
                self.top &= ~(1 << over)
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """``encode(texts)``: for each text (UTF-8) its ids as little-endian unsigned 32-bit numbers; ``decode`` the other way."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"the ranks lack {len(lacking)} of the 256 single bytes")
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << ID_BITS | right] = rank
        self.first = np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of the non-empty pre-tokens, which share one list and one queue."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        n = len(data)
        found = np.full(n, -1, np.int32)
        found[:-1] = self.first[data[:-1].astype(np.int32) << 8 | data[1:]]
        found[ends - 1] = -1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1

        queue = RankQueue(self.size)
        places = np.flatnonzero(found >= 0).astype(np.int32)
        places = places[np.argsort(found[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(found[places])) + 1
        for part in np.split(places, cuts) if len(places) else ():
            queue.put(int(found[part[0]]), part.tolist())

        hold = (lambda a: array("i", a.tobytes())) if n > TOGETHER else np.ndarray.tolist
        token, rank, nxt, prv = hold(self.single[data]), hold(found), hold(after), hold(before)
        get, held, put = self.pairs.get, queue.buckets.get, queue.put
        while (lowest := queue.pop()) is not None:
            r, bucket = lowest
            bucket.sort()
            for k, p in enumerate(bucket):
                if rank[p] != r:
                    continue
                gone = nxt[p]
                right, left, lower = nxt[gone], prv[p], False
                token[p] = r
                nxt[p] = right
                token[gone] = rank[gone] = rank[p] = -1
                if right >= 0:
                    prv[right] = p
                    x = rank[p] = get(r << ID_BITS | token[right], -1)
                    if x >= 0:
                        if (there := held(x)) is not None:
                            there.append(p)
                        else:
                            put(x, [p])
                        lower = x < r
                if left >= 0:
                    x = rank[left] = get(token[left] << ID_BITS | r, -1)
                    if x >= 0:
                        if (there := held(x)) is not None:
                            there.append(left)
                        else:
                            put(x, [left])
                        lower |= x < r
                if lower:
                    queue.wait(r, bucket[k + 1 :])
                    break
        ids = np.array(token, np.int32)
        live = ids >= 0
        out = ids[live].astype("<u4").tobytes()
        at = [0, *(4 * np.cumsum(live)[ends - 1]).tolist()]
        return [out[s:e] for s, e in zip(at, at[1:])]

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        found, waiting, size = {}, [], 0
        for piece in fresh:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                found[piece] = whole.to_bytes(4, "little")
                continue
            if waiting and size + len(raw) > TOGETHER:
                found.update(zip([w for w, _ in waiting], self.merge([b for _, b in waiting])))
                waiting, size = [], 0
            waiting.append((piece, raw))
            size += len(raw)
        if waiting:
            found.update(zip([w for w, _ in waiting], self.merge([b for _, b in waiting])))
        return found

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        fresh = set().union(*split) - self.known.keys()
        if len(self.known) + len(fresh) > MOST:
            self.known = dict(islice(self.known.items(), KEPT))
            fresh = set().union(*split) - self.known.keys()
        found = self._learn(list(fresh))
        self.known.update(x for x in found.items() if len(x[0]) <= LONGEST)
        codes = self.known if all(len(p) <= LONGEST for p in found) else self.known | found
        return [b"".join([codes[p] for p in s]) for s in split]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        short = iter(self._ids([self.split(t) for t in decoded if len(t) <= STRETCH]))
        return [next(short) if len(t) <= STRETCH else b"".join([self._ids([self.split(t, s, e)])[0] for s, e in stretches(t)]) for t in decoded]

    def decode(self, codes: list[bytes]) -> list[bytes]:
        return [b"".join([self.tokens[i] for i in np.frombuffer(c, "<u4").tolist()]) for c in codes]


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Start and end of stretches of at least ``size`` characters that end before white space after another character."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size)
        end = gap.start() + 1 if gap else len(text)
        yield at, end
        at = end


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def model(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens, ids (binary, little-endian unsigned 32-bit) of every row."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for at, texts in tokens.slices(batch, "text"):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array([len(c) // 4 for c in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    held = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return held.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """The rows of ``encode`` with ``data``, the bytes that the ids stand for."""
    path, pattern = ranks or default_ranks(), default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for at, codes in tokens.slices(batch, "ids"):
                columns = batch.slice(at, len(codes)).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bpe.decode(codes), pa.binary())], names=["id", "n_tokens", "ids", "data"])

    held = encoded.select("id", "n_tokens", "ids")
    return held.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, data binary")


def op13_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = decode(encode(common.read(spark, sf_dir, "documents")))
    return read_back.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
