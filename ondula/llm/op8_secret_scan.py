"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

The three patterns (assignments, access keys, hex runs) always report.  Every other token
of 8 or more characters is scored by two first-order character models, one of random
strings and one of ordinary identifiers, and reported as ``markov`` where the log-likelihood
ratio is high: as a total for short tokens, by character for longer ones.  Ordinary
identifiers start with a letter, so digit strings of 8 or more, phone numbers and dates
among them, count as random.

The models are trained from labelled samples: random strings are the values that the
patterns matched, with seeded strings over common key alphabets; ordinary identifiers
are the other tokens.  They come from at most ``SAMPLE_DOCS`` documents, those of the
smallest hash; the scan itself covers every whole text.

A token that touches a span of a pattern is not scored, which one look-up among the sorted
spans tells, so a text takes time in proportion to its length, however many spans it has.

Defined results: a null text is empty and has no spans.  Spans count code points, end
exclusive, and order by start, then kind as listed, then end.  Repeated rows each return.  A
very long text is scanned whole.  An empty table gives an empty result, and models trained
on the seeded strings alone.  Null ids are returned; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Tokens that the models judge.
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}")
ORDINARY = re.compile(r"[A-Za-z][A-Za-z0-9_-]{5,}")
#: Documents in the training sample; seeded strings; log-likelihood ratio per character that reports, and the least total, which short tokens must reach.
SAMPLE_DOCS, SEEDED, LEAST_RATIO = 2000, 2000, 0.7
LEAST_TOTAL = 8.0
SYMBOLS = 130  # ASCII, other, and the edge of a token

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "base32-lower": _LOWER + "234567", "base36": _LOWER + _DIGITS, "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/", "lower": _LOWER, "upper": _UPPER, "digits": _DIGITS,
}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the three patterns' matches; a span is the whole match."""
    spans: list[Span] = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return spans


class Covered:
    """Whether a range touches one of some spans: spans that overlap are joined, and a range is looked up."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e, _ in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


def codes(token: str) -> np.ndarray:
    inner = np.frombuffer(token.encode("utf-32-le"), np.uint32)
    return np.concatenate([[129], np.minimum(inner, 128), [129]]).astype(np.int64)


def totals(text: str, tokens: list[re.Match], ratio: np.ndarray) -> list[float]:
    """Log-likelihood ratio of each token with its edges, by running sums over the whole text."""
    if not tokens:
        return []
    c = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)
    sums = np.concatenate([[0.0], np.cumsum(ratio[c[:-1], c[1:]])])
    at = np.array([t.span() for t in tokens])
    first, last = at[:, 0], at[:, 1] - 1
    return (sums[last] - sums[first] + ratio[129, c[first]] + ratio[c[last], 129]).tolist()


def scan(text: str, ratio: np.ndarray | None, least: float = LEAST_RATIO) -> list[Span]:
    """All spans of a text, by start, then kind as listed. ratio: log of random over ordinary, by two characters."""
    spans = base_spans(text)
    long = list(LONG.finditer(text))
    for t in long:  # a hex run of 24 stands inside such a token
        if t.end() - t.start() >= LEAST["hex"]:
            spans += [(t.start() + m.start(), t.start() + m.end(), "hex") for m in HEX.finditer(t[0]) if len(m[0]) >= LEAST["hex"]]
    if ratio is not None:
        taken = Covered(spans)
        for t, total in zip(long, totals(text, long, ratio)):
            if total >= max(LEAST_TOTAL, least * (t.end() - t.start() + 1)) and not taken(t.start(), t.end()):
                spans.append((t.start(), t.end(), "markov"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def labelled(text: str) -> Iterator[tuple[str, int]]:
    """(token, 1 if random) of a text."""
    values = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    spans = [s for s in scan(text, None)]
    yield from ((v, 1) for v in values)
    yield from ((text[s:e], 1) for s, e, kind in spans if kind != "assign")
    taken = Covered(spans)
    for m in ORDINARY.finditer(text):
        if not taken(m.start(), m.end()):
            yield m[0], 0


def seeded(n: int = SEEDED, seed: int = 1) -> list[str]:
    """Random strings over the alphabets of keys."""
    draw = random.Random(seed)
    alphabets = tuple(ALPHABETS.values())
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(8, 48))) for i in range(n)]


def log_ratio(counts: np.ndarray, smooth: float = 0.2) -> np.ndarray:
    """counts[label, a, b] to log P(b | a, random) - log P(b | a, ordinary)."""
    p = (counts + smooth) / (counts + smooth).sum(axis=2, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    held = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    edge = held.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, SYMBOLS, SYMBOLS), np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                for token, label in labelled(text):
                    c = codes(token)
                    np.add.at(found[label], (c[:-1], c[1:]), 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found.ravel()[at])], names=["at", "n"])

    counts = np.zeros(2 * SYMBOLS * SYMBOLS)
    if edge is not None:
        sums = held.where(F.col("h") <= edge).select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
        for r in sums.collect():  # at most two counts for each pair of characters
            counts[r.at] = r.n
    counts = counts.reshape(2, SYMBOLS, SYMBOLS)
    for token in seeded():
        c = codes(token)
        np.add.at(counts[1], (c[:-1], c[1:]), 1)
    return log_ratio(counts)


def secret_scan(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """id and spans, array of (start, end, kind), of every row."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t or "", ratio, least)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return held.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, spans array<struct<start:int,end:int,kind:string>>")


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span replaced; overlapping spans count as one."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if e > at:
            out += [text[at:s], mark] if s >= at else []
            at = e
    return "".join(out) + text[at:]


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan(docs, train(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
