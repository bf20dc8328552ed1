"""Token counts by dynamic programming over a trie of pre-tokens.

A unigram tokenizer splits a pre-token into the vocabulary pieces of least total cost.
The forward cost at a prefix depends on that prefix alone, so pre-tokens that share a
prefix share its work: the distinct pre-tokens of a slice are inserted in a trie, here
their sorted order with the length of the prefix that each shares with the one before,
each node's cost is computed once, and terminal counts are stored by pre-token.

Costs are whole numbers, so sharing changes no result: a piece of rank r costs
``round(1e6 * ln(r + 2))`` (Zipf's law over the public vocabulary's own order), and among
splits of equal cost the fewest pieces win.  A character without a piece falls back to
one token per UTF-8 byte.  A pre-token is a word with the word mark before it.

Nothing is shuffled; a worker holds the trie of one slice and a store of counts that is
bounded in words and in the bytes of each.  Defined results: null and blank texts count 0
words and 0 tokens; repeated rows each return; an empty table gives an empty result; other
columns are ignored, whatever their names.  A very long text is a slice of its own and
counted whole, a very long word too, at 16 bytes a character while it is.
"""

from __future__ import annotations

import math
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import common, tokens

MARK = "▁"
#: Counts stored per worker, and bytes of the longest word that is stored: some 150 MB at most. Longer words are counted anew in each slice.
MOST_WORDS, LONGEST = 600_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> dict[str, int]:
    """Piece to cost; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): round(1e6 * math.log(rank + 2)) for rank, i in enumerate(plain)}


class TrieCounter:
    def __init__(self, costs: dict[str, int]):
        self.costs = costs
        self.byte_cost = round(1e6 * math.log(len(costs) + 2))
        self.known: dict[bytes, int] = {}
        ends: dict[str, set[int]] = {}  # last two characters -> lengths of pieces that end so
        for p in costs:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v)) for k, v in ends.items()}

    def count(self, words: list[bytes]) -> list[int]:
        """Pieces of each of the distinct words, which are walked in trie order."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out = [0] * len(words)
        # Eight bytes a character each, so that a word may be as long as a text.
        cost, n, last = array("q", [0]), array("q", [0]), ""
        get, ends, byte_cost = self.costs.get, self.ends, self.byte_cost
        for i in order:
            word = MARK + words[i].decode("utf-8", "replace")
            shared = len(os.path.commonprefix((word, last)))
            del cost[shared + 1 :], n[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                c = word[d - 1]
                one = get(c)
                if one is None:
                    size = len(c.encode("utf-8"))
                    best, least = cost[d - 1] + size * byte_cost, n[d - 1] + size
                else:
                    best, least = cost[d - 1] + one, n[d - 1] + 1
                for size in ends.get(word[d - 2 : d], ()) if d > 1 else ():
                    if size > d:
                        break
                    more = get(word[d - size : d])
                    if more is not None:
                        total = cost[d - size] + more
                        if total < best or total == best and n[d - size] + 1 < least:
                            best, least = total, n[d - size] + 1
                cost.append(best)
                n.append(least)
            out[i], last = n[-1], word
        return out

    def totals(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        split = [t.split() for t in texts]
        fresh = list(set().union(*split) - self.known.keys())
        if len(self.known) + len(fresh) > MOST_WORDS:
            self.known.clear()
            fresh = list(set().union(*split))
        self.known.update(zip(fresh, self.count(fresh)))
        found = [len(w) for w in split], [sum(map(self.known.__getitem__, w)) for w in split]
        for word in fresh:
            if len(word) > LONGEST:
                del self.known[word]
        return found


_LOADED: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    if path not in _LOADED:
        _LOADED[path] = TrieCounter(pieces(path))
    return _LOADED[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_words, n_tokens of every row."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            for at, texts in tokens.slices(batch, "text"):
                words, n = model.totals(texts)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(words, pa.int64()), pa.array(n, pa.int64())], names=["id", "n_words", "n_tokens"])

    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return held.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, n_words long, n_tokens long")


def op6_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
