"""Token ids of whole texts, one dictionary look-up per word.

The public tokenizer drops white space before it merges, so a text's ids are the ids of
its words one after the other; each distinct word is encoded once per Python worker.  It
lowers the case, so words are looked up in lower case.  A word of Latin letters is one
piece to its merges and skips the steps before them; a full stop or comma after letters
is a piece of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Words held per worker, those that stay when it is full (the first met are the common ones), and the
#: longest one held; others are encoded again.
MOST_WORDS, KEPT_WORDS, LONGEST = 400_000, 100_000, 64
#: A control character that stands alone between words, and the words encoded in one call.
MARK, TOGETHER = b"\x01", 64
#: Letters before this have no combining forms to compose.
LATIN = "\u0250"
#: Bytes of text handled at once.
SLICE = 2 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """``ids(texts)``: for each text (UTF-8) its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.known = Tokenizer.from_file(path), {}
        (self.mark,) = self.model.encode(MARK.decode(), add_special_tokens=False).ids
        self.merge, self.letters = self.model.model.tokenize, byte_letters()
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.model.get_vocab_size())].__getitem__
        self.ends = {c: np.array(self.model.encode(c.decode(), add_special_tokens=False).ids, "<u4").tobytes() for c in (b".", b",")}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        # Bytes lower ASCII letters and split at the six ASCII spaces; special tokens are told by their case.
        split = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        fresh = list(set().union(*split) - self.known.keys())
        if len(self.known) + len(fresh) > MOST_WORDS:
            self.known = dict(islice(self.known.items(), KEPT_WORDS))
            fresh = list(set().union(*split) - self.known.keys())
        once = self.known
        if fresh:
            pairs = self._fresh(fresh)
            self.known.update(p for p in pairs if len(p[0]) <= LONGEST)
            if any(len(w) > LONGEST for w in fresh):
                once = self.known | dict(pairs)
        return [b"".join([once[w] for w in ws]) for ws in split]

    def _fresh(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        out, other, known = [], [], self.known
        for w in words:
            stem, end = (w[:-1], self.ends[w[-1:]]) if w[-1:] in self.ends else (w, b"")
            code = known.get(stem) if end else None
            if code is None:
                u = stem.decode()
                if u.isalpha() and max(u) < LATIN and u.islower():
                    piece = u if stem.isascii() else "".join([self.letters[b] for b in stem])
                    code = b"".join([self.bytes_of(t.id) for t in self.merge(piece)])
                    if end:
                        known[stem] = code
                else:
                    other.append(w)
                    continue
            elif not stem.decode().isalpha():
                other.append(w)
                continue
            out.append((w, code + end))
        return out + list(zip(other, self._encode(other)))

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Words are encoded ``TOGETHER`` at a time, as a call costs more than a word; a mark of one id parts them."""
        runs: list[list[bytes]] = []
        for w in words:
            if MARK in w or not runs or len(runs[-1]) >= TOGETHER or MARK in runs[-1][0]:
                runs.append([w])
            else:
                runs[-1].append(w)
        between = b" " + MARK + b" "
        found = self.model.encode_batch_fast([between.join(r).decode() for r in runs], add_special_tokens=False)
        out: list[bytes] = []
        for r, code in zip(runs, found):
            ids = np.array(code.ids, "<u4")
            if len(r) == 1:
                out.append(ids.tobytes())
                continue
            at = np.flatnonzero(ids == self.mark).tolist()
            data = ids.tobytes()
            out += [data[4 * s : 4 * e] for s, e in zip([0] + [i + 1 for i in at], [*at, len(ids)])]
        return out


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows of about ``most`` bytes; a null text is empty."""
    texts = batch.column(column).cast(pa.binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    at, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most or i == len(sizes) - 1:
            yield at, [x or b"" for x in texts.slice(at, i + 1 - at).to_pylist()]
            at, size = i + 1, 0
