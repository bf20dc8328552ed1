"""Turn repair, periodic runs and byte-level BPE against brute force and the public library, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.llm import common
from ondula.llm import op11_turn_repair as o11
from ondula.llm import op12_lyndon_runs as o12
from ondula.llm import op13_rank_queue_bpe as o13

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SHAPE = re.compile(r"(s?(ua)+)?")


# Turn repair


def best_repair(rows):
    """Cost, initials and turns of the best edits of (role, text, fault) by trying strings in every state."""
    expected = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def offer(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value

    def insert(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a, t) in list(out.items()):
                offer(out, expected[s], (c + 5, a + "I", t + ((full[expected[s]], ""),)))
        return out

    for role, text, fault in rows:
        new = {}
        for s, (c, a, t) in insert(states).items():
            offer(new, s, (c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            i = role[:1]
            if i and (i == "s" and s == "" or i == expected[s]):
                offer(new, i, (c + more, a + "K", t + ((role, text),)))
            offer(new, expected[s], (c + more + 1, a + "R", t + ((full[expected[s]], text),)))
        states = new
    return min((v for s, v in insert(states).items() if s in ("", "a")), key=lambda v: v[:2])


def every_repair(rows):
    """The same by trying every string of edits."""
    full = {"u": "user", "a": "assistant"}
    best = None
    for choice in itertools.product([(k, e) for k in range(3) for e in "DKR"], repeat=len(rows)):
        for tail in range(3):
            cost, audit, shape, last = 0, "", "", ""
            for (k, e), (role, _, fault) in zip(choice, rows):
                for _ in range(k):
                    shape += "a" if shape[-1:] == "u" else "u"
                cost, audit = cost + 5 * k, audit + "I" * k + e
                if e == "D":
                    cost += 2
                    continue
                if fault in ("blank", "duplicate"):
                    cost = 10**9
                shape += role[:1] if e == "K" else "a" if shape[-1:] == "u" else "u"
                cost += 5 * (fault == "truncated") + (e == "R")
            for _ in range(tail):
                shape += "a" if shape[-1:] == "u" else "u"
            if SHAPE.fullmatch(shape) and (best is None or (cost + 5 * tail, audit + "I" * tail) < best):
                best = cost + 5 * tail, audit + "I" * tail
    return best


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        left = text.rstrip(" \t\n\r\x0b\x0c")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        k, role, text = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20, s(role), s(text)
        if k:
            one = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [one] * (2 if k == 3 else 1)
    return out


def conversation(rows):
    """What the query returns of one conversation's damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    marked = faults(rows)
    cost, audit, turns = best_repair(marked)
    there = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    n = Counter(f for _, _, f in marked)
    gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns))


def by_hand(rows, damaged=damage):
    out = {c: [] for c, *_ in rows}
    for c, *rest in damaged(rows):
        out[c].append(tuple(rest))
    return Counter((c, *conversation(x)) for c, x in out.items())


def test_edits_are_the_cheapest_and_ascii_least():
    draw = random.Random(1)
    for _ in range(60):
        rows = [(draw.choice(["system", "user", "assistant", "tool", ""]), "x", draw.choice(["", "", "truncated", "blank"])) for _ in range(draw.randint(0, 3))]
        kinds = "".join("d" if f == "blank" else (k := r[:1] if r[:1] and r[:1] in "sua" else "o").upper() if f else (r[:1] if r[:1] and r[:1] in "sua" else "o") for r, _, f in rows)
        # A kept turn without a role would leave no initial; it counts as one that can't be kept.
        assert o11.repair(kinds) == every_repair([(r or "?", t, f) for r, t, f in rows]) == best_repair(rows)[:2]
    for _ in range(2000):
        kinds = "".join(draw.choices("suaoSUAOd", [3, 9, 9, 1, 1, 2, 2, 1, 3], k=draw.randint(0, 40)))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(k.lower(), "tool"), "x", "blank" if k == "d" else "truncated" if k.isupper() else "") for k in kinds]
        assert o11.repair(kinds) == best_repair(rows)[:2]


def odd_turns():
    draw = random.Random(2)
    rows = []
    for c in [None, *range(-1, 60)]:
        for t in range(draw.randint(1, 12)):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((c, draw.choice([t, t, t, 3 * t, None]), role, draw.choice(["Fine.", "Fine.", "So?", "and then", "", None, " \n", "Ünïcode!", "a\nb: c."])))
    rows += rows[:40] + rows[:10]
    return rows + [(7, t, ["user", "assistant"][t % 2] if t % 5 else "user", f"Turn {t % 700}." if t % 11 else "cut") for t in range(3000)] + [(8, 5, "user", "Again.")] * 1500


@pytest.mark.parametrize("parts, block", [(1, 4096), (5, 7), (13, 4096)])
def test_conversations_of_many_blocks(spark, monkeypatch, parts, block):
    monkeypatch.setattr(o11, "BLOCK_ROWS", block)
    rows = odd_turns()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, TURNS).repartition(4).withColumn("n", F.lit("clash"))
        totals, pieces = o11.repair_turns(o11.damaged(df))
        d = o11.digests(pieces).withColumnRenamed("conv_id", "c")
        out = totals.join(d, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
        assert Counter(map(tuple, out.collect())) == by_hand(rows)
        assert block > 100 or pieces.where("not alone").count() > 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_large_tables_of_states_and_repeats_are_joined(spark, monkeypatch):
    monkeypatch.setattr(common.maybe_broadcast, "__defaults__", (0,))
    monkeypatch.setattr(o11, "BLOCK_ROWS", 50)
    rows, least = odd_turns(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        totals, pieces = o11.repair_turns(o11.damaged(spark.createDataFrame(rows, TURNS)))
        got = {(r.conv_id, r.cost, r.duplicate) for r in totals.collect()}
        assert got == {(k[0], k[6], k[3]) for k in by_hand(rows)}
        assert "SortMergeJoin" in pieces._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_turn_repair_query(spark):
    rows = [tuple(r) for r in common.read(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, o11.op11_turn_repair(spark, SF).collect())) == by_hand(rows)


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    totals, pieces = o11.repair_turns(o11.damaged(none))
    assert totals.count() == 0 and o11.digests(pieces).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert by_hand([(gone, 0, "user", "Hi.")]) == Counter({(gone, 0, 0, 0, 0, 0, 0, "", sha("")): 1})
    totals, pieces = o11.repair_turns(o11.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS)))
    assert tuple(totals.drop("alone").first()) == (gone, 0, 0, 0, 0, 0, 0) and tuple(o11.digests(pieces).first()) == (gone, "", sha(""))


# Periodic runs


def runs_by_hand(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + r] for x in range(start, start + length - r)) for r in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(draw):
    k, w = draw.choice([1, 2, 3, 5, 30]), []
    for _ in range(draw.randint(0, 6)):
        w += [str(draw.randrange(k)).encode() for _ in range(draw.randint(1, 9))] * draw.randint(1, 7)
        del w[len(w) - draw.randint(0, 2) :]
    return w


@pytest.mark.parametrize("prime", [o12.PRIME, 7])
def test_runs_are_all_found(monkeypatch, prime):
    monkeypatch.setattr(o12, "PRIME", prime)  # with a prime of 7 hashes meet by chance all the time
    monkeypatch.setattr(o12, "_POWERS", np.ones(1, np.uint64))
    draw = random.Random(3)
    for _ in range(400):
        texts = [some_words(draw) for _ in range(draw.randint(1, 4))]
        assert o12.runs_of(texts) == [runs_by_hand(w) for w in texts]


@pytest.mark.parametrize("words", [[b"a"] * 50_000, [b"a", b"b"] * 25_000, [b"a"] * 25_000 + [b"b"] + [b"a"] * 25_000, [bytes([i % 97]) for i in range(50_000)]])
def test_long_runs_take_a_moment(words):
    import time

    began = time.process_time()
    runs = o12.runs_of([words])[0]
    assert time.process_time() - began < 5 and all(words[s : s + n - q] == words[s + q : s + n] for s, n, q in runs) and runs


def documents_of_runs():
    draw = random.Random(4)
    texts = [b" ".join(some_words(draw)).decode() for _ in range(120)]
    return texts + [None, "", " \n\t", "one", "a " * 6, "a " * 5, "ab " * 40_000, "é 　é x\x0by\x1cz", *texts[:5]]


def test_periodic_runs_of_rows(spark):
    rows = list(enumerate(documents_of_runs())) + [(3, "x y " * 9), (3, "x y " * 9), (None, "q " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "runs", "n_words")}).repartition(3)

    def want(text):
        w = (text or "").encode().split()
        runs = runs_by_hand(w) if len(w) < 10_000 else [(0, len(w), 1)]
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        return len(w), tuple(runs), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()

    got = Counter((r.id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in o12.periodic_runs(df).collect())
    assert got == Counter((i, *want(t)) for i, t in rows)
    assert o12.periodic_runs(df.where("false")).count() == 0


def test_periodic_runs_query(spark):
    want = []
    for r in common.read(spark, SF, "documents").collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = runs_by_hand(w) if n < 3000 else [tuple(x) for x in o12.runs_of([[x.encode() for x in w]])[0]]
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want.append((r.doc_id, len(runs), s, m, q, m and 1000 * m // q, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = o12.op12_lyndon_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(want) and sum(x[1] for x in want) > 0


# Byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    return o13.model(o13.default_ranks(), o13.default_pattern())


@pytest.fixture(scope="module")
def library(bpe):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=o13.default_pattern(), mergeable_ranks=bpe.ranks, special_tokens={})


def ids(code):
    return np.frombuffer(code, "<u4").tolist()


def odd_texts():
    draw = random.Random(5)
    parts = ["a", "b", "the", " ", "\n", "\t", "é", "日本", "12", "'s", "'LL", "!!", " ", "z" * 40, "İ", "\x1c", "🙂", "<|endoftext|>", "　"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(300)]
    return texts + ["", " ", "z" * 60_000, "ab" * 30_000, "".join(draw.choices("abcdefgh", k=80_000)), " " * 5000, "word " * 3000 + "tail"]


@pytest.mark.parametrize("stretch, together, most", [(1 << 20, 1 << 18, 10**6), (40, 64, 500)])
def test_ids_are_the_librarys(bpe, library, monkeypatch, stretch, together, most):
    monkeypatch.setattr(o13, "STRETCH", stretch)
    monkeypatch.setattr(o13.stretches, "__defaults__", (stretch,))
    monkeypatch.setattr(o13, "TOGETHER", together)
    monkeypatch.setattr(o13, "MOST", most)
    monkeypatch.setattr(o13, "KEPT", most // 2)
    texts = odd_texts()
    codes = bpe.encode([t.encode() for t in texts])
    for text, code in zip(texts, codes):
        assert ids(code) == library.encode_ordinary(text)
    assert bpe.decode(codes) == [t.encode() for t in texts]


def test_every_character_is_split_as_the_library_splits_it(bpe, library):
    for first in range(0, 0x11000, 64):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)} {chr(c)}{chr(c)} !{chr(c)}! " for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        assert ids(bpe.encode([text.encode()])[0]) == library.encode_ordinary(text)


def test_merges_that_open_lower_ranks(monkeypatch):
    """Ranks out of order: a merge makes a pair of a lower rank than its own, which goes first."""
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 5, b"abc": 2, b"bc": 7, b"cab": 1, b"aa": 9, b"abab": 0}
    bpe = o13.ByteBPE(ranks, r"\S+|\s+")

    def by_hand(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    draw = random.Random(6)
    words = [bytes(draw.choices(b"abc", k=draw.randint(1, 30))) for _ in range(1500)]
    for w, code in zip(words, bpe.encode(words)):
        assert ids(code) == by_hand(w), w


def test_lacking_bytes_are_named():
    with pytest.raises(ValueError, match="lack 255 of the 256"):
        o13.ByteBPE({b"a": 0}, r"\S+")


def test_bitmap_gives_ranks_in_order():
    draw = random.Random(7)
    queue, held = o13.RankQueue(50_000), set()
    for _ in range(5000):
        r = draw.randrange(50_000)
        if draw.random() < 0.5 and r not in held:
            held.add(r)
            queue.put(r, [r])
        elif held:
            low = min(held)
            assert queue.pop() == (low, [low])
            held.remove(low)
    assert [queue.pop()[0] for _ in range(len(held))] == sorted(held) and queue.pop() is None


def test_bpe_of_rows(spark, library):
    rows = list(enumerate(odd_texts())) + [(1, None), (1, "same"), (1, "same"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "ids", "data")}).repartition(3)
    got = Counter((r.id, r.n_tokens, bytes(r.ids), bytes(r.data)) for r in o13.decode(o13.encode(df)).collect())
    code = lambda t: np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
    assert got == Counter((i, len(code(t)) // 4, code(t), (t or "").encode()) for i, t in rows)
    assert o13.decode(o13.encode(df.where("false"))).count() == 0


def test_bpe_query(spark, library):
    want = Counter()
    for r in common.read(spark, SF, "documents").collect():
        code = library.encode_ordinary(r.text or "")
        want[r.doc_id, len(code), hashlib.sha256(np.array(code, "<u4").tobytes()).hexdigest(), sha(r.text or "")] += 1
    assert Counter(map(tuple, o13.op13_rank_queue_bpe(spark, SF).collect())) == want
