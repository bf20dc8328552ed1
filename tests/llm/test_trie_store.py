"""The store of word counts stays small, whatever the words, and changes no count."""

import random

from ondula.llm import op6_trie_counts as o6

COSTS = {c: 10 + i for i, c in enumerate("abcd" + o6.MARK)} | {"ab": 12, "bcd": 13, o6.MARK + "a": 11, "dd": 9}


def word(draw, n):
    return "".join(draw.choices("abcdé", k=n)).encode()


def test_long_words_are_counted_but_not_kept():
    draw = random.Random(1)
    counter = o6.TrieCounter(COSTS)
    short, long = [word(draw, n) for n in range(1, 30)], [word(draw, 3000) for _ in range(20)]
    text = b" ".join(short + long + long)
    first, again = counter.totals([text, b"", b" ".join(long)]), counter.totals([text, b"", b" ".join(long)])
    assert first == again and first[0] == [69, 0, 20]
    alone = o6.TrieCounter(COSTS)
    each = {w: alone.count([w])[0] for w in short + long}
    assert first[1] == [sum(each[w] for w in short + long + long), 0, sum(each[w] for w in long)]
    assert counter.known.keys() == set(short)
    assert max(map(len, counter.known)) <= o6.LONGEST


def test_a_full_store_changes_no_count(monkeypatch):
    draw = random.Random(2)
    texts = [b" ".join(word(draw, draw.randint(1, 80)) for _ in range(50)) for _ in range(20)]
    wanted = [o6.TrieCounter(COSTS).totals([t]) for t in texts]
    monkeypatch.setattr(o6, "MOST_WORDS", 60)
    counter = o6.TrieCounter(COSTS)
    assert [counter.totals([t]) for t in texts] == wanted
    assert len(counter.known) <= 60


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(7, "a b", "x", 1), (8, None, "y", 2), (7, "a b", "x", 1)], "doc_id long, text string, id string, n_tokens long")
    found = o6.token_counts(docs)
    assert found.columns == ["id", "n_words", "n_tokens"]
    assert sorted(tuple(r)[:2] for r in found.collect()) == [(7, 2), (7, 2), (8, 0)]


def test_a_word_as_long_as_a_text(spark):
    docs = spark.createDataFrame([(1, "z" * 3_000_000 + " a")], "doc_id long, text string")
    (found,) = o6.token_counts(docs).collect()
    assert found.n_words == 2 and 0 < found.n_tokens <= 3_000_002
