"""op7 on one large group of near copies: what moves and what is compared grows with the group, not with its square."""

import random
from collections import Counter

import numpy as np
import pytest

from ondula.llm import common
from ondula.llm import op7_count_rtree as o7

DOCS = "doc_id long, text string"


def family(size, seed=3, words=150):
    """Texts around one base, each with 0 to 14 words of its own: some link, most just don't."""
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(size):
        w = base[:]
        for j in draw.sample(range(words), draw.randint(0, 14)):
            w[j] = f"n{draw.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def components(rows):
    """The counter of (id, n, component) by comparing all pairs."""
    sets = o7.shingle_sets([t.encode() for _, t in rows])
    column = {s: i for i, s in enumerate(np.unique(np.concatenate(sets)).tolist())}
    has = np.zeros((len(sets), len(column)), np.float32)
    for i, s in enumerate(sets):
        has[i, [column[x] for x in s.tolist()]] = 1
    n = np.array([len(s) for s in sets])
    both = has @ has.T
    linked = 100 * both >= 90 * (n[:, None] + n[None, :] - both)
    least = np.arange(len(sets))
    while not np.array_equal(least, now := np.where(linked, least[None, :], len(sets)).min(axis=1)):
        least = now
    return Counter((rows[i][0], int(n[i]), int(least[i])) for i in range(len(sets)))


def test_a_group_of_near_copies_grows_less_than_quadratically(spark, monkeypatch):
    monkeypatch.setattr(o7, "LEAF", 32)
    seen = {}

    def counted(name):
        plain = getattr(o7, name)

        def run(units, percent):
            held, out = common.cut(units), None
            out = common.cut(plain(held, percent))
            seen[name] = held.count(), out.count()
            return out

        monkeypatch.setattr(o7, name, run)

    counted("met_here"), counted("near_points")
    moved = []
    for size in (200, 800):
        rows = family(size)
        found = o7.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(8)).collect()
        assert Counter((r.id, r.n, r.component) for r in found) == components(rows)
        assert seen["near_points"][1] <= size // 20  # pairs to be verified after the first join
        moved.append((seen["met_here"][0] + seen["near_points"][0]) / size)
    assert moved[1] < 1.9 * moved[0]  # rows a set: the square would be four times


@pytest.mark.parametrize("scale", [1, 4])
@pytest.mark.parametrize("percent", [80, 90])
def test_rarest_nodes_still_meet_every_partner(spark, scale, percent):
    """Sets around a base, some far from it: two that link keep a common node."""
    rng = np.random.default_rng(scale * percent)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(120)[: 120 - rng.integers(0, 12)]], rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])) for _ in range(60)]
    # A pair without any altered block in common with the others: short sets that fill few blocks.
    sets += [base[:n] for n in (1, 2, 9, 10, 11)]
    rows = [(int(c), i, int(h), int(p)) for i, f in enumerate(o7.cells(sets, percent, scale)) for c, h, p in zip(f[0].view(np.int64), f[1], f[2])]
    with common.Scratch(spark) as s:
        held = s.cut(spark.createDataFrame(rows, "cell long, name long, shift int, spare long"))
        kept = o7.rarest(held, s).select("cell", "name").collect()
    assert len(kept) < len(rows)
    mine = [{r.cell for r in kept if r.name == i} for i in range(len(sets))]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= o7.enough(len(sets[i]), len(sets[j]), percent)]
    assert len(pairs) > 50 and all(mine[i] & mine[j] for i, j in pairs)
