import random
from collections import defaultdict

import numpy as np
import pytest

from copperleaf.llm import packing


def check(rows, items, capacity):
    used, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.position, r.n_tokens))
        parts[r.k].append((r.piece, r.start, r.n_tokens))
    for spans in used.values():
        end = 0
        for at, n in sorted(s for s in spans if s[1]):
            assert at == end
            end += n
        assert end <= capacity
    assert sorted(parts) == sorted(k for k, _ in items)
    for k, n in items:
        n = max(n or 0, 0)
        assert sum(p[2] for p in parts[k]) == n
        assert len(parts[k]) == max(1, -(-n // capacity))
    return len(used)


@pytest.mark.parametrize("seed", range(3))
def test_every_item_fits(spark, seed):
    r = random.Random(seed)
    capacity = 100
    items = [(i, None if r.random() < 0.02 else 0 if r.random() < 0.05 else r.choice([r.randrange(1, 12), r.randrange(10, 101), r.randrange(90, 350)])) for i in range(3000)]
    rows = packing.pack(spark.createDataFrame(items, "k long, size int"), "k", "size", capacity, groups=12).collect()
    used = check(rows, items, capacity)
    half = sum(r.n_tokens > capacity // 2 for r in rows)  # no two of these share a container
    assert used <= 1.08 * max(sum(max(n or 0, 0) for _, n in items) / capacity, half) + 2


def test_one_hot_size_and_only_small(spark):
    for items in ([(i, 34) for i in range(1000)], [(i, 3) for i in range(500)], [(1, 250)], [(1, 0), (2, None)]):
        rows = packing.pack(spark.createDataFrame(items, "k long, size int"), "k", "size", 100).collect()
        check(rows, items, 100)


def test_empty_table(spark):
    packed = packing.pack(spark.createDataFrame([], "k long, size int"), "k", "size", 100)
    assert packed.collect() == []
    assert packing.fill_report(packed, 100).first().sequences == 0


def test_configurations_hold_what_is_needed():
    r = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.unique(r.integers(11, 101, 8))
        need = r.integers(1, 400, len(sizes))
        plan = packing.configurations(sizes, need, 100)
        assert all((c * sizes).sum() <= 100 for _, c in plan)
        assert (sum(t * c for t, c in plan) == need).all()
        bound = max((sizes * need).sum() / 100, need[sizes > 50].sum())
        assert sum(t for t, _ in plan) <= 1.25 * bound + len(sizes)


def test_check_report_finds_broken_rules(spark):
    kinds = "doc_id long, piece long, start long, n_tokens long, sequence_id long, position long"
    good = [(1, 0, 0, 6, 0, 0), (2, 0, 0, 4, 0, 6), (3, 0, 0, 10, 1, 0), (3, 1, 10, 3, 2, 0), (4, 0, 0, 0, 2, 0)]
    report = lambda rows: tuple(packing.check_report(spark.createDataFrame(rows, kinds), "doc_id", 10).first())
    assert report(good) == (4, 0, 0, 0, 0)
    assert report([(1, 0, 0, 6, 0, 0), (2, 0, 0, 5, 0, 5)]) == (2, 1, 0, 1, 0)
    assert report([(1, 0, 0, 6, 0, 0), (1, 1, 7, 1, 1, 0)]) == (1, 0, 1, 0, 1)
