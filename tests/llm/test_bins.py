"""Bin completion against plain best-fit decreasing and against the optimum of small tables."""

import random
from functools import lru_cache

import pytest

from restomart.llm import bin_completion as B


def plain_best_fit(items, capacity):
    left = []
    for k in sorted(items, reverse=True):
        fit = [i for i, r in enumerate(left) if r >= k]
        if fit:
            left[min(fit, key=left.__getitem__)] -= k
        else:
            left.append(capacity - k)
    return len(left)


def optimum(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @lru_cache(None)
    def need(rest, left):
        if not rest:
            return 0
        return min((need(rest[:i] + rest[i + 1:], left - k) if k <= left else
                    1 + need(rest[:i] + rest[i + 1:], capacity - k)) for i, k in enumerate(rest) if i == 0 or k != rest[i - 1])
    return need(items, 0)


def packed(counts, capacity):
    plan, got = B.complete_bins(counts, capacity), {}
    for bin_, n in plan:
        assert 0 < sum(bin_) <= capacity and n > 0
        for k in bin_:
            got[k] = got.get(k, 0) + n
    assert got == {k: n for k, n in counts.items() if n}
    return sum(n for _, n in plan)


@pytest.mark.parametrize("seed", range(40))
def test_never_more_bins_than_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100, 1024])
    items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 90))]
    counts = {k: items.count(k) for k in items}
    assert sum(n for _, n in B.best_fit(counts, capacity)) == plain_best_fit(items, capacity)
    assert B.lower_bound(counts, capacity) <= packed(counts, capacity) <= plain_best_fit(items, capacity)


def test_small_tables_are_packed_as_tight_as_can_be():
    rng = random.Random(1)
    for _ in range(60):
        items = [rng.randrange(2, 11) for _ in range(7)]
        assert packed({k: items.count(k) for k in items}, 12) == optimum(items, 12)
    # Best fit needs four bins here.
    assert plain_best_fit([6, 5, 5, 4, 4, 3, 3], 10) >= packed({6: 1, 5: 2, 4: 2, 3: 2}, 10) == 3


def test_no_items_and_wrong_lengths():
    assert B.complete_bins({}, 10) == [] and B.complete_bins({3: 0}, 10) == []
    with pytest.raises(ValueError):
        B.complete_bins({11: 1}, 10)
