"""Bin completion over a table of lengths and counts."""

from __future__ import annotations

from collections.abc import Iterator

# Limits of the search; beyond them the best packing so far stands, which is never worse than best fit.
FILLINGS = 6  # undominated fillings that are tried for one largest item
STEPS = 4_000  # places looked at for one list of fillings
NODES = 3_000  # placements from the end of the path backwards, and as many with one early choice changed

Packing = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by items too large to share what is left."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    for small in {k for k in counts if 2 * k <= capacity} | {0}:
        alone = sum(n for k, n in counts.items() if k > capacity - small)
        half = [(k, n) for k, n in counts.items() if capacity - small >= k > capacity / 2]
        pairs = sum(n for _, n in half)
        space = pairs * capacity - sum(k * n for k, n in half)
        rest = sum(k * n for k, n in counts.items() if small <= k <= capacity / 2)
        best = max(best, alone + pairs + max(0, -(-(rest - space) // capacity)))
    return best


def fillings(counts: dict[int, int], order: list[int], space: int, allowed: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``space``, least waste first, larger items first among equals.

    ``order`` holds the lengths, largest first. A filling is dominated if a further item fits, or
    if an item left out could replace a smaller one without overflow. Waste beyond ``allowed`` is
    pruned, except that the best fit is always kept as the incumbent.
    """
    fit = [k for k in order if k <= space and counts[k]]
    tail = [0] * (len(fit) + 1)  # all that later lengths could still add
    for i in range(len(fit) - 1, -1, -1):
        tail[i] = tail[i + 1] + fit[i] * min(counts[fit[i]], space // fit[i])
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0
    bound = space

    def walk(i: int, left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, tuple[int, ...]]]:
        nonlocal steps
        steps += 1
        while i < len(fit) and fit[i] > left:
            i += 1
        if i == len(fit) or not left:
            yield left, chosen
            return
        if left - tail[i] > bound or steps > STEPS:
            if steps > STEPS:
                yield left, chosen
            return
        k = fit[i]
        for n in range(min(counts[k], left // k), -1, -1):
            if n == 0 and left - tail[i + 1] > bound:
                return
            yield from walk(i + 1, left - n * k, chosen + (k,) * n)
            if steps > STEPS:
                return

    for waste, chosen in walk(0, space, ()):
        taken = {k: chosen.count(k) for k in set(chosen)}
        spare = [k for k in fit if counts[k] > taken.get(k, 0)]
        if any(k <= waste for k in spare) or any(0 < k - c <= waste for c in taken for k in spare):
            continue
        found.append((waste, chosen))
        found.sort(key=lambda f: f[0])
        del found[FILLINGS:]
        if len(found) == FILLINGS:
            bound = found[-1][0]
        if found[0][0] == 0 and len(found) > 1 or steps > STEPS:
            break
    if not found:  # every place looked at was dominated: plain best fit
        left, chosen = space, []
        for k in fit:
            n = min(counts[k], left // k)
            chosen += [k] * n
            left -= n * k
        found = [(left, tuple(chosen))]
    return [c for w, c in found if w <= allowed] or [found[0][1]]


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing, for all items of a length at once: bins of equal contents are one entry."""
    groups: dict[tuple[int, ...], int] = {}
    for k in sorted(counts, reverse=True):
        left = counts[k]
        for bin_ in sorted((b for b in groups if capacity - sum(b) >= k), key=lambda b: (capacity - sum(b), b)):
            each = (capacity - sum(bin_)) // k
            for n in (each, left % each):
                bins = min(groups.get(bin_, 0), left // n if n else 0)
                if bins:
                    groups[bin_] -= bins
                    groups[bin_ + (k,) * n] = groups.get(bin_ + (k,) * n, 0) + bins
                    left -= bins * n
        each = capacity // k
        for n in (each, left % each):
            bins = left // n if n else 0
            if bins:
                groups[(k,) * n] = groups.get((k,) * n, 0) + bins
                left -= bins * n
    return [(b, n) for b, n in groups.items() if n]


class _Search:
    """The state of a search: what is left to place, the bins placed, and the best packing so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = dict(counts), capacity
        self.order = sorted(counts, reverse=True)
        self.total = sum(k * n for k, n in counts.items())
        self.best = best_fit(counts, capacity)
        self.best_bins = sum(n for _, n in self.best)
        self.path: Packing = []
        self.bins = self.waste = 0

    def options(self) -> list[tuple[int, ...]]:
        """Fillings of a bin around the largest item left, within the waste a better packing can afford."""
        counts, largest = self.counts, next((k for k in self.order if self.counts[k]), None)
        if largest is None:
            return []
        counts[largest] -= 1
        allowed = (self.best_bins - 1) * self.capacity - self.total - self.waste
        out = [(largest, *f) for f in fillings(counts, self.order, self.capacity - largest, allowed)]
        counts[largest] += 1
        return out

    def place(self, bin_: tuple[int, ...]) -> None:
        copies = min(self.counts[k] // bin_.count(k) for k in set(bin_))
        for k in bin_:
            self.counts[k] -= copies
        self.path.append((bin_, copies))
        self.bins += copies
        self.waste += copies * (self.capacity - sum(bin_))
        if self.bins < self.best_bins and not any(self.counts.values()):
            self.best, self.best_bins = list(self.path), self.bins

    def take_back(self) -> None:
        bin_, copies = self.path.pop()
        for k in bin_:
            self.counts[k] += copies
        self.bins -= copies
        self.waste -= copies * (self.capacity - sum(bin_))

    def hopeless(self) -> bool:
        """No way on can beat the best packing: its bins, or their waste, are used up."""
        return self.bins + 1 >= self.best_bins or self.waste > (self.best_bins - 1) * self.capacity - self.total


def complete_bins(counts: dict[int, int], capacity: int) -> Packing:
    """Packs ``counts`` items of each length into bins; gives (lengths in a bin, bins) pairs.

    Best-fit decreasing is the first incumbent. The search takes the largest remaining length, fills its
    bin in an undominated way and repeats that bin as often as the counts allow, so the work follows
    the number of lengths, not of items. It goes back to other fillings, prunes by the waste that a better
    packing could still afford, and ends at the lower bound, when all is tried, or after ``NODES``
    placements. In the last case as many are spent on descents that change one of the first choices.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    least, search = lower_bound(counts, capacity), _Search(counts, capacity)
    nodes, stack = 0, [iter(search.options())]
    while stack and search.best_bins > least and nodes < NODES:
        bin_ = None if search.hopeless() else next(stack[-1], None)
        if bin_ is None:
            stack.pop()
            if search.path:
                search.take_back()
            continue
        search.place(bin_)
        nodes += 1
        stack.append(iter(search.options()))
    changed = 0
    while stack and search.best_bins > least and nodes < 2 * NODES:
        while search.path:
            search.take_back()
        depth = 0
        while not search.hopeless() and (found := search.options()) and nodes < 2 * NODES:
            if depth == changed and len(found) == 1:
                break
            search.place(found[1] if depth == changed else found[0])
            nodes, depth = nodes + 1, depth + 1
        nodes, changed = nodes + 1, changed + 1
    return search.best
