"""Bin completion: packs whole numbers into as few bins of one capacity as a bounded search can find."""

from __future__ import annotations

from typing import NamedTuple


class _Stock:
    """How many items of each length are left, with a bit for each length that is left."""

    def __init__(self, lengths):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.mask = 0
        for n in self.count:
            self.mask |= 1 << n

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask ^= 1 << n

    def give(self, n: int) -> None:
        self.count[n] += 1
        self.mask |= 1 << n

    def largest(self, most: int) -> int:
        """The largest length left that is at most that; 0 if none."""
        return (self.mask & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.mask & ((2 << most) - 1) else 0


def best_fit(lengths, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, longest first, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for n in sorted(lengths, reverse=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(n)
        else:
            room, at = capacity, len(bins)
            bins.append([n])
        if room > n:
            by_room.setdefault(room - n, []).append(at)
            rooms |= 1 << (room - n)
    return bins


class Search(NamedTuple):
    """How far a search looks; None is without a limit.

    nodes: fillings tried, for each bin of the incumbent (a dive without a return takes 1). width: lengths tried at each
    place of a filling. steps: lengths tried in all for a filling. keep: fillings of a node that are kept. branched: items
    of a filling that are chosen by branching; what room is left after them is filled longest first. per_item: waste,
    as a share of the capacity, that a filling may have more for each item that it has less.
    """

    nodes: float | None = 1.2
    width: int | None = None
    steps: int | None = 60
    keep: int | None = 2
    branched: int | None = 4
    per_item: float = 0.0


#: One after the other until a packing meets the lower bound. No order of fillings is best for all lengths: few small items
#: ask for full bins, many for bins that spend the long ones first.
SEARCHES = (Search(1.5, 5, 60, 3), Search(steps=60, per_item=0.1), Search(steps=400), Search(steps=200, per_item=0.05), Search(steps=200, per_item=0.1))
#: All undominated fillings, and all their orders, until the fewest bins are proven: for small cases, as its time is exponential.
EXACT = (Search(None, None, None, None, None),)


def lower_bound(lengths, capacity: int) -> int:
    """No packing has fewer bins: items that exclude one another, and what cannot be beside them (for each least length)."""
    rising = sorted(n for n in lengths if n)
    before = [0]
    for n in rising:
        before.append(before[-1] + n)
    from bisect import bisect_left, bisect_right

    half, best = bisect_right(rising, capacity // 2), 0
    for least in {0, *(n for n in rising[:half])}:
        alone = bisect_right(rising, capacity - least)  # from here on, items that nothing of that length fits beside
        others = bisect_left(rising, least)
        room = max(0, alone - half) * capacity - (before[max(alone, half)] - before[half])
        small = before[half] - before[others]
        best = max(best, len(rising) - max(alone, half) + max(0, alone - half) + max(0, -(-(small - room) // capacity)))
    return best


def _dominated(filling: list[int], slack: int, stock: _Stock, branched: int | None) -> bool:
    """Could an item that is left replace one or two of the filling's and fill more?"""
    if not slack or (branched is not None and len(filling) > branched):
        return False
    for part in {*filling, *(a + b for k, a in enumerate(filling) for b in filling[:k])}:
        x = stock.largest(part + slack)
        if (x > part or x == part and part not in filling) and stock.count[x] > filling.count(x):
            return True
    return False


def fillings(room: int, stock: _Stock, search: Search, per_item: float) -> list[list[int]]:
    """Undominated fillings of the room, those of least waste (and per_item) first, as many as the search keeps."""
    found: list[tuple[int, list[int]]] = []
    steps = search.steps

    def extend(filling: list[int], left: int, most: int) -> bool:
        """True once a filling is found that no other needs to be compared with: one item that leaves no waste, or, in a
        limited search that counts waste alone, any without waste."""
        nonlocal steps
        x, tried = stock.largest(min(left, most)), 0
        if x and search.branched is not None and len(filling) >= search.branched:
            filling = list(filling)
            while x:
                n = min(stock.count[x] - filling.count(x), left // x)
                filling += [x] * n
                left -= n * x
                x = stock.largest(min(left, x - 1))
        while x and (search.width is None or tried < search.width) and (steps is None or steps > 0 or not found):
            if stock.count[x] > filling.count(x):
                tried += 1
                steps = steps if steps is None else steps - 1
                if extend([*filling, x], left - x, x):
                    return True
            x = stock.largest(x - 1)
        if not tried:
            found.append((left, filling))
        return not tried and not left and (len(filling) == 1 or (search.keep is not None and not per_item))

    extend([], room, room)
    found.sort(key=lambda p: (p[0] + per_item * len(p[1]), len(p[1])))
    kept: list[list[int]] = []
    for waste, filling in found:
        if search.keep is not None and len(kept) >= search.keep:
            break
        if not _dominated(filling, waste, stock, search.branched):
            kept.append(filling)
    return kept or [found[0][1]]


def branch_and_bound(lengths: list[int], capacity: int, best: list[list[int]], least: int, search: Search) -> list[list[int]]:
    """Depth-first search over fillings around the largest item left; the best packing found, or the one given.

    A branch ends once its waste exceeds what a packing with one bin less could waste. The search stops at the lower
    bound or after its nodes.
    """
    total = sum(lengths)
    stock = _Stock(lengths)
    budget = float("inf") if search.nodes is None else int(search.nodes * len(best)) + 64
    chosen: list[list[int]] = []
    pending: list[list[list[int]]] = []
    waste = 0

    def descend() -> None:
        top = stock.mask.bit_length() - 1
        stock.take(top)
        options = fillings(capacity - top, stock, search, search.per_item * capacity)
        stock.give(top)
        pending.append([[top, *f] for f in reversed(options)])

    def undo() -> None:
        nonlocal waste
        last = chosen.pop()
        waste -= capacity - sum(last)
        for n in last:
            stock.give(n)

    if len(best) > least and stock.mask:
        descend()
    while pending and budget > 0 and len(best) > least:
        if not pending[-1]:
            pending.pop()
            if chosen and len(chosen) >= len(pending) and pending:
                undo()
            continue
        option = pending[-1].pop()
        budget -= 1
        lost = capacity - sum(option)
        if waste + lost > (len(best) - 1) * capacity - total:
            continue
        for n in option:
            stock.take(n)
        chosen.append(option)
        waste += lost
        if not stock.mask:
            best = [list(b) for b in chosen]
            undo()
        else:
            descend()
    return best


def complete(lengths, capacity: int, searches: tuple[Search, ...] = SEARCHES) -> list[list[int]]:
    """Bins for the lengths: best-fit decreasing as first incumbent, then the searches one after the other, each with the
    best packing so far as its incumbent. Ends where the lower bound is met. Zeros take no place."""
    lengths = [n for n in lengths if n]
    best, least = best_fit(lengths, capacity), lower_bound(lengths, capacity)
    for search in searches:
        if len(best) > least:
            best = branch_and_bound(lengths, capacity, best, least, search)
    return best
