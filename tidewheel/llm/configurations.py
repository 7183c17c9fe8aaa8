"""The configuration linear program of bin packing over a histogram of lengths, and its rounding.

A configuration is a multiset of lengths that fit in one bin. The program asks for
the fewest bins, in fractions, whose configurations hold as many items of each length
as there are. Multiplicative weights solve it: every length carries a price, its share
of the bin times a weight that grows exponentially with the part of its demand that is
still open; the configuration worth most at these prices (an unbounded knapsack, by
dynamic programming over the capacity) takes its part of the open demand, until none is
left. Prices divided by what that configuration is worth bound the program from below,
so every solution comes with its distance from the best.

The program runs over classes of lengths, at most CLASSES of them, each length in the
nearest. Rounding returns to the lengths themselves: a configuration's bins take lengths
of its classes such that each wastes no more than the configuration itself does. What is
left is solved and rounded again, with a little more waste allowed each time. The
shortest items are kept back for the end: with the few that no configuration took they
are packed best-fit, into the room of the bins there are. Where best-fit alone needs
fewer bins, its packing counts. Bins stay groups of equal bins throughout, so the work
depends on the capacity and the rounds, not on the number of items.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from math import ceil

import numpy as np

#: Most classes of lengths, rounds of the solver, and the rate at which prices follow open demand.
CLASSES = 256
ROUNDS = 4000
RATE = 0.1
#: Passes of the solver at most, and the part that the best may be above the bound to be good enough.
PASSES, NEAR = 12, 0.005
#: The part of its scarcest length's open demand that a configuration takes in a round; all of it once it is below LAST.
PORTION, LAST = 0.5, 0.02
#: The parts of the items, the shortest, that are kept for the room that configurations leave: each is tried.
RESERVES = (0.015, 0.03)
#: Waste of a bin beyond its configuration's, in each turn of solving and rounding, and combinations of lengths tried for a bin.
WASTE, TRIES = (0, 0, 0, 1, 2, 4, 8), 2000

#: {length: number}
Counts = dict[int, int]
#: (number of equal bins, lengths in each)
Bins = tuple[int, tuple[int, ...]]


def best_configuration(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[Counts, float]:
    """The multiset of sizes within the capacity whose prices sum to the most, and that sum; sizes ascend."""
    value = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(capacity + 1):
        k = upto[c]
        if not k:
            continue
        offers = price[:k] + value[c - sizes[:k]]
        best = offers.argmax()
        value[c], last[c] = offers[best], sizes[best]
        if value[c - 1] > value[c]:
            value[c], last[c] = value[c - 1], 0
    taken: Counts = defaultdict(int)
    c = capacity
    while c > 0:
        taken[int(last[c])] += 1
        c -= max(int(last[c]), 1)
    taken.pop(0, None)
    return dict(taken), float(value[capacity])


def _pass(sizes: np.ndarray, demand: np.ndarray, base: np.ndarray, capacity: int, rounds: int) -> tuple[dict[tuple, float], float, float]:
    """(bins of each configuration, bound, worth of the best one) of a pass that fills all demand, at prices about ``base``."""
    left, bound = demand.copy(), 0.0
    top = best_configuration(sizes, base, capacity)[1]
    used: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        on = np.flatnonzero(left > 0)
        if not len(on):
            break
        open_ = left[on] / demand[on]
        mean = (left[on] * sizes[on]).sum() / (demand[on] * sizes[on]).sum()
        price = base[on] * np.exp(RATE * np.clip(open_ / mean - 1, -5, 5))
        taken, worth = best_configuration(sizes[on], price, capacity)
        # Prices of the open lengths bound what these alone need, and so the whole.
        bound = max(bound, float((price * demand[on]).sum()) / worth)
        index = on[np.searchsorted(sizes[on], list(taken))]
        number = np.array(list(taken.values()), float)
        amount = (left[index] / number).min()
        if (left[index] > LAST * demand[index]).all():
            amount *= PORTION
        left[index] -= number * amount
        left[left < 1e-9 * demand] = 0
        used[tuple(sorted(taken.items(), reverse=True))] += amount
    return used, max(bound, float((base * demand).sum()) / top), top


def fractional(counts: Counts, capacity: int, rounds: int = ROUNDS, passes: int = PASSES) -> tuple[list[tuple[float, Counts]], float]:
    """([(bins, configuration)], bound): configurations that together hold the counts exactly, and a bound that no solution is below.

    A pass fills all demand. After it, lengths that went into bins worth less than the best
    configuration get dearer, by the factor that their bins were short of it, so the next
    pass serves them while there is still something to go with them. It ends as soon as the
    best pass is within NEAR of the bound.
    """
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[int(n)] for n in sizes], float)
    base, bound, best = sizes / capacity, 0.0, None
    for _ in range(passes):
        used, low, top = _pass(sizes, demand, base, capacity, rounds)
        bound = max(bound, low)
        if best is None or sum(used.values()) < sum(best.values()):
            best = used
        if sum(best.values()) <= (1 + NEAR) * bound:
            break
        dearer = np.zeros(len(sizes))
        for taken, amount in used.items():
            index = np.searchsorted(sizes, [n for n, _ in taken])
            number = np.array([k for _, k in taken], float)
            dearer[index] += amount * number / demand[index] * np.log(top / (number * base[index]).sum())
        base = base * np.exp(dearer)
    return [(amount, dict(taken)) for taken, amount in best.items()], bound


class _Stock:
    """Items left of each length, with the lengths that are left in order."""

    def __init__(self, counts: Counts):
        self.left = {n: k for n, k in counts.items() if k}
        self.order = sorted(self.left)

    def take(self, length: int, number: int) -> int:
        number = min(number, self.left[length])
        self.left[length] -= number
        if not self.left[length]:
            del self.left[length]
            self.order.remove(length)
        return number

    def put(self, length: int, number: int) -> None:
        if length not in self.left:
            self.left[length] = 0
            insort(self.order, length)
        self.left[length] += number

    def within(self, low: int, high: int) -> list[int]:
        """The lengths left from low to high, those with most items first."""
        found = self.order[bisect_left(self.order, low) : bisect_right(self.order, high)]
        return sorted(found, key=lambda n: (-self.left[n], n))

    def longest(self, room: int) -> int:
        """The longest length left that is within the room; 0 for none."""
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else 0


def _class(length: int, width: int) -> int:
    return max(1, (length + width // 2) // width)


def _combination(stock: _Stock, slots: list[int], width: int, capacity: int, waste: int) -> list[int] | None:
    """Lengths, one for each slot's class, that fill a bin but for the waste; the last may be of any class."""
    offers = {s: stock.within(s * width - width // 2 if s > 1 else 1, s * width + width - width // 2 - 1) for s in set(slots)}
    tried = 0

    def extend(k: int, room: int, held: list[int]) -> list[int] | None:
        nonlocal tried
        tried += 1
        if tried > TRIES:
            return None
        if k + 1 == len(slots):
            length = stock.longest(room)
            while length and room - length <= waste:
                if stock.left[length] > held.count(length):
                    return [*held, length]
                length = stock.longest(length - 1)
            return None
        for length in offers[slots[k]]:
            if length < room and stock.left[length] > held.count(length):
                found = extend(k + 1, room - length, [*held, length])
                if found or tried > TRIES:
                    return found
        return None

    return extend(0, capacity, [])


def _filled(stock: _Stock, slots: list[int], wanted: int, width: int, capacity: int, waste: int) -> list[Bins]:
    """Up to so many bins of one configuration (its classes, longest first), as the stock has lengths for them."""
    bins: list[Bins] = []
    while wanted:
        held = _combination(stock, slots, width, capacity, waste)
        if not held:
            break
        number = min(wanted, *(stock.left[n] // held.count(n) for n in set(held)))
        for length in held:
            stock.take(length, number)
        bins.append((number, tuple(held)))
        wanted -= number
    return bins


def best_fit(stock: _Stock, bins: list[Bins], capacity: int) -> list[Bins]:
    """Packs what is left in stock, longest first, into the tightest of the bins that it fits, else into new ones."""
    by_room: dict[int, list[Bins]] = defaultdict(list)
    for number, held in bins:
        by_room[capacity - sum(held)].append((number, held))
    rooms = sorted(by_room)
    while stock.order:
        length = stock.order[-1]
        i = bisect_right(rooms, length - 1)
        if i == len(rooms):
            per_bin = capacity // length
            number = stock.left[length]
            whole, rest = divmod(number, per_bin)
            stock.take(length, number)
            fresh = [(whole, (length,) * per_bin), (1, (length,) * rest)]
            fresh = [(m, held) for m, held in fresh if m and held]
        else:
            room = rooms[i]
            number, held = by_room[room].pop()
            got = stock.take(length, number)
            fresh = [(got, (*held, length)), (number - got, held)]
            fresh = [(m, held) for m, held in fresh if m]
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
        for m, held in fresh:
            room = capacity - sum(held)
            if room not in by_room:
                rooms.insert(bisect_right(rooms, room), room)
            by_room[room].append((m, held))
    return [x for room in rooms for x in by_room[room]]


def by_configurations(stock: _Stock, capacity: int, rounds: int = ROUNDS, classes: int = CLASSES) -> list[Bins]:
    """Bins of the program's configurations, rounded, taken out of the stock."""
    width = -(-capacity // classes)
    units = capacity // width
    bins: list[Bins] = []
    for turn, waste in enumerate(WASTE):
        grouped: Counts = defaultdict(int)
        for length, number in stock.left.items():
            grouped[min(_class(length, width), units)] += number
        if not grouped:
            break
        solved, _ = fractional(grouped, units, rounds, 1 if turn else PASSES)
        for amount, taken in sorted(solved, key=lambda x: (-max(x[1]), -x[0], sorted(x[1].items()))):
            slots = [size for size, number in sorted(taken.items(), reverse=True) for _ in range(number)]
            own = capacity - sum(slots) * width  # what the configuration itself leaves
            bins += _filled(stock, slots, ceil(amount - 1e-6), width, capacity, max(own - width // 2, 0) + waste)
    return bins


def rounded(counts: Counts, capacity: int, reserve: float, rounds: int = ROUNDS, classes: int = CLASSES) -> tuple[list[Bins], int]:
    """(bins, items that configurations placed): the program's bins, with the shortest part of the items and what is left in their room."""
    stock, kept, room = _Stock(counts), {}, int(reserve * sum(counts.values()))
    for length in list(stock.order):
        if room <= 0:
            break
        kept[length] = stock.take(length, room)
        room -= kept[length]
    bins = by_configurations(stock, capacity, rounds, classes)
    placed = sum(number * len(held) for number, held in bins)
    for length, number in kept.items():
        stock.put(length, number)
    return best_fit(stock, bins, capacity), placed


def pack(counts: Counts, capacity: int, rounds: int = ROUNDS, classes: int = CLASSES) -> list[Bins]:
    """Groups of equal bins that hold exactly the items of ``counts``; all lengths from 1 to capacity."""
    size = lambda held: sum(number for number, _ in held)
    least, tried = -(-sum(n * k for n, k in counts.items()) // capacity), []
    for reserve in RESERVES:
        tried.append(rounded(counts, capacity, reserve, rounds, classes)[0])
        if size(tried[-1]) == least:  # no packing takes fewer
            return tried[-1]
    return min([*tried, best_fit(_Stock(counts), [], capacity)], key=size)
