"""Bin packing on a length histogram: a configuration linear program, rounded.

Everything here works on ``counts[length]`` and on patterns with a number of
bins each, so its cost depends on the capacity and not on how many items
there are.

1. Lengths are put into classes (rounded up, so whatever fits by class fits).
   A fractional cover of the classes by configurations is found with
   multiplicative weights: a class that is covered less costs exponentially
   more, and a knapsack over class sizes finds the configuration that is worth
   the most at these prices.  The prices also prove how few bins any packing
   can have (:func:`lower_bound`).
2. Each configuration is used the whole number of times that is below its
   fractional value, as far as items are left, with the true lengths.  The
   place of its smallest item stays open: that one is chosen by true length.
3. All items left, longest first, go to the fullest bin that has room, and to
   a new one if none has.

Classes waste a little room in each bin, and short items left for step 3 fill
it.  How much of the cover is best rounded depends on the lengths, so several
shares of it are (``_shares``), from one that covers every class to none, and
the plan with the fewest bins stays; of equal ones, the largest share.

Defined results: no items give no patterns; items of the whole capacity get a
bin each; lengths above the capacity and zeros are not for this module.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np

CLASSES = 256  # classes of lengths
STEPS = 1500  # configurations priced
RATE = 12.0  # how strongly prices answer to coverage

# A kind of bin: items as (length, how many), longest first, and the number of such bins.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack with repetition: class index -> copies, of the largest total price within ``capacity``.

    ``sizes`` are ascending whole numbers.
    """
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(int(sizes[0]), capacity + 1):
        n = fitting[room]
        gains = value[room - sizes[:n]] + prices[:n]
        best = int(gains.argmax())
        if gains[best] > value[room - 1]:
            value[room], choice[room] = gains[best], best
        else:
            value[room] = value[room - 1]
    found: Counter[int] = Counter()
    room = capacity
    while room > 0:
        if choice[room] < 0 or value[room] == value[room - 1]:
            room -= 1
        else:
            found[int(choice[room])] += 1
            room -= int(sizes[choice[room]])
    return dict(found)


def fractional_cover(
    demand: np.ndarray, sizes: np.ndarray, capacity: int, steps: int = STEPS
) -> tuple[dict[tuple, float], np.ndarray, np.ndarray]:
    """Configurations and how often each is used, how many times that covers each class, and the mean prices.

    Keys are ``((class index, copies), ...)``.
    """
    covered = np.zeros(len(demand))
    mean = np.zeros(len(demand))
    used: Counter[tuple] = Counter()
    for _ in range(steps):
        behind = covered / demand
        prices = np.exp(RATE * (behind.min() - behind)) / demand
        found = best_configuration(prices, sizes, capacity)
        index = np.fromiter(found, int)
        copies = np.fromiter(found.values(), float)
        # No class is raised by more than a small part of its demand in one step.
        amount = (demand[index] / copies).min() / RATE
        mean += prices * (amount / (prices[index] @ copies))
        covered[index] += amount * copies
        used[tuple(sorted(found.items(), reverse=True))] += amount
    return dict(used), covered / demand, mean


def lower_bound(counts: np.ndarray, price_of: np.ndarray, capacity: int) -> float:
    """Bins that every packing of ``counts`` needs, proved by one price for each length.

    What a bin can hold is worth at most the best configuration of true
    lengths, so all items together fill at least their worth over that.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return 0.0
    prices = price_of[lengths]
    best = best_configuration(prices, lengths, capacity)
    return float(prices @ counts[lengths] / sum(prices[i] * n for i, n in best.items()))


def _shares(times: np.ndarray) -> list[float]:
    """What the cover is multiplied by: every class covered that is at all, classes covered on average, none twice, nothing."""
    return [1 / times[times > 0].min(), 1 / times.mean(), 1 / times.max(), 0.0]


class Stock:
    """Items by class, longest first."""

    def __init__(self, counts: np.ndarray, width: int):
        self.left = counts
        self.width = width

    def demand(self) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers that have items, and how many."""
        number = -(-np.arange(len(self.left)) // self.width)
        total = np.bincount(number, self.left)
        present = np.flatnonzero(total)
        return present, total[present]

    def _lengths(self, number: int) -> range:
        return range(min(number * self.width, len(self.left) - 1), (number - 1) * self.width, -1)

    def take(self, number: int, copies: int, bins: int) -> list[list[int]]:
        """Runs ``[length, bins]``, at most ``copies * bins`` items of a class, longest first."""
        runs, wanted = [], copies * bins
        for length in self._lengths(number):
            if n := min(int(self.left[length]), wanted):
                self.left[length] -= n
                wanted -= n
                runs.append([length, n])
        return runs


def _use(stock: Stock, configuration: list[tuple[int, int]], bins: int) -> list[Pattern]:
    """``bins`` bins of one configuration with true lengths, as patterns."""
    # Each copy of a class is a column of ``bins`` items in runs of equal lengths; columns are cut where any run ends.
    columns: list[list[list[int]]] = []
    for number, copies in configuration:
        runs = stock.take(number, copies, bins)
        for _ in range(copies):
            column, wanted = [], bins
            while wanted and runs:
                n = min(runs[0][1], wanted)
                column.append([runs[0][0], n])
                runs[0][1] -= n
                wanted -= n
                if not runs[0][1]:
                    runs.pop(0)
            if wanted:
                column.append([0, wanted])  # items have run out: an empty place
            columns.append(column)
    out: list[Pattern] = []
    done = 0
    while done < bins:
        n = min(column[0][1] for column in columns)
        items = Counter(column[0][0] for column in columns if column[0][0])
        if items:
            out.append((tuple(sorted(items.items(), reverse=True)), n))
        for column in columns:
            column[0][1] -= n
            if not column[0][1]:
                column.pop(0)
        done += n
    return out


def _without_smallest(configuration: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """All but one item of the smallest class: that place is filled by true length."""
    if sum(n for _, n in configuration) == 1:
        return configuration
    *larger, (number, copies) = configuration
    return larger + [(number, copies - 1)] if copies > 1 else larger


def best_fit(counts: np.ndarray, patterns: list[Pattern], capacity: int) -> list[Pattern]:
    """Add all items of ``counts``, longest first, to the fullest bins with room or to new ones."""
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []  # sorted room sizes that have bins

    def put(items: tuple, bins: int) -> None:
        room = capacity - sum(length * n for length, n in items)
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append([items, bins])

    for items, bins in patterns:
        put(items, bins)
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            place = bisect_left(rooms, length)
            if place == len(rooms):
                copies = capacity // length
                bins = left // copies
                if bins:
                    put(((length, copies),), bins)
                    left -= bins * copies
                if left:
                    put(((length, left),), 1)
                    left = 0
                continue
            room = rooms[place]
            items, bins = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(place)
            n = min(bins, left)
            if bins > n:
                put(items, bins - n)
            together = Counter(dict(items))
            together[length] += 1
            put(tuple(sorted(together.items(), reverse=True)), n)
            left -= n
    return [(items, bins) for found in by_room.values() for items, bins in found]


def plan(counts: np.ndarray, capacity: int, steps: int = STEPS) -> list[Pattern]:
    """Patterns and bins that hold exactly the items of ``counts`` (index: length, up to ``capacity``)."""
    return plan_and_bound(counts, capacity, steps)[0]


def plan_and_bound(counts: np.ndarray, capacity: int, steps: int = STEPS) -> tuple[list[Pattern], float]:
    """:func:`plan`, and a number of bins that no packing can go below."""
    width = -(-capacity // CLASSES)
    left = counts.astype("int64")
    full: list[Pattern] = []
    if whole := int(left[capacity]):
        full.append((((capacity, 1),), whole))
        left[capacity] = 0
    present, demand = Stock(left, width).demand()
    if not len(present):
        return full, float(whole)
    cover, times, mean = fractional_cover(demand, present, capacity // width, steps)

    price_of = np.zeros(capacity + 1)
    number = -(-np.arange(capacity + 1) // width)
    for i, priced in enumerate(present):
        price_of[number == priced] = mean[i]
    by_length = float(left @ np.arange(capacity + 1)) / capacity
    bound = whole + max(by_length, lower_bound(left, price_of, capacity))

    found: list[list[Pattern]] = []
    for share in _shares(times):
        stock, patterns = Stock(left.copy(), width), list(full)
        for configuration, used in sorted(cover.items(), key=lambda x: (-x[1], x[0])):
            if bins := int(used * share):
                chosen = _without_smallest([(int(present[i]), n) for i, n in configuration])
                patterns += _use(stock, chosen, bins)
        found.append(best_fit(stock.left, patterns, capacity))
    return min(found, key=lambda patterns: sum(bins for _, bins in patterns)), bound
