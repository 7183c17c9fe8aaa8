"""An error-correcting Earley parser for the roles of a conversation.

Grammar: a dialogue is empty, or an optional system turn and then pairs of a user and an
assistant turn. Beside keeping a row where the grammar has its role, four weighted
productions correct it: a row may be deleted, given the role wanted, or a turn without text
inserted; a truncated row costs more unless it is deleted.

Rows are read from the last to the first, by the mirrored grammar. A chart item then holds
the least (cost, audit) of the rows behind it, with the newest letter in front, so the
ASCII-least of equally cheap audits is found by that letter alone: two ways to one item with
one letter are the same way. In this grammar nonterminals stand in front of a rule only, so
every item begins with the chart, a completed one advances the same items everywhere, and a
chart set is its items' costs. Sets that differ by a constant are the same to the rows ahead:
there are few, and what a kind of row makes of each is remembered.

A kind of row is one letter: s, u, a for the initial of its role, o for any other, in upper
case where it is truncated, and x where it must be deleted.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: Added for a truncated row that stays.
TRUNCATED = 5
#: Roles that rows can be given and turns inserted with.
MADE = "ua"
GONE = "x"

#: Mirrored: what comes last in a conversation comes first.
GRAMMAR = (
    ("Root", ("Dialogue",)),
    ("Dialogue", ("Base",)),
    ("Dialogue", ("Turns", "s")),
    ("Turns", ("Base", "a", "u")),
    ("Base", ()),
    ("Base", ("Turns",)),
)
#: Items by rule and dot; those with the dot in front of a nonterminal are in no set, as completion makes what follows them.
ITEMS = [(rule, dot) for rule, (_, right) in enumerate(GRAMMAR) for dot in range(len(right) + 1) if dot or not right]
#: The terminal after an item's dot, and what an item has completed.
WANTED = [(GRAMMAR[rule][1][dot :] or (None,))[0] for rule, dot in ITEMS]
COMPLETED = [GRAMMAR[rule][0] if dot == len(GRAMMAR[rule][1]) else None for rule, dot in ITEMS]
AFTER = {left: [i for i, (rule, dot) in enumerate(ITEMS) if dot == 1 and GRAMMAR[rule][1][0] == left] for left, _ in GRAMMAR}
ROOT = ITEMS.index((0, 1))
EMPTY = next(i for i, (rule, _) in enumerate(ITEMS) if not GRAMMAR[rule][1])

#: A set: the cost of each item, None where it has none.
Set = tuple[int | None, ...]
#: How each item was reached: its letter, the item before it, and whether that is in the set behind the row.
Ways = tuple[tuple[str, int, bool] | None, ...]


def _closed(found: list[tuple[int, str, int, int, bool]]) -> tuple[Set, Ways]:
    """The set of the scanned items (cost, letter, item, before, row used), completed and with insertions."""
    heapq.heapify(found)
    costs: list[int | None] = [None] * len(ITEMS)
    ways: list[tuple[str, int, bool] | None] = [None] * len(ITEMS)
    while found:
        cost, letter, item, before, used = heapq.heappop(found)
        if costs[item] is not None:
            continue
        costs[item], ways[item] = cost, (letter, before, used)
        for after in AFTER.get(COMPLETED[item], ()):
            heapq.heappush(found, (cost, letter, after, before, used))
        if WANTED[item] and WANTED[item] in MADE:
            heapq.heappush(found, (cost + COST[INSERT], INSERT, item + 1, item, False))
    return tuple(costs), tuple(ways)


#: The set behind the last row.
END, END_WAYS = _closed([(0, "", EMPTY, EMPTY, False)])


@lru_cache(maxsize=1 << 14)
def step(behind: Set, kind: str) -> tuple[int, Set, Ways]:
    """(cost, set, ways) in front of a row of a kind; the set's costs are less by ``cost``, its least one."""
    found = []
    for item, cost in enumerate(behind):
        wanted = WANTED[item]
        if cost is None or (wanted is None and item != ROOT):
            continue
        found.append((cost + COST[DELETE], DELETE, item, item, True))
        if wanted is None or kind == GONE:
            continue
        stays = cost + (TRUNCATED if kind.isupper() else 0)
        if kind.lower() == wanted:
            found.append((stays + COST[KEEP], KEEP, item + 1, item, True))
        elif wanted in MADE:
            found.append((stays + COST[REROLE], REROLE, item + 1, item, True))
    costs, ways = _closed(found)
    least = min(c for c in costs if c is not None)
    return least, tuple(None if c is None else c - least for c in costs), ways


def read(behind: Set, kinds: str) -> tuple[int, Set]:
    """(cost, set) in front of rows of these kinds; the set's costs are less by ``cost``."""
    total = 0
    for kind in reversed(kinds):
        cost, behind, _ = step(behind, kind)
        total += cost
    return total, behind


def write(item: int, behind: Set, kinds: str, last: bool) -> tuple[str, str, int]:
    """(audit, roles, item behind) of the cheapest edits of rows that an item in front of them stands for.

    roles: the role each letter puts in the repaired conversation, ``-`` for none. last: no
    rows follow, so turns inserted at the end belong here.
    """
    every = []
    for kind in reversed(kinds):
        _, behind, ways = step(behind, kind)
        every.append(ways)
    audit, roles = [], []
    for ways in [*reversed(every), *([END_WAYS] if last else [])]:
        used = False
        while not used:
            letter, item_before, used = ways[item]
            if not letter:
                break
            audit.append(letter)
            roles.append("-" if letter == DELETE else WANTED[item_before])
            item = item_before
    return "".join(audit), "".join(roles), item


def repair(kinds: str) -> tuple[int, str, str]:
    """(cost, audit, roles) of the cheapest edits of a whole conversation."""
    cost, front = read(END, kinds)
    audit, roles, _ = write(ROOT, END, kinds, True)
    return cost + front[ROOT], audit, roles
