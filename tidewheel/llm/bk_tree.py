"""BK-trees over fingerprints of one or more 64-bit words, many at once in numpy.

A node's children are keyed by their integer Hamming distance to it, one child a
distance. A search that is at distance d from a node follows only the edges keyed
d - radius to d + radius; the triangle inequality rules out the rest. The trees of
a forest are built and searched together, a level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 64
#: Width of a radius up to which edges are looked up one by one; a wider one takes a node's children and drops those outside.
STEPS_WIDE = 16
#: Nodes and searches are worked on in pieces of about this many (search, node) steps.
STEPS = 1 << 20


@dataclass
class Forest:
    """prints: distinct within a tree; root: each node's tree, by its first node; child[node, d]: -1 for none."""

    prints: np.ndarray
    root: np.ndarray
    child: np.ndarray


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, which may have several words."""
    bits = np.bitwise_count(a ^ b).astype(np.int64)
    return bits if bits.ndim == 1 else bits.sum(1)


def _width(prints: np.ndarray) -> int:
    return BITS * (prints.shape[1] if prints.ndim > 1 else 1) + 1


def build(prints: np.ndarray, tree: np.ndarray) -> Forest:
    """A forest from fingerprints (uint64, or rows of them) and the number of the tree of each, in ascending order of trees."""
    n, width = len(prints), _width(prints)
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if n else np.empty(0, np.int64)
    root = np.repeat(starts, np.diff(np.r_[starts, n])) if n else np.empty(0, np.int64)
    child = np.full((n, width), -1, np.int32)
    flat = child.reshape(-1)
    at = root.copy()
    waiting = np.flatnonzero(at != np.arange(n))
    while len(waiting):
        slot = at[waiting] * width + distance(prints[waiting], prints[at[waiting]])
        free = flat[slot] < 0
        slots, first = np.unique(slot[free], return_index=True)
        flat[slots] = waiting[free][first]
        below = flat[slot]
        at[waiting] = below
        waiting = waiting[below != waiting]
    return Forest(prints, root, child)


def search(forest: Forest, prints: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(search, node) of all nodes within the radius; starts: the root that each search begins at."""
    if not len(prints):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    largest = int(np.bincount(np.unique(forest.root, return_inverse=True)[1]).max())
    piece = max(64, STEPS // largest)
    found_q, found_n = [], []
    wide = 2 * radius + 1 > STEPS_WIDE
    if wide:  # the children of all nodes in order, and where those of each begin
        parent, key = np.nonzero(forest.child >= 0)
        below = forest.child[parent, key].astype(np.int64)
        begins = np.searchsorted(parent, np.arange(len(forest.prints) + 1))
    for begin in range(0, len(prints), piece):
        q = np.arange(begin, min(begin + piece, len(prints)))
        node = starts[q]
        while len(q):
            d = distance(prints[q], forest.prints[node])
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            if wide:
                number = begins[node + 1] - begins[node]
                of = np.repeat(np.arange(len(q)), number)
                at = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) + begins[node][of]
                near = np.abs(key[at] - d[of]) <= radius
                q, node = q[of[near]], below[at[near]]
                continue
            next_q, next_n = [], []
            for step in range(-radius, radius + 1):
                edge = d + step
                ok = (edge > 0) & (edge <= BITS)
                to = forest.child[node[ok], edge[ok]]
                there = to >= 0
                next_q.append(q[ok][there])
                next_n.append(to[there].astype(np.int64))
            q, node = np.concatenate(next_q), np.concatenate(next_n)
    return np.concatenate(found_q), np.concatenate(found_n)


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 with links a - b: the lowest node that each can reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label
