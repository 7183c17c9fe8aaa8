"""Ball trees over integer vectors, searched for the best inner products within windows.

A node covers consecutive rows of the tree and keeps their centre, the radius around it and
the range of their labels. For a query q every score in a node lies within |q| radius of
q centre, so a node is skipped if all of its scores are above or below the query's window,
if they are strictly beneath the query's k-th score so far, or if its labels are all of the
wrong kind. Many queries go down together: a node is entered by those that cannot skip it.

A part of rows with several labels is split by labels first, so that most nodes have one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidewheel.llm.topk_search import NOBODY, NONE, Best, products

#: Rows of a leaf, about.
LEAF = 64
#: Share of the sizes that enter a bound by which it may be off in doubles.
SLACK = 1e-9


@dataclass
class Tree:
    """Rows in the tree's order, and nodes: begin, end, first child (-1 for none; the second follows it), least and most label."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    nodes: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def _halves(weights: np.ndarray, labels: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two parts of rows: by label if there are several, or else along the line between two far ones."""
    n = len(weights)
    if labels.min() != labels.max():
        order = np.argsort(labels, kind="stable")
        edges = np.flatnonzero(np.diff(labels[order])) + 1
        at = edges[np.abs(edges - n // 2).argmin()]
    else:
        far = weights[((weights - centre) ** 2).sum(1).argmax()].astype(float)
        other = weights[((weights - far) ** 2).sum(1).argmax()]
        order, at = np.argsort(weights @ (other - far), kind="stable"), n // 2
    return order[:at], order[at:]


def build(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over at least one row."""
    order = np.arange(len(ids))
    nodes, centres, radii = [[0, len(ids), -1, 0, 0]], [], []
    at = 0
    while at < len(nodes):
        begin, end = nodes[at][:2]
        own = order[begin:end]
        vectors = weights[own].astype(float)
        centre = vectors.mean(0)
        centres.append(centre)
        radii.append(np.sqrt(((vectors - centre) ** 2).sum(1).max(initial=0)))
        nodes[at][3:] = int(labels[own].min()), int(labels[own].max())
        if end - begin > leaf:
            first, second = _halves(vectors, labels[own], centre)
            order[begin:end] = np.r_[own[first], own[second]]
            nodes[at][2] = len(nodes)
            nodes += [[begin, begin + len(first), -1, 0, 0], [begin + len(first), end, -1, 0, 0]]
        at += 1
    return Tree(ids[order], rows[order], labels[order], weights[order], np.array(nodes, np.int64), np.stack(centres), np.array(radii))


def bounds(tree: Tree, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[query, node]: the least and the most that a score can be."""
    size = np.sqrt((queries.astype(float) ** 2).sum(1))[:, None]
    middle = queries.astype(float) @ tree.centre.T
    reach = size * tree.radius * (1 + SLACK) + SLACK * size * np.sqrt((tree.centre**2).sum(1)) + SLACK
    return middle - reach, middle + reach


@dataclass
class Queries:
    """Vectors, own rows, labels, and the windows (least, most) that scores have to be in."""

    weights: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    least: np.ndarray
    most: np.ndarray


def search(tree: Tree, asked: Queries, best: Best, same: bool) -> int:
    """Offers ``best`` each query's best rows within its window, of its own label (without itself) or of others; returns the rows scored.

    What best holds from other trees prunes this one.
    """
    low, high = bounds(tree, asked.weights)
    inside = (high >= asked.least[:, None]) & (low <= asked.most[:, None])
    of, to = tree.nodes[:, 3], tree.nodes[:, 4]
    mine = asked.labels[:, None]
    inside &= (mine >= of) & (mine <= to) if same else (mine != of) | (mine != to)
    scored = 0
    going = [(0, np.arange(len(asked.weights)))]
    while going:
        node, q = going.pop()
        q = q[inside[q, node] & (high[q, node] >= best.last()[q])]
        if not len(q):
            continue
        begin, end, child = tree.nodes[node, :3]
        if child >= 0:
            # The child that promises more on the whole is searched first.
            children = sorted((child, child + 1), key=lambda c: high[q, c].sum())
            going += [(c, q) for c in children]
            continue
        scored += len(q) * int(end - begin)
        score = products(asked.weights[q], tree.weights[begin:end])
        fits = (score >= asked.least[q, None]) & (score <= asked.most[q, None]) & (score >= best.last()[q, None])
        kin = asked.labels[q, None] == tree.labels[begin:end]
        fits &= kin & (asked.rows[q, None] != tree.rows[begin:end]) if same else ~kin
        some = fits.any(1)
        q, score, fits = q[some], score[some], fits[some]
        if len(q):
            names = np.where(fits, tree.ids[begin:end], NOBODY)
            best.offer(q, np.where(fits, score, NONE), names)
    return scored
