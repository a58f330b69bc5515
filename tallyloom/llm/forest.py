"""Spanning forests of dense links inside one bounded block, so links of a clique need not be listed."""

from __future__ import annotations

import numpy as np


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 edges that connect the same nodes 0..n-1 as the links a[i]-b[i] do."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        if np.array_equal(before, label):
            break
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]
