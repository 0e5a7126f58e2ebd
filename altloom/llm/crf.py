"""Linear chains of labels: marginals for training, Viterbi for decoding, many chains at a time.

A chain's score is the sum of its words' scores, ``emitted``, a start score for
its first label and a transition score, ``moves``, between neighbours. Chains
lie one after the other, ``counts`` words each; a count may be zero.
"""

from __future__ import annotations

import numpy as np


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Chains from the longest on: their numbers, their first words, and how many are longer than t, for each t."""
    order = np.argsort(-counts, kind="stable")
    size = counts[order]
    begin = (np.cumsum(counts) - counts)[order]
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if len(size) else 0)]
    return order, begin, active


def marginals(emitted: np.ndarray, counts: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's label probabilities, the expected number of each transition, and each chain's log of the sum of all labellings."""
    k = emitted.shape[1]
    _, begin, active = layout(counts)
    peak = emitted.max(axis=1, keepdims=True)
    b, step = np.exp(emitted - peak), np.exp(moves - moves.max())
    ahead, pairs = np.empty((len(emitted), k)), np.zeros((k, k))
    total = np.zeros(len(begin))
    for t, n in enumerate(active):
        at = begin[:n] + t
        now = (np.exp(start - start.max()) if t == 0 else ahead[at - 1] @ step) * b[at]
        sums = now.sum(axis=1, keepdims=True)
        ahead[at] = now / sums
        total[:n] += np.log(sums[:, 0]) + peak[at, 0] + (start.max() if t == 0 else moves.max())
    found = np.empty((len(emitted), k))
    behind = np.ones((len(begin), k))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        both = ahead[at] * behind[:n]
        found[at] = both / both.sum(axis=1, keepdims=True)
        now = b[at] * behind[:n]
        if t:
            pair = ahead[at - 1][:, :, None] * step[None] * now[:, None, :]
            pairs += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            behind[:n] = now @ step.T
            behind[:n] /= behind[:n].max(axis=1, keepdims=True)
    out = np.empty(len(total))
    out[layout(counts)[0]] = total
    return found, pairs, out


def viterbi(emitted: np.ndarray, counts: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The labels of the best labelling of each chain; of equal ones that with the smallest labels from the end."""
    _, begin, active = layout(counts)
    labels = np.zeros(len(emitted), np.int8)
    if not active:
        return labels
    come = np.zeros(emitted.shape, np.int8)
    best = np.zeros((len(begin), emitted.shape[1]), emitted.dtype)
    back = np.ascontiguousarray(moves.T).astype(emitted.dtype)
    for t, n in enumerate(active):
        at = begin[:n] + t
        if t == 0:
            best[:n] = emitted[at] + start
            continue
        ways = best[:n, None, :] + back[None]
        come[at] = ways.argmax(axis=2)
        best[:n] = ways.max(axis=2) + emitted[at]
    now = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = come[at, now[:n]]
    return labels
