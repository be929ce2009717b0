"""Forward and backward recursions over many symbol sequences at once, in numpy.

Sequences are laid out step by step, longest first: row ``off[t] + j`` is step t of the j-th longest. A step of all sequences
is then one small matrix product, and sequences that have ended drop off the end. Matrices need not be normalised, so the
same recursions serve hidden Markov models and linear-chain conditional random fields.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols handled at a time; the arrays of a chunk hold this many rows.
CHUNK = 200_000


def chunks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of sequences, longest first, in chunks of about ``CHUNK`` symbols."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if len(order):
        ends = np.cumsum(lengths[order])
        cut = np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK))
        yield from (c for c in np.split(order, np.unique(cut)) if len(c))


class Layout:
    """Sequences of one chunk, given longest first."""

    def __init__(self, seqs: list[np.ndarray]):
        lens = np.array([len(s) for s in seqs])
        self.n = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # sequences alive at each step
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        self.obs = np.empty(self.off[-1], np.int64)
        for j, s in enumerate(seqs):
            self.obs[self.off[: len(s)] + j] = s
        self.seq = np.arange(self.off[-1]) - np.repeat(self.off[:-1], self.n)
        self.lens = lens

    def rows(self, j: int) -> np.ndarray:
        return self.off[: self.lens[j]] + j


def forward(x: Layout, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables, their scales, and the log of each sequence's total weight. ``emit`` is (states, symbols)."""
    a = emit.T[x.obs]
    scale = np.empty(len(a))
    off, n = x.off.tolist(), x.n.tolist()
    prev = None
    for t, k in enumerate(n):
        now = a[off[t] : off[t + 1]]
        now *= start if t == 0 else prev[:k] @ trans
        s = now.sum(1)
        now /= s[:, None]
        scale[off[t] : off[t + 1]] = s
        prev = now
    return a, scale, np.bincount(x.seq, np.log(scale), len(x.lens))


def posteriors(x: Layout, a: np.ndarray, scale: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the states at each step, and expected transitions summed over all."""
    gamma = a.copy()
    moves = np.zeros_like(trans)
    weight = emit.T[x.obs] / scale[:, None]
    off, n = x.off.tolist(), x.n.tolist()
    beta = np.ones((0, len(trans)))
    back = trans.T.copy()
    for t in range(len(n) - 2, -1, -1):
        k = n[t + 1]
        g = weight[off[t + 1] : off[t + 2]]
        g[: len(beta)] *= beta
        moves += a[off[t] : off[t] + k].T @ g
        beta = g @ back
        gamma[off[t] : off[t] + k] *= beta
    return gamma, moves * trans


def expected_counts(seqs: list[np.ndarray], start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log weight, and expected counts of first states, transitions and (state, symbol), over all sequences."""
    total, first, moves, seen = 0.0, np.zeros_like(start), np.zeros_like(trans), np.zeros_like(emit)
    for c in chunks(np.array([len(s) for s in seqs])):
        x = Layout([seqs[i] for i in c])
        a, scale, logs = forward(x, start, trans, emit)
        gamma, m = posteriors(x, a, scale, trans, emit)
        total += logs.sum()
        first += gamma[: x.n[0]].sum(0)
        moves += m
        for k in range(len(start)):
            seen[k] += np.bincount(x.obs, gamma[:, k], emit.shape[1])
    return total, first, moves, seen
