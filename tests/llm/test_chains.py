import itertools

import numpy as np
import pytest

from lorekeep.llm import chains


def brute(seq, start, trans, emit):
    """Total weight and expected counts by enumerating all paths."""
    k = len(start)
    total, first, moves, seen = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(emit)
    for path in itertools.product(range(k), repeat=len(seq)):
        w = start[path[0]] * np.prod([emit[s, o] for s, o in zip(path, seq, strict=True)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:], strict=False)])
        total += w
        first[path[0]] += w
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += w
        for s, o in zip(path, seq, strict=True):
            seen[s, o] += w
    return np.log(total), first / total, moves / total, seen / total


@pytest.mark.parametrize("chunk", [5, 1000])
def test_against_all_paths(monkeypatch, chunk):
    monkeypatch.setattr(chains, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    start, trans, emit = rng.random(3), rng.random((3, 3)) * 2, rng.random((3, 4)) * 3
    seqs = [rng.integers(0, 4, n) for n in (1, 5, 3, 3, 6, 1, 2, 0)]
    want = [brute(s, start, trans, emit) for s in seqs if len(s)]
    got = chains.expected_counts(seqs, start, trans, emit)
    for i in range(4):
        assert np.allclose(got[i], sum(w[i] for w in want))


def test_long_sequences_do_not_underflow():
    emit = np.full((2, 2), 1e-5)
    x = chains.Layout([np.zeros(50_000, np.int64)])
    _, _, logs = chains.forward(x, np.array([0.5, 0.5]), np.full((2, 2), 0.5), emit)
    assert np.isclose(logs[0], 50_000 * np.log(1e-5))
