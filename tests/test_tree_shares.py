"""Contributions to trees: rows of a kind are told apart without sorting."""

import numpy as np
import pytest

from tableloom.operators import explain as ex

RNG = np.random.default_rng(8)


def leaf(m, width):
    low = RNG.uniform(-1, 0, m)
    return RNG.uniform(0.1, 1), RNG.normal(), [(int(f), float(a), float(a + 1), float(t)) for f, a, t in zip(RNG.permutation(width)[:m], low, RNG.uniform(0.2, 0.9, m))]


def test_short_paths_sort_no_rows(monkeypatch):
    monkeypatch.setattr(ex.np, "unique", lambda *a, **k: pytest.fail("rows are sorted"))
    assert ex._leaf_contributions(RNG.uniform(-1, 1, (50, 4)), [leaf(3, 4), leaf(1, 4), (0.5, 2.0, [])], 4).shape == (50, 4)


@pytest.mark.parametrize("m", [1, 5, 12, 13, 16])
def test_contributions_of_a_leaf_add_up(m):
    """A row's contributions are the leaf's value, if it gets there, less the value's share on average."""
    weight, value, path = leaf(m, 16)
    x = np.where(RNG.random((200, 16)) < 0.9, 0.0, 5.0)
    got = ex._leaf_contributions(x, [(weight, value, path)], 16).sum(axis=1)
    there = np.all([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path], axis=0)
    np.testing.assert_allclose(got, weight * value * (there - np.prod([t for *_, t in path])), atol=1e-12)
