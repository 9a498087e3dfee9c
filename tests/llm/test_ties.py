"""Ties of the approximate search: of equally near vectors the smaller ids."""

import numpy as np
import pytest

from depweave.llm import ann


@pytest.mark.parametrize("scale", [0.01, 1.0, 1000.0])
def test_copies_in_any_order_go_by_id(scale):
    rng = np.random.default_rng(3)
    x = np.concatenate((np.repeat(rng.standard_normal((1, 64)), 90, axis=0), rng.standard_normal((200, 64)))) * scale
    ids = np.arange(len(x)) * 10
    how = ann.Probing()
    longest = float((x * x).sum(1).max())
    lists = ann.Lists(ann._rotation(64, how.seed), np.zeros((2, 65)), 2, longest)
    of = ids[[0, 40, 89]]
    want = {k: [int(i) for i in ids[:90] if i != of[k]][: how.k] for k in range(3)}
    for _ in range(5):
        order = rng.permutation(len(x))
        # Copies are in both lists, so each is cut and both are merged.
        at, score, vec = ann.search_lists(ids[order], x[order], order % 2, of, x[[0, 40, 89]], [np.array([0, 1])] * 3, lists, how)
        assert {k: vec[at == k].tolist() for k in range(3)} == want
        assert all(len(set(score[at == k])) == 1 for k in range(3))
