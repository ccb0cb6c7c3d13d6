"""Gains and keys of the suffix tree keep what the totals need."""

import numpy as np

from tablemine.llm import suffix_tree


def test_gains_of_hot_contexts_add_up():
    parts = [np.array([90_000.0, 1e6, -0.25]), np.array([-70_000.0, -1_000_003.5, 0.125])]
    total = sum(suffix_tree.unpack_gains(suffix_tree.pack_gains(p)) for p in parts)
    assert total.tolist() == [20_000.0, -3.5, -0.125]


def test_keys_are_48_bits_at_least():
    assert suffix_tree.LEAST_BITS >= 48
