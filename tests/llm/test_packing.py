"""Choices of the packer among many bins of one room, and of texts with more copies than bins."""

from collections import Counter

import numpy as np

from strandloom.llm.packing import _bits, best_fit


def test_a_bin_without_the_source_is_found_wherever_it_stands():
    for odd in (0, 150, 299):
        sources = [int(k == odd) for k in range(300)] + [0]
        assert best_fit([60] * 300 + [30], [-1] * 301, sources, 100)[-1] == odd


def test_only_surplus_copies_share_bins():
    sizes = np.array([10] * 11 + [89] * 10)
    clusters = np.array([5] * 11 + list(range(100, 110)))
    lots = _bits(clusters, sizes, 100)
    assert Counter(Counter(lots[:11]).values()) == {10: 1, 1: 1} and set(lots[11:]) == {-1}
    place = best_fit(sizes.tolist(), lots, [0] * 21, 110)
    assert sorted(Counter(place[:11]).values()) == [1] * 9 + [2]
