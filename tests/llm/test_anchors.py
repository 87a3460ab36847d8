"""Every shared run of forty pieces has an anchor in common, whatever it is made of."""

from __future__ import annotations

import numpy as np
import pytest

from spanloom.llm import repeats


@pytest.mark.parametrize("times", [1, 2, 3, 5, 7, 9, 40])
def test_runs_of_forty_pieces_have_a_common_anchor(times):
    """Each piece stands so many times in a row, in the shared run and around it."""
    draw, missed = np.random.default_rng(times), 0
    for _ in range(300):
        some = lambda n: np.repeat(draw.integers(0, 1 << 63, n // times + 2).astype(np.uint64), times)  # noqa: E731, B023
        cut = draw.integers(0, times)
        span = some(40)[cut : cut + 40]
        texts, begins = [], []
        for _ in range(2):
            ahead, after = some(60)[: draw.integers(0, 60)], some(60)
            if draw.random() < 0.5:  # the run at an end of the span goes on outside
                ahead, after = np.r_[ahead, np.repeat(span[:1], draw.integers(1, 9))], np.r_[np.repeat(span[-1:], draw.integers(1, 9)), after]
            begins.append(len(ahead))
            texts.append(np.r_[ahead, span, after])
        bounds = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
        of, key, lo, hi = repeats.anchors(np.concatenate(texts), bounds)
        held = [set(key[(of == i) & (lo <= begins[i]) & (hi >= begins[i])].tolist()) for i in (0, 1)]
        missed += not held[0] & held[1]
    assert missed == 0
