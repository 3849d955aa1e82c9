"""Short lists are aligned cell by cell, with the same sums and choices as long ones."""

import random

from loomspan.operators import alignment


def test_short_lists_equal_long_ones(monkeypatch):
    draw = random.Random(7)
    lists = [[" ".join(draw.choices(["a", "b", "c", "ß", "..."], k=draw.randint(0, 4))) for _ in range(draw.randint(0, 6))] for _ in range(400)]
    short = [alignment._align_short(a, b) for a, b in zip(lists, lists[1:], strict=False)]
    monkeypatch.setattr(alignment, "_SHORT", -1)
    assert short == [alignment.align(a, b) for a, b in zip(lists, lists[1:], strict=False)]
