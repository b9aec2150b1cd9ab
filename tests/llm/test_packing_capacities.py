import numpy as np
import pytest

from graphloom.llm import packing


@pytest.mark.parametrize("limit,room", [({"tokens": 40}, 4), ({"documents": 3}, 3), ({"attention": 500}, 5)])
def test_each_capacity_alone_closes_a_bin(limit, room):
    wide = {"tokens": 10_000, "documents": 10_000, "attention": 10_000**2}
    bins, _ = packing.best_fit(np.full(30, 10), packing.Capacity(**wide | limit))
    assert np.bincount(bins).max() == room and len(set(bins.tolist())) == 30 // room + (30 % room > 0)


def test_production_values_leave_tokens_alone():
    c = packing.Capacity()
    assert c.documents >= c.tokens and c.attention >= c.tokens**2  # pieces have one token at least
