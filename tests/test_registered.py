"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from rolecall import checks
from rolecall.checks.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Nothing matches at this size: no name of the lists occurs in a text.
MAY_BE_EMPTY = {"d8_substring_join", "d8_substring_join_grams", "j5_model_failures", "d16_rank_position_join", "c8_facet_filter_recent", "c8_facet_counts_recent"}

checks.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, SF_DIR).count() > 0
        return
    problem = compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY), problem


def test_every_operator_of_the_inventory_is_registered():
    kinds = {"a": 9, "b": 15, "c": 10, "d": 16, "e": 12, "f": 2, "g": 6, "h": 3, "i": 10, "j": 6, "l": 2, "p": 4, "t": 1}
    for letter, count in kinds.items():
        for number in range(1, count + 1):
            assert any(name.startswith(f"{letter}{number}_") for name in QUERIES), f"{letter}{number}"
