"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as contract
from reviewlake.plans.registry import load_all

from .compare import compare

QUERIES = load_all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, name):
    same, message = compare(spark, sf_dir, QUERIES[name])
    assert same, message


def test_contract_is_complete(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries()) >= set(QUERIES)
    assert contract.entry(spark).limit(1).count() == 1


def test_inventory_is_covered():
    covered = {op for query in QUERIES.values() for op in query.operators}
    families = {"I": 10, "C": 5, "D": 7, "E": 17, "F": 6, "G": 10, "H": 8, "J": 6, "K": 8, "L": 7, "M": 7, "N": 1, "S": 9}
    missing = {f"OP-{letter}{i}" for letter, last in families.items() for i in range(1, last + 1)} - covered
    assert not missing
