"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.QUERIES, contract.ORACLES


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["pais", "Origem", "saldo_Máximo", "nome_Contagem", "segmento_Contagem_Única"]
    assert found.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    assert difference(spark, database, FOLDER, name, QUERIES[name], ORACLES[name]) is None
