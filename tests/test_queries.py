"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from quillwave.plans.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert spark_rows(df) == sql_rows(SF, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_imports_and_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
