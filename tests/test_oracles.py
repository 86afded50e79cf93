"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pytest

from compare import connect, differences
from geomatch.plans.oracles import ORACLES
from geomatch.plans.queries import QUERIES
from geomatch.sources import catalog

SF_DIR = "/root/testdata/sf0.001"
KINDS = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    wanted = {r[0]: KINDS.get(r[1], r[1]) for r in con.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert dict(df.dtypes) == wanted
    assert not differences(df, con, ORACLES[name])


def test_listing(spark):
    rows = catalog.file_catalog(spark, SF_DIR, {"A": SF_DIR}, pattern="*.parquet").collect()
    assert {r.file_name for r in rows} == {p.name for p in Path(SF_DIR).glob("*.parquet")}
    assert all(r.size == (Path(SF_DIR) / r.file_name).stat().st_size for r in rows)
    assert all(len(r.version_key) == 32 for r in rows)
