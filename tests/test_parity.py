"""Every query with SQL gives the rows DuckDB gives, on the smallest tables."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from lodestrata import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


def spelt(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(float(r[k]) if isinstance(r[k], Decimal) else r[k] for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, tiny, name):
    df = plans.QUERIES[name](spark, tiny)
    got, names = df.collect(), df.columns
    found = duck.execute(plans.ORACLES[name])
    want, other = found.fetchall(), [d[0] for d in found.description]
    assert sorted(names) == sorted(other)
    assert spelt(got, names) == spelt(want, other)


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLES.keys()))
def test_rows_only(spark, tiny, name):
    assert plans.QUERIES[name](spark, tiny).count() > 0
