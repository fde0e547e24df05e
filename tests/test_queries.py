from __future__ import annotations

import duckdb
import pytest

from vecspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    link = duckdb.connect()
    for table in TABLES:
        link.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return link


def comparable(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in row)) for row in rows)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_query_equals_its_twin(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert comparable(map(tuple, got.select(*columns).collect())) == comparable(duck.sql(f"SELECT {quoted} FROM want").fetchall())
