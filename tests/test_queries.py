"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from quern.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return value


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, smallest, name):
    found = q.queries()[name](spark, smallest)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    if name not in q.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{smallest}/{t}.parquet'")
    cursor = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(float(r[i])) if type(r[i]).__name__ == "Decimal" else plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)
    assert len(rows) == len(want)
    assert all(a == pytest.approx(b) if isinstance(a, float) else a == b for x, y in zip(rows, want) for a, b in zip(x, y))
