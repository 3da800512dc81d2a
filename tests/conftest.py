import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tarmaq.session import local_session

    session = local_session(2, 2, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture
def same(spark, sf, duck):
    """Compare a query with its oracle: column names, rows, values."""

    def check(query, sql):
        df = query(spark, sf)
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        got = sorted(repr([r[c] for c in order]) for r in df.collect())
        want = sorted(repr([r[names.index(c)] for c in order]) for r in cursor.fetchall())
        assert got == want

    return check
