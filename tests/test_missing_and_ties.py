"""Ids without a prediction, and movements of one second."""

from itertools import permutations

import duckdb

from tarmaq import queries


def against_sql(spark, name, folder, sql=None):
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    cursor = con.execute(sql or queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = queries.queries()[name](spark, str(folder)).select(*names).collect()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, cursor.fetchall()))


def test_f6_ids_without_prediction(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,), (4,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 401), (2, 99_999), (3, 3), (3, 477)], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = against_sql(spark, "q33_keyed_output", tmp_path)
    assert got == want and "(4, 0, True, False)" in got


def test_f7_ties_by_id(spark, tmp_path):
    """Any order of the rows in the file gives the result of the SQL with its open ties in order of the ids."""
    name = "q34b_lift_offs"
    sql = queries.oracle_sql()[name].replace("PARTITION BY rwy ORDER BY t)", "PARTITION BY rwy ORDER BY t, id)")
    assert sql != queries.oracle_sql()[name]
    ids = [(5, "view"), (2, "purchase"), (9, "click"), (7, "error")]
    for i, order in enumerate(permutations(ids)):
        folder = tmp_path / str(i)
        events = spark.createDataFrame([(k, kind, 1.0, '{"k": 4}') for k, kind in order], "event_id long, event_type string, value double, props string")
        events = events.selectExpr("event_id", "0L AS user_id", "event_type", "value", "props", "TIMESTAMP_NTZ '2024-01-01 00:00:07' AS ts")
        events.coalesce(1).write.parquet(f"{folder}/events.parquet")
        got, want = against_sql(spark, name, folder, sql)
        assert got == want == [repr((0, 1, 1704067207, 1704067207))]
