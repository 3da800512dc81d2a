"""One test per boundary convention, on few literal rows."""

import pytest
from pyspark.sql import functions as F

from tarmaq.functions import scalar
from tarmaq.operators import temporal
from tarmaq.plans import rules


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("bucket", [7, 100, 10_000])
def test_trailing_and_centred(spark, bucket):
    df = frame(spark, [(1, "a", 0), (2, "a", 60), (3, "a", 120), (4, "a", 120), (5, None, 60), (6, "a", None)], "id int, k string, t long")
    out = temporal.window_aggregates(df, "k", "t", {"trail": (-59, 0, F.count("*")), "around": (-60, 59, F.count("*")), "closed": (-60, 60, F.count("*"))}, bucket)
    got = {r["id"]: (r["trail"], r["around"], r["closed"]) for r in out.collect()}
    assert got == {1: (1, 1, 2), 2: (1, 2, 4), 3: (2, 3, 3), 4: (2, 3, 3), 5: (1, 1, 1), 6: (None, None, None)}


@pytest.mark.parametrize("bucket", [5, 1000])
def test_asof(spark, bucket):
    left = frame(spark, [(1, "a", 10), (2, "a", 25), (3, "b", 10), (4, None, 10), (5, "a", None), (6, "a", 3)], "id int, k string, t long")
    right = frame(spark, [("a", 10, "x"), ("a", 20, "y"), (None, 10, "z")], "k string, u long, v string")

    def ids(**how):
        return {r["id"]: r["v"] for r in temporal.asof(left, right, "k", "t", "u", {"v": F.col("v")}, bucket, **how).collect()}

    assert ids() == {1: "x", 2: "y", 3: None, 4: None, 5: None, 6: None}
    assert ids(strict=True) == {1: None, 2: "y", 3: None, 4: None, 5: None, 6: None}
    assert ids(forward=True) == {1: "x", 2: None, 3: None, 4: None, 5: None, 6: "x"}
    assert ids(forward=True, strict=True) == {1: "y", 2: None, 3: None, 4: None, 5: None, 6: "x"}
    assert ids(tolerance=4) == {1: "x", 2: None, 3: None, 4: None, 5: None, 6: None}
    assert ids(tolerance=5)[2] == "y"


@pytest.mark.parametrize("bucket", [3, 1000])
def test_counts_before_may_be_negative(spark, bucket):
    df = frame(spark, [(1, "a", 10, 30), (2, "a", 20, 15), (3, "a", 15, None)], "id int, k string, t long, aobt long")
    out = temporal.counts_before(df, "id", "k", {"t": (F.col("t"), False), "a": (F.col("aobt"), False), "ua": (F.col("aobt"), True)}, {"n": (df, "k", "t")}, bucket)
    got = {r["id"]: (r["n_t"], r["n_a"], r["n_ua"]) for r in out.collect()}
    assert got == {1: (0, 3, 3), 2: (2, 1, 2), 3: (1, None, None)}
    assert got[1][0] - got[1][1] == -3


def test_sessions_share_the_first_place(spark):
    df = frame(spark, [(1, "r", 0), (2, "r", 150), (3, "r", 150), (4, "r", 301), (5, "r", 400)], "id int, k string, t long")
    got = {r["id"]: (r["rank"], r["elapsed"]) for r in temporal.gap_sessions(df, "k", "t", 150).collect()}
    assert got == {1: (0, 0), 2: (1, 150), 3: (1, 150), 4: (0, 0), 5: (1, 99)}


def test_leave_one_out(spark):
    df = frame(spark, [(1, "a", 0, 10.0), (2, "a", 60, 30.0), (3, "a", 61, None), (4, "a", 500, 7.0)], "id int, k string, t long, e double")
    got = {r["id"]: r["m"] for r in temporal.leave_one_out(df, "k", "t", "e", 60, "m", 100).collect()}
    assert got == {1: 30.0, 2: 10.0, 3: 30.0, 4: None}


def test_bands(spark):
    df = frame(spark, [(0.4,), (0.5,), (1.0,), (2.5,), (14.0,), (None,)], "x double")
    got = [tuple(r) for r in df.select(scalar.digitize(F.col("x"), rules.SHRINK_BANDS_H), scalar.band_above(F.col("x"), rules.LATE_BANDS_H)).collect()]
    assert got == [(0, None), (1, None), (2, None), (3, 2.0), (5, 8.0), (0, None)]


def test_nulls_stay_nulls(spark):
    df = frame(spark, [(None, "ab", None), (9.5, "abc", "M"), (-1.0, None, "x")], "x double, s string, n string")
    out = df.select(scalar.clip(F.col("x"), 0, 5), scalar.stand_group(F.col("s")), scalar.composite_key(F.col("x"), F.col("s")), scalar.lenient_number(F.col("n"))).collect()
    assert [tuple(r) for r in out] == [(None, "a", None, None), (5.0, "ab", "9.5|abc", None), (0.0, None, None, None)]
    assert [r[0] for r in frame(spark, [(0.5,), (1.5,), (2.5,), (None,)], "x double").select(scalar.round_half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, None]


def test_floor_may_exceed_the_cap(spark):
    df = frame(spark, [("x", False, 9000.0, 5000.0, 0, 0), ("L", False, 9000.0, 5000.0, 0, 0), ("x", True, 9000.0, 5000.0, 9000, None)], "apt string, matched boolean, pred double, level double, t long, lobt long")
    assert [r["pred"] for r in rules.final_rules(df, "L").collect()] == [4750.0, 9000.0, 9000.0]
    assert [r["pred"] for r in rules.final_rules(df, "L", ("congestion_floor",)).collect()] == [3600.0, 9000.0, 9000.0]
