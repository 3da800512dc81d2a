"""Frames that hold many rows: what a row costs must not grow with them."""

import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from tarmaq import queries
from tarmaq.operators import temporal
from tarmaq.plans import evaluate

SLIDING = re.compile(r"RangeFrame, (?!unboundedpreceding)|collect_list")


def plan(spark, df):
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def rows(n=300, seed=5):
    """id, k, t, v: ties, null keys, values and times, negative times, and more rows in a frame than a bucket is wide."""
    r = random.Random(seed)
    return [(i, r.choice(["a", "a", "b", None]), None if i % 41 == 0 else r.randrange(-60, 60), None if r.random() < 0.2 else r.randrange(-9, 9)) for i in range(n)]


def near(data, k, t, low, high):
    return [v for _, o, u, v in data if o == k and u is not None and t + low <= u <= t + high]


def test_f1_window_counts_plan(spark, sf):
    assert not SLIDING.search(plan(spark, queries.queries()["q18_window_counts"](spark, sf)))


@pytest.mark.parametrize("bucket", [7, 1000])
def test_f1_window_sums(spark, bucket):
    data, frames = rows(), {"around": (-5, 5, "v"), "before": (-9, -1, "v"), "after": (1, 12, "v"), "far": (3, 4, "v")}
    got = {r["id"]: tuple(r[n] for n in frames) for r in temporal.window_sums(spark.createDataFrame(data, "id int, k string, t long, v int"), "k", "t", frames, bucket).collect()}
    assert got == {i: tuple(None if t is None else sum(v for v in near(data, k, t, lo, hi) if v is not None) for lo, hi, _ in frames.values()) for i, k, t, _ in data}


def test_f1_rounded_sums_are_refused(spark):
    with pytest.raises(TypeError):
        temporal.window_sums(spark.createDataFrame([("a", 0, 0.1)], "k string, t long, v double"), "k", "t", {"s": (-1, 1, "v")}, 10)


def test_f2_live_excess_plan(spark, sf):
    assert not SLIDING.search(plan(spark, queries.queries()["q26_live_excess"](spark, sf)))


@pytest.mark.parametrize("kind", ["int", "decimal(9,2)", "double"])
def test_f2_leave_one_out(spark, kind):
    data = rows()
    df = spark.createDataFrame(data, "id int, k string, t long, v int").withColumn("v", F.col("v").cast(kind))
    got = {r["id"]: r["m"] for r in temporal.leave_one_out(df, "k", "t", "v", 6, "m", 20).collect()}
    for i, k, t, v in data:
        own = [] if t is None else [x for x in near(data, k, t, -6, 6) if x is not None]
        n = len(own) - (v is not None)
        assert got[i] is None if t is None or n < 1 else float(got[i]) == pytest.approx((sum(own) - (v or 0)) / n, abs=1e-6)


def test_f3_neighbour_level_plan(spark, sf):
    assert not SLIDING.search(plan(spark, queries.queries()["q29_neighbour_level"](spark, sf)))


@pytest.mark.parametrize("bucket", [7, 1000])
@pytest.mark.parametrize("least", [0, 3, 20])
def test_f3_frame_median(spark, bucket, least):
    data = rows()
    got = {r["id"]: r["m"] for r in temporal.frame_median(spark.createDataFrame(data, "id int, k string, t long, v int"), "k", "t", "v", 6, least, "m", bucket).collect()}
    own = {i: [] if t is None else [x for x in near(data, k, t, -6, 6) if x is not None] for i, k, t, _ in data}
    assert got == {i: float(median(x)) if len(x) >= max(least, 1) else None for i, x in own.items()}


def test_f3_frame_median_of_nothing(spark):
    none = spark.createDataFrame([(1, "a", 0, None), (2, "a", None, 5.0)], "id int, k string, t long, v double")
    assert [r["m"] for r in temporal.frame_median(none, "k", "t", "v", 6, 1, "m", 7).orderBy("id").collect()] == [None, None]
    assert temporal.frame_median(none.where("id = 0"), "k", "t", "v", 6, 1, "m", 7).count() == 0


@pytest.mark.parametrize("name", ["q29b_congestion_floor", "q31b_rule_ablation"])
def test_f4_f5_plans(name, spark, sf):
    assert not SLIDING.search(plan(spark, queries.queries()[name](spark, sf)))


def test_f5_rules_share_a_join(spark, sf):
    """One join by id and the medians of its two sides, not three joins with medians for each."""
    text = plan(spark, queries.queries()["q31b_rule_ablation"](spark, sf))
    assert text.count("FlatMapGroupsInArrow") == 2 and len(re.findall(r"Join Inner", text)) == 1


def test_f5_ablation(spark):
    """Against pairs of rows of one id; ids that are repeated or null, rows without prediction."""
    data = [(1, 5.0, 9.0), (1, 2.0, 1.0), (2, -3.0, 0.5), (3, None, 1.0), (None, 7.0, 2.0), (4, 1.0, None)]
    steps = {"double": lambda x: x * 2, "add": lambda x: x + 3}

    def rules(df, leave_out=()):
        for name, step in steps.items():
            if name not in leave_out:
                df = df.withColumn("pred", step(F.col("pred")))
        return df

    def alone(x, leave_out=()):
        for name, step in steps.items():
            x = x if x is None or name in leave_out else step(x)
        return x

    def rmse(errors):
        known = [e for e in errors if e is not None]
        return (sum(e * e for e in known) / len(known)) ** 0.5

    got = {r["rule"]: (r["rmse"], r["delta"], r["changed"]) for r in evaluate.ablation(spark.createDataFrame(data, "id int, pred double, truth double"), rules, list(steps), "id", "truth").collect()}
    assert set(got) == set(steps)
    for name, (error, delta, changed) in got.items():
        pairs = [(alone(p, (name,)), alone(q), t) for i, p, t in data for j, q, _ in data if i is not None and i == j]
        less, full = (rmse([None if x[k] is None or x[2] is None else x[k] - x[2] for x in pairs]) for k in (0, 1))
        assert (error, delta) == pytest.approx((less, less - full)) and changed == sum(a != b for a, b, _ in pairs)
