"""Streams give what batches give; models fit and hold their rules; features don't read what they must not."""

import pytest
from pyspark.sql import functions as F

from tarmaq.operators.queues import replay
from tarmaq.operators.temporal import gap_sessions
from tarmaq.plans import context, evaluate, model, rules
from tarmaq.plans.movements import departures, movements
from tarmaq.streaming import flows


def streamed(spark, df, path, flow, name):
    df.write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    q = flow(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture(scope="module")
def moves(spark, sf):
    return movements(spark, sf).withColumn("ts", F.timestamp_seconds("t"))


def test_sessions(spark, moves, tmp_path):
    d = moves.where("phase = 'DEP'").select("rwy", "ts", "t")
    got = streamed(spark, d.drop("t"), str(tmp_path / "s"), lambda s: flows.busy_sessions(s, gap="7200 seconds"), "busy")
    batch = gap_sessions(d, "rwy", "t", 7199).groupBy("rwy", "session_start").agg(F.count("*").alias("n"))
    want = {(r[0], r[1]): r[2] for r in batch.collect()}
    closed = {(r["rwy"], int(r["first"].timestamp())): r["departures"] for r in got.collect()}
    assert len(closed) >= len(want) - 30 and all(want[k] == n for k, n in closed.items())


def test_configuration(spark, moves, tmp_path):
    got = streamed(spark, moves.select("apt", "rwy", "ts"), str(tmp_path / "c"), lambda s: flows.hourly_configuration(s, period="1 day"), "configuration")
    batch = moves.groupBy(F.date_trunc("day", "ts").alias("start"), "apt").agg(F.count("*").alias("n"), F.count_distinct("rwy").alias("r"))
    want = {(r[0], r[1]): (r[2], r[3]) for r in batch.collect()}
    closed = {(r["start"], r["apt"]): (r["movements"], r["runways"]) for r in got.collect()}
    assert len(closed) > 0.8 * len(want) and all(want[k] == v for k, v in closed.items())


def test_queue(spark, moves, tmp_path):
    q = moves.select("rwy", "id", (F.col("phase") == "DEP").alias("departure"), "wake", F.col("t").cast("double").alias("ready"), "ts")
    got = streamed(spark, q, str(tmp_path / "q"), flows.runway_queue, "queue")
    want = {r["id"]: r["start"] for r in replay(q, ["rwy"]).collect()}
    closed = {r["id"]: r["start"] for r in got.collect()}
    assert len(closed) > 0.8 * len(want) and all(want[k] == v for k, v in closed.items())


def test_context_does_not_read_departures_block(moves):
    m = moves.select("id", "phase", "apt", "rwy", "stand", "t", "aobt", "block")
    blank = m.withColumn("block", F.when(F.col("phase") == "ARR", F.col("block")))
    a, b = ({r["id"]: r for r in context.build(x, 10 * 86400, 86400).collect()} for x in (m, blank))
    assert a == b and len(a) == m.where("phase = 'DEP'").count() and len(next(iter(a.values()))) == 39


def test_context_order_does_not_matter(moves):
    m = moves.select("id", "phase", "apt", "rwy", "stand", "t", "aobt", "block")
    a = {r["id"]: r for r in context.build(m, 86400 * 10).collect()}
    b = {r["id"]: r for r in context.build(m.orderBy(F.col("id").desc()), 86400 * 3).collect()}
    assert a == b


def test_mixture_and_corrector(spark, sf):
    d = departures(spark, sf).withColumn("gap", F.col("t") - F.col("sched")).withColumn("nm", F.col("t") - F.col("aobt")).withColumn("matched", F.col("aobt").isNotNull())
    at = F.abs(F.col("block") - F.col("sched")) <= 10
    anchor = rules.anchor(F.col("nm"), F.lit(None).cast("long"))
    fitted = model.fit_mixture(d, ["gap", "nm"], ["apt", "wake"], at, "target", anchor, group="apt", groups=[0, 1], seeds=(0, 1), rounds=3, depth=3)
    out = rules.predict(fitted.components(d, anchor)).cache()
    assert out.count() == d.count() and out.where("p < 0 OR p > 1 OR pred IS NULL OR isnan(pred)").isEmpty()
    plain = d.agg(F.stddev_pop("target")).first()[0]
    assert out.agg(evaluate.rmse(F.col("pred"), F.col("target"))).first()[0] < 0.9 * plain
    seen = out.withColumn("observed", F.col("id") % 3 != 0)
    fixed = model.fit_corrector(seen, ["pred", "gap"], ["apt"], "target", rounds=3)(seen)
    assert fixed.where("NOT observed AND correction <> 0").isEmpty()
    better = rules.corrected(fixed, F.col("correction"))
    assert better.where("observed").agg(evaluate.rmse(F.col("pred"), F.col("target"))).first()[0] <= out.where("id % 3 <> 0").agg(evaluate.rmse(F.col("pred"), F.col("target"))).first()[0]


def test_row_bootstrap(spark):
    df = spark.range(2000).select("id", (F.rand(3) - 0.5).alias("e"))
    draws = evaluate.row_bootstrap(df, "id", {"one": F.col("e"), "two": 2 * F.col("e")}, 40).collect()
    assert len(draws) == 40 and all(abs(r["two"] - 2 * r["one"]) < 1e-9 for r in draws)
    assert 0.27 < sum(r["one"] for r in draws) / 40 < 0.31 and len({r["one"] for r in draws}) == 40


def test_month_split(spark):
    df = spark.sql("SELECT timestamp'2025-01-05' AS ts UNION ALL SELECT timestamp'2025-02-05' UNION ALL SELECT null")
    assert [x.count() for x in evaluate.month_split(df, "ts")] == [1, 1]
