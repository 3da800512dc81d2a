"""Learned operators: a mixture of "recorded at the schedule" and "normal taxi", and a residual corrector.

Boosted trees of pyspark.ml train distributed on vectors. Missing numbers are filled and flagged; categories are
indexed once at fit, unseen ones to an index of their own, rare ones together so that bins stay bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories kept apart per column; the rest share one. A bound of trees' bins.
MOST_CATEGORIES = 60
MISSING = -999999.0


@dataclass
class Encoder:
    """Feature vectors from numeric and categorical columns."""

    numeric: list[str]
    categorical: list[str]
    common: dict[str, list[str]] = field(default_factory=dict)
    stages: PipelineModel | None = None

    def _prepared(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.numeric:
            out = out.withColumn(f"_x_{c}", F.coalesce(F.col(c).cast("double"), F.lit(MISSING))).withColumn(f"_na_{c}", F.col(c).isNull().cast("double"))
        for c in self.categorical:
            text = F.coalesce(F.col(c).cast("string"), F.lit("NA"))
            out = out.withColumn(f"_c_{c}", F.when(text.isin(self.common[c]), text).otherwise("other"))
        return out

    def fit(self, df: DataFrame) -> Encoder:
        for c in self.categorical:
            rows = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias("v")).count().orderBy(F.col("count").desc(), "v").limit(MOST_CATEGORIES).collect()
            self.common[c] = [r["v"] for r in rows]
        indexers = [StringIndexer(inputCol=f"_c_{c}", outputCol=f"_i_{c}", handleInvalid="keep") for c in self.categorical]
        inputs = [f"_x_{c}" for c in self.numeric] + [f"_na_{c}" for c in self.numeric] + [f"_i_{c}" for c in self.categorical]
        self.stages = Pipeline(stages=[*indexers, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(self._prepared(df))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        made = self.stages.transform(self._prepared(df))
        return made.select(*df.columns, "features")


@dataclass
class Mixture:
    """p: the probability that the record stands at the schedule; r: the normal taxi time, anchored."""

    encoder: Encoder
    classifiers: list
    regressors: list
    per_group: dict
    group: str | None

    def components(self, df: DataFrame, anchor: Column) -> DataFrame:
        """df with p and r. Regressors are averaged, then a group's own one with that; groups unseen at fit keep the shared one."""
        out = self.encoder.transform(df.withColumn("_anchor", anchor.cast("double")))
        ps, rs = [], []
        for k, m in enumerate(self.classifiers):
            out = m.transform(out).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
            ps.append(F.col(f"_p{k}"))
        for k, m in enumerate(self.regressors):
            out = m.transform(out).withColumnRenamed("prediction", f"_r{k}")
            rs.append(F.col(f"_r{k}"))
        shared = sum(rs[1:], rs[0]) / len(rs)
        out = out.withColumn("_shared", shared)
        own: Column = F.lit(None).cast("double")
        for k, (value, m) in enumerate(sorted(self.per_group.items())):
            out = m.transform(out).withColumnRenamed("prediction", f"_g{k}")
            own = F.when(F.col(self.group) == F.lit(value), F.col(f"_g{k}")).otherwise(own)
        r = F.when(own.isNotNull(), (F.col("_shared") + own) / 2).otherwise(F.col("_shared")) + F.col("_anchor")
        return out.select(*df.columns, (sum(ps[1:], ps[0]) / len(ps)).alias("p"), r.alias("r"))


def fit_mixture(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], at_schedule: Column, target: str, anchor: Column, group: str | None = None, groups: Sequence = (), seeds: Sequence[int] = (0,), rounds: int = 20, depth: int = 5, twins: bool = True) -> Mixture:
    """Classifiers on all rows; regressors of target - anchor on rows that don't stand at the schedule.

    seeds: one regressor each, on subsamples. groups: values of the group column that get a regressor of their own. twins: a random
    forest beside the boosted trees, averaged with them.
    """
    labelled = df.withColumn("_at", F.coalesce(at_schedule, F.lit(False)).cast("double")).withColumn("_y", F.col(target).cast("double") - anchor.cast("double"))
    encoder = Encoder(list(numeric), list(categorical)).fit(labelled)
    x = encoder.transform(labelled).cache()
    bins = MOST_CATEGORIES + 4
    classifiers: list = [GBTClassifier(labelCol="_at", maxIter=rounds, maxDepth=depth, maxBins=bins, seed=7).fit(x)]
    if twins:
        classifiers.append(RandomForestClassifier(labelCol="_at", numTrees=rounds, maxDepth=depth, maxBins=bins, seed=7).fit(x))
    normal = x.where("_at = 0")

    def booster(rows: DataFrame, seed: int):
        return GBTRegressor(labelCol="_y", maxIter=rounds, maxDepth=depth, maxBins=bins, seed=seed, subsamplingRate=0.8).fit(rows)

    regressors: list = [booster(normal, s) for s in seeds]
    if twins:
        regressors.append(RandomForestRegressor(labelCol="_y", numTrees=rounds, maxDepth=depth, maxBins=bins, seed=7).fit(normal))
    per_group = {g: booster(normal.where(F.col(group) == F.lit(g)), 0) for g in groups} if group else {}
    x.unpersist()
    return Mixture(encoder, classifiers, regressors, per_group, group)


def fit_corrector(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, rounds: int = 20, depth: int = 4):
    """A regressor of what pred misses, on observed rows; returns rows -> rows with ``correction`` (0 where not observed)."""
    seen = rows.where("observed").withColumn("_y", F.col(target).cast("double") - F.col("pred"))
    encoder = Encoder(list(numeric), list(categorical)).fit(seen)
    model = GBTRegressor(labelCol="_y", maxIter=rounds, maxDepth=depth, maxBins=MOST_CATEGORIES + 4, seed=7).fit(encoder.transform(seen))

    def apply(df: DataFrame) -> DataFrame:
        out = model.transform(encoder.transform(df))
        return out.select(*df.columns, F.when(F.col("observed"), F.col("prediction")).otherwise(0.0).alias("correction"))

    return apply
