"""Choosing, training and describing models: every fit is one distributed job, loops run over settings and folds only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import pipeline, score


def grid_search(rows: DataFrame, features: list[str], model, grid: dict[str, list], folds: int = 3, group: str = "group", label: str = "label", best: int = 5) -> DataFrame:
    """(settings, auc, spread) of the best settings by group k-fold; grid has values by parameter name."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), values)
    maps = builder.build()
    marked = rows.withColumn("__fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))
    fitted = CrossValidator(estimator=pipeline(features, model), estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, foldCol="__fold").fit(marked)
    told = [(", ".join(f"{p.name}={v}" for p, v in m.items()), float(a), float(s)) for m, a, s in zip(maps, fitted.avgMetrics, fitted.stdMetrics, strict=True)]
    return rows.sparkSession.createDataFrame(told, "settings string, auc double, spread double").orderBy(F.desc("auc"), "settings").limit(best)


def learning_curve(train: DataFrame, test: DataFrame, features: list[str], model, shares: list[float], group: str = "group", label: str = "label") -> DataFrame:
    """(share, n_train, auc_train, auc_test) of models fitted on growing shares of the groups."""
    evaluator = BinaryClassificationEvaluator(labelCol=label)
    place = F.pmod(F.xxhash64(group), F.lit(1 << 20)) / F.lit(1 << 20)
    told = []
    for share in shares:
        part = train.filter(place < share)
        fitted = pipeline(features, model).fit(part)
        told.append((float(share), part.count(), float(evaluator.evaluate(fitted.transform(part))), float(evaluator.evaluate(fitted.transform(test)))))
    return train.sparkSession.createDataFrame(told, "share double, n_train long, auc_train double, auc_test double")


def fold_loop(rows: DataFrame, folds: DataFrame, features: list[str], model, path: str, key: str = "complex_id") -> PipelineModel:
    """Scores every fold's test rows by a model of its training rows under path; returns a model of all rows.

    A fold whose tested complexes are all there already is left out, so a stopped run goes on where
    it stood; of a half-done fold only the missing complexes are scored. folds: fold, part, complex_id.
    """
    spark = rows.sparkSession
    for fold in [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()]:
        ids = lambda part: folds.filter((F.col("fold") == fold) & (F.col("part") == part)).select(F.col("complex_id").alias(key))  # noqa: E731, B023
        target = f"{path}/fold={fold}"
        wanted = ids("test")
        if (done := _scored(spark, target)) is not None:
            wanted = wanted.join(done.select(key).distinct(), key, "left_anti")
        test = rows.join(wanted, key, "left_semi")
        if not test.take(1):
            continue
        fitted = pipeline(features, model).fit(rows.join(ids("train"), key, "left_semi"))
        score(fitted, test).write.mode("append").parquet(target)
    return pipeline(features, model).fit(rows)


def _scored(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
    return spark.read.parquet(path) if there else None


def protocol(kind_l: Column, kind_r: Column) -> Column:
    """``seq`` or ``struct`` where both partners are of that kind, else ``mixed``."""
    return F.when(kind_l == kind_r, kind_l).otherwise("mixed")


def model_kind(seq_l: Column, seq_r: Column) -> Column:
    return F.when(seq_l == seq_r, "homo").otherwise("hetero")


def logistic_fit(points: DataFrame, t: str, p: str) -> tuple[float, float]:
    """(slope, intercept) of p = 1 / (1 + exp(-(slope t + intercept))): each point is a hit of weight p and a miss of weight 1 - p."""
    both = points.select(F.col(t).alias("t"), F.inline(F.array(F.struct(F.lit(1.0).alias("label"), F.col(p).alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col(p)).alias("w")))))
    fitted = LogisticRegression(weightCol="w").fit(VectorAssembler(inputCols=["t"], outputCol="features").transform(both.filter("w > 0")))
    return float(fitted.coefficients[0]), float(fitted.intercept)


def power_fit(points: DataFrame, part: str, t: str, p: str) -> DataFrame:
    """(part, factor, exponent) of p = factor * t ** exponent, by least squares on the logarithms; points over 0 only have one."""
    logs = points.filter((F.col(t) > 0) & (F.col(p) > 0)).select(part, F.log(t).alias("lt"), F.log(p).alias("lp"))
    return logs.groupBy(part).agg(F.exp(F.regr_intercept("lp", "lt")).alias("factor"), F.regr_slope("lp", "lt").alias("exponent"))


def importances(fitted: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """(feature, importance) of a fitted tree pipeline, one row per feature."""
    values = fitted.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")
