"""Model (L1-L3, L3b, K4, L11): MLlib gradient-boosted trees.

* training rows carry a class weight (M10) in ``weightCol``;
* MLlib trees reject NaN, so NULL pass-through features get a sentinel
  outside every valid range before assembly (the ``_missing`` indicators
  still carry the missingness);
* tuning samples the parameter grid with a seeded generator on the driver
  (the grid is a handful of literals) and runs ``CrossValidator`` with the
  stratified ``foldCol`` of ``features.stratified_folds``.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTINEL = -1.0e6
#: Rows of one partition of a training table; MLlib keeps them as objects and a task reads its whole partition.
PARTITION_ROWS = 250_000


def dealt(train: DataFrame, partition_rows: int | None = None) -> DataFrame:
    """``train`` in partitions of about ``partition_rows`` rows.  A well compressed
    table has few, large file parts, so that what one task holds would grow with
    the table.  A table of at most that many rows stays as it lies."""
    partition_rows = partition_rows or PARTITION_ROWS
    rows = train.count()
    if rows <= partition_rows:
        return train
    cores = train.sparkSession.sparkContext.defaultParallelism
    return train.repartition(max(cores, math.ceil(rows / partition_rows)))


def fill_sentinel(df: DataFrame, feature_names, sentinel: float = SENTINEL) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel)) for c in feature_names})


def gbt(label: str = "flag", weight: str | None = "weight", max_iter: int = 20,
        max_depth: int = 4, step_size: float = 0.1, subsampling_rate: float = 0.8,
        feature_subset: str = "0.8", min_instances: int = 5, seed: int = 42) -> GBTClassifier:
    """L1 estimator (depth, learning rate, row / column subsampling, minimum
    node size, class weight, seed).  Boosting state is checkpointed every 10
    iterations into the session's checkpoint folder, so a lost executor
    never replays the whole boosting lineage."""
    est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter,
                        maxDepth=max_depth, stepSize=step_size, subsamplingRate=subsampling_rate,
                        featureSubsetStrategy=feature_subset, minInstancesPerNode=min_instances,
                        seed=seed, maxBins=64, checkpointInterval=10)
    if weight:
        est = est.setWeightCol(weight)
    return est


def train_gbt(train: DataFrame, feature_names, label: str = "flag",
              weight: str | None = "weight", **params) -> PipelineModel:
    """L1: assemble (NULL -> sentinel) + GBT; returns a PipelineModel."""
    from riskframe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(train.sparkSession)     # the cluster's folder; set only when unset
    va = VectorAssembler(inputCols=list(feature_names), outputCol="features", handleInvalid="keep")
    pipe = Pipeline(stages=[va, gbt(label, weight, **params)])
    src = fill_sentinel(dealt(train), feature_names).withColumn(label, F.col(label).cast("double"))
    return pipe.fit(src)


def score(df: DataFrame, model: PipelineModel, feature_names, keep=(),
          column: str = "probability") -> DataFrame:
    """L3: probability of class 1 (plus the raw margin) for every row."""
    out = model.transform(fill_sentinel(df, feature_names))
    return out.select(*keep,
                      vector_to_array(F.col("probability"))[1].alias(column),
                      vector_to_array(F.col("rawPrediction"))[1].alias("margin"))


def check_width(df: DataFrame, feature_names) -> None:
    """L3b feature-count check: every model input column must exist."""
    missing = [c for c in feature_names if c not in df.columns]
    if missing:
        raise ValueError(f"feature mismatch: {len(missing)} of {len(feature_names)} missing: "
                         f"{missing[:5]}")


#: The values the search of the original tool draws from, and how many settings it draws.
GRID = {
    "maxIter": [100, 200, 300, 500],
    "maxDepth": [3, 4, 5, 6, 8],
    "stepSize": [0.01, 0.05, 0.1, 0.2],
    "minInstancesPerNode": [1, 3, 5, 10],
    "subsamplingRate": [0.6, 0.7, 0.8, 0.9],
    "featureSubsetStrategy": ["0.6", "0.7", "0.8", "0.9"],
}
CANDIDATES = 30


def sample_grid(est: GBTClassifier, n_iter: int, seed: int = 42, grid=None) -> list[dict]:
    """Seeded random sample of ``n_iter`` parameter maps from the grid."""
    grid = grid or GRID
    names = sorted(grid)
    combos = list(itertools.product(*[grid[k] for k in names]))
    rnd = random.Random(seed)
    picked = rnd.sample(combos, min(n_iter, len(combos)))
    return [{est.getParam(k): v for k, v in zip(names, combo)} for combo in picked]


def tune(train: DataFrame, feature_names, label: str = "flag", fold_col: str = "fold",
         weight: str | None = "weight", n_iter: int = CANDIDATES, seed: int = 42, parallelism: int = 2,
         grid=None):
    """L2: randomized search scored by AUROC over stratified folds.
    Returns (CrossValidatorModel, results DataFrame of params + mean AUROC)."""
    est = gbt(label, weight, seed=seed)
    maps = sample_grid(est, n_iter, seed, grid)
    va = VectorAssembler(inputCols=list(feature_names), outputCol="features", handleInvalid="keep")
    src = va.transform(fill_sentinel(train, feature_names)).withColumn(label, F.col(label).cast("double"))
    # every candidate x fold fit re-reads this input: write it once
    from riskframe.session import materialize
    src = dealt(materialize(src.select("features", label, fold_col, *([weight] if weight else [])), "cv-input"))
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC")
    k = src.agg(F.max(fold_col)).first()[0] + 1  # number of folds (one small aggregate)
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col, numFolds=int(k),
                        parallelism=parallelism, seed=seed)
    m = cv.fit(src)
    spark = train.sparkSession
    rows = []
    for i, (pm, a) in enumerate(zip(maps, m.avgMetrics)):
        e = est.copy(pm)
        rows.append((i, e.getMaxIter(), e.getMaxDepth(), e.getStepSize(), e.getMinInstancesPerNode(),
                     e.getSubsamplingRate(), e.getFeatureSubsetStrategy(), float(a)))
    res = spark.createDataFrame(
        rows, "candidate int, maxIter int, maxDepth int, stepSize double, minInstancesPerNode int, "
        "subsamplingRate double, featureSubsetStrategy string, cv_auroc double")
    return m, res


def save_model(model: PipelineModel, path: str) -> None:
    """K4."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importance(model: PipelineModel, feature_names, spark) -> DataFrame:
    """Normalised importances, ranked (one value per feature)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(feature_names, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    from pyspark.sql import Window
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))  # <= #features rows
    return df.withColumn("rank", F.row_number().over(w))
