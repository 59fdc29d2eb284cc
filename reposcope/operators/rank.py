"""Per-repository file ranking.

The source trains a pairwise gradient-boosted ranker with one group per
repository. Emitting all file pairs of a repository is quadratic, so the
pairwise objective is rewritten: for squared pairwise loss,

    sum_{i<j in repo} ((x_i - x_j) . w - (y_i - y_j))^2
        = n_repo * sum_i ((x_i - mean_x) . w - (y_i - mean_y))^2,

i.e. a pairwise least-squares ranker equals ordinary least squares on
features and targets centred per repository. Centring is one windowed
aggregate keyed by repo_id (linear, no pairs); the fit is Spark ML
``LinearRegression`` (distributed normal equations / L-BFGS).
Missing feature groups are imputed with 0 plus a missing-indicator column.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reposcope.session import merged


def _design(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    cols = []
    out = df
    for c in features:
        out = out.withColumn(f"_f_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        cols.append(f"_f_{c}")
    # one indicator for the optional import group
    if "rank" in features:
        out = out.withColumn("_f_no_import", F.col("rank").isNull().cast("double"))
        cols.append("_f_no_import")
    return out, cols


def fit_pairwise_ranker(df: DataFrame, features: list[str], target: str,
                        group: str = "repo_id", reg: float = 1e-3) -> LinearRegressionModel:
    """M5: pairwise least-squares ranker (see module doc)."""
    d, cols = _design(df, features)
    w = Window.partitionBy(group)
    # the sum over all pairs of a repository is n_repo times the sum over its centred rows
    centred = d.select(*[(F.col(c) - F.avg(c).over(w)).alias(c) for c in cols],
                       (F.col(target) - F.avg(target).over(w)).alias("_y"),
                       F.count(F.lit(1)).over(w).cast("double").alias("_n"))
    vec = VectorAssembler(inputCols=cols, outputCol="_x").transform(centred)
    lr = LinearRegression(featuresCol="_x", labelCol="_y", weightCol="_n", fitIntercept=False,
                          regParam=reg, elasticNetParam=0.0, standardization=True, maxIter=100)
    model = lr.fit(vec)
    model._reposcope_cols = cols  # type: ignore[attr-defined]
    return model


def coefficients(model: LinearRegressionModel, spark: SparkSession) -> DataFrame:
    cols = getattr(model, "_reposcope_cols")
    return spark.createDataFrame([(c[3:], float(v)) for c, v in zip(cols, model.coefficients.toArray())],
                                 "feature string, weight double")


def score(model: LinearRegressionModel, df: DataFrame, features: list[str]) -> DataFrame:
    d, cols = _design(df, features)
    vec = VectorAssembler(inputCols=cols, outputCol="_x").transform(d)
    return model.setFeaturesCol("_x").setPredictionCol("score").transform(vec).drop("_x", *cols)


def best_per_repo(scored: DataFrame, score_col: str = "score", group: str = "repo_id",
                  tiebreak: str = "ord") -> DataFrame:
    """Argmax per repository, first in traversal order on ties."""
    w = Window.partitionBy(group).orderBy(F.col(score_col).desc(), F.col(tiebreak))
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rank_summary(scored: DataFrame) -> DataFrame:
    """M6: best path per repository and its score; the full path -> score
    map stays in the scored table (one row per file)."""
    best = best_per_repo(scored)
    n = scored.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    return best.select("repo_id", F.col("path_str").alias("best_path"), "score").join(merged(n), "repo_id")


def save_model(model: LinearRegressionModel, path: str) -> None:
    """Persist the ranker (Spark ML writer) with its feature order."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    cols = getattr(model, "_reposcope_cols")
    spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "i int, col string") \
        .write.mode("overwrite").parquet(path.rstrip("/") + "_columns")


def load_model(path: str) -> LinearRegressionModel:
    """Load a ranker saved by ``save_model``."""
    model = LinearRegressionModel.load(path)
    spark = SparkSession.getActiveSession()
    cols = [r.col for r in spark.read.parquet(path.rstrip("/") + "_columns").orderBy("i").collect()]
    model._reposcope_cols = cols  # type: ignore[attr-defined]
    return model
