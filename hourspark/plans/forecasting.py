"""Encoding, distributed regressors, prediction tables and candidate evaluation."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions.numbers import finite
from hourspark.functions.text import typed_token
from hourspark.operators.metrics import score, winner
from hourspark.operators.ordered import ranked
from hourspark.operators.quality import enforce_features
from hourspark.session import cut

CANDIDATES = ["base", "lag_enhanced"]


def vocabulary(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, token, code): each column's distinct typed tokens in text order, coded 0.. ; one pass over the rows."""
    held = [F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), typed_token(train, c)).alias("token")) for c in columns]
    tokens = train.select(F.explode(F.array(*held)).alias("t")).select("t.*").filter("token IS NOT NULL").distinct()
    return ranked(tokens, ["column"], ["token"], "code")


def encode(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>__code`` (null if missing or unknown) and ``<column>__unseen`` from the training vocabulary."""
    out, known = df, cut(vocabulary(train, columns))
    for c in columns:
        words = known.filter(F.col("column") == c).select(F.col("token").alias("_token"), F.col("code").alias(f"{c}__code"))
        out = out.withColumn("_token", typed_token(df, c)).join(words, "_token", "left").drop("_token").withColumn(
            f"{c}__unseen", F.col(c).isNotNull() & F.col(f"{c}__code").isNull()
        )
    return out


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    """Model input only: each feature as a number plus its missing flag; the table keeps its nulls."""
    numbers = {f"_x_{c}": F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in features}
    flags = {f"_m_{c}": finite(F.col(c)).isNull().cast("double") for c in features}
    wide = df.withColumns({**numbers, **flags})
    return VectorAssembler(inputCols=[*numbers, *flags], outputCol="_features").transform(wide).drop(*numbers, *flags)


def fit_poisson(train: DataFrame, features: list[str], target: str, max_iter: int = 25, ridge: float = 1e-3) -> Model:
    """Poisson regression with log link over the training rows."""
    enforce_features(train, features)
    glm = GeneralizedLinearRegression(
        family="poisson", link="log", featuresCol="_features", labelCol="_y", predictionCol="_prediction",
        maxIter=max_iter, regParam=ridge,
    )
    return glm.fit(_vector(train.withColumn("_y", F.col(target).cast("double")), features))


def fit_trees(train: DataFrame, validation: DataFrame, features: list[str], target: str, rounds: int = 20, depth: int = 5) -> Model:
    """Boosted trees on log1p of the target, stopped early on the validation rows."""
    enforce_features(train, features)
    both = train.withColumn("_valid", F.lit(False)).unionByName(validation.withColumn("_valid", F.lit(True)))
    gbt = GBTRegressor(
        featuresCol="_features", labelCol="_y", predictionCol="_prediction", validationIndicatorCol="_valid",
        maxIter=rounds, maxDepth=depth, seed=42,
    )
    return gbt.fit(_vector(both.withColumn("_y", F.log1p(F.col(target).cast("double"))), features))


def predict(model: Model, df: DataFrame, features: list[str], name: str = "prediction") -> DataFrame:
    """Adds the non-negative prediction of either model."""
    raw = F.col("_prediction")
    back = raw if model.__class__.__name__.startswith("GeneralizedLinear") else F.expm1(raw)
    done = model.transform(_vector(df, features))
    return done.withColumn(name, F.greatest(back, F.lit(0.0))).drop("_features", "_prediction")


def ranking(model: Model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) by falling importance, ties by name."""
    gains = [float(x) for x in model.featureImportances.toArray()]
    n = len(features)
    summed = [(c, gains[i] + gains[n + i]) for i, c in enumerate(features)]
    return sorted(summed, key=lambda t: (-t[1], t[0]))


def evaluate(predictions: DataFrame, key: list[str], candidates: list[str] = CANDIDATES, by: list[str] = ()) -> DataFrame:
    """Scores of every candidate on the keys that all candidates have, per ``by`` and split.

    ``predictions`` has candidate, split, actual and prediction.
    """
    per_key = predictions.groupBy(*key, "split").agg(F.count_distinct("candidate").alias("_c"))
    shared = per_key.filter(F.col("_c") == len(candidates)).drop("_c")
    return score(predictions.join(shared, [*key, "split"], "left_semi"), "actual", "prediction", [*by, "split", "candidate"])


def select(scores: DataFrame, group: list[str], candidates: list[str] = CANDIDATES) -> DataFrame:
    return winner(scores, group, candidates)
