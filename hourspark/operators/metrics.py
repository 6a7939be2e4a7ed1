"""Forecast scores as decomposable aggregates, at any set of scopes in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.functions.numbers import finite

SMALLEST_MEAN = 1e-12


def score_columns(actual: Column, predicted: Column) -> list[Column]:
    """n, target mean, MAE, RMSE and Poisson deviance; non-finite pairs are left out."""
    y, p = finite(actual), finite(predicted)
    usable = y.isNotNull() & p.isNotNull()
    p = F.greatest(p, F.lit(0.0))
    mean = F.greatest(p, F.lit(SMALLEST_MEAN))
    log_term = F.when(y > 0, y * (F.log(F.when(y > 0, y)) - F.log(mean)) - (y - mean)).otherwise(mean)
    kept = lambda c: F.when(usable, c)
    return [
        F.count_if(usable).alias("n"),
        F.avg(kept(y)).alias("target_mean"),
        F.avg(kept(F.abs(y - p))).alias("mae"),
        F.sqrt(F.avg(kept((y - p) * (y - p)))).alias("rmse"),
        (F.lit(2.0) * F.avg(kept(log_term))).alias("poisson_deviance"),
    ]


def score(df: DataFrame, actual: str, predicted: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*score_columns(F.col(actual), F.col(predicted)))


def score_scopes(
    df: DataFrame,
    actual: str,
    predicted: str,
    by: list[str],
    scopes: dict[str, Column],
    flags: dict[str, Column] | None = None,
    levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Scores per ``by`` and (scope, level).

    ``scopes`` maps a scope name to its level text (null counts as ``<MISSING>``); ``flags`` maps a
    feature name to its missing flag and yields scope ``feature:<name>`` with levels present and
    missing.  ``levels`` names levels that must appear even when no row has them.  Rows are widened
    by one narrow struct per scope and meet in a single map-side combined aggregation.
    """
    texts = {n: F.coalesce(c.cast("string"), F.lit("<MISSING>")) for n, c in scopes.items()}
    texts |= {f"feature:{n}": F.when(c, "missing").otherwise("present") for n, c in (flags or {}).items()}
    cells = F.array(*[F.struct(F.lit(n).alias("scope"), t.alias("level")) for n, t in texts.items()])
    y, p = F.col(actual).cast("double").alias("_y"), F.col(predicted).cast("double").alias("_p")
    narrow = df.select(*by, y, p, F.explode(cells).alias("_c")).select(*by, "_y", "_p", "_c.scope", "_c.level")
    wanted = {**(levels or {}), **{f"feature:{n}": ["missing", "present"] for n in (flags or {})}}
    if wanted:
        spine = F.array(*[F.struct(F.lit(n).alias("scope"), F.lit(v).alias("level")) for n, vs in wanted.items() for v in vs])
        groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
        # A row without a pair is scored as nothing, but makes its level appear.
        nothing = F.lit(None).cast("double")
        narrow = narrow.unionByName(groups.withColumn("_c", F.explode(spine)).select(
            *by, nothing.alias("_y"), nothing.alias("_p"), "_c.scope", "_c.level"
        ))
    return narrow.groupBy(*by, "scope", "level").agg(*score_columns(F.col("_y"), F.col("_p")))


def score_baselines(
    df: DataFrame, actual: str, baselines: dict[str, str], by: list[str] = (), non_negative: bool = False
) -> DataFrame:
    """Each lag column as a forecast of its own, with the share of rows it is available on."""
    narrow = df.select(*by, actual, F.explode(F.array(*[
        F.struct(F.lit(n).alias("baseline"), F.col(c).cast("double").alias("value")) for n, c in baselines.items()
    ])).alias("_b")).select(*by, actual, "_b.baseline", "_b.value")
    value = finite(F.col("value"))
    if non_negative:
        value = F.when(value >= 0, value)
    scored = narrow.withColumn("value", value).groupBy(*by, "baseline").agg(
        *score_columns(F.col(actual), F.col("value")),
        F.count("value").alias("available_rows"),
        F.count_if(F.col("value").isNull()).alias("missing_rows"),
    )
    return scored.withColumn("coverage", F.col("available_rows") / (F.col("available_rows") + F.col("missing_rows")))


def winner(
    scores: DataFrame, group: list[str], candidate_order: list[str], split: str = "validation"
) -> DataFrame:
    """Best candidate per group by (deviance, MAE, RMSE, listed order) on the validation split only."""
    listed = F.array_position(F.array(*[F.lit(c) for c in candidate_order]), F.col("candidate"))
    worst = F.lit(float("inf"))
    place = F.struct(
        *[F.coalesce(F.col(c), worst).alias(c) for c in ("poisson_deviance", "mae", "rmse")],
        F.when(listed > 0, listed).otherwise(999).alias("listed"),
    )
    rest = [c for c in scores.columns if c not in group]
    best = scores.filter(F.col("split") == split).groupBy(*group).agg(F.min_by(F.struct(*rest), place).alias("_best"))
    return best.select(*group, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*scores.columns)


def prediction_table(
    df: DataFrame, keep: list[str], actual: str, predicted: str, seen: Column, features: list[str], baselines: dict[str, str]
) -> DataFrame:
    """Row-level forecasts: prediction clipped at zero, seen flag, missing features, clipped baselines."""
    missing = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    return df.select(
        *keep,
        F.col(actual).cast("double").alias("actual"),
        F.when(finite(F.col(predicted)).isNotNull(), F.greatest(F.col(predicted), F.lit(0.0))).alias("prediction"),
        seen.alias("unit_seen_in_train"),
        missing.alias("missing_feature_count"),
        F.when(missing > 0, "missing").otherwise("complete").alias("missingness_group"),
        *[
            F.when(finite(F.col(c)).isNotNull(), F.greatest(finite(F.col(c)), F.lit(0.0))).alias(f"baseline_{n}")
            for n, c in baselines.items()
        ],
    )


def feature_quality(df: DataFrame, features: list[str], blocking: list[str]) -> DataFrame:
    """Coverage share, warnings and status of each feature row.

    ``unavailable`` when every column of ``blocking`` is null, ``degraded`` with any warning.
    """
    covered = sum((F.col(c).isNotNull().cast("int") for c in features), F.lit(0)) / F.lit(len(features))
    warnings = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in blocking]), lambda w: w.isNotNull()
    )
    status = F.when(F.size("warnings") == len(blocking), "unavailable").when(F.size("warnings") > 0, "degraded")
    return df.withColumn("feature_coverage", covered).withColumn("warnings", warnings).withColumn(
        "status", status.otherwise("ok")
    )
