"""Severity models, fitted by Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.model import RISK_WEIGHT, SEVERITIES


def severity_number(severity: Column) -> Column:
    """Fatal 3, Serious 2, Slight 1; anything else is missing."""
    number = F.lit(None).cast("double")
    for name, value in RISK_WEIGHT.items():
        number = F.when(severity == name, float(value)).otherwise(number)
    return number


def linear_severity(df: DataFrame, features: Sequence[str], severity: str = "collision_severity") -> DataFrame:
    """Ordinary least squares of severity on the features: (term, estimate).

    The normal equations are summed per partition; only a matrix of features by
    features reaches the driver.
    """
    data = df.select(severity_number(F.col(severity)).alias("label"), *[F.col(f).cast("double") for f in features]).dropna()
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(data)
    fit = LinearRegression(solver="normal", regParam=0.0, standardization=False).fit(rows)
    terms = [("(Intercept)", float(fit.intercept)), *zip(features, map(float, fit.coefficients))]
    return df.sparkSession.createDataFrame(terms, "term string, estimate double")


def simple_regression(df: DataFrame, feature: str, severity: str = "collision_severity") -> DataFrame:
    """Slope and intercept for one feature as a plain aggregate."""
    y, x = severity_number(F.col(severity)), F.col(feature).cast("double")
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def severity_probabilities(
    df: DataFrame, features: Sequence[str], severity: str = "collision_severity", iterations: int = 500, tolerance: float = 1e-8
) -> DataFrame:
    """Multinomial logit: per severity the observed share and mean fitted probability.

    The estimator keeps its own cached copy while it iterates; afterwards one more
    pass averages the fitted probabilities.
    """
    label = severity_number(F.col(severity)) - 1
    data = df.select(label.alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(data)
    fit = LogisticRegression(family="multinomial", maxIter=iterations, tol=tolerance).fit(rows)
    if fit.summary.totalIterations >= iterations:
        raise RuntimeError(f"the fit did not converge within {iterations} iterations")
    fitted = fit.transform(rows).select("label", vector_to_array("probability").alias("p"))
    # labels count upwards from the mildest severity
    names = list(enumerate(reversed(SEVERITIES)))
    wide = fitted.agg(
        *[F.avg(F.col("p")[i]).alias(f"fit_{i}") for i, _ in names],
        *[F.avg((F.col("label") == i).cast("double")).alias(f"obs_{i}") for i, _ in names],
    )
    table = F.array(
        *[
            F.struct(F.lit(n).alias("severity"), F.col(f"obs_{i}").alias("share"), F.col(f"fit_{i}").alias("mean_fitted"))
            for i, n in names
        ]
    )
    return wide.select(F.explode(table).alias("r")).select("r.*")
