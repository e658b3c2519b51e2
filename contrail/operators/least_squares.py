"""Least squares over numeric and one-hot features held as tables: products, weights and levels never reach the driver.

The products of the features are rows (i, j, v), made of grouped sums: one aggregate row for the numeric features, one row
for each level and numeric feature, one for each pair of levels seen together. A matrix-vector product is a join on j and a
grouped sum. Batch gradient descent is linear in its start, so `epochs` steps are applied in stretches as a binomial series in
the products, each term one matrix-vector product, until a term no longer counts; only scalars are read back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.session import materialize

# Training constants.
LINEAR_EPOCHS, LINEAR_RATE = 700, 0.0000008
INTERCEPT = "(intercept)"
NEGLIGIBLE = 1e-15
BROADCAST_LEVELS = 100_000


@dataclass(frozen=True)
class LinearModel:
    """Coefficients as a stored table (feature, coefficient); levels are named ``feature=level``, the constant INTERCEPT."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    coefficients: DataFrame


def _level(name: str) -> Column:
    return F.concat(F.lit(f"{name}="), F.col(name).cast("string"))


def _triples(*rows: tuple[Column, Column, Column]) -> Column:
    return F.explode(F.array(*[F.struct(i.alias("i"), j.alias("j"), v.cast("double").alias("v")) for i, j, v in rows])).alias("t")


def feature_products(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str) -> tuple[DataFrame, int, float]:
    """((i, j, v): sums of products of each two features and, under the name of the target, of each feature with it, rows, target sum)."""
    numeric, categorical = sorted(numeric), sorted(categorical)
    plain = {INTERCEPT: F.lit(1.0), **{x: F.col(x).cast("double") for x in numeric}}
    names, y = list(plain), F.col(target).cast("double")
    goal = F.lit(f"({target})")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [F.sum(plain[a] * plain[b]).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]
    total = train.agg(*sums, *[F.sum(plain[a] * y).alias(f"y{k}") for k, a in enumerate(names)])
    both = [(F.lit(a), F.lit(b), F.col(f"p{k}")) for k, (a, b) in enumerate(pairs)]
    both += [(j, i, v) for (i, j, v), (a, b) in zip(both, pairs, strict=True) if a != b]
    parts = [total.select(_triples(*both, *[(F.lit(a), goal, F.col(f"y{k}")) for k, a in enumerate(names)]))]
    if categorical:
        own = train.select(*[x.alias(f"x{k}") for k, x in enumerate(plain.values())], y.alias("y"), F.explode(F.array(*map(_level, categorical))).alias("level"))
        by_level = own.where("level IS NOT NULL").groupBy("level").agg(*[F.sum(c).alias(c) for c in (*[f"x{k}" for k in range(len(names))], "y")])
        level = F.col("level")
        sides = [(F.lit(a), level, F.col(f"x{k}")) for k, a in enumerate(names)]
        parts.append(by_level.select(_triples(*sides, *[(j, i, v) for i, j, v in sides], (level, level, F.col("x0")), (level, goal, F.col("y")))))
    together = [F.struct(_level(a).alias("i"), _level(b).alias("j")) for k, a in enumerate(categorical) for b in categorical[k + 1 :]]
    if together:
        seen = train.select(F.explode(F.array(*together)).alias("t")).select("t.*").where("i IS NOT NULL AND j IS NOT NULL")
        counted = seen.groupBy("i", "j").agg(F.count(F.lit(1)).alias("v"))
        i, j, v = F.col("i"), F.col("j"), F.col("v")
        parts.append(counted.select(_triples((i, j, v), (j, i, v))))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionAll(part)
    stored = materialize(table.select("t.*"), "products")
    ends = stored.where(F.col("i") == INTERCEPT).agg(
        F.max(F.when(F.col("j") == INTERCEPT, F.col("v"))).alias("n"), F.max(F.when(F.col("j") == goal, F.col("v"))).alias("y")
    )
    row = ends.first()
    return stored, int(row["n"] or 0), float(row["y"] or 0.0)


def _times(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, x): the product of (i, j, v) with (i, x)."""
    return matrix.join(vector.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def _greatest(vector: DataFrame) -> float:
    return float(vector.agg(F.max(F.abs("x")).alias("m")).first()["m"] or 0.0)


def descended(matrix: DataFrame, pull: DataFrame, start: DataFrame, epochs: int, rate: float) -> DataFrame:
    """(i, x) after `epochs` steps x <- x - rate * (matrix x - pull) from `start`."""
    size = matrix.groupBy("i").agg(F.sum(F.abs("v")).alias("x"))
    reach = max(rate * _greatest(size), 1e-300)  # bounds what one step adds, relative to the weights
    x, left = start, epochs
    while left:
        steps = min(left, max(1, math.floor(1 / reach)))
        left -= steps
        pulled = _times(matrix, x).withColumnRenamed("x", "ax").join(pull.withColumnRenamed("x", "p"), "i", "full")
        term = materialize(
            pulled.select("i", (F.coalesce("ax", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))).alias("x")), "slope"
        )
        weight, terms = rate * steps, []
        first = _greatest(term)
        for k in range(1, steps + 1):
            terms.append(term.select("i", (F.col("x") * F.lit(-weight)).alias("x")))
            if k == steps:
                break
            term = materialize(_times(matrix, term), "slope")
            weight *= -rate * (steps - k) / (k + 1)
            if abs(weight) * _greatest(term) <= NEGLIGIBLE * rate * first:
                break
        for t in terms:
            x = x.unionAll(t)
        x = materialize(x.groupBy("i").agg(F.sum("x").alias("x")), "weights")
    return x


def fit_linear(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str = "target",
    epochs: int = LINEAR_EPOCHS,
    rate: float = LINEAR_RATE,
) -> LinearModel:
    """Batch gradient descent on squared error, features scaled by their root mean square, from the mean of the target."""
    products, n, y_sum = feature_products(train, numeric, categorical, target)
    goal = F.lit(f"({target})")
    n = max(n, 1)
    scale = materialize(
        products.where(F.col("i") == F.col("j")).select(
            F.col("i").alias("k"), F.when(F.col("i") == INTERCEPT, 1.0).otherwise(F.greatest(F.lit(1.0), F.sqrt(F.col("v") / n))).alias("s")
        ),
        "scale",
    )
    of_i, of_j = scale.toDF("i", "si"), scale.toDF("j", "sj")
    matrix = materialize(
        products.where(F.col("j") != goal).join(of_i, "i").join(of_j, "j").select("i", "j", (F.col("v") / (F.col("si") * F.col("sj") * n)).alias("v")),
        "matrix",
    )
    pull = products.where(F.col("j") == goal).join(of_i, "i").select("i", (F.col("v") / (F.col("si") * n)).alias("x"))
    start = scale.select(F.col("k").alias("i"), F.when(F.col("k") == INTERCEPT, y_sum / n).otherwise(0.0).alias("x"))
    weights = descended(matrix, materialize(pull, "pull"), start, epochs, rate)
    table = weights.join(of_i, "i").select(F.col("i").alias("feature"), F.round(F.col("x") / F.col("si"), 10).alias("coefficient"))
    return LinearModel(tuple(sorted(numeric)), tuple(sorted(categorical)), materialize(table, "coefficients"))


def predict_linear(rows: DataFrame, model: LinearModel, name: str = "raw_prediction") -> DataFrame:
    """Apply a linear model; levels not seen in training add nothing."""
    table = model.coefficients
    plain = table.where(F.col("feature").isin(INTERCEPT, *model.numeric))  # as many rows as numeric columns
    known = {r["feature"]: float(r["coefficient"]) for r in plain.collect()}
    terms = [f"{known.get(INTERCEPT, 0.0)!r}D", *[f"cast(`{x}` AS double) * {known.get(x, 0.0)!r}D" for x in model.numeric]]
    out = rows
    for i, feature in enumerate(model.categorical):
        own = table.where(F.startswith("feature", F.lit(f"{feature}="))).select(
            F.substring("feature", len(feature) + 2, 1 << 30).alias(f"_level_{i}"), F.col("coefficient").alias(f"_coef_{i}")
        )
        own = F.broadcast(own) if own.count() <= BROADCAST_LEVELS else own
        out = out.join(own, F.col(feature).cast("string") == F.col(f"_level_{i}"), "left").drop(f"_level_{i}")
        terms.append(f"coalesce(_coef_{i}, 0.0D)")
    return out.withColumn(name, F.expr(" + ".join(terms))).drop(*[f"_coef_{i}" for i in range(len(model.categorical))])


def gradient(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str = "target") -> DataFrame:
    """(feature, slope): slope of half the mean squared error of the mean, for each unscaled feature; what a first step follows."""
    products, n, y_sum = feature_products(train, numeric, categorical, target)
    of = products.where(F.col("j") == INTERCEPT).select("i", F.col("v").alias("x"))
    with_y = products.where(F.col("j") == F.lit(f"({target})")).select("i", F.col("v").alias("y"))
    return of.join(with_y, "i").select(F.col("i").alias("feature"), ((F.col("x") * (y_sum / max(n, 1)) - F.col("y")) / max(n, 1)).alias("slope"))
