"""Win-probability models: preprocessing as SQL aggregates, families of pyspark.ml, paired scoring.

Numbers are imputed with the exact median (0 if all are null) and scaled by the population standard
deviation; flags pass; categories are one-hot with zeros for unseen values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 1729
FAMILIES = ("baseline", "logistic", "forest")


@dataclass
class Scaler:
    """(median, mean, deviation) of each number, by the imputed training rows."""

    stats: dict[str, tuple[float, float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}__z": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - mean) / (sd or 1.0) for c, (m, mean, sd) in self.stats.items()})


def fit_scaler(train: DataFrame, numbers: list[str]) -> Scaler:
    """Two passes for all columns: medians, then mean and deviation of the imputed values."""
    if not numbers:
        return Scaler({})
    medians = train.agg(*(F.coalesce(F.median(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in numbers)).first()
    filled = train.select(*(F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in numbers))
    moments = filled.agg(*(F.avg(c).alias(f"{c}_m") for c in numbers), *(F.stddev_pop(c).alias(f"{c}_s") for c in numbers)).first()
    return Scaler({c: (medians[c], moments[f"{c}_m"] or 0.0, moments[f"{c}_s"] or 0.0) for c in numbers})


@dataclass
class Fitted:
    """A family fitted on one feature set."""

    family: str
    scaler: Scaler
    flags: list[str]
    model: PipelineModel | None
    prior: float

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the probability of a win of the first side."""
        if self.model is None:
            return df.withColumn(name, F.lit(self.prior))
        ready = self.scaler.transform(df).withColumns({f"{f}__f": F.col(f).cast("double") for f in self.flags})
        scored = self.model.transform(ready)
        p = vector_to_array("probability")[1]
        checked = F.when((p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.lit("a probability outside 0 to 1")).cast("double"))
        return scored.select(*df.columns, checked.alias(name))


def fit(family: str, train: DataFrame, numbers: list[str], flags: list[str], categories: list[str], label: str = "y_blue_win") -> Fitted:
    """Fit one family: the prior, a ridge logistic regression (C = 1) or a forest of 32 trees of depth 4."""
    n, prior = train.agg(F.count(F.lit(1)), F.avg(label)).first()
    if family == "baseline":
        return Fitted(family, Scaler({}), [], None, prior)
    scaler = fit_scaler(train, numbers)
    ready = scaler.transform(train).withColumns({f"{f}__f": F.col(f).cast("double") for f in flags})
    inputs = [f"{c}__z" for c in numbers] + [f"{f}__f" for f in flags] + [f"{c}__v" for c in categories]
    stages = []
    if categories:
        stages.append(StringIndexer(inputCols=categories, outputCols=[f"{c}__i" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in categories], outputCols=[f"{c}__v" for c in categories], dropLast=True))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features__"))
    if family == "logistic":
        stages.append(LogisticRegression(featuresCol="features__", labelCol=label, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10))
    else:
        stages.append(RandomForestClassifier(featuresCol="features__", labelCol=label, numTrees=32, maxDepth=4, minInstancesPerNode=2, seed=SEED, featureSubsetStrategy="sqrt"))
    return Fitted(family, scaler, flags, Pipeline(stages=stages).fit(ready), prior)


def compare(pre: DataFrame, post: DataFrame, key: str = "game_id") -> DataFrame:
    """Both phases of each match and the change in percentage points; a match that only one has fails."""
    both = pre.select(key, F.col("p").alias("pre")).join(post.select(key, F.col("p").alias("post")), key, "full")
    lone = F.col("pre").isNull() | F.col("post").isNull()
    return both.select(key, "pre", "post", F.when(lone, F.raise_error(F.lit("an unpaired prediction")).cast("double")).otherwise((F.col("post") - F.col("pre")) * 100).alias("delta_points"))
