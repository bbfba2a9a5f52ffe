"""Model runs over the paired dataset: the model's frame, checks of a split, fitted bundles and their publication."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.operators import models as M
from draftlake.operators.dataset import POST_COLUMNS, PRE_COLUMNS
from draftlake.operators.metrics import metrics, select_family

FAMILIES = ("baseline", "logistic", "forest")
KEYS = ("game_id", "y_blue_win")


def features(phase: str) -> tuple[list[str], list[str], list[str]]:
    """(numbers, flags, categories) of a phase: PRE, or POST with the ten champions as categories."""
    columns = list(PRE_COLUMNS) + (list(POST_COLUMNS) if phase == "POST" else [])
    flags = [c for c in columns if c.endswith("_missing")]
    categories = [c for c in columns if c.endswith("_champion_id")]
    return [c for c in columns if c not in flags and c not in categories], flags, categories


def model_frame(pairs: DataFrame, phase: str) -> DataFrame:
    """Key, label and a phase's features with their types; a row with a value outside its domain fails."""
    numbers, flags, categories = features(phase)
    counts = [c for c in numbers if c.endswith("_count")]
    bad = reduce(lambda a, b: a | b, (F.col(c).isNull() | (F.col(c) < 0) for c in counts))
    bad = bad | reduce(lambda a, b: a | b, (F.col(f).isNull() for f in flags))
    if categories:
        bad = bad | (F.size(F.array_distinct(F.array(*categories))) != 10)
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("E_MODEL_VALUE_INVALID: "), F.col("game_id"))).cast("string")).otherwise(F.col("game_id"))
    return pairs.select(
        checked.alias("game_id"), F.col("y_blue_win").cast("int").alias("y_blue_win"), *(F.col(c).cast("double").alias(c) for c in numbers), *(F.col(c).cast("boolean").alias(c) for c in flags), *(F.col(c).cast("string").alias(c) for c in categories)
    )


def signature(pairs: DataFrame, columns: Iterable[str] | None = None) -> str:
    """A digest of a dataset's rows in any order: count, and the sum of the rows' hashes (-0.0 as 0.0, null and NaN alike null)."""
    kinds = dict(pairs.dtypes)
    plain = lambda c: F.when(~F.isnan(c), F.col(c) + 0.0) if kinds[c] in ("double", "float") else F.col(c)
    text = F.concat_ws("\x1f", *(F.coalesce(plain(c).cast("string"), F.lit("<NULL>")) for c in sorted(columns or pairs.columns)))
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    return f"{row[0]}-{int(row[1] or 0):x}"


def split_issues(split: DataFrame, dataset: DataFrame) -> DataFrame:
    """(problem, n) of a split (game_id, partition, purged, y_blue_win) of a dataset; must be empty: parts that overlap, rows lost or
    unknown, an empty part, a training part of one class."""
    kept = split.where("NOT purged")
    counts = kept.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y_blue_win").alias("classes"))
    parts = split.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "partition string").join(counts, "partition", "left")
    found = [
        split.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("overlap").alias("problem")),
        dataset.join(split, "game_id", "left_anti").select(F.lit("lost").alias("problem")),
        split.join(dataset, "game_id", "left_anti").select(F.lit("unknown").alias("problem")),
        parts.where("n IS NULL").select(F.concat(F.lit("empty "), "partition").alias("problem")),
        parts.where("partition = 'train' AND classes = 1").select(F.lit("E_TRAIN_SINGLE_CLASS").alias("problem")),
    ]
    return reduce(DataFrame.union, found).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def evaluate(fitted: M.Fitted, frame: DataFrame, locked: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """Metrics of a fitted model on a frame; ``locked``: the signature that the frame must have."""
    if locked is not None and signature(frame, columns) != locked:
        raise ValueError("E_MODEL_DATASET_IDENTITY")
    return metrics(fitted.score(frame), "y_blue_win", "p")


def fit_candidates(train: DataFrame, validation: DataFrame, phases: Iterable[str] = ("PRE", "POST"), families: Iterable[str] = FAMILIES) -> tuple[dict, str]:
    """({(family, phase): fitted}, the selected family): each family is fitted on the training part and compared by its mean metrics on validation."""
    fitted, results = {}, []
    for family in families:
        scores = []
        for phase in phases:
            model = M.fit(family, model_frame(train, phase), *features(phase))
            fitted[family, phase] = model
            scores.append(evaluate(model, model_frame(validation, phase)).first())
        results.append({"family": family, "brier": sum(s.brier for s in scores) / len(scores), "log_loss": sum(s.log_loss for s in scores) / len(scores)})
    return fitted, select_family(results)


def publish_bundle(spark: SparkSession, root: str, fitted: dict, selected: str, dataset: str) -> None:
    """Write each model of a bundle, then its manifest: without a manifest there is no bundle. An existing one is never overwritten."""
    if bundle_exists(spark, root):
        raise FileExistsError(f"E_MODEL_ARTIFACT_EXISTS: {root}")
    rows = []
    for (family, phase), model in fitted.items():
        path = f"{family}-{phase}"
        if model.model is not None:
            model.model.write().overwrite().save(f"{root}/{path}")  # left over from a run that failed before its manifest
        stats = [(c, *map(float, s)) for c, s in model.scaler.stats.items()]
        rows.append((family, phase, path, float(model.prior), list(model.flags), stats, family == selected, dataset))
    kind = "family string, phase string, path string, prior double, flags array<string>, stats array<struct<c: string, median: double, mean: double, sd: double>>, selected boolean, dataset string"
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest")


def bundle_exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load_bundle(spark: SparkSession, root: str, dataset: str | None = None) -> tuple[dict, str]:
    """({(family, phase): fitted}, the selected family) of a published bundle; ``dataset``: the signature that it must be of."""
    if not bundle_exists(spark, root):
        raise FileNotFoundError(f"E_MODEL_COMPARISON_MISSING: {root}")
    fitted, selected = {}, None
    for r in spark.read.parquet(f"{root}/manifest").collect():  # six rows
        if dataset is not None and r.dataset != dataset:
            raise ValueError("E_MODEL_DATASET_IDENTITY")
        model = None if r.family == "baseline" else PipelineModel.load(f"{root}/{r.path}")
        fitted[r.family, r.phase] = M.Fitted(r.family, M.Scaler({s.c: (s.median, s.mean, s.sd) for s in r.stats}), list(r.flags), model, r.prior)
        selected = r.family if r.selected else selected
    return fitted, selected


def comparison(fitted: dict, pairs: DataFrame, phase: str) -> DataFrame:
    """(game_id, baseline, logistic, forest): the probabilities of all families for each match."""
    frame = model_frame(pairs, phase)
    scored = [m.score(frame).select("game_id", F.lit(family).alias("family"), "p") for (family, of), m in fitted.items() if of == phase]
    return reduce(DataFrame.union, scored).groupBy("game_id").pivot("family", list(FAMILIES)).agg(F.first("p"))
