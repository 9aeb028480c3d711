"""Learned fusion of signals with prompt-grouped cross-validation, on pyspark.ml and the trees of ``trees``."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..shared import written
from . import trees
from .ranking import global_rank


def numbers(rows: DataFrame, but: list[str]) -> list[str]:
    """The numeric columns of a table of features, for use as inputs, without keys and labels."""
    return [f.name for f in rows.schema.fields if f.name not in but and isinstance(f.dataType, NumericType)]


def grouped_folds(rows: DataFrame, folds: int = 5, prompt: str = "prompt_id") -> DataFrame:
    """Adds ``fold``: all rows of a prompt share one, and prompts are spread evenly in the order of their hash."""
    order = F.md5(F.col(prompt).cast("string").cast("binary"))
    prompts = global_rank(rows.select(prompt).distinct(), [order, F.col(prompt)], "_r")
    return rows.join(prompts.select(prompt, ((F.col("_r") - 1) % folds).cast("int").alias("fold")), prompt)


def model(kind: str, n_rows: int):
    """logistic (L2 with unit cost, unscaled); the forest grows and boosting runs in ``trees``."""
    if kind == "logistic":
        return LogisticRegression(maxIter=5000, tol=1e-4, regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False)
    raise ValueError(f"unknown model {kind!r}")


def out_of_fold(rows: DataFrame, inputs: list[str], label: str, kind: str, folds: int = 5, prompt: str = "prompt_id", estimator=None) -> DataFrame:
    """The rows with ``score``: the probability of label 1 from models that did not see the row's prompt.

    Inputs that the rows lack are skipped; null and NaN inputs are 0.
    """
    have = [c for c in inputs if c in rows.columns]
    data = rows if "fold" in rows.columns else grouped_folds(rows, folds, prompt)
    clean = data.select(*data.columns, *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(have)], F.col(label).cast("double").alias("_y"))
    clean = written(clean)
    if kind in ("forest", "boosting") and estimator is None:
        return (trees.forest_scores if kind == "forest" else trees.boosting_scores)(clean, data.columns, len(have), folds)
    ready = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(have))], outputCol="_features").transform(clean).drop(*[f"_x{i}" for i in range(len(have))])
    sizes = {r.fold: r["count"] for r in clean.groupBy("fold").count().collect()}  # one row a fold

    def fold_scores(fold: int) -> DataFrame:
        train = ready.where(F.col("fold") != fold).cache()
        try:
            est = (estimator or model(kind, sum(sizes.values()) - sizes.get(fold, 0))).copy()
            fitted = est.setFeaturesCol("_features").setLabelCol("_y").setProbabilityCol("_p").setPredictionCol("_yhat").setRawPredictionCol("_raw").fit(train)
        finally:
            train.unpersist()
        return fitted.transform(ready.where(F.col("fold") == fold)).select(*data.columns, vector_to_array("_p")[1].alias("score"))

    with ThreadPool(folds) as pool:  # folds wait on the cluster side by side
        parts = pool.map(fold_scores, range(folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
