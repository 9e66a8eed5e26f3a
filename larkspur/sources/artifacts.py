"""Fitted models at rest: Spark's pipelines as they save themselves, whole fits with how to fit them anew, linear fits as tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import estimator, moments, ridge
from ..operators.search import Fit, calibrate


def save_pipeline(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    (model.write().overwrite() if overwrite else model.write()).save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass(frozen=True)
class Recipe:
    """All that a fit is made by: an estimator of Spark's by name, its parameters, the steps before it and whether it is calibrated after."""

    name: str
    features: tuple[str, ...]
    target: str
    parameters: Mapping[str, object] = field(default_factory=dict)
    covariates: tuple[str, ...] = ()
    fill: float = 0.0
    calibrated: bool = False


@dataclass(frozen=True)
class WholeFit:
    """A recipe, the pipeline fitted by it (scaler, fill, covariates, estimator) and the calibration of its logit."""

    recipe: Recipe
    pipeline: PipelineModel
    calibration: tuple[float, float] = (1.0, 0.0)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction, and for a classifier p, the calibrated probability of the second class."""
        out = self.pipeline.transform(df)
        if "probability" in out.columns:
            a, b = self.calibration
            q = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-12)), F.lit(1 - 1e-12))
            p = 1 / (1 + F.exp(-(a * F.ln(q / (1 - q)) + b))) if self.recipe.calibrated else vector_to_array("probability")[1]
            out = out.withColumn("p", p)
        return out.select(*df.columns, "prediction", *(["p"] if "p" in out.columns else []))


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def fit_whole(df: DataFrame, recipe: Recipe) -> WholeFit:
    """Scaler, fill, covariates, estimator and calibrator fitted to df; the steps are SQL with the fitted numbers in it."""
    columns = [*recipe.features, *recipe.covariates]
    stats = df.agg(*(f(F.col(f"`{c}`").cast("double")) for c in columns for f in (F.avg, F.stddev_pop))).first()
    scaled = [f"coalesce((`{c}` - {_number(stats[2 * i] or 0)}) / {_number(stats[2 * i + 1] or 1)}, {_number(recipe.fill)}) AS `__z_{c}`" for i, c in enumerate(columns)]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")]
    rows = stages[0].transform(df)
    inputs = [f"__z_{c}" for c in recipe.features]
    if recipe.covariates:
        given, left = [f"__z_{c}" for c in recipe.covariates], []
        for c in recipe.features:
            b = ridge(moments(rows, given, f"__z_{c}")[None])
            left.append(f"`__z_{c}` - ({' + '.join([_number(b[0]), *(f'{_number(x)} * `{g}`' for x, g in zip(b[1:], given))])}) AS `__r_{c}`")
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(left)} FROM __THIS__"))
        rows, inputs = stages[-1].transform(rows), [f"__r_{c}" for c in recipe.features]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    rows = stages[-1].transform(rows).where(F.col(recipe.target).isNotNull()).withColumn("label", F.col(recipe.target).cast("double"))
    model = estimator(recipe.name, **recipe.parameters).fit(rows)
    pipeline, calibration = PipelineModel([*stages, model]), (1.0, 0.0)
    if recipe.calibrated:
        raw = vector_to_array("probability")[1]
        q = F.least(F.greatest(raw, F.lit(1e-12)), F.lit(1 - 1e-12))
        calibration = calibrate(model.transform(rows).select("label", F.ln(q / (1 - q)).alias("logit")), "label", "logit")
    return WholeFit(recipe, pipeline, calibration)


def save_fit(fit: WholeFit, path: str, overwrite: bool = False) -> None:
    """The pipeline as it saves itself, and the recipe and calibration as one row of JSON beside it."""
    save_pipeline(fit.pipeline, f"{path}/pipeline", overwrite)
    spark = SparkSession.getActiveSession()
    told = json.dumps({"recipe": asdict(fit.recipe), "calibration": fit.calibration})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(f"{path}/recipe")


def load_fit(spark: SparkSession, path: str) -> WholeFit:
    told = json.loads(spark.read.text(f"{path}/recipe").first()[0])
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in told["recipe"].items()}
    return WholeFit(Recipe(**given), load_pipeline(f"{path}/pipeline"), tuple(told["calibration"]))


def fits_table(spark: SparkSession, fits: Sequence[Fit], features: Sequence[str]) -> DataFrame:
    """(fold, penalty, feature, kept, coefficient), the intercept as feature null."""
    rows = [
        (None if f.fold is None else int(f.fold), f.penalty, name, name is None or name in f.features, float(b))
        for f in fits for name, b in zip((None, *features), f.coefficients)
    ]
    return spark.createDataFrame(rows, "fold int, penalty double, feature string, kept boolean, coefficient double")


def load_fits(table: DataFrame, features: Sequence[str]) -> list[Fit]:
    """The fits of such a table; it has a row a fold and feature."""
    per = table.groupBy("fold", "penalty").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("feature", F.lit("")), F.struct("kept", "coefficient")))).alias("c")).collect()
    out = []
    for r in per:
        kept = tuple(f for f in features if r.c[f].kept)
        out.append(Fit(r.fold, r.penalty, kept, (r.c[""].coefficient, *(r.c[f].coefficient for f in features))))
    return sorted(out, key=lambda f: (f.fold is None, f.fold))
