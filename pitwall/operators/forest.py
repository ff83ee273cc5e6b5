"""The classifier: imputation, features and random forest as one Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall import schema
from pitwall.sources.layers import list_folder

# The forest's settings.
TREES = 500
MIN_LEAF_ROWS = 50
SEED = 42
# The engine's own limit; trees stop at MIN_LEAF_ROWS.
MAX_DEPTH = 30
# Values of a feature that a split tells apart at most; columns with more are cut at quantiles.
MAX_BINS = 256
# Tasks that draw bootstrap samples. Each draws its own, so the number is part of the model, not of the cluster.
TASKS = 64


def pipeline(
    features: Sequence[str],
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    max_bins: int = MAX_BINS,
    bootstrap: bool = True,
    subset: str = "auto",
    weight: str | None = None,
) -> Pipeline:
    """Missing features become the sentinel, then a forest on all of them. `subset` is
    the share of features a split looks at, in Spark's words; `weight` a column."""
    filled = ", ".join(f"coalesce(double(`{c}`), {schema.SENTINEL}D) AS `filled_{c}`" for c in features)
    impute = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    assemble = VectorAssembler(inputCols=[f"filled_{c}" for c in features], outputCol="features")
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol=schema.LABEL,
        numTrees=trees,
        minInstancesPerNode=MIN_LEAF_ROWS,
        maxDepth=max_depth,
        maxBins=max_bins,
        bootstrap=bootstrap,
        featureSubsetStrategy=subset,
        seed=SEED,
        # Every pass would send each row down all the trees again; the nodes are those of the pass before. Same forest.
        cacheNodeIds=True,
    )
    if weight:
        forest.setWeightCol(weight)
    return Pipeline(stages=[impute, assemble, forest])


def fit(
    train: DataFrame,
    features: Sequence[str],
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    max_bins: int = MAX_BINS,
    bootstrap: bool = True,
    subset: str = "auto",
    tasks: int = TASKS,
    balanced: bool = False,
) -> PipelineModel:
    """Fit on rows spread evenly over `tasks` tasks and in a fixed order: the same rows,
    settings and seed give the same forest on any cluster. `balanced` gives both classes
    the same weight as a whole."""
    spread = train.repartition(tasks, *schema.FEATURE_KEY).sortWithinPartitions(*schema.FEATURE_KEY)
    made = pipeline(features, trees, max_depth, max_bins, bootstrap, subset, "weight" if balanced else None)
    kept = [F.col(schema.LABEL), *[F.col(c) for c in features]]
    if balanced:
        ones, others = spread.agg(F.count_if(F.col(schema.LABEL) == 1), F.count_if(F.col(schema.LABEL) != 1)).first()
        kept.append(F.when(F.col(schema.LABEL) == 1, others / ones if ones else 1.0).otherwise(1.0).alias("weight"))
    return made.fit(spread.select(*kept))


def feature_names(model: PipelineModel) -> list[str]:
    return [c.removeprefix("filled_") for c in model.stages[1].getInputCols()]


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """All columns of `rows` plus the class probabilities `0` and `prob_win` and the
    predicted class. The features are picked by the model's own names."""
    out = model.transform(rows)
    chance = vector_to_array("probability")
    return out.select(
        *rows.columns,
        chance[0].alias("0"),
        chance[1].alias("prob_win"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance), highest first. One row per feature of the model."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    rows = list(zip(feature_names(model), values))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def versions(spark: SparkSession, root: str) -> list[int]:
    names = (n for n, is_folder in list_folder(spark, root).items() if is_folder and n.startswith("v="))
    return sorted(int(n[2:]) for n in names)


def next_version(spark: SparkSession, root: str) -> int:
    return max(versions(spark, root), default=0) + 1


def save_model(model: PipelineModel, spark: SparkSession, root: str) -> int:
    """Store under the next version; versions already there are kept."""
    version = next_version(spark, root)
    model.write().save(f"{root.rstrip('/')}/v={version}")
    return version


def load_model(spark: SparkSession, root: str) -> PipelineModel | None:
    """The newest version, or None if there is none."""
    known = versions(spark, root)
    return PipelineModel.load(f"{root.rstrip('/')}/v={known[-1]}") if known else None
