"""ROC curve and area under it, for scores of any number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.session import stage

# Slices the score range is cut into for the running counts, for each shuffle partition.
SLICES_PER_PARTITION = 4


def score_counts(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each class per distinct score. Equal scores collapse before the shuffle."""
    return (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )


def cumulative_counts(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from high to low: rows at it (pos, neg), at or above it (tps,
    fps), at the next lower score (next_pos, next_neg), and the totals (n_pos, n_neg).

    One running sum over all scores would be one task. The scores are cut into slices at
    approximate quantiles of the distinct scores; rows are added up within a slice, and
    what lies in higher slices comes from the slice totals, of which there are at most
    a few for each shuffle partition and group. The cut only spreads the work: sums are exact wherever it falls.
    The counts are staged, so the scores are computed once.
    """
    counts = stage(score_counts(scored, score, label, by), "score_counts")
    slices = SLICES_PER_PARTITION * int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(counts.approxQuantile("threshold", [i / slices for i in range(1, slices)], 0.1 / slices)))
    if cuts:
        # Placed by binary search. The lowest slice takes all below, the highest all above.
        borders = [-float("inf"), *[c for c in cuts if abs(c) != float("inf")], float("inf")]
        sliced = Bucketizer(splits=borders, inputCol="threshold", outputCol="slice", handleInvalid="keep").transform(counts)
    else:
        sliced = counts.withColumn("slice", F.lit(0.0))
    down = Window.partitionBy(*by).orderBy(F.col("slice").desc())
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = (
        sliced.groupBy(*by, "slice")
        .agg(
            F.sum("pos").alias("s_pos"),
            F.sum("neg").alias("s_neg"),
            F.max_by("pos", "threshold").alias("top_pos"),
            F.max_by("neg", "threshold").alias("top_neg"),
        )
        .select(
            *by,
            "slice",
            F.coalesce(F.sum("s_pos").over(above), F.lit(0)).alias("pos_above"),
            F.coalesce(F.sum("s_neg").over(above), F.lit(0)).alias("neg_above"),
            F.lead("top_pos").over(down).alias("below_pos"),
            F.lead("top_neg").over(down).alias("below_neg"),
            F.sum("s_pos").over(whole).alias("n_pos"),
            F.sum("s_neg").over(whole).alias("n_neg"),
        )
    )
    within = Window.partitionBy(*by, "slice").orderBy(F.col("threshold").desc())
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sliced.join(totals, [*by, "slice"]).select(
        *by,
        "threshold",
        "pos",
        "neg",
        (F.sum("pos").over(running) + F.col("pos_above")).alias("tps"),
        (F.sum("neg").over(running) + F.col("neg_above")).alias("fps"),
        F.coalesce(F.lead("pos").over(within), "below_pos").alias("next_pos"),
        F.coalesce(F.lead("neg").over(within), "below_neg").alias("next_neg"),
        "n_pos",
        "n_neg",
    )


def roc_curve(
    scored: DataFrame, score: str, label: str, by: Sequence[str] = (), drop_intermediate: bool = True
) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, plus the start (infinity, 0, 0).

    `drop_intermediate` leaves out points on a straight line between their neighbours:
    those where the next score adds the same counts. Both ends always stay.
    """
    points = cumulative_counts(scored, score, label, by)
    if drop_intermediate:
        first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
        bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        points = points.where(first | F.col("next_pos").isNull() | bends)
    curve = points.select(
        *by,
        "threshold",
        F.try_divide(F.col("fps").cast("double"), F.col("n_neg").cast("double")).alias("fpr"),
        F.try_divide(F.col("tps").cast("double"), F.col("n_pos").cast("double")).alias("tpr"),
    )
    groups = scored.select(*by).distinct() if by else scored.sparkSession.range(1).select()
    start = groups.select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(start)


def roc_auc(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by trapezoids, null where one of the two classes is missing.

    The areas are added up as whole numbers and divided once at the end.
    """
    twice = F.col("neg").cast("decimal(19,0)") * (2 * F.col("tps") - F.col("pos")).cast("decimal(19,0)")
    whole = 2.0 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return (
        cumulative_counts(scored, score, label, by)
        .groupBy(*by)
        .agg(F.sum(twice).cast("double").alias("area"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
        .select(*by, F.try_divide(F.col("area"), whole).alias("auc"))
    )
