"""Scores of probabilities against labels, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def classification(rows: DataFrame, by: list[str], *, y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy, balanced accuracy (over the classes present), precision, recall, f1, log loss and Brier score of each group."""
    label, guess, chance = F.col(y), (F.col(p) >= 0.5).cast("int"), F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = lambda a, b: F.sum(((label == a) & (guess == b)).cast("long"))
    counts = rows.groupBy(*by).agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"),
        (-F.avg(label * F.ln(chance) + (1 - label) * F.ln(1 - chance))).alias("log_loss"), F.avg(F.pow(F.col(p) - label, F.lit(2))).alias("brier"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    sides = F.filter(F.array(F.when(tp + fn > 0, tp / (tp + fn)), F.when(tn + fp > 0, tn / (tn + fp))), lambda x: x.isNotNull())
    balanced = F.aggregate(sides, F.lit(0.0), lambda a, x: a + x) / F.size(sides)
    return counts.select(*by, ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), balanced.alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "log_loss", "brier")


def roc_auc(rows: DataFrame, by: list[str], *, y: str = "y", p: str = "p") -> DataFrame:
    """Area under the curve from the counts at each distinct score; null for a group of one class.

    Scores are counted first, so the ordered window sees distinct scores, not rows.
    """
    at = rows.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*by).orderBy(p)) - F.col("neg")
    area = at.withColumn("area", F.col("pos") * (below + F.col("neg") / 2)).groupBy(*by).agg(F.sum("area").alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return area.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos") * F.col("neg"))).alias("roc_auc"))


def majority(rows: DataFrame, by: list[str], *, y: str = "y") -> DataFrame:
    """Share of ones and the majority class, ties to 0."""
    return rows.groupBy(*by).agg(F.avg(y).alias("up_rate"), (F.sum(y) * 2 > F.count(F.lit(1))).cast("int").alias("majority"))


def medians(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Exact, interpolating medians; 0 for a column without values."""
    return rows.groupBy(*by).agg(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(c) for c in columns])
