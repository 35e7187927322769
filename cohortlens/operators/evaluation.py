"""Label indexing and classification metrics as aggregates.

The reference issues five ``count(*)`` queries per fold and divides in
float32; here all counts are one conditional aggregate (optionally grouped
by fold) and the ratios use ``try_divide`` (undefined -> null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_mapping(df: DataFrame, col: str = "DOA", label_col: str = "label") -> DataFrame:
    """Class -> index by descending frequency, ties by the value's string form.

    Same order as MLlib's ``StringIndexer`` (frequencyDesc). The class table is
    aggregated map-side, so only one row per class is shuffled.
    """
    return rank_classes(df.groupBy(col).agg(F.count(F.lit(1)).alias("n")), col, label_col)


def rank_classes(counts: DataFrame, col: str, label_col: str = "label") -> DataFrame:
    """Add the index to a table of classes and their counts ``n``: one row per class, so one small window."""
    order = Window.orderBy(F.desc("n"), F.col(col).cast("string").asc())
    return counts.withColumn(label_col, (F.row_number().over(order) - F.lit(1)).cast("double"))


def index_label(df: DataFrame, col: str = "DOA", label_col: str = "label",
                mapping: DataFrame | None = None) -> DataFrame:
    """Attach ``label`` from a mapping fitted on ``df`` (or a given one, e.g. train-only)."""
    m = (mapping if mapping is not None else label_mapping(df, col, label_col)).select(col, label_col)
    return df.join(m, col, "left")


def restore_label(df: DataFrame, mapping: DataFrame, col: str = "DOA", label_col: str = "label",
                  prediction: str = "prediction", out: str = "predicted_value") -> DataFrame:
    """The original class of each predicted index (the inverse of :func:`index_label`); unknown indices give null."""
    m = mapping.select(F.col(label_col).alias(prediction), F.col(col).alias(out))
    return df.join(F.broadcast(m), prediction, "left")  # one row per class


def mean_fold_accuracy(folds: DataFrame, accuracy: str = "accuracy", digits: int | None = 6) -> DataFrame:
    """Number of folds and the mean, lowest and highest of their accuracies (folds without one are not counted)."""
    r = lambda c: F.round(c, digits) if digits is not None else c
    return folds.agg(F.count(accuracy).alias("folds"), r(F.avg(accuracy)).alias("mean_accuracy"),
                     r(F.min(accuracy)).alias("min_accuracy"), r(F.max(accuracy)).alias("max_accuracy"))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = (), positive: float = 1.0) -> DataFrame:
    """tp, tn, fp, fn, n in one aggregate."""
    y, p = F.col(label) == F.lit(positive), F.col(prediction) == F.lit(positive)
    return df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.count(F.lit(1)).alias("n"))


def _ratio(num: Column, den: Column, digits: int | None) -> Column:
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return F.round(r, digits) if digits is not None else r


def binary_metrics(counts: DataFrame, digits: int | None = 6) -> DataFrame:
    """accuracy, precision, recall, f1 from confusion counts.

    f1 = 2tp / (2tp + fp + fn): equal to the harmonic mean wherever that is
    defined, 0 when tp = 0 and there are errors, null when nothing is positive.
    """
    tp, tn, fp, fn, n = (F.col(c) for c in ("tp", "tn", "fp", "fn", "n"))
    return counts.select(
        "*",
        _ratio(tp + tn, n, digits).alias("accuracy"),
        _ratio(tp, tp + fp, digits).alias("precision"),
        _ratio(tp, tp + fn, digits).alias("recall"),
        _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn, digits).alias("f1"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def per_class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                      digits: int | None = 6) -> DataFrame:
    """Per class: tp, actual, predicted, precision, recall (from the small confusion matrix)."""
    m = confusion_matrix(df, label, prediction)
    actual = m.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("actual"))
    predicted = m.groupBy(F.col(prediction).alias("class")).agg(F.sum("n").alias("predicted"))
    tp = m.where(F.col(label) == F.col(prediction)).select(F.col(label).alias("class"), F.col("n").alias("tp"))
    out = actual.join(predicted, "class", "full").join(tp, "class", "left")
    out = out.select("class",
                     F.coalesce("tp", F.lit(0)).cast("long").alias("tp"),
                     F.coalesce("actual", F.lit(0)).cast("long").alias("actual"),
                     F.coalesce("predicted", F.lit(0)).cast("long").alias("predicted"))
    return out.select("*", _ratio(F.col("tp"), F.col("predicted"), digits).alias("precision"),
                      _ratio(F.col("tp"), F.col("actual"), digits).alias("recall"))


def holdout_accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """Share of rows with prediction == label (multiclass accuracy)."""
    hit = F.col(label) == F.col(prediction)
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct"))
    return agg.withColumn("accuracy", _ratio(F.col("correct"), F.col("n"), digits))
