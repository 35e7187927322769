"""Tree models on weighted cells: fold evaluation, hold-out evaluation, importances.

Rows are binned and counted once into cells; a fold's training set is all cells
less its own (:mod:`trees`). Forests of all folds grow together as tables.
Boosted trees are fitted on a fold's cells in a task where they are few enough,
and else by MLlib with the counts as weights: there a driver-side loop runs over
the folds, one model each, on a bounded thread pool.
``fit_model`` fits MLlib models on rows, for those who want the fitted object.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import trees
from cohortlens.operators.evaluation import binary_metrics
from cohortlens.session import stored

# The reference's model settings.
FOREST_FOLDS = dict(numTrees=50, maxDepth=8, maxBins=100, impurity="gini", featureSubsetStrategy="auto", seed=5043)
FOREST_HOLDOUT = dict(numTrees=20, maxDepth=8, maxBins=100, impurity="gini", featureSubsetStrategy="auto", seed=5043)
GBT_PARAMS = dict(maxIter=100, maxDepth=8, seed=5043)
CLINICAL_FOREST = dict(numTrees=10, maxDepth=8, featureSubsetStrategy="sqrt", seed=42)


def _estimator(kind: str, params: dict | None):
    if kind == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label", **(params or FOREST_FOLDS))
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="label", **(params or GBT_PARAMS))
    raise ValueError(f"unknown model {kind!r}")


def fit_model(train: DataFrame, features: Sequence[str], kind: str = "forest", params: dict | None = None):
    """Assemble features and fit; ``train`` must carry a numeric ``label``."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, _estimator(kind, params)]).fit(train)


def fit_forest(train: DataFrame, features: Sequence[str], params: dict | None = None):
    return fit_model(train, features, "forest", params)


def fit_gbt(train: DataFrame, features: Sequence[str], params: dict | None = None):
    return fit_model(train, features, "gbt", params)


def importance_table(spark: SparkSession, model, features: Sequence[str], tag: int | None = None) -> DataFrame:
    """(fold, feature, importance) of an MLlib model, most important first. One row per feature."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(tag, f, float(v)) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "fold int, feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature"))


FOLD_COUNTS = "num long, tp long, tn long, fp long, fn long, n long"
#: Cells of one partition of an MLlib fit.
FIT_CELLS = 200_000


def _bins(kind: str, params: dict) -> int:
    return params.get("maxBins", 32)


def outcome_values(df: DataFrame, outcome: str) -> list:
    """The (at most two) outcome values, in order of their string form."""
    values = [r[0] for r in df.where(F.col(outcome).isNotNull()).select(outcome).distinct().limit(3).collect()]
    if len(values) > 2:
        raise ValueError(f"{outcome} has more than two values")
    return sorted(values, key=str)


def fold_cells(blocked: DataFrame, features: Sequence[str], outcome: str = "DOA", block_col: str = "block",
               max_bins: int = 100) -> DataFrame:
    """(block, is_tail, bins, n0, n1): rows of the first and second outcome value in every cell of every block; stored.

    One pass over the rows (and one over the values, for the bins). Rows without an outcome are in no cell.
    """
    ends = trees.feature_thresholds(blocked, features, max_bins)
    values = outcome_values(blocked, outcome)
    second = F.col(outcome) == F.lit(values[1]) if len(values) > 1 else F.col(outcome).isNotNull() & F.lit(False)
    rows = trees.binned(blocked, features, ends).where(F.col(outcome).isNotNull())
    return stored(trees.count_cells(rows, len(features), second.cast("int"), [block_col, "is_tail"]), "cells")


def by_frequency(cells: DataFrame) -> DataFrame:
    """Class 0 becomes each fold's more frequent training class (ties: the first value), as a label index does: where ``flip`` is true."""
    swap = lambda a, b: F.when(F.col("flip"), F.col(b)).otherwise(F.col(a)).alias(a)
    rest = [c for c in cells.columns if c not in ("n0", "n1", "t0", "t1", "flip")]
    return cells.select(*rest, swap("n0", "n1"), swap("n1", "n0"), swap("t0", "t1"), swap("t1", "t0"))


def _forest_predictions(cells: DataFrame, n_features: int, params: dict) -> tuple[DataFrame, DataFrame]:
    """(cells with predictions, splits) of a forest per fold."""
    depth = params.get("maxDepth", 5)
    splits = trees.grow_forest(cells.where("n0 + n1 > 0"), n_features, params.get("numTrees", 20), depth,
                               params.get("featureSubsetStrategy", "auto"), params.get("seed", 1))
    return trees.forest_votes(splits, cells, n_features, depth), splits


def _boosted_predictions(cells: DataFrame, n_features: int, params: dict, folds: Sequence[int], max_parallel: int,
                         task_cells: int = trees.TASK_CELLS) -> DataFrame:
    """Cells with predictions of boosted trees per fold, fitted on the cells with their counts as weights.

    Folds of up to ``task_cells`` cells are fitted in tasks, small ones together, without subsampling; others, and all where ``params`` has
    more than iterations, depth, bins, step and seed, by MLlib.
    """
    names = trees.bin_columns(n_features)
    if set(params) <= {"maxIter", "maxDepth", "maxBins", "stepSize", "seed"} and trees.fold_sizes(cells)[0] <= task_cells:
        return trees.boosted_predictions(cells, n_features, params.get("maxIter", 20), params.get("maxDepth", 5), params.get("stepSize", 0.1))
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    params = {"maxBins": 32, **params}

    def one(i: int) -> DataFrame:
        mine = stored(cells.where(F.col("fold") == i), "fold-cells")
        label = F.explode(F.array(F.struct(F.lit(0.0).alias("label"), F.col("n0").alias("w")), F.struct(F.lit(1.0).alias("label"), F.col("n1").alias("w"))))
        train = mine.select(*names, label.alias("x")).select(*names, "x.label", F.col("x.w").cast("double").alias("weight")).where("weight > 0")
        train = stored(train.repartition(max(1, -(-train.count() // FIT_CELLS))), "train")
        estimator = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **params)
        model = Pipeline(stages=[assembler, estimator]).fit(train)
        return stored(model.transform(mine).select(*mine.columns, "prediction"), "scored")

    with ThreadPoolExecutor(max_workers=max(1, min(max_parallel, len(folds)))) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _predictions(cells: DataFrame, n_features: int, kind: str, params: dict, folds: Sequence[int], max_parallel: int) -> DataFrame:
    if kind == "forest":
        return _forest_predictions(cells, n_features, params)[0]
    if kind == "gbt":
        return _boosted_predictions(cells, n_features, params, folds, max_parallel)
    raise ValueError(f"unknown model {kind!r}")


def _defaults(kind: str, params: dict | None) -> dict:
    return params or (GBT_PARAMS if kind == "gbt" else FOREST_FOLDS)


def fold_training_cells(blocked: DataFrame, features: Sequence[str], outcome: str = "DOA", block_col: str = "block", max_bins: int = 100,
                        folds: Sequence[int] | None = None) -> tuple[DataFrame, list[int]]:
    """(fold, bins, n0, n1, t0, t1) of every full block, by frequency of the training classes, and the folds; stored.

    Empty below two full blocks, where no fold could be trained.
    """
    cells = fold_cells(blocked, features, outcome, block_col, max_bins)
    sums = stored(cells.groupBy(F.col(block_col).cast("int").alias("fold")).agg(
        F.bool_and("is_tail").alias("is_tail"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "blocks")
    full = sorted(r[0] for r in sums.where(~F.col("is_tail")).select("fold").collect())
    wanted = [] if len(full) < 2 else [i for i in full if folds is None or i in set(folds)]
    chosen = sums.where(~F.col("is_tail")) if folds is None else sums.where(F.col("fold").isin(wanted))
    # Block numbers are a row each: as many as there are models to fit.
    whole = sums.agg(F.sum("n0").alias("a0"), F.sum("n1").alias("a1"))
    flip = F.col("a1") - F.col("n1") > F.col("a0") - F.col("n0")
    chosen = stored((chosen if wanted else chosen.limit(0)).crossJoin(whole).select("fold", flip.alias("flip")), "wanted")
    return stored(by_frequency(trees.leave_one_out(cells.drop("is_tail"), len(features), block_col, chosen)), "fold-cells"), wanted


def evaluate_folds(blocked: DataFrame, features: Sequence[str], outcome: str = "DOA", kind: str = "forest",
                   params: dict | None = None, block_col: str = "block", evaluate_on: str = "test",
                   max_parallel: int = 4, folds: Sequence[int] | None = None) -> DataFrame:
    """Leave-one-block-out evaluation: one row per full block ``num, accuracy, precision, recall, f1``.

    For fold i the model is fitted on every other row (tail included), with
    label 1 for the less frequent class of those training rows, and scored on
    block i (``evaluate_on="train"`` scores the training rows, as the reference's
    code path does). ``folds`` limits the work to some blocks: there is a model
    for each. Needs at least two blocks; otherwise the result is empty.
    """
    spark = blocked.sparkSession
    params = _defaults(kind, params)
    cells, wanted = fold_training_cells(blocked, features, outcome, block_col, _bins(kind, params), folds)
    if not wanted:
        return binary_metrics(spark.createDataFrame([], FOLD_COUNTS))
    scored = _predictions(cells, len(features), kind, params, wanted, max_parallel)
    no, yes = ("t0", "t1") if evaluate_on == "test" else ("n0", "n1")
    said = F.col("prediction") == 1
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    counts = scored.groupBy(F.col("fold").cast("long").alias("num")).agg(
        total(yes, said).alias("tp"), total(no, ~said).alias("tn"), total(no, said).alias("fp"), total(yes, ~said).alias("fn"),
        F.sum(F.col(no) + F.col(yes)).alias("n"))
    return binary_metrics(stored(counts, "folds"))


def _split_cells(df: DataFrame, features: Sequence[str], label: F.Column, test: F.Column, max_bins: int) -> DataFrame:
    """(fold = 0, bins, n0, n1, t0, t1): training and test counts of one split; stored."""
    rows = trees.binned(df, features, trees.feature_thresholds(df, features, max_bins))
    count = lambda side, y: F.count_if(side & (label == y))
    return stored(rows.groupBy(F.lit(0).alias("fold"), *trees.bin_columns(len(features))).agg(
        count(~test, 0).alias("n0"), count(~test, 1).alias("n1"), count(test, 0).alias("t0"), count(test, 1).alias("t1")), "cells")


def forest_table(df: DataFrame, features: Sequence[str], label: str, params: dict | None = None) -> DataFrame:
    """The splits of one forest fitted on all rows with a 0/1 ``label`` (see ``trees.grow_forest``); stored."""
    params = params or FOREST_FOLDS
    cells = _split_cells(df, features, F.col(label), F.lit(False), _bins("forest", params))
    return trees.grow_forest(cells, len(features), params.get("numTrees", 20), params.get("maxDepth", 5), params.get("featureSubsetStrategy", "auto"),
                             params.get("seed", 1))


def evaluate_holdout(df: DataFrame, features: Sequence[str], outcome: str = "DOA", key: str | None = None,
                     train_fraction: float = 0.7, seed: int = 5043,
                     models: Sequence[tuple[str, str, dict]] = (("forest", "forest", FOREST_HOLDOUT),
                                                                 ("gbt", "gbt", GBT_PARAMS))) -> DataFrame:
    """One split, several models, test accuracy each: (model, n, correct, accuracy).

    With ``key`` the split is md5-keyed (reproducible anywhere); without it
    the rows are split by a seeded random number, which is written once.
    """
    from cohortlens.operators.sampling import holdout_split

    values = outcome_values(df, outcome)
    label = (F.col(outcome) == F.lit(values[-1])).cast("int") if len(values) > 1 else F.lit(0)
    if key:
        split = holdout_split(df, key, train_fraction, seed)
    else:
        split = stored(df.withColumn("split", F.when(F.rand(seed) < train_fraction, F.lit("train")).otherwise(F.lit("test"))), "split")
    split = split.where(F.col(outcome).isNotNull())
    out = None
    for name, kind, params in models:
        cells = _split_cells(split, features, label, F.col("split") == "test", _bins(kind, params))
        scored = _predictions(cells, len(features), kind, params, [0], 1)
        right = F.when(F.col("prediction") == 1, F.col("t1")).otherwise(F.col("t0"))
        acc = scored.agg(F.sum(F.col("t0") + F.col("t1")).alias("n"), F.sum(right).alias("correct"))
        acc = acc.select(F.lit(name).alias("model"), "n", "correct",
                         F.round(F.try_divide(F.col("correct").cast("double"), F.col("n").cast("double")), 6)
                         .alias("accuracy"))
        out = acc if out is None else out.unionByName(acc)
    return out


def cross_val_predictions(df: DataFrame, features: Sequence[str], label: str, fold_col: str = "fold",
                          kind: str = "forest", params: dict | None = None, max_parallel: int = 3) -> DataFrame:
    """Out-of-fold predictions: every row scored by the model not trained on its fold."""
    params = params or _defaults(kind, params)
    n = len(features)
    rows = trees.binned(df.withColumn("label", F.col(label).cast("double")), features, trees.feature_thresholds(df, features, _bins(kind, params)))
    cells = stored(trees.count_cells(rows, n, F.col("label"), [fold_col]), "cells")
    numbers = stored(cells.select(F.col(fold_col).cast("int").alias("fold")).distinct(), "numbers")
    folds = sorted(r[0] for r in numbers.collect())
    per_fold = stored(trees.leave_one_out(cells.withColumnRenamed(fold_col, "_own"), n, "_own", numbers), "fold-cells")
    scored = _predictions(per_fold, n, kind, params, folds, max_parallel).where("t0 + t1 > 0")
    keys = trees.bin_columns(n)
    scored = stored(scored.select(F.col("fold").alias("_fold"), *[F.col(b).alias(f"_{b}") for b in keys], "prediction"), "scored")
    same = rows[fold_col] == scored["_fold"]
    for b in keys:
        same = same & (rows[b] == scored[f"_{b}"])
    return rows.join(scored, same).drop("_fold", *keys, *[f"_{b}" for b in keys])
