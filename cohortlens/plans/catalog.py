"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables (or data Spark derives from them) in full.
Computed columns carry the same names as in :mod:`cohortlens.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.evaluation import (
    binary_metrics, confusion_counts, holdout_accuracy, index_label, label_mapping, mean_fold_accuracy, per_class_metrics,
    restore_label,
)
from cohortlens.operators.sampling import exact_sample, hash_sample, holdout_split, id_difference, rebalance
from cohortlens.operators.synthesis import (
    blocked_outcomes, expected_cells, fixed_rate_config, independent_marginals, marginals, normal_attribute, quota_assign,
    synthesize_cohorts,
)
from cohortlens.operators.odds import odds_ratio_expr
from cohortlens.operators.similarity import (
    DIST_COLS, dataset_pairs, distance_summary, joint_minmax, match_rank_aligned, nearest_neighbor, pair_rows,
    rank_aligned_matches, with_incomplete,
)
from cohortlens.functions.columns import row_sum
from cohortlens.functions.columns import cast_all, project, rename_positional, suffix_columns, valid_rows
from cohortlens.operators.misc import register_views, top_n
from cohortlens.session import scratch_path, stored
from cohortlens.sources.csv import parse_provenance, read_clinical, read_cohorts, write_cohort_csv
from cohortlens.sources.sinks import write_table
from cohortlens.sources.testdata import COHORT_COLUMNS
from cohortlens.operators.models import (
    CLINICAL_FOREST, FOREST_FOLDS, FOREST_HOLDOUT, cross_val_predictions, evaluate_folds, evaluate_holdout, fold_training_cells, forest_table,
)
from cohortlens.operators.trees import forest_importances
from cohortlens.sources.testdata import MODEL_FEATURES
from cohortlens.operators.matching import match_exact, match_sampled, sampled_matches
from cohortlens.operators.pairwise import pairwise_similarity
from cohortlens.operators.blocks import block_summary, contiguous_blocks, fold_summary, stratified_folds
from cohortlens.operators.odds import contingency, odds_ratios, threshold_odds_scan
from cohortlens.operators.profile import complete_cases, impute_constant, null_profile, shape
from cohortlens.operators.ranking import average_rank
from cohortlens.operators.stats import corr_matrix, corr_pivot, marginal_report, value_counts
from cohortlens.sources.testdata import CORR_COLUMNS, FEATURES_WITH_HF, clinical, cohort, load_table

# Size of the contiguous blocks: one that leaves a tail at every scale factor.
BLOCK_K = 2_300
Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the reference's jobs.
MODEL_K = 10_000          # fold size of the model evaluations
THRESHOLD_STEP = 1_000    # threshold scan step (block size of the prototype)


def q_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contingency(cohort(spark, sf_dir), FEATURES_WITH_HF, "DOA")


def q_odds_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odds_ratios(contingency(cohort(spark, sf_dir), FEATURES_WITH_HF, "DOA"))


def q_odds_ratios_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odds_ratios(contingency(cohort(spark, sf_dir), FEATURES_WITH_HF, "DOA", by=["dataset_id"]))


def q_global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir, with_index=True)
    return c.select("dataset_id", "index", "Age", "Gender", "PT", "PTT", "Platelets", "HF", "DOA")


def q_threshold_odds_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_odds_scan(cohort(spark, sf_dir, with_index=True), "index", "DOA", THRESHOLD_STEP)


def _blocked(spark: SparkSession, sf_dir: str, k: int = BLOCK_K) -> DataFrame:
    return contiguous_blocks(cohort(spark, sf_dir, with_index=True), k, "index")


def q_contiguous_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_summary(_blocked(spark, sf_dir))


def q_block_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_summary(_blocked(spark, sf_dir))


def q_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clinical(spark, sf_dir)
    return stratified_folds(c, "outcome", "doc_id", n_folds=3, seed=42).select("doc_id", "outcome", "fold")


def _full_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocked(spark, sf_dir).where(~F.col("is_tail"))


def q_corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corr_matrix(_full_blocks(spark, sf_dir), CORR_COLUMNS, ["block"], "pearson")


def q_corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corr_matrix(_full_blocks(spark, sf_dir), CORR_COLUMNS, ["block"], "spearman")


def q_corr_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _full_blocks(spark, sf_dir)
    long = corr_matrix(blocks, CORR_COLUMNS, ["block"], "pearson").unionByName(
        corr_matrix(blocks, CORR_COLUMNS, ["block"], "spearman"))
    return corr_pivot(long, CORR_COLUMNS, ["block"])


def q_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = average_rank(_blocked(spark, sf_dir), ["Age", "Platelets"], ["block"])
    return ranked.select("index", "block", "Age_rank", "Platelets_rank")


def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(clinical(spark, sf_dir), "outcome")


def q_marginal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marginal_report(clinical(spark, sf_dir), ["quality", "toxic"])


def q_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_profile(clinical(spark, sf_dir))


def q_impute_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute_constant(clinical(spark, sf_dir), -1)


def q_complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_cases(clinical(spark, sf_dir))


def q_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(clinical(spark, sf_dir))


def rule_prediction(df: DataFrame) -> DataFrame:
    """A fixed rule classifier in label space (1.0 = dead when deaths are the minority).

    Lets the metric operators be checked by SQL without a fitted model.
    """
    dead = ((F.col("PT") == 0) & (F.col("Platelets") == 0)) | (F.col("Age") > 45)
    return df.withColumn("prediction", F.when(dead, F.lit(1.0)).otherwise(F.lit(0.0)))


def _scored(spark: SparkSession, sf_dir: str, with_index: bool = False) -> DataFrame:
    return rule_prediction(index_label(cohort(spark, sf_dir, with_index=with_index), "DOA", "label"))


def q_index_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_mapping(cohort(spark, sf_dir), "DOA", "label")


def q_confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_counts(_scored(spark, sf_dir), by=["dataset_id"])


def q_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_metrics(confusion_counts(_scored(spark, sf_dir), by=["dataset_id"]))


def q_per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_class_metrics(_scored(spark, sf_dir))


def q_holdout_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = holdout_split(_scored(spark, sf_dir, with_index=True), "id", 0.7, 5043)
    return holdout_accuracy(split.where(F.col("split") == "test"))


def q_restore_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted indices back to outcome values, counted against the true ones."""
    c = cohort(spark, sf_dir)
    back = restore_label(rule_prediction(c), label_mapping(c, "DOA", "label"), "DOA", "label")
    return back.groupBy("dataset_id", "DOA", "predicted_value").agg(F.count(F.lit(1)).alias("n"))


def q_mean_fold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy of a rule over the stratified folds of the clinical table."""
    folded = stratified_folds(clinical(spark, sf_dir), "outcome", "doc_id", n_folds=3, seed=42)
    scored = folded.select("fold", F.col("outcome").cast("double").alias("label"),
                           F.when(F.col("n_chars") > 1000, F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction"))
    return mean_fold_accuracy(holdout_accuracy(scored, by=["fold"]))


def q_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_sample(cohort(spark, sf_dir, with_index=True), "id", 0.2, 100).select("id", "dataset_id", "DOA")


def q_exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir, with_index=True)
    return exact_sample(c, 500, "id", ["dataset_id"], seed=7).select("dataset_id", "id")


def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = holdout_split(cohort(spark, sf_dir, with_index=True), "id", 0.7, 5043)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("DOA") == 0).alias("n_dead"))


def q_id_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir, with_index=True)
    return id_difference(c.select("id", "dataset_id"), c.where(F.col("DOA") == 0), "id")


def q_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir, with_index=True).select("id", "DOA")
    return rebalance(c, "DOA", 0.1 + 0.1 * 2, seed=2, key="id")


def measured_config(c: DataFrame) -> DataFrame:
    """Per (dataset, feature): n, dead, alive, low, high and the measured odds ratio.

    The generators' configuration taken from the data itself, so synthetic
    cohorts reproduce each dataset's marginals and odds ratios.
    """
    cells = contingency(c, FEATURES_WITH_HF, "DOA", by=["dataset_id"])
    sizes = c.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("DOA") == 0).alias("dead"))
    return (cells.join(sizes, "dataset_id")
            .select("dataset_id", "feature", "n", "dead", (F.col("n") - F.col("dead")).alias("alive"),
                    (F.col("dead_low") + F.col("alive_low")).alias("low"),
                    (F.col("dead_high") + F.col("alive_high")).alias("high"),
                    odds_ratio_expr().alias("odds_ratio")))


def _expected(c: DataFrame) -> DataFrame:
    return expected_cells(measured_config(c)).withColumn("odds_ratio", F.round("odds_ratio", 6))


def q_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = measured_config(cohort(spark, sf_dir))
    rates = cfg.select("dataset_id", "feature", "n",
                       (F.col("dead") / F.col("n")).alias("dead_rate"),
                       (F.col("low") / F.col("n")).alias("low_rate"))
    return marginals(rates, "ceil").drop("dead_rate", "low_rate")


def q_fixed_rate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed-rate variant at the size of each dataset: floored marginals and the cells for its odds ratios."""
    sizes = cohort(spark, sf_dir).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return expected_cells(marginals(fixed_rate_config(sizes), "floor")).drop("dead_rate", "low_rate", "high_rate")


def q_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that cannot be had: odds ratios that are null or negative, and marginals that do not fit."""
    cfg = measured_config(cohort(spark, sf_dir))
    bad = (F.when(F.col("feature") == "PT", F.lit(None).cast("double")).when(F.col("feature") == "PTT", F.lit(-1.0))
           .otherwise(F.col("odds_ratio")))
    low = F.when(F.col("feature") == "HF", -F.col("low")).otherwise(F.col("low"))
    return (expected_cells(cfg.withColumn("odds_ratio", bad).withColumn("low", low))
            .select("dataset_id", "feature", "dead_low", "dead_high", "alive_low", "alive_high", "reason"))


def q_expected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expected(cohort(spark, sf_dir))


def q_quota_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir, with_index=True)
    return quota_assign(c.select("dataset_id", "id", "DOA"), _expected(c), FEATURES_WITH_HF)


def q_synthesize_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir, with_index=True)
    cells = _expected(c)
    dead = cells.select("dataset_id", "dead").distinct()
    return synthesize_cohorts(c.select("dataset_id", "id"), dead, cells, FEATURES_WITH_HF)


def q_normal_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_attribute(cohort(spark, sf_dir, with_index=True).select("id"), "id", 1)


def q_independent_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return independent_marginals(cohort(spark, sf_dir, with_index=True).select("dataset_id", "id"))


def q_blocked_threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir, with_index=True).select("id", "index")
    return threshold_odds_scan(blocked_outcomes(c, "index", THRESHOLD_STEP), "index", "DOA", THRESHOLD_STEP)


def _sim_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 7-column cohort (id, Age, Gender, PT, PTT, Platelets, DOA) per dataset."""
    c = cohort(spark, sf_dir, with_index=True, with_hf=False)
    return c.select("dataset_id", "id", *DIST_COLS)


def _gappy_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort with values missing: every 7th Age and every 11th PT by id."""
    c = _sim_cohort(spark, sf_dir)
    return (c.withColumn("Age", F.when(F.col("id") % 7 != 0, F.col("Age"))).withColumn("PT", F.when(F.col("id") % 11 != 0, F.col("PT"))))


def q_match_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-aligned matching of rows with missing values: they are left out and counted."""
    return match_rank_aligned(_gappy_cohort(spark, sf_dir))


def q_nearest_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _gappy_cohort(spark, sf_dir)
    return nearest_neighbor(c).select("ds_a", "ds_b", "n_matched", "n_incomplete")


def q_dataset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_pairs(cohort(spark, sf_dir))


def q_joint_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir)
    return joint_minmax(c, dataset_pairs(c))


def q_row_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_rows(_sim_cohort(spark, sf_dir))
    return rows.select("ds_a", "ds_b", "side", "id", F.round(row_sum(DIST_COLS), 9).alias("row_sum"))


def q_mean_abs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rank_aligned_matches(_sim_cohort(spark, sf_dir))
    return m.select("ds_a", "ds_b", "rank", "l_id", "r_id", F.round("distance", 9).alias("distance"))


def q_match_rank_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rank_aligned(_sim_cohort(spark, sf_dir))


def q_distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance_summary(rank_aligned_matches(_sim_cohort(spark, sf_dir)))


def q_nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Row ids are not needed for nearest distances: skip the global sort.
    c = cohort(spark, sf_dir, with_hf=False)
    return nearest_neighbor(c.select("dataset_id", *DIST_COLS))


def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the cohort as headerless CSV, one directory per dataset; scan the folder back as one table."""
    c = _sim_cohort(spark, sf_dir)
    path = scratch_path(spark, "cohort-csv")
    write_cohort_csv(c, path, COHORT_COLUMNS, partition_col="dataset_id")
    back = read_cohorts(spark, path, COHORT_COLUMNS, dataset_col="source_path")
    ds = F.regexp_extract("source_path", r"dataset_id=(\d+)", 1).cast("int")
    return back.select(ds.alias("dataset_id"), F.col("id").cast("long").alias("id"), *DIST_COLS)


def provenance_label(cfg: DataFrame) -> DataFrame:
    """The reference's file-name provenance per dataset: seeds j..j+6, then four odds ratios."""
    wide = cfg.groupBy("dataset_id").pivot("feature", ["Gender", "PT", "PTT", "Platelets"]).agg(
        F.first(F.format_string("%.2f", F.col("odds_ratio"))))
    j = F.col("dataset_id")
    seeds = F.concat(*[(j + F.lit(i)).cast("string") for i in range(7)])
    return wide.select("dataset_id", F.concat(F.lit("dataset_"), seeds, F.lit("_"),
                                              F.concat_ws("_", "Gender", "PT", "PTT", "Platelets"),
                                              F.lit("_20260101_000000")).alias("provenance"))


def q_parse_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write datasets under provenance-named folders, read them back, parse the names."""
    c = _sim_cohort(spark, sf_dir)
    # Stored, so that the planner sees that it is one row a dataset: joined by a shuffle, each dataset would be one task.
    labels = stored(provenance_label(measured_config(cohort(spark, sf_dir))), "labels")
    path = scratch_path(spark, "cohort-prov")
    write_cohort_csv(c.join(labels, "dataset_id"), path, COHORT_COLUMNS, partition_col="provenance")
    back = parse_provenance(read_cohorts(spark, path, COHORT_COLUMNS, dataset_col="source_path"), "source_path")
    return back.groupBy("seeds", "gender_or", "pt_or", "ptt_or", "platelet_or", "created").agg(
        F.count(F.lit(1)).alias("rows"))


def q_read_clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header CSV sink and scan of the clinical table, explicit schema."""
    c = clinical(spark, sf_dir)
    path = write_table(c, scratch_path(spark, "clinical-csv"), fmt="csv", header=True)
    schema = "doc_id BIGINT, n_chars BIGINT, quality INT, toxic INT, lang STRING, source STRING, outcome INT"
    return read_clinical(spark, path, schema)


def q_cast_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string cells -> doubles (junk -> null) -> positional names."""
    li = load_table(spark, sf_dir, "lineitem")
    raw = li.select(F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"),
                    F.col("l_returnflag"), F.col("l_discount").cast("string"))
    return rename_positional(cast_all(raw, "double"), ["id", "Age", "flag", "PT"])


def q_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_columns(project(_sim_cohort(spark, sf_dir), ["id", "Age", "DOA"]), "df1")


def q_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir, with_index=True)
    labs = independent_marginals(c.select("dataset_id", "id")).join(c.select("id", "Age"), "id")
    return valid_rows(labs).select("id", "dataset_id", "Age", "PT", "PTT", "Platelets")


def q_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir, with_index=True)
    return top_n(c.select("id", "dataset_id", "Age", "DOA"), [F.desc("Age"), F.asc("id")], 10)


def q_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(cohort(spark, sf_dir), ["dataset_id", "Age", "DOA"])


def q_register_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, {"INPUT": contiguous_blocks(cohort(spark, sf_dir, with_index=True), BLOCK_K)})
    return spark.sql("SELECT block, count(*) AS n, count_if(DOA = 0) AS n_dead, min(`index`) AS low, "
                     "max(`index`) AS high FROM INPUT GROUP BY block")


def q_evaluate_folds_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_folds(_blocked(spark, sf_dir, MODEL_K), MODEL_FEATURES, "DOA", "forest")


def q_evaluate_folds_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_folds(_blocked(spark, sf_dir, MODEL_K), MODEL_FEATURES, "DOA", "gbt")


def _consistent(num: str, den: str, ratio: str) -> F.Column:
    want = F.round(F.try_divide(F.expr(num).cast("double"), F.expr(den).cast("double")), 6)
    return F.col(ratio).eqNullSafe(want)


def q_fold_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and test counts of every cell of every fold: what the models of the folds are fitted on."""
    cells, _ = fold_training_cells(_blocked(spark, sf_dir, MODEL_K), MODEL_FEATURES)
    return cells


def q_fold_evaluation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written fold table, fold sizes, positives and the metrics' arithmetic, of every fold."""
    blocks = _blocked(spark, sf_dir, MODEL_K // 4)
    small = dict(numTrees=3, maxDepth=3, seed=5043)
    path = write_table(evaluate_folds(blocks, MODEL_FEATURES, "DOA", "forest", small), scratch_path(spark, "folds"))
    return spark.read.parquet(path).select("num", "n", (F.col("tp") + F.col("fn")).alias("positives"),
                        ((F.expr("tp + tn + fp + fn = n")) & _consistent("tp + tn", "n", "accuracy") & _consistent("tp", "tp + fp", "precision")
                         & _consistent("tp", "tp + fn", "recall") & _consistent("2 * tp", "2 * tp + fp + fn", "f1")).alias("consistent"))


def q_holdout_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test size and arithmetic of a hold-out evaluation with small models."""
    models = (("forest", "forest", dict(numTrees=3, maxDepth=3, seed=5043)), ("gbt", "gbt", dict(maxIter=3, maxDepth=3, seed=5043)))
    out = evaluate_holdout(cohort(spark, sf_dir, with_index=True), MODEL_FEATURES, "DOA", key="id", models=models)
    return out.select("model", "n", (_consistent("correct", "n", "accuracy") & (F.col("correct") <= F.col("n"))).alias("consistent"))


def q_importance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances of a small forest are shares of one, for every feature."""
    c = index_label(cohort(spark, sf_dir), "DOA", "label")
    table = forest_importances(forest_table(c, MODEL_FEATURES, "label", {**FOREST_FOLDS, "numTrees": 5}), MODEL_FEATURES)
    return table.agg(F.count_distinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
                     F.min(F.col("importance") >= 0).alias("no_negative"))


def q_clinical_cv_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is predicted once, out of its fold."""
    c = impute_constant(clinical(spark, sf_dir), -1)
    folded = stratified_folds(c, "outcome", "doc_id", n_folds=3, seed=42)
    pred = cross_val_predictions(folded, CLINICAL_FEATURES, "outcome", "fold", "forest", dict(numTrees=2, maxDepth=3, seed=42))
    return pred.groupBy("fold", "outcome").agg(F.count_distinct("doc_id").alias("rows"), F.count("prediction").alias("predictions"))


def q_evaluate_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_holdout(cohort(spark, sf_dir, with_index=True), MODEL_FEATURES, "DOA", key="id")


def q_holdout_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of the hold-out evaluation alone."""
    return evaluate_holdout(cohort(spark, sf_dir, with_index=True), MODEL_FEATURES, "DOA", key="id", models=(("forest", "forest", FOREST_HOLDOUT),))


def q_importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = index_label(cohort(spark, sf_dir), "DOA", "label")
    table = forest_importances(forest_table(c, MODEL_FEATURES, "label"), MODEL_FEATURES)
    return table.withColumn("importance", F.round("importance", 6)).orderBy(F.desc("importance"), F.asc("feature"))


CLINICAL_FEATURES = ["n_chars", "quality", "toxic"]


def q_clinical_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impute -1, stratified 3 folds, 10-tree forest, out-of-fold per-class precision/recall."""
    c = impute_constant(clinical(spark, sf_dir), -1)
    folded = stratified_folds(c, "outcome", "doc_id", n_folds=3, seed=42)
    pred = cross_val_predictions(folded, CLINICAL_FEATURES, "outcome", "fold", "forest", CLINICAL_FOREST)
    return per_class_metrics(pred, "label", "prediction")


def q_match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_exact(_sim_cohort(spark, sf_dir))


def q_match_exact_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact matching by ranges of values, level by level, as pairs too large for a task go."""
    return match_exact(_sim_cohort(spark, sf_dir), max_task_edges=0)


def q_match_exact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the exact matching with missing values, and the bounds of its distances."""
    s = match_exact(_gappy_cohort(spark, sf_dir))
    return s.select("ds_a", "ds_b", "n_matched", "n_unmatched", "n_incomplete",
                    F.expr("0 <= min_distance and min_distance <= avg_distance and avg_distance <= max_distance and max_distance <= 1"
                           " and n_nonzero <= n_matched").alias("in_bounds"))


def q_match_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_sampled(_sim_cohort(spark, sf_dir))


def q_match_sampled_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled matching is one to one and leaves no row that could be matched, values missing."""
    c = _gappy_cohort(spark, sf_dir)
    pair, inside = ["ds_a", "ds_b"], (F.col("distance") >= 0) & (F.col("distance") <= 1)

    def distinct_ids(matched: DataFrame) -> DataFrame:
        # Distinct ids by a grouping a side: together they would be a copy of every row for each side.
        left = (matched.groupBy(*pair, "l_id").agg(F.count(F.lit(1)).alias("n"), F.min(inside).alias("in_bounds")).groupBy(*pair)
                .agg(F.sum("n").alias("n_matched"), F.count("l_id").alias("n_left"), F.min("in_bounds").alias("in_bounds")))
        right = matched.groupBy(*pair, "r_id").agg(F.lit(1)).groupBy(*pair).agg(F.count("r_id").alias("n_right"))
        return left.join(right, pair).select(*pair, "n_matched", "n_left", "n_right", "in_bounds")

    s, _ = sampled_matches(c, summary=distinct_ids)
    return with_incomplete(s, c)


def q_pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in the reference's sink layout, by rank, written as a table and read again."""
    path = write_table(pairwise_similarity(_sim_cohort(spark, sf_dir), "rank"), scratch_path(spark, "pairs"), fmt="csv")
    return spark.read.csv(path, header=True, schema="File1 int, File2 int, avgDistance double, minDistance double, "
                                                    "maxDistance double, zeroDistPercent double")


def q_pairwise_similarity_nearest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_similarity(_sim_cohort(spark, sf_dir), "nearest")


def queries() -> dict[str, Query]:
    return {
        "odds_ratios": q_odds_ratios,
        "contingency": q_contingency,
        "odds_ratios_by_dataset": q_odds_ratios_by_dataset,
        "global_index": q_global_index,
        "threshold_odds_scan": q_threshold_odds_scan,
        "contiguous_blocks": q_contiguous_blocks,
        "block_folds": q_block_folds,
        "stratified_folds": q_stratified_folds,
        "corr_pearson": q_corr_pearson,
        "corr_spearman": q_corr_spearman,
        "corr_pivot": q_corr_pivot,
        "average_rank": q_average_rank,
        "value_counts": q_value_counts,
        "marginal_report": q_marginal_report,
        "null_profile": q_null_profile,
        "impute_constant": q_impute_constant,
        "complete_cases": q_complete_cases,
        "shape": q_shape,
        "index_label": q_index_label,
        "confusion_counts": q_confusion_counts,
        "binary_metrics": q_binary_metrics,
        "per_class_metrics": q_per_class_metrics,
        "holdout_accuracy": q_holdout_accuracy,
        "hash_sample": q_hash_sample,
        "exact_sample": q_exact_sample,
        "holdout_split": q_holdout_split,
        "id_difference": q_id_difference,
        "rebalance": q_rebalance,
        "marginals": q_marginals,
        "expected_cells": q_expected_cells,
        "quota_assign": q_quota_assign,
        "synthesize_cohorts": q_synthesize_cohorts,
        "normal_attribute": q_normal_attribute,
        "independent_marginals": q_independent_marginals,
        "blocked_threshold_scan": q_blocked_threshold_scan,
        "dataset_pairs": q_dataset_pairs,
        "joint_minmax": q_joint_minmax,
        "row_sum": q_row_sum,
        "mean_abs_distance": q_mean_abs_distance,
        "match_rank_aligned": q_match_rank_aligned,
        "distance_summary": q_distance_summary,
        "nearest_neighbor": q_nearest_neighbor,
        "csv_round_trip": q_csv_round_trip,
        "parse_provenance": q_parse_provenance,
        "read_clinical": q_read_clinical,
        "cast_rename": q_cast_rename,
        "suffix_columns": q_suffix_columns,
        "valid_rows": q_valid_rows,
        "top_n": q_top_n,
        "project": q_project,
        "register_views": q_register_views,
        "evaluate_folds_forest": q_evaluate_folds_forest,
        "evaluate_folds_gbt": q_evaluate_folds_gbt,
        "evaluate_holdout": q_evaluate_holdout,
        "importance_table": q_importance_table,
        "clinical_cv": q_clinical_cv,
        "match_sampled": q_match_sampled,
        "match_exact": q_match_exact,
        "match_exact_levels": q_match_exact_levels,
        "match_exact_check": q_match_exact_check,
        "match_sampled_all": q_match_sampled_all,
        "match_with_gaps": q_match_with_gaps,
        "nearest_with_gaps": q_nearest_with_gaps,
        "pairwise_similarity_nearest_all": q_pairwise_similarity_nearest_all,
        "restore_label": q_restore_label,
        "mean_fold_accuracy": q_mean_fold_accuracy,
        "fixed_rate_cells": q_fixed_rate_cells,
        "missing_cells": q_missing_cells,
        "fold_evaluation_all": q_fold_evaluation_all,
        "fold_cells": q_fold_cells,
        "holdout_check": q_holdout_check,
        "holdout_forest": q_holdout_forest,
        "importance_check": q_importance_check,
        "clinical_cv_check": q_clinical_cv_check,
        "pairwise_similarity": q_pairwise_similarity,
    }
