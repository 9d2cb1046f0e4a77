"""Pairwise-comparison analytics on Spark: fits of human and judges' comparisons, their intervals and tests, and measures of scores."""

from .api import (
    calibration_test,
    fit_consensus,
    fit_human,
    fit_isotonic,
    fit_joint,
    fit_judges,
    fit_pooled,
    fit_selected,
    fit_staged,
    joint_intervals,
    judge_intervals,
    rank_by_bic,
    selection_path,
)
from .operators.metrics import coverage, evaluate_scores, human_sign_accuracy, kendall, log_loss, mse, ndcg, record_accuracy, sign_accuracy, spearman

__all__ = [
    "calibration_test", "coverage", "evaluate_scores", "fit_consensus", "fit_human", "fit_isotonic", "fit_joint", "fit_judges", "fit_pooled", "fit_selected", "fit_staged",
    "human_sign_accuracy", "joint_intervals", "judge_intervals", "kendall", "log_loss", "mse", "ndcg", "rank_by_bic", "record_accuracy", "selection_path", "sign_accuracy", "spearman",
]
