"""Attack detection in logs of SQL statements, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from querysentry.operators.autoencoder import (
    fit_autoencoder,
    fit_lexical_autoencoder,
    reconstruction_error_by_feature,
    score_autoencoder,
)
from querysentry.operators.curves import auprc, auroc, curve_areas, pr_curve, roc_curve
from querysentry.operators.forest import nearest_by_forest
from querysentry.operators.lexical import escape_counts, lexical_features
from querysentry.operators.metrics import basic_metrics, confusion, exceedance, predict, threshold, threshold_fixed_fpr
from querysentry.operators.neighbours import fit_lof, nearest_neighbours, score_lof
from querysentry.operators.one_class import fit_one_class_svm, score_one_class_svm
from querysentry.operators.scoring import score_table, throughput
from querysentry.operators.selection import sample_fraction, sample_n, validation_split
from querysentry.operators.traces import assert_one_to_one, fill_failed_traces, merge_traces, pending, traces_per_split
from querysentry.operators.tree import explode_edges, explode_nodes, statement_features, tag_counts, trace_features
from querysentry.plans.evaluation import evaluate_grid, model_report
from querysentry.plans.features import hybrid_features, training_table
from querysentry.sources.sinks import load_model, materialize, save_model, write_curves, write_results
from querysentry.sources.tables import read_labelled_queries, read_null_normalised_csv, read_trace_log
from querysentry.streaming.logs import stream_alerts, stream_features, stream_trace_log
from querysentry.streaming.merging import late_invocations, stream_merge_invocations

# Executors get the package's few Python functions with the task, not by import, so
# nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "assert_one_to_one", "auprc", "auroc", "basic_metrics", "confusion", "curve_areas", "escape_counts",
    "evaluate_grid", "exceedance", "explode_edges", "explode_nodes", "fill_failed_traces", "fit_autoencoder",
    "fit_lexical_autoencoder", "fit_lof", "fit_one_class_svm", "hybrid_features", "late_invocations", "lexical_features", "load_model",
    "materialize", "merge_traces", "model_report", "nearest_by_forest", "nearest_neighbours", "pending", "pr_curve", "predict",
    "read_labelled_queries", "read_null_normalised_csv", "read_trace_log", "reconstruction_error_by_feature",
    "roc_curve", "sample_fraction", "sample_n", "save_model", "score_autoencoder", "score_lof",
    "score_one_class_svm", "score_table", "statement_features", "stream_alerts", "stream_features",
    "stream_merge_invocations", "stream_trace_log", "tag_counts", "threshold", "threshold_fixed_fpr", "throughput",
    "trace_features", "traces_per_split", "training_table", "validation_split", "write_curves", "write_results",
]
