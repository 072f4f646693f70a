"""Reports of evaluation runs: the layout of a summary, of a table of slices, and where they go."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .tables import _report_rows

# Sections, labels and formats of a run's summary, and columns of the table of slices.
HEAD = (
    ("Split", "split"), ("Dataset filter", "dataset_id"), ("Domain filter", "domain"), ("Manifest", "manifest"), ("Seed", "seed"),
    ("Preprocessing mode", "preprocessing"), ("Threshold policy", "policy"), ("Selected threshold", "threshold"), ("Calibration", "calibration"),
    ("Governance allowed", "allowed"), ("Governance reason", "reason"), ("Override used", "override"),
)
SECTIONS = (
    ("Threshold-Free Metrics", (("ROC-AUC", "roc_auc"), ("PR-AUC", "pr_auc"))),
    ("Thresholded Metrics", (("Accuracy", "accuracy"), ("Balanced accuracy", "balanced_accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"))),
    ("Confusion Matrix", (("TN", "tn"), ("FP", "fp"), ("FN", "fn"), ("TP", "tp"))),
    ("Calibration", (("ECE", "ece"), ("Brier score", "brier"))),
)
SLICE_HEAD = (
    ("Split", "split"), ("Tuning split", "tuning_split"), ("Manifest", "manifest"), ("Model", "model"), ("Preprocessing mode", "preprocessing"),
    ("Threshold policy", "policy"), ("Selected threshold", "threshold"), ("Calibration", "calibration"),
)
SLICE_COLUMNS = (("Accuracy", "accuracy"), ("Balanced Acc.", "balanced_accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("ROC-AUC", "roc_auc"), ("PR-AUC", "pr_auc"))
CORRUPTION_HEAD = (("Split", "split"), ("Manifest", "manifest"), ("Model", "model"), ("Preprocessing mode", "preprocessing"), ("Dataset filter", "dataset_id"), ("Domain filter", "domain"))
CORRUPTION_COLUMNS = (("ROC-AUC", "roc_auc"), ("PR-AUC", "pr_auc"), ("Accuracy", "accuracy"), ("Balanced Acc.", "balanced_accuracy"), ("ECE", "ece"), ("Brier", "brier"))
# The corruptions' names in reports and their order, what grid.corrupt calls them, and the ends of files' names.
KINDS = ("jpeg30", "jpeg50", "blur", "resize_down", "noise")
KIND_NAMES = {"blur3": "blur", "resize112": "resize_down", "noise05": "noise"}
FILES = {"evaluation": ("metrics.json", "summary.md"), "slices": ("slices.json", "slices.md"), "corruptions": ("corruptions.json", "corruptions.md")}


def _shown(value) -> str:
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def _items(rows, values: Mapping) -> list[str]:
    return [f"- {label}: `{_shown(values[key])}`" for label, key in rows]


def summary(run_id: str, facts: Mapping, metrics: DataFrame) -> str:
    """Markdown of a run: facts by the keys of HEAD, and the one row of metrics that evaluation.bundle() and ece() make."""
    rows = _report_rows(metrics)
    if len(rows) != 1:
        raise ValueError(f"a run has one row of metrics, not {len(rows)}")
    values, lines = rows[0].asDict(), [f"# Evaluation Summary - {run_id}", "", *_items(HEAD, facts)]
    for title, fields in SECTIONS:
        lines += ["", f"## {title}", "", *_items(fields, values)]
    return "\n".join(lines) + "\n"


def slice_summary(run_id: str, facts: Mapping, slices: DataFrame) -> str:
    """Markdown of a table that evaluation.slices() makes: one table a dimension, in the rows' order."""
    by: dict[str, list] = {}
    for r in _report_rows(slices):
        by.setdefault(r["dimension"], []).append(r)
    lines = [f"# Slice Evaluation Summary - {run_id}", "", *_items(SLICE_HEAD, facts), ""]
    for dimension, rows in by.items():
        lines += [f"## By `{dimension}`", "", "| " + " | ".join(("Slice", "Samples", *(n for n, _ in SLICE_COLUMNS))) + " |", "| --- | " + "---: | " * 7 + "---: |"]
        for r in rows:
            count = r["tn"] + r["fp"] + r["fn"] + r["tp"]
            lines.append(f"| {r['value']} | {count} | " + " | ".join(f"{r[k]:.4f}" for _, k in SLICE_COLUMNS) + " |")
        lines.append("")
    return "\n".join(lines)


def corruption_summary(run_id: str, facts: Mapping, results: DataFrame) -> str:
    """Markdown of a table (corruption and the metrics of CORRUPTION_COLUMNS), a line each in the order of KINDS, then by name. The kinds'
    names may be a report's own or those of grid.corrupt."""
    order = {k: i for i, k in enumerate(KINDS)}
    named = [(KIND_NAMES.get(r["corruption"], r["corruption"]), r) for r in _report_rows(results)]
    lines = [f"# Corruption Evaluation - {run_id}", "", *_items(CORRUPTION_HEAD, facts), ""]
    lines += ["| " + " | ".join(("Corruption", *(n for n, _ in CORRUPTION_COLUMNS))) + " |", "| --- | " + " | ".join(["---:"] * len(CORRUPTION_COLUMNS)) + " |"]
    for kind, r in sorted(named, key=lambda x: (order.get(x[0], len(order)), x[0])):
        lines.append(f"| {kind} | " + " | ".join(f"{r[k]:.4f}" for _, k in CORRUPTION_COLUMNS) + " |")
    return "\n".join([*lines, ""])


def write_report(spark: SparkSession, folder: str, run_id: str, report: Mapping, text: str, kind: str = "evaluation") -> tuple[str, str]:
    """Write a report's JSON and Markdown below a folder of any file system that Spark knows, under the names that FILES has for its
    kind: <run>_metrics.json and <run>_summary.md for an evaluation; slices and corruptions have names of their own."""
    jvm = spark.sparkContext._jvm
    paths = tuple(f"{folder.rstrip('/')}/{run_id}_{end}" for end in FILES[kind])
    for path, body in zip(paths, (json.dumps(report, indent=2, default=str), text)):
        at = jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(body.encode()))
        out.close()
    return paths
