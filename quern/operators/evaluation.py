"""Evaluation: confusion counts, curves, thresholds, calibration, slices, ensembles, ranking.

Curves are made from counts by distinct score, so a cumulative window runs over distinct scores and not over rows. `by` adds
grouping columns to everything, which is how slices, corruptions and folds share one plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.labels import safe_divide
from ..functions.names import fresh

RATES = 6  # decimals of reported rates


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    return df.groupBy(*(by or [])).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def _rates(strict: bool) -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    if strict:  # what is divided by nothing is 0
        p, r, s = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn), safe_divide(tn, tn + fp)
        return {"accuracy": safe_divide(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (r + s) / 2, "precision": p, "recall": r, "f1": safe_divide(2 * p * r, p + r)}
    p, r = tp / F.greatest(F.lit(1), tp + fp), tp / F.greatest(F.lit(1), tp + fn)  # denominators are floored instead
    return {"accuracy": (tp + tn) / F.greatest(F.lit(1), tp + tn + fp + fn), "precision": p, "recall": r, "f1": 2 * p * r / F.greatest(F.lit(1e-12), p + r)}


def with_rates(counts: DataFrame, strict: bool = True) -> DataFrame:
    return counts.withColumns({k: F.round(v, RATES) for k, v in _rates(strict).items()})


def threshold_metrics(df: DataFrame, threshold: float = 0.5, y: str = "y", score: str = "p", by: list[str] | None = None, strict: bool = True) -> DataFrame:
    (pred,) = fresh(df, "pred")
    return with_rates(confusion(df.withColumn(pred, (F.col(score) >= threshold).cast("int")), y, pred, by), strict)


#: Slices of the distinct scores, cut at quantiles of them, so that no task sees all.
SLICES = 64


def _by_score(df: DataFrame, y: str, score: str, by: list[str], *more: str) -> DataFrame:
    """Distinct scores with how many of either class lie there (a, b) and at or above (tp, fp), and the class totals. Sums run inside a
    slice of scores; what lies above a slice is summed over slices."""
    counts = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(F.col(y) == 1).alias("a"), F.count_if(F.col(y) != 1).alias("b"))
    cuts = counts.agg(F.percentile_approx("threshold", [k / SLICES for k in range(1, SLICES)], 1000).alias("__cuts"))
    counts = counts.crossJoin(cuts).withColumn("__s", F.size(F.filter("__cuts", lambda c: c < F.col("threshold")))).drop("__cuts")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows a group
    sliced = counts.groupBy(*by, "__s").agg(F.sum("a").alias("__a"), F.sum("b").alias("__b"))
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sliced = sliced.select(*by, "__s", over("__a", above).alias("__ua"), over("__b", above).alias("__ub"), over("__a", whole).alias("pos"), over("__b", whole).alias("neg"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "__s"]]
    upto = Window.partitionBy(*[F.col(f"l.{c}") for c in [*by, "__s"]]).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.alias("l").join(sliced.alias("r"), on).select(
        *[F.col(f"l.{c}") for c in by], "threshold", "a", "b",
        (F.sum("a").over(upto) + F.col("__ua")).alias("tp"), (F.sum("b").over(upto) + F.col("__ub")).alias("fp"), "pos", "neg",
        *[F.col(f"l.{c}") for c in more],
    )


def roc_points(df: DataFrame, y: str = "y", score: str = "p", by: list[str] | None = None) -> DataFrame:
    """(fpr, tpr, threshold): the origin at infinity, then a point per distinct score; (1, 1) closes the curve if it is not there."""
    by = by or []
    cum = _by_score(df, y, score, by)
    points = cum.select(*by, (F.col("fp") / F.greatest("neg", F.lit(1))).alias("fpr"), (F.col("tp") / F.greatest("pos", F.lit(1))).alias("tpr"), "threshold")
    ends = points.groupBy(*by).agg(F.max("fpr").alias("f"), F.max("tpr").alias("t"))
    origin = ends.select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    last = ends.where("f <> 1 or t <> 1").select(*by, F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"), F.lit(float("-inf")).alias("threshold"))
    return origin.unionByName(points).unionByName(last)


def pr_points(df: DataFrame, y: str = "y", score: str = "p", by: list[str] | None = None) -> DataFrame:
    """(recall, precision, threshold): (0, 1) first; (1, share of positives) closes the curve if recall never gets to 1."""
    by = by or []
    cum = _by_score(df, y, score, by)
    points = cum.select(*by, (F.col("tp") / F.greatest("pos", F.lit(1))).alias("recall"), safe_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), "threshold")
    ends = cum.groupBy(*by).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"), F.max(F.col("tp") / F.greatest("pos", F.lit(1))).alias("r"))
    first = ends.select(*by, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(float("inf")).alias("threshold"))
    last = ends.where("r <> 1").select(*by, F.lit(1.0).alias("recall"), (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("precision"), F.lit(float("-inf")).alias("threshold"))
    return first.unionByName(points).unionByName(last)


def area(points: DataFrame, x: str, y: str, by: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Trapezoids under any points in order of (x, y), by one window a group: for curves that are small. compat: among points of one x
    the curve goes from the greatest y down, as an older tool sorted them."""
    by = by or []
    rest = [F.desc(y), F.asc("threshold")] if compat else [F.asc(y), F.desc("threshold")]
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.asc(x), *([F.desc(F.col("threshold") == float("inf"))] if compat else []), *rest)
    steps = points.withColumns({"__x": F.lag(x).over(w), "__y": F.lag(y).over(w)})
    return steps.groupBy(*by).agg(F.round(F.coalesce(F.sum((F.col(x) - F.col("__x")) * (F.col(y) + F.col("__y")) / 2), F.lit(0.0)), RATES).alias("auc"))


def _pr_area(cum: DataFrame, by: list[str]) -> DataFrame:
    """(by, __pr): the area under the points of pr_points in order of (recall, precision). A level of recall begins at a score with
    positives, where its precision is greatest, and ends above the next such score, where it is least; the curve goes from
    the greatest of one level to the least of the next. cum: _by_score() with its slices. The neighbour of a slice's first or last level is another slice's."""
    levels = cum.where("a > 0")
    row, inside = F.struct("tp", "fp", "b"), Window.partitionBy(*by, "__s").orderBy(F.desc("threshold"))
    slices = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("__s"))  # SLICES rows a group
    ends = levels.groupBy(*by, "__s").agg(F.max_by(row, "threshold").alias("__first"), F.min_by(row, "threshold").alias("__last"))
    ends = ends.select(*by, "__s", F.lag("__last").over(slices).alias("__up"), F.lead("__first").over(slices).alias("__down"))
    levels = levels.withColumns({"__p": F.lag(row).over(inside), "__n": F.lead(row).over(inside)})
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "__s"]]
    j = levels.alias("l").join(ends.alias("r"), on)
    up, down = F.coalesce("__p", "__up"), F.coalesce("__n", "__down")
    greatest = F.when(up.isNull(), 1.0).otherwise(up["tp"] / (up["tp"] + up["fp"]))
    least = F.col("tp") / (F.col("tp") + F.coalesce(down["fp"] - down["b"], F.col("neg")))
    return j.groupBy(*[F.col(f"l.{c}") for c in by]).agg(F.sum(F.col("a") / F.col("pos") * (greatest + least) / 2).alias("__pr"))


def auc(df: DataFrame, y: str = "y", score: str = "p", by: list[str] | None = None, compat: bool = False) -> DataFrame:
    """roc_auc and pr_auc, from counts by score: what lies at a score and above it names the point before on the curve too. Without
    negatives the ROC curve only has its closing step, without positives the other one has; compat as in area()."""
    by = by or []
    cum = _by_score(df, y, score, by, "__s")
    tp, a, b = (F.col(c) for c in ("tp", "a", "b"))
    closing = F.when(F.max("neg") > 0, 0.0).when(F.max("pos") > 0, 1.0).otherwise(0.5)
    roc = F.sum(b / F.greatest("neg", F.lit(1)) * (2 * tp - a) / F.greatest("pos", F.lit(1)) / 2) + closing
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), RATES)
    whole = cum.groupBy(*by).agg(zero(roc).alias("roc_auc"), F.max("pos").alias("__pos"))
    if compat:
        whole = _beside(whole.drop("roc_auc"), area(roc_points(df, y, score, by), "fpr", "tpr", by, True).withColumnRenamed("auc", "roc_auc"), by)
    both = _beside(whole, _pr_area(cum, by), by)
    return both.select(*by, "roc_auc", zero(F.when(F.col("__pos") == 0, 0.5).otherwise(F.col("__pr"))).alias("pr_auc"))


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return left.crossJoin(right)
    renamed = right.select(*[F.col(c).alias(f"__r{k}") for k, c in enumerate(by)], *[c for c in right.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"__r{k}")) for k, c in enumerate(by)]
    return left.join(renamed, same, "left").drop(*[f"__r{k}" for k in range(len(by))])


def rank_auc(df: DataFrame, y: str = "y", score: str = "p") -> DataFrame:
    """The area by the rank sum, from counts by distinct score: each positive counts the negatives below it and half of those beside it."""
    cum = _by_score(df, y, score, [])
    return cum.agg(F.round(F.sum(F.col("a") * (F.col("neg") - F.col("fp") + F.col("b") / 2)) / (F.max("pos") * F.max("neg")), RATES).alias("roc_auc"))


def select_threshold(df: DataFrame, method: str = "youden", fixed: float | None = None, y: str = "y", score: str = "p") -> DataFrame:
    """(threshold, objective) with the greatest youden or f1, the lowest threshold on ties. fixed: the given value, no objective."""
    if method == "fixed":
        if fixed is None:
            raise ValueError("method fixed needs a threshold")
        return df.sparkSession.createDataFrame([(float(fixed), float("nan"))], "threshold double, objective double")
    if df.isEmpty():
        raise ValueError("no rows to choose a threshold from")
    cum = _by_score(df, y, score, [])
    fn, tn = F.col("pos") - F.col("tp"), F.col("neg") - F.col("fp")
    p, r = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + fn)
    goal = {"youden": r - safe_divide(F.col("fp"), F.col("fp") + tn), "f1": safe_divide(2 * p * r, p + r)}[method]
    best = cum.withColumn("__o", F.round(goal, 12)).agg(F.max_by(F.struct("threshold", "__o"), F.struct(F.col("__o"), -F.col("threshold"))).alias("b"))
    return best.select("b.threshold", F.round("b.__o", RATES).alias("objective"))


def brier(df: DataFrame, y: str = "y", score: str = "p", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.round(F.avg(F.pow(F.col(score) - F.col(y), F.lit(2))), RATES).alias("brier"))


def reliability(df: DataFrame, bins: int = 10, y: str = "y", score: str = "p") -> DataFrame:
    """(bin, lo, hi, n, mean_score, positive_rate, gap) for equal bins [lo, hi), the last one closed; empty bins are zeros. Edges are
    k * (1 / bins) in floating point, so 0.3 lies below the fourth edge. Each score meets its bin by a chain of comparisons; the
    frame of bins is joined to counts only."""
    step = 1.0 / bins
    edges = [k * step for k in range(bins)] + [1.0]
    at = F.lit(None).cast("int")
    for k in range(bins):
        inside = (F.col(score) >= edges[k]) & ((F.col(score) < edges[k + 1]) if k < bins - 1 else (F.col(score) <= 1.0))
        at = F.when(inside, k).otherwise(at)
    counts = df.withColumn("bin", at).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(F.col(y).cast("double")).alias("r"))
    frame = df.sparkSession.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(bins)], "bin int, lo double, hi double")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), RATES)
    return frame.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), zero(F.col("s")).alias("mean_score"), zero(F.col("r")).alias("positive_rate"), zero(F.abs(F.col("s") - F.col("r"))).alias("gap"))


def ece(df: DataFrame, bins: int = 10, y: str = "y", score: str = "p") -> DataFrame:
    """Expected calibration error; scores outside [0, 1] are in no bin but count in the total."""
    return reliability(df, bins, y, score).crossJoin(df.agg(F.count("*").alias("__t"))).agg(F.round(F.coalesce(F.sum(F.col("gap") * F.col("n")) / F.max("__t"), F.lit(0.0)), RATES).alias("ece"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def apply_temperature(df: DataFrame, temperature: float, score: str = "p", out: str = "p") -> DataFrame:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    return df.withColumn(out, 1 / (1 + F.exp(-logit(F.col(score)) / temperature)))


#: Cells that logits are counted in, and the range of temperatures.
LOGIT_CELLS, TEMPERATURES = 16_384, (0.05, 20.0)


def logit_histogram(df: DataFrame, y: str = "y", score: str = "p", eps: float = 1e-6) -> DataFrame:
    """(a, b, za, zb): positive and other rows of each cell of logits, and the sums of their logits; LOGIT_CELLS rows at the most."""
    most = math.log((1 - eps) / eps)
    z, is_a = logit(F.col(score), eps), F.col(y) == 1
    cell = F.floor((z + most) * (LOGIT_CELLS - 1) / (2 * most))
    sides = [(is_a, "a"), (~is_a, "b")]
    return df.where(F.col(score).isNotNull()).groupBy(cell.alias("cell")).agg(*[F.count_if(w).alias(n) for w, n in sides], *[F.coalesce(F.sum(F.when(w, z)), F.lit(0.0)).alias("z" + n) for w, n in sides])


def fit_temperature(df: DataFrame, y: str = "y", score: str = "p", compat: bool = False) -> float:
    """The temperature with the least log loss. One aggregate counts rows by cells of their logit, a bounded table whatever the rows; Newton
    steps on it find where the loss's derivative by 1 / T is zero. A cell stands at its mean, which moves the result by less than
    1e-6. compat doubles the margin, as an older fit did."""
    import numpy as np

    rows = logit_histogram(df, y, score).collect()
    if not rows:
        raise ValueError("no rows to fit a temperature to")
    a, b, za, zb = (np.array([r[c] for r in rows], float) for c in ("a", "b", "za", "zb"))
    n = np.concatenate([a, b])
    z = np.concatenate([za, -zb]) / np.maximum(n, 1) * (2.0 if compat else 1.0)  # as if all were positive
    low, high = 1 / TEMPERATURES[1], 1 / TEMPERATURES[0]
    # the loss sum n ln(1 + e^-xz) is convex in x = 1 / T: bisection where a step would leave the range that holds the zero
    x = 1.0
    for _ in range(100):
        s = 1 / (1 + np.exp(np.clip(x * z, -700, 700)))
        slope, curve = -(n * z * s).sum(), (n * z * z * s * (1 - s)).sum()
        low, high = (low, x) if slope > 0 else (x, high)
        new = x - slope / curve if curve > 0 else (low + high) / 2
        new = new if low < new < high else (low + high) / 2
        if abs(new - x) <= 1e-12 * x:
            break
        x = new
    return float(1 / x)


def tune(df: DataFrame, threshold: str = "youden", fixed: float | None = None, calibration: str = "none", split: str = "val", allow: bool = False) -> dict:
    """Calibration and threshold from a tuning split. Nothing to do for a fixed threshold without calibration; a fixed one
    must lie in [0, 1]; held-out splits are no tuning splits unless allowed."""
    if threshold == "fixed" and (fixed is None or not 0 <= fixed <= 1):
        raise ValueError("a fixed threshold lies in [0, 1]")
    if not needs_tuning(threshold, calibration):
        return {"temperature": None, "threshold": fixed}
    if split in ("test", "real_world") and not allow:
        raise ValueError(f"{split} is held out and not for tuning")
    t = fit_temperature(df) if calibration == "temp_scaling" else None
    scored = df if t is None else apply_temperature(df, t)
    return {"temperature": t, "threshold": fixed if threshold == "fixed" else select_threshold(scored, threshold).first()["threshold"]}


def needs_tuning(threshold: str, calibration: str) -> bool:
    return not (threshold == "fixed" and calibration == "none")


def bundle(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Counts, rates, both areas and Brier score, for all rows or each group."""
    by = by or []
    parts = [threshold_metrics(df, threshold, by=by), auc(df, by=by), brier(df, by=by)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by) if by else out.crossJoin(p)
    return out


def slices(df: DataFrame, dimensions: list[str], threshold: float = 0.5) -> DataFrame:
    """The bundle for each non-blank value of each dimension, under one global threshold, the worst balanced accuracy first. The
    table is unpivoted once and grouped by (dimension, value)."""
    long = df.select("y", "p", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("s")).select("y", "p", "s.dimension", "s.value").where("trim(value) <> ''")
    return bundle(long, threshold, ["dimension", "value"]).orderBy("balanced_accuracy", "dimension", "value")


def slice_recall(df: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, and the mean recall of the classes that a slice has."""
    per = df.groupBy(*by, y).agg(F.count("*").alias("n"), F.count_if(F.col(y) == F.col(pred)).alias("r"))
    return per.groupBy(*by).agg(F.round(F.sum("r") / F.sum("n"), RATES).alias("accuracy"), F.round(F.avg(F.col("r") / F.col("n")), RATES).alias("balanced_accuracy"))


def soft_vote(long: DataFrame, key: str = "sample_id") -> DataFrame:
    """Mean probability of the members. Labels must agree, and every member must have every sample: else reading it is an error."""
    (most,) = fresh(long, "most")
    per = long.groupBy(key).agg(F.min("y").alias("y"), F.max("y").alias(most), F.avg("p").alias("p"), F.count("*").alias("members"))
    agreed = checks.no_row(per, F.col("y") != F.col(most), "members disagree in the label of ", F.col(key)).drop(most)
    return checks.fact(agreed, per.agg(F.min("members").alias("a"), F.max("members").alias("b")), F.col("a") != F.col("b"), "members disagree in samples")


CORRUPTIONS = ("jpeg30", "jpeg50", "blur3", "resize112", "noise05")


def corruption_report(df: DataFrame, corruption: str = "corruption") -> DataFrame:
    """The bundle at 0.5 for each corruption of a table of scores (corruption, y, p)."""
    return bundle(df, 0.5, [corruption])


def rank_runs(long: DataFrame, runs: DataFrame, primary: str, secondary: str) -> DataFrame:
    """Runs with status ok or dry_run, best first. long: (run, kind, metric, value) with kind val, holdout or slice.

    A metric's name says where it comes from: slice_<m> is the mean over slices, holdout_mean_<m> and holdout_worst_<m> are over
    holdouts, generalization_score is 0.5 mean + 0.3 worst + 0.2 val of balanced accuracy (val alone without holdouts, a
    missing part 0); any other is the run's own. What is missing is minus infinity.
    """
    ok = runs.where(F.col("status").isin("ok", "dry_run")).select("run")

    def one(kind: str, metric: str, how) -> DataFrame:
        return long.where((F.col("kind") == kind) & (F.col("metric") == metric)).groupBy("run").agg(how("value").alias("v"))

    def value(name: str) -> DataFrame:
        if name == "generalization_score":
            m = "balanced_accuracy"
            parts = [one("holdout", m, F.avg).withColumnRenamed("v", "a"), one("holdout", m, F.min).withColumnRenamed("v", "b"), one("val", m, F.avg).withColumnRenamed("v", "c")]
            j = ok
            for p in parts:
                j = j.join(p, "run", "left")
            z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
            return j.select("run", F.when(F.col("a").isNull() & F.col("b").isNull(), F.col("c")).otherwise(0.5 * z("a") + 0.3 * z("b") + 0.2 * z("c")).alias("v"))
        for prefix, kind, how in (("slice_", "slice", F.avg), ("holdout_mean_", "holdout", F.avg), ("holdout_worst_", "holdout", F.min)):
            if name.startswith(prefix):
                return one(kind, name[len(prefix) :], how)
        return one("val", name, F.avg)

    low = F.lit(float("-inf"))
    out = ok.join(value(primary).withColumnRenamed("v", "__a"), "run", "left").join(value(secondary).withColumnRenamed("v", "__b"), "run", "left")
    out = out.select("run", F.round(F.coalesce("__a", low), RATES).alias("primary"), F.round(F.coalesce("__b", low), RATES).alias("secondary"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("primary"), F.desc("secondary"), "run"))).orderBy("place")


def wide_pattern(df: DataFrame, metric: str) -> DataFrame:
    """Add <metric>_mean and <metric>_worst over the columns holdout__*__<metric>; columns that do not parse are left out."""
    cols = [c for c in df.columns if c.startswith("holdout__") and c.endswith(f"__{metric}")]
    if not cols:
        return df.withColumns({f"{metric}_mean": F.lit(None).cast("double"), f"{metric}_worst": F.lit(None).cast("double")})
    values = F.filter(F.array(*[F.col(c).try_cast("double") for c in cols]), lambda v: v.isNotNull())
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))
    return df.withColumns({f"{metric}_mean": F.round(mean, RATES), f"{metric}_worst": F.array_min(values)})


def to_wide(long: DataFrame, key: str = "run") -> DataFrame:
    """(run, holdout, metric, value) as one column holdout__<holdout>__<metric> each."""
    from ..functions.text import slug

    named = long.select(key, F.concat_ws("__", F.lit("holdout"), slug(F.col("holdout")), "metric").alias("c"), "value")
    return named.groupBy(key).pivot("c").agg(F.first("value"))


def extract_metrics(reports: DataFrame, column: str = "report") -> DataFrame:
    """(run, metric, value) from nested JSON reports with an object "metrics" of numbers."""
    parsed = F.from_json(F.get_json_object(column, "$.metrics"), "map<string,double>")
    return reports.select("run", F.explode(parsed).alias("metric", "value"))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(class, precision, recall, f1, support) for every class of labels or predictions."""
    a = df.groupBy(F.col(y).alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col(y) == F.col(pred)).alias("hit"))
    b = df.groupBy(F.col(pred).alias("class")).agg(F.count("*").alias("said"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    p, r = safe_divide(z("hit"), z("said")), safe_divide(z("hit"), z("support"))
    return a.join(b, "class", "full_outer").select("class", F.round(p, RATES).alias("precision"), F.round(r, RATES).alias("recall"), F.round(safe_divide(2 * p * r, p + r), RATES).alias("f1"), z("support").alias("support"))
