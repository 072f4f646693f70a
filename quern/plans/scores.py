"""Queries over scores. The score of a labelled document is a fixed arithmetic of its id and length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import evaluation as E
from .registry import query, table

_S = """
WITH s AS (SELECT doc_id, quality AS y, lang AS domain, source AS dataset_id, CAST((doc_id * 7919 + n_chars * 31) % 101 AS DOUBLE) / 100 AS p FROM documents JOIN labels USING (doc_id)),
k AS (SELECT (SELECT count(*) FROM s WHERE y = 1) AS pos, (SELECT count(*) FROM s WHERE y <> 1) AS neg)"""


def scored(spark, sf):
    p = ((F.col("doc_id") * 7919 + F.col("n_chars") * 31) % 101).cast("double") / 100
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("lang").alias("domain"), F.col("source").alias("dataset_id"), p.alias("p"))


_DIV = "coalesce(({}) / nullif(CAST({} AS DOUBLE), 0), 0)"
_P, _R, _SP = _DIV.format("tp", "(tp + fp)"), _DIV.format("tp", "(tp + fn)"), _DIV.format("tn", "(tn + fp)")
_F1 = _DIV.format(f"2 * {_P} * {_R}", f"({_P} + {_R})")
_RATES = f"round({_DIV.format('tp + tn', '(tp + tn + fp + fn)')}, 6) AS accuracy, round(({_R} + {_SP}) / 2, 6) AS balanced_accuracy, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F1}, 6) AS f1"
_COUNT = "count(*) FILTER (y = 0 AND q = 0) AS tn, count(*) FILTER (y = 0 AND q = 1) AS fp, count(*) FILTER (y = 1 AND q = 0) AS fn, count(*) FILTER (y = 1 AND q = 1) AS tp"


@query(f"{_S}, t AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS q FROM s) SELECT {_COUNT} FROM t")
def confusion(spark, sf):
    return E.confusion(scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int")))


@query(f"{_S}, t AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS q FROM s), c AS (SELECT {_COUNT} FROM t) SELECT *, {_RATES} FROM c")
def threshold_metrics(spark, sf):
    return E.threshold_metrics(scored(spark, sf))


@query(f"""{_S}, t AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS q FROM s), c AS (SELECT {_COUNT} FROM t),
r AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM c)
SELECT tn, fp, fn, tp, round((tp + tn) / greatest(1, tp + tn + fp + fn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(CAST(1e-12 AS DOUBLE), p + r), 6) AS f1 FROM r""")
def floored_metrics(spark, sf):
    return E.threshold_metrics(scored(spark, sf), strict=False)


_CUM = f"""{_S}, g AS (SELECT p AS threshold, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b FROM s GROUP BY p),
c AS (SELECT threshold, sum(a) OVER w AS tp, sum(b) OVER w AS fp, pos, neg FROM g CROSS JOIN k WINDOW w AS (ORDER BY threshold DESC))"""
_ROC = f"""{_CUM}, o AS (SELECT fp / greatest(CAST(neg AS DOUBLE), 1) AS fpr, tp / greatest(CAST(pos AS DOUBLE), 1) AS tpr, threshold FROM c),
roc AS (SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold WHERE (SELECT count(*) FROM o) > 0 UNION ALL SELECT * FROM o UNION ALL SELECT 1, 1, '-inf'::DOUBLE FROM (SELECT max(fpr) AS f, max(tpr) AS t FROM o) WHERE f <> 1 OR t <> 1)"""
_PR = f"""{_ROC}, q AS (SELECT tp / greatest(CAST(pos AS DOUBLE), 1) AS recall, tp / CAST(tp + fp AS DOUBLE) AS precision, threshold FROM c),
pr AS (SELECT 0.0::DOUBLE AS recall, 1.0::DOUBLE AS precision, 'inf'::DOUBLE AS threshold UNION ALL SELECT * FROM q UNION ALL SELECT 1, pos / CAST(pos + neg AS DOUBLE), '-inf'::DOUBLE FROM k, (SELECT max(recall) AS r FROM q) WHERE r <> 1)"""


def _area(t, x, y):
    return f"(SELECT round(sum((x - px) * (y + py) / 2), 6) FROM (SELECT {x} AS x, {y} AS y, lag({x}) OVER w AS px, lag({y}) OVER w AS py FROM {t} WINDOW w AS (ORDER BY {x}, {y}, threshold DESC)))"


@query(f"{_ROC} SELECT fpr, tpr, threshold FROM roc")
def roc_curve(spark, sf):
    return E.roc_points(scored(spark, sf))


@query(f"{_PR} SELECT recall, precision, threshold FROM pr")
def pr_curve(spark, sf):
    return E.pr_points(scored(spark, sf))


@query(f"{_PR} SELECT {_area('roc', 'fpr', 'tpr')} AS roc_auc, {_area('pr', 'recall', 'precision')} AS pr_auc")
def auc(spark, sf):
    return E.auc(scored(spark, sf))


@query(f"""{_S}, g AS (SELECT p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b FROM s GROUP BY p)
SELECT round(sum(x.a * (SELECT coalesce(sum(z.b), 0) FROM g z WHERE z.p < x.p) + x.a * x.b / 2) / (SELECT CAST(pos * neg AS DOUBLE) FROM k), 6) AS roc_auc FROM g x""")
def rank_auc(spark, sf):
    return E.rank_auc(scored(spark, sf))


@query(f"""{_CUM}, o AS (SELECT threshold, round({_DIV.format('tp', 'pos')} - {_DIV.format('fp', 'neg')}, 12) AS o FROM c)
SELECT threshold, round(o, 6) AS objective FROM o ORDER BY o DESC, threshold LIMIT 1""")
def select_threshold(spark, sf):
    return E.select_threshold(scored(spark, sf))


@query(f"{_S} SELECT round(avg(power(p - y, 2)), 6) AS brier FROM s")
def brier(spark, sf):
    return E.brier(scored(spark, sf))


_EDGES = ", ".join(f"({k}, CAST({k * 0.1!r} AS DOUBLE), CAST({(k + 1) * 0.1 if k < 9 else 1.0!r} AS DOUBLE))" for k in range(10))
_REL = f"""{_S}, e(bin, lo, hi) AS (VALUES {_EDGES}),
r AS (SELECT bin, lo, hi, count(p) AS n, round(coalesce(avg(p), 0), 6) AS mean_score, round(coalesce(avg(y), 0), 6) AS positive_rate, round(coalesce(abs(avg(p) - avg(y)), 0), 6) AS gap
  FROM e LEFT JOIN s ON p >= lo AND (p < hi OR (bin = 9 AND p <= hi)) GROUP BY bin, lo, hi)"""


@query(f"{_REL} SELECT * FROM r")
def reliability_bins(spark, sf):
    return E.reliability(scored(spark, sf))


@query(f"{_REL} SELECT round(sum(gap * n) / (SELECT count(*) FROM s), 6) AS ece FROM r")
def calibration_error(spark, sf):
    return E.ece(scored(spark, sf))


@query(f"{_S}, c AS (SELECT doc_id, greatest(CAST(1e-6 AS DOUBLE), least(CAST(1 - 1e-6 AS DOUBLE), p)) AS q FROM s) SELECT doc_id, round(1 / (1 + exp(-ln(q / (1 - q)) / 1.5)), 6) AS p FROM c")
def temperature_scaled(spark, sf):
    return E.apply_temperature(scored(spark, sf), 1.5).select("doc_id", F.round("p", 6).alias("p"))


@query(f"""
WITH RECURSIVE {_S.strip()[5:]}, q AS (SELECT y, greatest(1e-6, least(1 - 1e-6, (2 * p + y) / 3)) AS q FROM s),
l AS (SELECT CASE WHEN y = 1 THEN ln(q / (1 - q)) ELSE -ln(q / (1 - q)) END AS z, count(*) AS n FROM q GROUP BY 1),
w AS (SELECT 0 AS k, 1.0::DOUBLE AS x UNION ALL
  SELECT k + 1, x + sum(n * z / (1 + exp(x * z))) / sum(n * z * z * exp(x * z) / power(1 + exp(x * z), 2)) FROM w, l WHERE k < 40 GROUP BY k, x)
SELECT round(1 / x, 3) AS temperature FROM w WHERE k = 40""")
def fitted_temperature(spark, sf):
    """The temperature of scores that lean towards their labels."""
    leaning = scored(spark, sf).withColumn("p", (2 * F.col("p") + F.col("y")) / 3)
    return spark.createDataFrame([(round(E.fit_temperature(leaning), 3),)], "temperature double")


def _grouped(dim):
    """Areas for groups in SQL: the same curves with PARTITION BY."""
    return f"""{_S}, l AS ({dim}),
t AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS q FROM l), c AS (SELECT d, v, {_COUNT}, round(avg(power(p - y, 2)), 6) AS brier FROM t GROUP BY d, v),
n AS (SELECT d, v, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM l GROUP BY d, v),
g AS (SELECT d, v, p AS threshold, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b FROM l GROUP BY d, v, p),
u AS (SELECT d, v, threshold, sum(a) OVER w AS tp, sum(b) OVER w AS fp, pos, neg FROM g JOIN n USING (d, v) WINDOW w AS (PARTITION BY d, v ORDER BY threshold DESC)),
o AS (SELECT d, v, fp / greatest(CAST(neg AS DOUBLE), 1) AS x, tp / greatest(CAST(pos AS DOUBLE), 1) AS y, threshold FROM u),
ro AS (SELECT d, v, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 'inf'::DOUBLE AS threshold FROM n UNION ALL SELECT * FROM o UNION ALL SELECT d, v, 1, 1, '-inf'::DOUBLE FROM (SELECT d, v, max(x) AS f, max(y) AS t FROM o GROUP BY d, v) WHERE f <> 1 OR t <> 1),
qo AS (SELECT d, v, tp / greatest(CAST(pos AS DOUBLE), 1) AS x, tp / CAST(tp + fp AS DOUBLE) AS y, threshold FROM u),
po AS (SELECT d, v, 0.0::DOUBLE AS x, 1.0::DOUBLE AS y, 'inf'::DOUBLE AS threshold FROM n UNION ALL SELECT * FROM qo UNION ALL SELECT d, v, 1, pos / CAST(pos + neg AS DOUBLE), '-inf'::DOUBLE FROM n JOIN (SELECT d, v, max(x) AS r FROM qo GROUP BY d, v) USING (d, v) WHERE r <> 1),
ra AS (SELECT d, v, round(coalesce(sum((x - px) * (y + py) / 2), 0), 6) AS roc_auc FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ro WINDOW w AS (PARTITION BY d, v ORDER BY x, y, threshold DESC)) GROUP BY d, v),
pa AS (SELECT d, v, round(coalesce(sum((x - px) * (y + py) / 2), 0), 6) AS pr_auc FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM po WINDOW w AS (PARTITION BY d, v ORDER BY x, y, threshold DESC)) GROUP BY d, v)
SELECT {{}}, tn, fp, fn, tp, {_RATES}, roc_auc, pr_auc, brier FROM c JOIN ra USING (d, v) JOIN pa USING (d, v)"""


@query(_grouped("SELECT 'domain' AS d, domain AS v, y, p FROM s WHERE trim(domain) <> '' UNION ALL SELECT 'dataset_id', dataset_id, y, p FROM s WHERE trim(dataset_id) <> ''").format("d AS dimension, v AS value"))
def slice_metrics(spark, sf):
    return E.slices(scored(spark, sf), ["domain", "dataset_id"])


def _corrupted(spark, sf):
    p = F.least(F.lit(1.0), F.col("p") * F.col("f"))
    kinds = spark.createDataFrame([("blur3", 0.9), ("noise05", 0.75)], "corruption string, f double")
    return scored(spark, sf).crossJoin(kinds).withColumn("p", p)


@query(_grouped("SELECT '' AS d, c.k AS v, y, least(CAST(1 AS DOUBLE), p * c.f) AS p FROM s CROSS JOIN (VALUES ('blur3', CAST(0.9 AS DOUBLE)), ('noise05', CAST(0.75 AS DOUBLE))) AS c(k, f)").format("v AS corruption"))
def corruption_report(spark, sf):
    return E.corruption_report(_corrupted(spark, sf))


@query(f"""{_S}, m AS (SELECT doc_id, y, p FROM s UNION ALL SELECT doc_id, y, 1 - p FROM s UNION ALL SELECT doc_id, y, p * p FROM s)
SELECT doc_id, max(y) AS y, round(avg(p), 6) AS p, count(*) AS members FROM m GROUP BY doc_id""")
def soft_vote(spark, sf):
    s = scored(spark, sf).select(F.col("doc_id").alias("sample_id"), "y", "p")
    long = s.unionByName(s.withColumn("p", 1 - F.col("p"))).unionByName(s.withColumn("p", F.col("p") * F.col("p")))
    return E.soft_vote(long).select(F.col("sample_id").alias("doc_id"), "y", F.round("p", 6).alias("p"), "members")


@query(f"""{_S}, t AS (SELECT domain, y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS q FROM s), c AS (SELECT domain, y, count(*) AS n, count(*) FILTER (y = q) AS r FROM t GROUP BY domain, y)
SELECT domain, round(sum(r) / sum(n), 6) AS accuracy, round(avg(r / n), 6) AS balanced_accuracy FROM c GROUP BY domain""")
def slice_recall(spark, sf):
    return E.slice_recall(scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int")), ["domain"])


@query(f"""{_S}, t AS (SELECT y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS q FROM s), k2(class) AS (VALUES (0), (1)),
c AS (SELECT class, (SELECT count(*) FROM t WHERE y = class AND q = class) AS hit, (SELECT count(*) FROM t WHERE y = class) AS support, (SELECT count(*) FROM t WHERE q = class) AS said FROM k2),
r AS (SELECT *, {_DIV.format('hit', 'said')} AS p, {_DIV.format('hit', 'support')} AS r FROM c)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round({_DIV.format('2 * p * r', '(p + r)')}, 6) AS f1, support FROM r""")
def classification_report(spark, sf):
    return E.classification_report(scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int")))


@query(f"""{_S} SELECT doc_id, CASE WHEN p >= 0.9 THEN 'Very likely AI-generated' WHEN p >= 0.75 THEN 'Likely AI-generated' WHEN p >= 0.6 THEN 'Possibly AI-generated' WHEN p >= 0.4 THEN 'Uncertain origin'
WHEN p >= 0.25 THEN 'Likely human-generated' WHEN p >= 0.1 THEN 'Very likely human-generated' ELSE 'Almost certainly human-generated' END AS verdict,
CASE WHEN p >= 0.5 THEN 'AI' ELSE 'HUMAN' END AS label, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 6) AS confidence FROM s""")
def verdict_bands(spark, sf):
    d = L.decision(F.col("p"))
    return scored(spark, sf).select("doc_id", L.verdict(F.col("p")).alias("verdict"), d["label"].alias("label"), F.round(d["confidence"], 6).alias("confidence"))


_RUNS = """WITH e AS (SELECT 'r' || (user_id % 7) AS run, 'u' || (user_id % 3) AS holdout, event_type AS metric, value FROM events WHERE event_type IN ('view', 'click')),
l AS (SELECT run, holdout, metric, avg(value) AS value FROM e GROUP BY run, holdout, metric)"""


def _runs(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    return e.groupBy(F.concat(F.lit("r"), F.col("user_id") % 7).alias("run"), F.concat(F.lit("u"), F.col("user_id") % 3).alias("holdout"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))


@query(f"{_RUNS} SELECT run, metric, round(avg(value), 6) AS mean, round(min(value), 6) AS worst, count(*) AS total, count(value) AS completed FROM l GROUP BY run, metric")
def holdout_aggregate(spark, sf):
    from ..operators.profile import holdout_aggregate as agg

    return agg(_runs(spark, sf)).withColumn("worst", F.round("worst", 6))


@query(f"""{_RUNS}, a AS (SELECT run, round(avg(value), 6) AS p FROM l WHERE metric = 'view' GROUP BY run), b AS (SELECT run, round(min(value), 6) AS s FROM l WHERE metric = 'click' GROUP BY run)
SELECT run, coalesce(p, '-inf'::DOUBLE) AS "primary", coalesce(s, '-inf'::DOUBLE) AS secondary, CAST(row_number() OVER (ORDER BY p DESC NULLS LAST, s DESC NULLS LAST, run) AS INT) AS place
FROM (SELECT DISTINCT run FROM l WHERE run <> 'r6') LEFT JOIN a USING (run) LEFT JOIN b USING (run)""")
def rank_runs(spark, sf):
    long = _runs(spark, sf).withColumn("kind", F.lit("holdout"))
    runs = long.select("run").distinct().withColumn("status", F.when(F.col("run") == "r6", "failed").otherwise("ok"))
    return E.rank_runs(long, runs, "holdout_mean_view", "holdout_worst_click")


@query(f"{_RUNS} SELECT run, " + ", ".join(f"round(max(value) FILTER (holdout = 'u{k}' AND metric = '{m}'), 6) AS holdout__u{k}__{m}" for k in range(3) for m in ("click", "view")) + " FROM l GROUP BY run")
def runs_wide(spark, sf):
    wide = E.to_wide(_runs(spark, sf).withColumn("value", F.round("value", 6)))
    return wide


@query(f"{_RUNS} SELECT run, round(avg(round(value, 6)), 6) AS view_mean, min(round(value, 6)) AS view_worst FROM l WHERE metric = 'view' GROUP BY run")
def wide_pattern(spark, sf):
    wide = E.to_wide(_runs(spark, sf).withColumn("value", F.round("value", 6)))
    return E.wide_pattern(wide, "view").select("run", "view_mean", "view_worst")
