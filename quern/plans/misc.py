"""Queries over events, conversations and pixel grids: governance, history, labels, image features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import dedup, evaluation, governance, grid, profile
from ..streaming import events as stream
from .registry import query, table


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE value > 5 AND event_type IN ('click', 'purchase') GROUP BY 1")
def daily_quota(spark, sf):
    log = table(spark, sf, "events").select(F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("eval_split"), (F.col("value") > 5).alias("allowed"))
    return governance.heldout_counts(log, ["click", "purchase"])


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events WHERE event_type IN ('error') GROUP BY 1")
def daily_window_counts(spark, sf):
    d = stream.daily_counts(table(spark, sf, "events"), ["error"])
    return d.select(F.col("day").cast("timestamp_ntz").alias("day"), "n")


@query("SELECT user_id, event_id, CAST(place AS INT) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5")
def history_topk(spark, sf):
    return stream.recent(table(spark, sf, "events"), "user_id").select("user_id", "event_id", "place")


@query("""WITH c AS (SELECT event_type AS artifact, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS hash FROM events WHERE event_id % 2 = 0 GROUP BY event_type),
b AS (SELECT event_type AS artifact, CASE WHEN event_type = 'view' THEN NULL ELSE md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) END AS hash FROM events WHERE event_id % 2 = CASE WHEN event_type = 'click' THEN 0 ELSE 1 END GROUP BY event_type)
SELECT artifact, b.hash AS baseline, c.hash AS current FROM c JOIN b USING (artifact) WHERE b.hash IS NOT NULL AND c.hash <> b.hash""")
def hash_drift(spark, sf):
    e = table(spark, sf, "events")
    h = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ","))
    current = e.where("event_id % 2 = 0").groupBy(F.col("event_type").alias("artifact")).agg(h.alias("hash"))
    base = e.where("event_id % 2 = case when event_type = 'click' then 0 else 1 end").groupBy(F.col("event_type").alias("artifact")).agg(h.alias("hash"))
    return governance.hash_drift(current, base.withColumn("hash", F.when(F.col("artifact") != "view", F.col("hash"))))


@query("""
WITH r AS (SELECT event_id, event_id % 11 <> 0 AS m, event_id % 7 <> 0 AS l, event_id % 5 <> 0 AS f, event_type IN ('click', 'view') AS h, user_id % 2 = 0 AS t, event_id % 3 = 0 AS fb, value > 20 AS d, user_id % 6 AS today, event_id % 4 = 0 AS o FROM events)
SELECT event_id,
  CASE WHEN NOT m OR NOT l OR NOT f THEN false WHEN fb AND h AND t THEN o WHEN d AND NOT o THEN false WHEN h AND today >= 3 THEN o ELSE true END AS allowed,
  m AND l AND f AND NOT (fb AND h AND t) AND NOT d AND NOT (h AND today >= 3) AND NOT o AS valid,
  CASE WHEN NOT m THEN 'manifest_required' WHEN NOT l THEN 'label_mapping_hash_required' WHEN NOT f THEN 'split_policy_not_frozen'
    WHEN fb AND h AND t THEN CASE WHEN o THEN 'override_held_out_tuning' ELSE 'held_out_tuning_forbidden' END WHEN d AND NOT o THEN 'hash_drift_blocked'
    WHEN h AND today >= 3 THEN CASE WHEN o THEN 'override_daily_heldout_limit' ELSE 'daily_heldout_limit_exceeded' END WHEN d OR o THEN 'override_used_hash_drift' ELSE 'allowed' END AS reason
FROM r""")
def governance_replay(spark, sf):
    e = table(spark, sf, "events")
    when = lambda c, v: F.when(c, v).otherwise("")
    i, u = F.col("event_id"), F.col("user_id")
    requests = e.select(
        "event_id", when(i % 11 != 0, "m.csv").alias("manifest_path"), when(i % 7 != 0, "abc").alias("label_mapping_hash"), (i % 5 != 0).alias("split_frozen"), F.col("event_type").alias("eval_split"),
        F.when(u % 2 == 0, "view").otherwise("val").alias("tuning_split"), (i % 3 == 0).alias("forbid_test_tuning"), (F.col("value") > 20).alias("drift"), (u % 6).alias("heldout_today"), (i % 4 == 0).alias("override"),
    )
    config = governance.Config(held_out_splits=["click", "view"], max_heldout_evals_per_day=3, selection_metric="balanced_accuracy")
    return governance.decide(requests, config).select("event_id", "allowed", "valid", "reason")


@query("SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_epoch(spark, sf):
    return profile.last_epoch(table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value"), "user_id", "event_id")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def fold_mean_std(spark, sf):
    return profile.mean_std(table(spark, sf, "events"), "event_type", "value")


@query("""SELECT event_id AS run, m AS metric, coalesce(v, '-inf'::DOUBLE) AS value FROM (SELECT event_id, unnest(['f1', 'k', 'gap']) AS m,
  unnest([CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END, CAST(json_extract_string(props, '$.k') AS DOUBLE), NULL]) AS v FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0)""")
def metric_extraction(spark, sf):
    """Numbers out of nested reports, some of which are broken or have no metrics; a missing or bad number is minus infinity."""
    e = table(spark, sf, "events")
    value, k = F.col("value"), F.get_json_object("props", "$.k")
    # JSON has no numbers for NaN and the infinities: they are written as texts, which are read as numbers
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    number = F.when((F.col("event_id") % 11 == 0) | value.isNull(), F.lit("null")).when(odd, F.concat(F.lit('"'), value.cast("string"), F.lit('"'))).otherwise(value.cast("string"))
    good = F.concat(F.lit('{"run": {"id": 1}, "metrics": {"f1": '), number, F.lit(', "k": '), F.coalesce(k, F.lit("null")), F.lit(', "gap": null}}'))
    report = F.when(F.col("event_id").isNull() | (F.col("event_id") % 7 == 0), '{"metrics": {"f1": 0.').when(F.col("event_id") % 5 == 0, '{"other": {"f1": 1}}').otherwise(good)
    got = evaluation.extract_metrics(e.select(F.col("event_id").alias("run"), report.alias("report")))
    return got.select("run", "metric", L.safe_float(F.col("value").cast("string")).alias("value"))


@query("""SELECT doc_id, CASE WHEN p >= 0.5 THEN 'AI' ELSE 'HUMAN' END AS label, CASE WHEN p > 0.5 THEN 'AI' ELSE 'HUMAN' END AS strict, printf('%.1f%%', CASE WHEN p >= 0.5 THEN p ELSE 1 - p END * 100) AS confidence, printf('%.4f', p) AS raw_score,
  'Classification: ' || CASE WHEN p > 0.5 THEN 'AI' ELSE 'HUMAN' END || printf(' (confidence: %.2f%%)', p * 100) AS logged
FROM (SELECT doc_id, CAST((doc_id * 7919 + n_chars) % 9 AS DOUBLE) / 8 AS p FROM documents)""")
def decisions(spark, sf):
    """The decision on a score, eighths of one among them, in both readings of one half."""
    p = F.col("p")
    df = table(spark, sf, "documents").select("doc_id", (((F.col("doc_id") * 7919 + F.col("n_chars")) % 9).cast("double") / 8).alias("p"))
    shown = df.select("doc_id", L.shown_decision(p).alias("d"), L.decision(p, strict=True)["label"].alias("strict"), L.logged_decision(p).alias("logged"))
    return shown.select("doc_id", "d.label", "strict", "d.confidence", "d.raw_score", "logged")


@query("""SELECT doc_id, '/app/data/' || source || '/' || doc_id || '.txt' AS path, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 END AS y, p AS positive FROM (SELECT *, CAST(doc_id % 17 AS DOUBLE) / 16 AS p FROM documents)""")
def normalized_rows(spark, sf):
    """Paths in three spellings under one root, a case-sensitive map of labels, and the positive one of two probabilities."""
    d = table(spark, sf, "documents")
    file = F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("./data/"), file)).when(F.col("doc_id") % 3 == 1, F.translate(F.concat(F.lit("data/"), file), "/", "\\")).otherwise(F.concat(F.lit("/app/data/"), file))
    p = (F.col("doc_id") % 17).cast("double") / 16
    return d.select("doc_id", L.normalize_path(path).alias("path"), L.map_value(F.col("lang"), {"en": 0, "fr": 1, "DE": 2}).alias("y"), L.positive_probability(F.array(1 - p, p)).alias("positive"))


@query("SELECT count(*) AS rows, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words, round(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) * 1.35 * 1.0 / 1e6, 6) AS dollars FROM documents")
def cost_estimate(spark, sf):
    return governance.cost_estimate(table(spark, sf, "documents"))


@query("""WITH a AS (SELECT event_id, event_id % 4 = 0 AS override, event_id % 3 <> 0 AS allowed, event_id % 3 <> 0 AND event_id % 4 <> 0 AS valid FROM events)
SELECT event_id, allowed AND valid AND NOT override AS baseline_pending FROM a""")
def baseline_pending(spark, sf):
    """Which requests would pin a baseline while there is none."""
    i = F.col("event_id")
    decided = table(spark, sf, "events").select("event_id", (i % 4 == 0).alias("override"), (i % 3 != 0).alias("allowed"), ((i % 3 != 0) & (i % 4 != 0)).alias("valid"))
    none = spark.createDataFrame([], "artifact string, hash string")
    return governance.baseline_pending(decided, none).select("event_id", "baseline_pending")


@query("SELECT conv_id, turn, CASE lower(trim(role)) WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END AS y FROM conversations")
def normalized_labels(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(L.map_normalized(F.col("role"), {"user": 0, "assistant": 1}), F.lit(-1)).alias("y"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 ELSE 1 END AS y FROM conversations WHERE role <> 'system'")
def binary_labels(spark, sf):
    renamed = table(spark, sf, "conversations").where("role <> 'system'").withColumn("role", F.when(F.col("role") == "user", " Human ").otherwise("AI"))
    return L.binary_labels(renamed, "role").select("conv_id", "turn", "y")


@query("SELECT r_name AS model, CAST(h AS INT) AS holdout FROM region CROSS JOIN range(0, 4) AS t(h)")
def benchmark_grid(spark, sf):
    axis = spark.range(4).select(F.col("id").cast("int").alias("holdout"))
    return dedup.grid(table(spark, sf, "region").select(F.col("r_name").alias("model")), axis)


_G = "WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)"


def _grid(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))


_SUM = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
_BLOCK = "list_transform(range(0, 16), lambda k: (a[(k // 4) * 16 + (k % 4) * 2 + 1] {0} a[(k // 4) * 16 + (k % 4) * 2 + 2] {1} a[(k // 4) * 16 + (k % 4) * 2 + 9] {2} a[(k // 4) * 16 + (k % 4) * 2 + 10]) / 2)"


@query(f"""{_G} SELECT vec_id, round(list_sum(list_transform({_BLOCK.format('+', '+', '+')}, lambda x: abs(x))), 6) AS ll, round(list_sum(list_transform({_BLOCK.format('+', '-', '-')}, lambda x: abs(x))), 6) AS lh,
round(list_sum(list_transform({_BLOCK.format('-', '+', '-')}, lambda x: abs(x))), 6) AS hl, round(list_sum(list_transform({_BLOCK.format('-', '-', '+')}, lambda x: abs(x))), 6) AS hh FROM g""")
def haar_bands(spark, sf):
    b = grid.haar(F.col("a"), 8, 8)
    return _grid(spark, sf).select("vec_id", *[_SUM(F.transform(b[n], F.abs)).alias(n) for n in ("ll", "lh", "hl", "hh")])


_LEVEL = "list_transform(a, lambda v: CAST(least(7, greatest(0, floor((v + 0.5::DOUBLE) * 8))) AS INT))"


@query(f"""{_G}, q AS (SELECT vec_id, {_LEVEL} AS l FROM g),
p AS (SELECT vec_id, l[k + 1] AS i, l[k + 2] AS j FROM (SELECT vec_id, l, unnest(range(0, 63)) AS k FROM q) WHERE k % 8 < 7), b AS (SELECT * FROM p UNION ALL SELECT vec_id, j, i FROM p)
SELECT vec_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, count(*) AS n FROM b GROUP BY vec_id, i, j""")
def co_occurrence(spark, sf):
    counts = grid.co_occurrence(grid.quantize(F.transform("a", lambda v: (v + 0.5) * 256.0)), 8, 8)
    cells = _grid(spark, sf).select("vec_id", F.posexplode(counts).alias("c", "n")).where("n > 0")
    return cells.select("vec_id", F.floor(F.col("c") / 8).cast("int").alias("i"), (F.col("c") % 8).cast("int").alias("j"), F.col("n").cast("long").alias("n"))


def _conv(kernel, size, edge):
    """SQL for a kernel over an 8 x 8 grid: sums over the kernel's places, at the edge mirrored or zero."""
    r = size // 2
    y, x = f"(k // 8 + t // {size} - {r})", f"(k % 8 + t % {size} - {r})"
    if edge == "mirror":
        value = f"a[(7 - abs(7 - abs({y}))) * 8 + (7 - abs(7 - abs({x}))) + 1]"
    else:
        value = f"CASE WHEN {y} BETWEEN 0 AND 7 AND {x} BETWEEN 0 AND 7 THEN a[{y} * 8 + {x} + 1] ELSE 0 END"
    return f"list_transform(range(0, 64), lambda k: list_sum(list_transform(range(0, {size * size}), lambda t: CAST(([{kernel}])[t + 1] AS DOUBLE) * {value})))"


# Fixed values, written out for the SQL: gradient kernels, and the high-pass kernel of the noise residual.
_GY, _GX = _conv("-1, -2, -1, 0, 0, 0, 1, 2, 1", 3, "mirror"), _conv("-1, 0, 1, -2, 0, 2, -1, 0, 1", 3, "mirror")
_NOISE = _conv("-1, 2, -2, 2, -1, 2, -6, 8, -6, 2, -2, 8, -12, 8, -2, 2, -6, 8, -6, 2, -1, 2, -2, 2, -1", 5, "zero")
_GRADIENT = f"{_G}, d AS (SELECT vec_id, {_GY} AS gy, {_GX} AS gx FROM g)"


@query(f"""{_GRADIENT}, m AS (SELECT vec_id, list_transform(range(1, 65), lambda k: sqrt(gy[k] * gy[k] + gx[k] * gx[k])) AS e FROM d)
SELECT vec_id, round(list_sum(list_transform(e, lambda v: v / (list_max(e) + CAST(1e-7 AS DOUBLE)))), 6) AS edge FROM m""")
def sobel_grid(spark, sf):
    return _grid(spark, sf).select("vec_id", _SUM(grid.sobel(F.col("a"), 8, 8)).alias("edge"))


@query(f"""{_GRADIENT} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda k: gx[k] * gx[k])) / 64, 6) AS xx, round(list_sum(list_transform(range(1, 65), lambda k: gx[k] * gy[k])) / 64, 6) AS xy,
round(list_sum(list_transform(range(1, 65), lambda k: gy[k] * gy[k])) / 64, 6) AS yy FROM d""")
def gradient_covariance(spark, sf):
    c = grid.gradient_covariance(F.col("a"), 8, 8)
    return _grid(spark, sf).select("vec_id", *[grid.rounded(c[n]).alias(n) for n in ("xx", "xy", "yy")])


@query(f"{_G}, r AS (SELECT vec_id, {_NOISE} AS r FROM g) SELECT vec_id, round(list_sum(list_transform(r, lambda x: abs(x))), 6) AS noise FROM r")
def noise_residual(spark, sf):
    return _grid(spark, sf).select("vec_id", _SUM(F.transform(grid.noise_residual(F.col("a"), 8, 8), F.abs)).alias("noise"))


_BANDS = f"{_G}, b AS (SELECT vec_id, {_BLOCK.format('+', '-', '-')} AS lh, {_BLOCK.format('-', '+', '-')} AS hl, {_BLOCK.format('-', '-', '+')} AS hh FROM g)"


@query(f"""{_BANDS}, m AS (SELECT *, list_min(lh || hl || hh) AS low, list_max(lh || hl || hh) AS high FROM b)
SELECT vec_id, {', '.join(f"round(list_sum(list_transform({n}, lambda v: (v - low) / (high - low + CAST(1e-7 AS DOUBLE)))), 6) AS {n}" for n in ('lh', 'hl', 'hh'))} FROM m""")
def haar_detail(spark, sf):
    """The detail bands, scaled together."""
    d = grid.haar_detail(F.col("a"), 8, 8)
    return _grid(spark, sf).select("vec_id", *[_SUM(d[n]).alias(n) for n in grid.DETAIL])


@query(f"""{_BANDS}, m AS (SELECT *, list_max(list_transform(lh || hl || hh, lambda v: abs(v) / 2)) AS high FROM b)
SELECT vec_id, {', '.join(f"round(list_sum(list_transform({n}, lambda v: abs(v) / 2 / (high + CAST(1e-7 AS DOUBLE)))), 6) AS {n}" for n in ('lh', 'hl', 'hh'))} FROM m""")
def haar_layer(spark, sf):
    d = grid.haar_layer(F.col("a"), 8, 8)
    return _grid(spark, sf).select("vec_id", *[_SUM(d[n]).alias(n) for n in grid.DETAIL])


@query()
def spectrum_features(spark, sf):
    s = grid.spectrum_features(F.col("a"), 8, 8)
    return _grid(spark, sf).withColumn("s", s).select("vec_id", *[F.round(f"s.{n}", 6).alias(n) for n in ("mean", "variance", "skewness", "high")])


@query()
def preprocess_modes(spark, sf):
    """The mean pixel of each channel under each mode of preprocessing; the channels are the grid, its mirror image and its negative."""
    g, a = _grid(spark, sf), F.col("a")
    g = g.select("vec_id", a.alias("r"), grid.flip(a, 8, 8).alias("g"), F.transform("a", lambda v: -v).alias("b"))
    made = g.select("vec_id", *[grid.dispatch(F.col("r"), F.col("g"), F.col("b"), m, 8, 8).alias(m.replace("+", "_")) for m in grid.MODES])
    return made.select("vec_id", *[F.round(_SUM(F.col(m.replace("+", "_"))[c]) / 64, 6).alias(f"{m.replace('+', '_')}_{c}") for m in grid.MODES for c in "rgb"])


_BLUR = _conv(", ".join(["1"] * 9), 3, "zero")


@query(f"{_G}, r AS (SELECT vec_id, list_transform({_BLUR}, lambda v: v / 9) AS r FROM g) SELECT vec_id, round(list_sum(list_transform(r, lambda x: abs(x))), 6) AS blur3 FROM r")
def blurred(spark, sf):
    return _grid(spark, sf).select("vec_id", _SUM(F.transform(grid.blur(F.col("a"), 8, 8), F.abs)).alias("blur3"))


_HALF = "list_transform(range(0, 16), lambda k: (a[(k // 4) * 16 + (k % 4) * 2 + 1] + a[(k // 4) * 16 + (k % 4) * 2 + 2] + a[(k // 4) * 16 + (k % 4) * 2 + 9] + a[(k // 4) * 16 + (k % 4) * 2 + 10]) / 4)"
# Of 8 places over 4 values, place j lies at j / 2 - 1 / 4: a quarter and three quarters of two neighbours, the edge repeated.
_NEAR, _FAR = "greatest(0, least(3, {0} // 2))", "greatest(0, least(3, CASE WHEN {0} % 2 = 0 THEN {0} // 2 - 1 ELSE {0} // 2 + 1 END))"
_AT = "s[{0} * 4 + {1} + 1]"
_BACK = " + ".join(f"{u} * {v} * " + _AT.format(y.format("(k // 8)"), x.format("(k % 8)")) for u, y in ((0.75, _NEAR), (0.25, _FAR)) for v, x in ((0.75, _NEAR), (0.25, _FAR)))


@query(f"{_G}, h AS (SELECT vec_id, {_HALF} AS s FROM g) SELECT vec_id, round(list_sum(list_transform(list_transform(range(0, 64), lambda k: ({_BACK})::DOUBLE), lambda x: abs(x))), 6) AS resized FROM h")
def resized(spark, sf):
    """Down to half the size by area and back bilinearly."""
    return _grid(spark, sf).select("vec_id", _SUM(F.transform(grid.down_up(F.col("a"), 8, 8, (4, 4)), F.abs)).alias("resized"))


@query()
def corruptions(spark, sf):
    return _grid(spark, sf).select("vec_id", *[_SUM(grid.corrupt(F.col("a"), F.col("vec_id"), k, 8, 8, (4, 4))).alias(k) for k in ("blur3", "resize112", "noise05")])


@query(f"{_G} SELECT vec_id, list_transform(range(0, 64), lambda k: round(a[(k // 8) * 8 + 7 - k % 8 + 1], 6)) AS flipped FROM g")
def flipped(spark, sf):
    return _grid(spark, sf).select("vec_id", F.transform(grid.flip(F.col("a"), 8, 8), lambda x: grid.rounded(x)).alias("flipped"))
