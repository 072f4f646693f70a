"""Queries of training input: epochs in seeded order, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws
from ..operators import augment, epochs
from .registry import query, table

_SEED, _EPOCH = 42, 3
_KEYS = [draws.round_keys(_SEED, _EPOCH, r) for r in range(epochs.ROUNDS)]
_PICK = lambda k: f"CASE k % {epochs.ROUNDS} " + " ".join(f"WHEN {r} THEN {x[k]}" for r, x in enumerate(_KEYS)) + " END"


@query(f"""
WITH RECURSIVE t AS (SELECT max(doc_id) + 1 AS n, CAST(ceil(sqrt(max(doc_id) + 1)) AS BIGINT) AS a, CAST(ceil((max(doc_id) + 1) / ceil(sqrt(max(doc_id) + 1))) AS BIGINT) AS b FROM documents),
walk AS (SELECT doc_id, doc_id // b AS u, doc_id % b AS v, a AS m, b AS w, 0 AS k, n, b FROM documents, t
  UNION ALL SELECT doc_id, v, (u + {draws.mixed_sql('v', _PICK(0), _PICK(1))}) % m, w, m, k + 1, n, b FROM walk WHERE NOT (k > 0 AND k % {epochs.ROUNDS} = 0 AND u * b + v < n)),
p AS (SELECT doc_id, u * b + v AS p FROM walk WHERE k > 0 AND k % {epochs.ROUNDS} = 0 AND u * b + v < n)
SELECT doc_id, CAST(p % 4 AS INT) AS shard, p // 4 AS place, p // 4 // 16 AS batch FROM p WHERE p // 4 >= 10""")
def epoch_order(spark, sf):
    """The third epoch of the documents in four shards and batches of sixteen, resumed at the tenth place."""
    docs = table(spark, sf, "documents").select("doc_id")
    n = docs.agg(F.max("doc_id")).first()[0] + 1
    return epochs.epoch(docs, n, _SEED, _EPOCH, "doc_id", shards=4, batch=16, start=10)


def _draw(stream: str, counter: str = "0") -> str:
    a, b = draws.round_keys("stream", stream)
    return f"({draws.mixed_sql(counter, f'((one + {a}) % {draws.PRIME})', f'((two + {b}) % {draws.PRIME})')} / 2147483648.0::DOUBLE)"


def _row(name: str) -> str:
    a = draws.round_keys(_SEED, _EPOCH, name)
    return draws.mixed_sql(f"vec_id % {draws.PRIME}", f"(((vec_id >> 31) % {draws.PRIME} + {a[0]}) % {draws.PRIME})", a[1])


_DOMAIN = "CASE label % 5 WHEN 0 THEN 'doc' WHEN 1 THEN ' Satellite' WHEN 2 THEN 'FF++' WHEN 3 THEN 'chameleon' END"


def _by_domain(pick) -> str:
    cases = " ".join(f"WHEN d = '{d}' THEN {float(pick(s))}" for d, s in augment.DOMAINS.items())
    return f"CAST(CASE {cases} ELSE {float(pick(augment.GENERAL))} END AS DOUBLE)"


def _between(stream: str, low: str, high: str) -> str:
    return f"({low} + {_draw(stream)} * ({high} - {low}))"


def _factor(what: str) -> str:
    return _between(what, _by_domain(lambda s: s[what][0]), _by_domain(lambda s: s[what][1]))


def _shift(what: str) -> str:
    return _between(what, "-" + _by_domain(lambda s: s[what]), _by_domain(lambda s: s[what]))


def _chance(what: str) -> str:
    return f"({_draw(what)} < {_by_domain(lambda s: s[what])})"


def augmented_images(spark, sf):
    """(vec_id, image, domain): the embeddings as 8 x 8 images, their numbers between 0 and 1, with a domain by label."""
    a = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") + 0.5)))
    image = F.struct(a.alias("r"), F.reverse(a).alias("g"), F.transform(a, lambda v: 1 - v).alias("b"))
    return table(spark, sf, "embeddings").select("vec_id", image.alias("image"), F.expr(_DOMAIN).alias("domain"))


@query(f"""
WITH e AS (SELECT vec_id, lower(trim({_DOMAIN})) AS d, {_row('one')} AS one, {_row('two')} AS two FROM embeddings),
s AS (SELECT *, greatest(8, CAST(floor(8 * {_between('scale', '0.9::DOUBLE', '1.1::DOUBLE')}) AS INT)) AS tall FROM e)
SELECT vec_id, tall, CAST(floor({_draw('top')} * (tall - 7)) AS INT) AS top, CAST(floor({_draw('left')} * (tall - 7)) AS INT) AS "left", {_chance('flip')} AS flip, {_chance('upside')} AS upside,
  CASE WHEN {_chance('turn')} THEN CAST(floor({_draw('turns')} * 4) AS INT) ELSE 0 END AS turns, round({_shift('brightness')}, 9) AS brightness, round({_factor('contrast')}, 9) AS contrast,
  round({_factor('saturation')}, 9) AS saturation, round({_shift('hue')}, 9) AS hue, {_chance('blur')} AS blur, {_chance('noise')} AS noise FROM s""")
def augment_choices(spark, sf):
    """What each image's augmentation does."""
    c = augment.choices(F.col("vec_id"), F.col("domain"), 8, 8, _SEED, _EPOCH)
    made = augmented_images(spark, sf).select("vec_id", c.alias("c"))
    real = {"brightness", "contrast", "saturation", "hue"}
    names = ("tall", "top", "left", "flip", "upside", "turns", "brightness", "contrast", "saturation", "hue", "blur", "noise")
    return made.select("vec_id", *[(F.round(F.col("c")[n], 9) if n in real else F.col("c")[n]).alias(n) for n in names])


@query()
def augmented(spark, sf):
    """The augmented images: sums by channel."""
    made = augmented_images(spark, sf).select("vec_id", augment.augment(F.col("image"), F.col("vec_id"), F.col("domain"), 8, 8, _SEED, _EPOCH).alias("a"))
    return made.select("vec_id", *[F.round(F.aggregate(F.col("a")[c], F.lit(0.0), lambda s, v: s + v), 6).alias(c) for c in augment.CHANNELS])
