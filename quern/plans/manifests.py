"""Queries over manifests: duplicates, leakage, splits, holdouts, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, filters, hashes, splits
from ..sources import tables
from .registry import query, table

_MAN = """
WITH m AS (SELECT 'd' || doc_id AS path, sha256(text) AS hash, lang AS domain, source AS dataset_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split,
  CAST(doc_id % 2 AS INT) AS label FROM documents)"""


def manifest(spark, sf):
    """Documents as files: path, hash of the content, split, label, dataset and domain."""
    d = F.col("doc_id") % 10
    split = F.when(d < 7, "train").when(d < 9, "val").otherwise("test")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2("text", 256).alias("hash"), F.col("lang").alias("domain"), F.col("source").alias("dataset_id"), split.alias("split"), (F.col("doc_id") % 2).cast("int").alias("label")
    )


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS h, lang, NULL::VARCHAR AS item_id FROM documents UNION ALL SELECT NULL, md5(text), NULL, item_id::VARCHAR FROM benchmark")
def union_by_name(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("h"), "lang")
    return dedup.union_all(a, table(spark, sf, "benchmark").select(F.md5("text").alias("h"), F.col("item_id").cast("string").alias("item_id")))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_first(spark, sf):
    return dedup.dedup_first(table(spark, sf, "documents"), ["text", "lang"], "doc_id").select("doc_id", "lang")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT text) AS distinct_keys, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def duplicate_count(spark, sf):
    return dedup.duplicate_count(table(spark, sf, "documents"), ["text"])


@query("SELECT md5(text) AS h FROM (SELECT trim(text) AS text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT trim(text) FROM documents WHERE doc_id % 2 = 1)")
def cross_duplicates(spark, sf):
    d = table(spark, sf, "documents")
    return dedup.shared_texts(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")).select(F.md5("text").alias("h"))


@query("SELECT count(*) AS overlap FROM (SELECT text FROM documents WHERE doc_id % 5 > 0 INTERSECT SELECT text FROM documents WHERE doc_id % 5 = 0)")
def train_test_overlap(spark, sf):
    d = table(spark, sf, "documents")
    return dedup.overlap_count(d.where("doc_id % 5 > 0"), d.where("doc_id % 5 = 0"))


@query(f"{_MAN} SELECT a.path AS a_path, b.path AS b_path, a.split AS a_split, b.split AS b_split, a.split <> b.split AS cross_split FROM m a JOIN m b USING (hash) WHERE a.path < b.path")
def exact_dup_pairs(spark, sf):
    return dedup.exact_pairs(manifest(spark, sf)).select("a_path", "b_path", "a_split", "b_split", "cross_split")


@query(f"{_MAN}, g AS (SELECT hash, count(*) AS group_size FROM m GROUP BY hash HAVING count(*) > 1) SELECT path, group_size FROM m JOIN g USING (hash)")
def exact_dup_groups(spark, sf):
    return dedup.exact_groups(manifest(spark, sf)).select("path", "group_size")


# Embeddings as images of 64 pixels; each comes again with its last two pixels turned over, and every seventh as it is.
_AHASH = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
x AS (SELECT vec_id, a FROM v UNION ALL SELECT vec_id + 1000000, a[1:62] || [-a[63], -a[64]] FROM v UNION ALL SELECT vec_id + 2000000, a FROM v WHERE vec_id % 7 = 0),
e AS (SELECT vec_id, a, array_to_string(list_transform(a, lambda x: CASE WHEN x >= list_sum(a) / len(a) THEN '1' ELSE '0' END), '') AS bits FROM x)"""


def images(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    turned = v.select(F.col("vec_id") + 1_000_000, F.concat(F.slice("a", 1, 62), F.array(-F.get("a", F.lit(62)), -F.get("a", F.lit(63)))))
    return v.union(turned).union(v.where("vec_id % 7 = 0").select(F.col("vec_id") + 2_000_000, "a"))


def hashed(spark, sf):
    made = images(spark, sf).select(F.col("vec_id").alias("path"), "a", dedup.average_hash_bits(F.col("a"), "bits"))
    return made.withColumn("ahash", dedup.bits_to_long(F.col("bits")))


@query(f"{_AHASH} SELECT vec_id AS path, bits FROM e")
def average_hash(spark, sf):
    return hashed(spark, sf).select("path", "bits")


@query(f"{_AHASH} SELECT a.vec_id AS a_path, b.vec_id AS b_path, CAST(hamming(a.bits, b.bits) AS INT) AS distance FROM e a JOIN e b ON substr(a.bits, 1, 16) = substr(b.bits, 1, 16) AND a.vec_id < b.vec_id WHERE hamming(a.bits, b.bits) <= 5")
def near_dup_pairs(spark, sf):
    return dedup.near_pairs(hashed(spark, sf)).select("a_path", "b_path", "distance")


@query(f"{_AHASH} SELECT a.vec_id AS a_path, b.vec_id AS b_path, CAST(hamming(a.bits, b.bits) AS INT) AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE hamming(a.bits, b.bits) <= 8")
def near_dup_pairs_banded(spark, sf):
    return dedup.near_pairs_banded(hashed(spark, sf), most=8).select("a_path", "b_path", "distance")


@query(f"""{_AHASH}, d AS (SELECT CAST(CAST(bits AS BIT) AS BIGINT) AS h, any_value(bits) AS bits, count(*) AS n FROM e GROUP BY 1)
SELECT a.h AS "left", b.h AS "right", CAST(hamming(a.bits, b.bits) AS INT) AS distance, a.n AS left_n, b.n AS right_n FROM d a JOIN d b ON a.h < b.h WHERE hamming(a.bits, b.bits) <= 8""")
def near_hash_links(spark, sf):
    return hashes.near_links(hashed(spark, sf), radius=8)


_SPLIT = "CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 9 THEN 'val' ELSE 'test' END"


@query(f"""{_AHASH}, m AS (SELECT vec_id AS path, a AS hash, bits, {_SPLIT} AS split FROM e),
p AS (SELECT a.split <> b.split AS x FROM m a JOIN m b ON a.hash = b.hash AND a.path < b.path),
n AS (SELECT a.split <> b.split AS x FROM m a JOIN m b ON substr(a.bits, 1, 16) = substr(b.bits, 1, 16) AND a.path < b.path WHERE hamming(a.bits, b.bits) <= 5)
SELECT (SELECT count(*) FROM m) AS files, (SELECT count(*) FROM m WHERE hash IS NULL) AS errors, (SELECT count(*) FROM p) AS exact_pairs, (SELECT count(*) FROM p WHERE x) AS exact_cross_split, (SELECT count(*) FROM n) AS near_pairs, (SELECT count(*) FROM n WHERE x) AS near_cross_split""")
def dup_summary(spark, sf):
    """The audit summary with both halves."""
    d = F.col("path") % 10
    split = F.when(d < 7, "train").when(d < 9, "val").otherwise("test")
    m = hashed(spark, sf).withColumn("split", split).withColumnRenamed("a", "hash")
    return dedup.audit_summary(m, dedup.exact_pairs(m), dedup.near_pairs(m))


@query(f"""{_MAN}, t AS (SELECT hash, CASE WHEN count(*) FILTER (split = 'train') >= count(*) FILTER (split = 'val') THEN 'train' ELSE 'val' END AS target FROM m WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1 AND count(DISTINCT split) > 1)
SELECT path, coalesce(target, split) AS split FROM m LEFT JOIN t USING (hash)""")
def leakage_repair(spark, sf):
    m = manifest(spark, sf)
    return dedup.repair_leakage(m.drop("hash"), m.select("path", "hash")).select("path", "split")


@query("SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n FROM documents")
def value_frequency(spark, sf):
    return dedup.with_frequency(table(spark, sf, "documents").select("doc_id", "lang"), "lang")


@query("SELECT doc_id, source, coalesce(m.y, -1) AS y FROM documents LEFT JOIN (VALUES ('src0', 0), ('src1', 1)) AS m(source, y) USING (source)")
def mapping_join(spark, sf):
    dim = spark.createDataFrame([("src0", 0), ("src1", 1)], "source string, y int")
    return dedup.lookup(table(spark, sf, "documents"), dim, "source").select("doc_id", "source", F.coalesce("y", F.lit(-1)).alias("y"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf):
    return dedup.resume(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query(f"{_MAN} SELECT path FROM m WHERE path IN (SELECT 'd' || doc_id FROM labels)")
def existing_files(spark, sf):
    listing = table(spark, sf, "labels").select(F.concat(F.lit("d"), "doc_id").alias("path"))
    return filters.existing_files(manifest(spark, sf), listing).select("path")


@query(f"{_MAN} SELECT path, label FROM m WHERE split = 'val' AND label >= 0 AND domain = 'en'")
def split_frame(spark, sf):
    return filters.split_frame(manifest(spark, sf), "val", domain="en").select("path", "label")


@query(f"{_MAN} SELECT path FROM m WHERE split IN ('train', 'val') AND label >= 0")
def training_rows(spark, sf):
    return filters.training_rows(manifest(spark, sf)).select("path")


@query("SELECT doc_id, lang, coalesce(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 END, -1) AS label, CASE WHEN lang IN ('en', 'de') THEN 'train' ELSE 'skipped_unknown' END AS split FROM documents")
def category_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.lit("train").alias("split"))
    return tables.assign_labels(d, {"en": 0, "de": 1}, allow_unknown=True, category="lang").select("doc_id", "lang", "label", "split")


_H = "sha256('42|' || {})"


@query(f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_H.format('doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN k <= round_even(CAST(n AS DOUBLE) * CAST(0.2 AS DOUBLE), 0) THEN 'test' ELSE 'train' END AS part FROM r""")
def strat_split(spark, sf):
    return splits.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.2)


@query(f"SELECT doc_id, quality, CAST(ntile(5) OVER (PARTITION BY quality ORDER BY {_H.format('doc_id')}, doc_id) - 1 AS INT) AS fold FROM labels")
def kfold(spark, sf):
    return splits.stratified_folds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 5)


_UNKNOWN = "CASE WHEN lang = 'fr' THEN 'skipped_unknown' END"


def _partly_known(spark, sf):
    """Documents of one language have no label: a split leaves them as they are."""
    return table(spark, sf, "documents").select("doc_id", "source", F.when(F.col("lang") == "fr", "skipped_unknown").alias("split"))


@query(f"""
WITH d AS (SELECT doc_id, source, {_UNKNOWN} AS u FROM documents), e AS (SELECT * FROM d WHERE u IS NULL),
g AS (SELECT source AS g, count(*) AS n FROM e WHERE source <> '' GROUP BY source),
s AS (SELECT g, coalesce(sum(n) OVER (ORDER BY {_H.format('g')}, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
t AS (SELECT greatest(1, CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS t FROM e)
SELECT doc_id, source, CASE WHEN u IS NOT NULL THEN u WHEN before < t THEN 'val' ELSE 'train' END AS split FROM d LEFT JOIN s ON source = g CROSS JOIN t""")
def group_split(spark, sf):
    return splits.group_split(_partly_known(spark, sf), "source", 0.2)


_ROWS = f"""
WITH d AS (SELECT doc_id, {_UNKNOWN} AS u FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_H.format('doc_id')}, doc_id) AS k FROM d WHERE u IS NULL)
SELECT doc_id, coalesce(u, CASE WHEN k <= greatest(1, floor((SELECT count(*) FROM r) * CAST(0.1 AS DOUBLE))) THEN 'val' ELSE 'train' END) AS split FROM d LEFT JOIN r USING (doc_id)"""


@query(_ROWS)
def row_split(spark, sf):
    return splits.row_split(_partly_known(spark, sf).select("doc_id", "split"), "doc_id", 0.1)


@query(_ROWS)
def group_split_without_groups(spark, sf):
    """Rows are split where no row has a group."""
    return splits.group_split(_partly_known(spark, sf).withColumn("source", F.lit("")), "source", 0.1, key="doc_id").select("doc_id", "split")


_GROUPS = r"""
WITH p AS (SELECT {0}, regexp_extract(regexp_replace({1}, '\.[^.]*$', ''), '^([^_\- ]*)', 1) AS p FROM {2}),
n AS (SELECT p AS q, count(*) AS n FROM p GROUP BY p HAVING count(*) > 1),
j AS (SELECT {0}, q, n FROM p LEFT JOIN n ON p = q)
SELECT {0}, CASE WHEN (SELECT count(n) * 2 >= count(*) FROM j) THEN nullif(q, '') END AS "group" FROM j"""


@query(_GROUPS.format("page_id", "split_part(split_part(url, '://', 2), '/', 1)", "pages"))
def derived_groups(spark, sf):
    """Hosts as names: whole stems."""
    named = table(spark, sf, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("name"))
    return splits.derive_groups(named, "name").select("page_id", "group")


@query(_GROUPS.format("doc_id", "CASE WHEN doc_id % 3 = 0 THEN lang || '.' || source ELSE source || '_' || doc_id || '.txt' END", "documents"))
def derived_name_groups(spark, sf):
    """Names with a separator and without."""
    name = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(".", "lang", "source")).otherwise(F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")))
    return splits.derive_groups(table(spark, sf, "documents").select("doc_id", name.alias("name")), "name").select("doc_id", "group")


_HOLD = f"""{_MAN}, v AS (SELECT DISTINCT domain AS holdout FROM m WHERE coalesce(domain, '') <> ''),
h AS (SELECT path, holdout, CASE WHEN split IN ('train', 'val') THEN CASE WHEN coalesce(domain, '') = holdout THEN 'val' ELSE 'train' END ELSE split END AS split FROM m CROSS JOIN v)"""


@query(f"{_HOLD} SELECT path, holdout, split FROM h")
def holdout_manifests(spark, sf):
    return splits.holdouts(manifest(spark, sf), "domain").select("path", "holdout", "split")


@query(f"{_HOLD} SELECT holdout, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows FROM h GROUP BY holdout")
def holdout_summary(spark, sf):
    return splits.holdout_summary(splits.holdouts(manifest(spark, sf), "domain"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_H.format('doc_id')}, doc_id) AS place FROM documents")
def shuffled(spark, sf):
    """Every row's place in the seeded shuffle."""
    return splits.ranked(table(spark, sf, "documents").select("doc_id"), "doc_id", 42, out="place")


@query(f"SELECT doc_id FROM documents ORDER BY {_H.format('doc_id')}, doc_id LIMIT 50")
def shuffled_head(spark, sf):
    """A limit is the feature here: the first rows of the seeded shuffle."""
    return splits.seeded_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id").limit(50)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def head_rows(spark, sf):
    return splits.head(table(spark, sf, "documents"), "doc_id").select("doc_id")


@query(f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H.format('doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
m AS (SELECT max(n) AS m FROM r)
SELECT doc_id, lang, unnest(range(0, (m - k) // n + 1)) AS copy_no FROM r CROSS JOIN m""")
def balanced(spark, sf):
    return splits.balance(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id").select("doc_id", "lang", "copy_no")


@query("WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT quality, n, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS weight FROM c")
def class_weights(spark, sf):
    return splits.class_weights(table(spark, sf, "labels"), "quality")


@query("""
WITH h AS (SELECT doc_id, sha256('42|' || doc_id) AS h FROM documents), p AS (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b FROM h)
SELECT doc_id, (['rewrite', 'shorten', 'expand', 'formal', 'casual'])[a % 5 + 1] AS prompt_used, round(CAST(0.3 AS DOUBLE) + (b % 61) / 100, 2) AS temperature FROM p""")
def assigned_prompts(spark, sf):
    return splits.assign_prompts(table(spark, sf, "documents").select("doc_id"), "doc_id", ["rewrite", "shorten", "expand", "formal", "casual"])
