"""The queries of the training-data operators, opN_<name>(spark, sf_dir), each over its whole table; ORACLE has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import decontam, infill, langid, media, packing, quality, secrets, simhash, spelling, substring, suffix, urls, wordpiece
from .shared import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(documents(spark, sf_dir)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir), texts=False).drop("kept")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.digest(docs, langid.train(docs))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a table of redirects made from them: short links that join pages, and mirrors under a blocked name."""
    pages = table(spark, sf_dir, "pages")
    short = pages.select(F.concat(F.lit("http://go.example.edu/"), F.floor(F.col("page_id") / 3)).alias("source"), F.col("url").alias("target"))
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    mirrors = pages.where(host.startswith("m.")).select(F.col("url").alias("source"), F.concat(F.lit("http://mirror.net"), path).alias("target"))
    return urls.judge(pages, redirects=short.unionByName(mirrors))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir), texts=False).drop("kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_substring_dedup, op3_secret_scans, op4_media_columns, op5_language_id, op6_best_fit_packing, op7_benchmark_decontamination, op8_url_filters, op9_suffix_array_dedup, op10_token_counts, op11_spelling_variants, op12_quality_rules, op13_fill_in_middle, url_redirects)
}

#: Words of a text as DuckDB lists, for the rules that part words at U+0020 and U+0009 to U+000D.
_WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""

#: Pages judged by SQL; @LINKS: further rows (a, url) for links, by node and target.
_HOST = "translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_NODE = f"""CASE WHEN {_HOST} <> '' THEN {_HOST} || coalesce(nullif(regexp_extract({{0}}, '(?s)^.*?://[^/?#]*([^#]*)', 1), ''), '/') END"""
_RULE = """CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END"""
_JUDGED = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, html, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_NODE.format('url')} AS node FROM pages),
p AS (SELECT page_id, host, path, node, {_RULE} AS rule FROM u),
t AS (SELECT url, host, path, node, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?(?:</script\b[^>]*>|\z)|<style\b.*?(?:</style\b[^>]*>|\z)|<textarea\b.*?(?:</textarea\b[^>]*>|\z)|<title\b.*?(?:</title\b[^>]*>|\z)|<template\b.*?(?:</template\b[^>]*>|\z)', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM u WHERE contains(url, '://')),
v AS (SELECT host, path, node, CASE WHEN regexp_matches(t, '(?is)^<link') THEN regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(t, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)', 1) END AS v
  FROM t WHERE regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b') OR regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')),
w AS (SELECT host, path, node, array_to_string(list_transform(regexp_extract_all(v, '(?i)&(?:amp|lt|gt|quot|apos|#[0-9]{{1,7}}|#x[0-9a-f]{{1,6}});|[^&]+|&'), lambda x: CASE
    WHEN lower(x) = '&amp;' THEN '&' WHEN lower(x) = '&lt;' THEN '<' WHEN lower(x) = '&gt;' THEN '>' WHEN lower(x) = '&quot;' THEN '"' WHEN lower(x) = '&apos;' THEN ''''
    WHEN regexp_matches(x, '^&#[0-9]+;$') THEN chr(CAST(x[3:-2] AS INT)) WHEN regexp_matches(x, '^&#[xX].+;$') THEN chr(CAST('0x' || x[4:-2] AS INT)) ELSE x END), '') AS v FROM v),
x AS (SELECT *, CASE WHEN starts_with(v, '/') THEN v ELSE regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || v END AS whole FROM w),
y AS (SELECT *, regexp_extract(whole, '(?s)^([^?#]*)(.*)$', 1) AS way, regexp_extract(whole, '(?s)^([^?#]*)(.*)$', 2) AS tail FROM x),
z AS (SELECT node AS a, CASE WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN v WHEN starts_with(v, '//') THEN 'http:' || v WHEN starts_with(v, '?') THEN 'http://' || host || path || v
    WHEN v <> '' AND NOT starts_with(v, '#') THEN 'http://' || host || '/' || substr(list_reduce(list_prepend('', string_split(substr(regexp_replace(way, '/(\.\.?)$', '/\1/'), 2), '/')),
      lambda done, s: CASE s WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || s END), 2) || tail END AS url FROM y @LINKS),
e AS (SELECT DISTINCT a, {_NODE.format('url')} AS b FROM z),
ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, ways.b FROM r JOIN ways ON r.other = ways.a),
roots AS (SELECT node, min(other) AS root FROM r GROUP BY node),
says AS (SELECT node, rule FROM p WHERE rule IS NOT NULL UNION SELECT node, rule FROM (SELECT node, {_RULE} AS rule FROM (SELECT {_NODE.format('url')} AS node, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM z)) WHERE rule IS NOT NULL),
bad AS (SELECT root, bool_or(rule IN ('net/', 'example.com/de/')) AND NOT bool_or(rule NOT IN ('net/', 'example.com/de/')) AS bad FROM roots JOIN says USING (node) GROUP BY root)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') OR (rule IS NULL AND coalesce(bad, false)) THEN 'block' ELSE 'allow' END AS verdict, root AS alias_of
FROM p LEFT JOIN roots USING (node) LEFT JOIN bad USING (root)"""
#: Short links, each to the pages of three ids, and a page's mirror under a blocked name, in neither case a page.
_HUBS = f"""
  UNION ALL SELECT {_NODE.format("('http://go.example.edu/' || (page_id // 3))")}, url FROM pages WHERE page_id IS NOT NULL
  UNION ALL SELECT {_NODE.format('url')}, 'http://mirror.net' || {_PATH.format('url')} FROM pages WHERE {_HOST.format('url')} LIKE 'm.%'"""

ORACLE: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT v, min(doc_id) AS m FROM win GROUP BY v),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN firsts USING (v) WHERE doc_id > m),
gone AS (SELECT doc_id, list(k) AS ks FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: ks IS NULL OR NOT list_contains(ks, k)), lambda k: w[k]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op9_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS v FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY v ORDER BY doc_id, i) > 1),
b AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 THEN 1 ELSE 0 END AS b FROM r),
g AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM g GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM sp),
k AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
      FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op7_benchmark_decontamination": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS v
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS v FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w CROSS JOIN ns)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, v)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op8_url_filters": _JUDGED.replace("@LINKS", ""),
    "url_redirects": _JUDGED.replace("@LINKS", _HUBS),
    # crc32 bit by bit into a table, then byte by byte over "<doc_id>:<run>"
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM range(256) r(b)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
crc AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT))), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) AS c FROM bytes CROSS JOIN t),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN c % 31 = 0 THEN run[:c % length(run)] || run[c % length(run) + 2:] ELSE run END AS word, n FROM crc) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS gap FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.gap = b.gap AND a.word <> b.word
  UNION SELECT gaps.word, words.word, words.n FROM gaps JOIN words ON gap = words.word UNION SELECT words.word, gaps.word, gaps.n FROM gaps JOIN words ON gap = words.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word),
found AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root, form FROM found UNION ALL SELECT ways.word, found.word, found.form FROM ways JOIN found ON ways.form = found.word)
SELECT found.word, found.form, root, n, n_near, form_n FROM found JOIN ways ON found.word = ways.word AND ways.form IS NULL""",
    "op13_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
}
