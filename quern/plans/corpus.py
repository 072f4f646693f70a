"""Queries over texts: cleaning, features, filters, chunks, profiles, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.features import with_features
from ..operators import chunk, dedup, filters, profile, sketches, tokens
from ..sources import files
from ..sources.tables import spread
from . import registry
from .registry import query, table


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
LEAKLESS = r"regexp_replace(regexp_replace(text, '\[AI[^\]]*\]', '', 'g'), '\[Human[^\]]*\]', '', 'g')"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
STATS = "min({0}) AS min_{1}, max({0}) AS max_{1}, round(avg({0}), 6) AS mean_{1}, median({0}) AS median_{1}"


def cleaned(spark, sf):
    return docs(spark, sf).withColumn("text", T.squeeze(T.strip_leak_labels(F.col("text"))))


@query(f"""
WITH c AS (SELECT doc_id, lang, {SQUEEZE.format(LEAKLESS)} AS t FROM documents),
w AS (SELECT doc_id, lang, t, CAST(len({WORDS.format('t')}) AS INT) AS n FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS k FROM w WHERE n >= 10)
SELECT lang, count(*) AS rows, {STATS.format('n', 'words')}, round(stddev_samp(n), 6) AS std_words FROM d WHERE k = 1 GROUP BY lang""")
def corpus_word_stats(spark, sf):
    """Clean leak labels and white space, keep ten words or more, first of equal texts, word statistics by language."""
    return profile.word_stats(dedup.dedup_first(filters.min_words(cleaned(spark, sf), 10), ["text"], "doc_id"), "lang")


@query(f"SELECT doc_id, md5({SQUEEZE.format(LEAKLESS)}) AS h FROM (SELECT doc_id, '[AI text ' || doc_id || '] ' || text || ' [Human: ' || lang || ']' AS text FROM documents)")
def clean_leak_labels(spark, sf):
    """Each text has a label before it and one behind."""
    marked = docs(spark, sf).withColumn("text", F.concat(F.lit("[AI text "), F.col("doc_id").cast("string"), F.lit("] "), "text", F.lit(" [Human: "), "lang", F.lit("]")))
    return marked.select("doc_id", F.md5(T.squeeze(T.strip_leak_labels(F.col("text")))).alias("h"))


@query()
def clean_markdown(spark, sf):
    """Each text stands below a heading made of its id, with emphasis and a list, so that the rules have something to do."""
    t = F.concat(F.lit("## Part "), "doc_id", F.lit("\n- **bold** and *thin*\n"), "text")
    return docs(spark, sf).select("doc_id", F.md5(T.remove_markdown(t)).alias("h"), (T.remove_markdown(t) != t).alias("changed"))


_META = (
    r"regexp_replace(regexp_replace(regexp_replace(text, '(?i)^(?:here(?:''?s| is)(?: the| a| my)?(?: rewritten| revised| paraphrased| expanded| following| essay| text| passage| version)?[:\s]*\n?)', ''), "
    r"'(?i)^(?:this (?:is a |is an )?(?:rewritten|revised|paraphrased|essay|text|passage)[^.]*\.\s*)', ''), "
    r"'(?i)(?:i hope (?:this|you)[^.]*\.|feel free to[^.]*\.|let me know if[^.]*\.|please note[^.]*\.)\s*$', '')"
)


#: What rewriters put around a text, around three of four.
_AROUND = r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Here is the rewritten text:' || chr(10) || text || ' I hope this helps.' WHEN 1 THEN 'This is a revised essay of ' || doc_id || '. ' || text
  WHEN 2 THEN text || ' Let me know if it is too long.' ELSE text END AS text FROM documents)"""


def _around(spark, sf):
    t, k = F.col("text"), F.col("doc_id") % 4
    made = F.when(k == 0, F.concat(F.lit("Here is the rewritten text:\n"), t, F.lit(" I hope this helps."))).when(k == 1, F.concat(F.lit("This is a revised essay of "), F.col("doc_id").cast("string"), F.lit(". "), t))
    return docs(spark, sf).withColumn("text", made.when(k == 2, F.concat(t, F.lit(" Let me know if it is too long."))).otherwise(t))


@query(rf"{_AROUND} SELECT doc_id, md5(regexp_replace({_META}, '^\s+|\s+$', '', 'g')) AS h FROM d")
def clean_meta(spark, sf):
    return _around(spark, sf).select("doc_id", F.md5(T.remove_meta(F.col("text"))).alias("h"))


@query(r"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)^(?:so[,\s]+(?:basically[,\s]+|here''?s?\s+the\s+thing[,\s]*|anyway[,\s]+|yeah[,\s]+)?)', ''), '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'So, basically, ' || text WHEN 1 THEN 'so here''s the thing, ' || text ELSE text END AS text FROM documents))
SELECT doc_id, md5(upper(substr(t, 1, 1)) || substr(t, 2)) AS h FROM c""")
def clean_filler(spark, sf):
    """Two of three texts begin with a filler."""
    t, k = F.col("text"), F.col("doc_id") % 3
    opened = F.when(k == 0, F.concat(F.lit("So, basically, "), t)).when(k == 1, F.concat(F.lit("so here's the thing, "), t)).otherwise(t)
    return docs(spark, sf).select("doc_id", F.md5(T.remove_filler(opened)).alias("h"))


_FOLD = "regexp_replace(replace(replace(replace(translate({}, '—–‘’“”éèàçêâôûîïüöä', '--''''\"\"eeaceaouiiuoa'), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), '[^\\x00-\\x7F]', '', 'g')"


@query(f"SELECT doc_id, md5({_FOLD.format('text')}) AS h FROM documents")
def ascii_fold(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.fold_ascii(F.col("text"))).alias("h"))


_RUNS = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '!{{2,}}', '!', 'g'), '\?{{2,}}', '?', 'g'), '\.{{3,}}', '.', 'g'), '-{{3,}}', '-', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_RUNS.format(_FOLD.format('text'))}) AS h FROM documents")
def normalize_punctuation(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("h"))


_FOLD_SHORT = "regexp_replace(replace(replace(translate({}, '—–‘’“”éèàç', '--''''\"\"eeac'), 'æ', 'ae'), 'œ', 'oe'), '[^\\x00-\\x7F]', '', 'g')"


@query(rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '<[^>]+>', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM documents),
k AS (SELECT doc_id, array_to_string(list_filter(ls, lambda x: x <> '' AND NOT (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}') AND length(x) < 60) AND len({WORDS.format('x')}) >= 4), ' ') AS t FROM l),
n AS (SELECT doc_id, {_FOLD_SHORT.format('t')} AS t FROM k)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!{{2,}}', '!', 'g'), '\.{{3,}}', '.', 'g'), '-{{3,}}', '-', 'g'), '\s+', ' ', 'g'))) AS h FROM n""")
def clean_archive(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.clean_archive(F.col("text"))).alias("h"))


@query()
def clean_book(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.clean_book(F.col("text"))).alias("h"))


def _chain(c, *pairs):
    for pattern, new in pairs:
        c = "regexp_replace({}, '{}', '{}', 'g')".format(c, pattern, new)
    return c


# Fixed values, written out for the SQL: the markup of wiki texts and of abstracts.
_WIKI = _chain(
    "html", (r"\[[0-9]+\]", ""), (r"\[note [0-9]+\]", ""), (r"\[[a-z]\]", ""), (r"\([^)]*(ˈ|ˌ)[^)]*\)", ""), (r"\([0-9]+°(N|S)[^)]*\)", ""), ("<[^>]+>", ""),
    (r"\{{\{{[^}}]*\}}\}}".replace("{{", "{").replace("}}", "}"), ""), (r"\[\[([^\]|]+\|)?([^\]]+)\]\]", r"\2"), ("''{2,3}", ""), (r"\([^)]{1,25}\)", ""),
)


@query(f"SELECT page_id, md5({_RUNS.format(_FOLD.format(_WIKI))}) AS h FROM pages")
def clean_wiki(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", F.md5(T.clean_wiki(F.col("html"))).alias("h"))


@query()
def clean_forum(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", F.md5(T.clean_forum(F.col("html"))).alias("h"))


_LATEX = _chain(
    "text", (r"\$[^$]+\$", ""), (r"\$\$[^$]+\$\$", ""), (r"\\[\p{L}\p{N}_]+\{[^}]*\}", ""), (r"\\[\p{L}\p{N}_]+", ""), (r"\{[^}]*\}", ""), (r"\[[0-9]+\]", ""),
    (r"\(cf\.[^\n]*?\)", ""), (r"[^\x00-\x7F]", ""), (r"\.{3,}", "."),
)


@query(f"SELECT doc_id, md5({SQUEEZE.format(_LATEX)}) AS h FROM documents")
def clean_abstract(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.clean_abstract(F.col("text"))).alias("h"))


@query(f"SELECT doc_id, md5(coalesce({SQUEEZE.format('lower(text)')}, '')) AS h FROM documents")
def lower_squeezed(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.lower_squeezed(F.col("text"))).alias("h"))


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace({SQUEEZE.format('text')}, '[^\x00-\x7F]+', ' ', 'g'), '\b\w{{1,2}}\b', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents""")
def clean_ocr(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.clean_ocr(F.col("text"))).alias("h"))


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '\s', '', 'g') <> '')) AS INT) AS sentences FROM documents""")
def sentence_counts(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.sentences_capital(F.col("text"))).alias("sentences"))


@query()
def protected_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.sentences_protected(F.col("text"))).alias("sentences"), F.size(T.sentences_any(F.col("text"))).alias("parts"))


@query(rf"""
SELECT doc_id, CAST(len({WORDS.format('text')}) AS INT) AS word_count, CAST(length(text) AS INT) AS char_count,
  CAST(length(regexp_replace(text, '[^"]', '', 'g')) AS INT) AS quote_chars, CAST(length(regexp_replace(text, '[^()]', '', 'g')) AS INT) AS paren_chars,
  CAST(length(regexp_replace(text, '[^,]', '', 'g')) AS INT) AS comma_count, CAST(length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS INT) AS upper_count,
  CAST(length(regexp_replace(text, '\P{{L}}', '', 'g')) AS INT) AS alpha_count, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS INT) AS digit_count,
  regexp_matches(text, '^\p{{Ll}}') AS starts_lower, doc_id % 6 = 0 AS has_url FROM documents""")
def text_features(spark, sf):
    """The features that need no sentences, in one pass; a link is in every sixth text, which the others only seem to have."""
    link = F.concat(F.col("text"), F.lit("\nhttp"), F.when(F.col("doc_id") % 4 == 0, "s").otherwise(""), F.lit("://x.org/a"))
    linked = F.coalesce(F.when(F.col("doc_id") % 6 == 0, link), F.concat("text", F.lit(" http:/ ftp://x")))
    names = ("word_count", "char_count", "quote_chars", "paren_chars", "comma_count", "upper_count", "alpha_count", "digit_count", "starts_lower")
    plain = with_features(docs(spark, sf).select("doc_id", "text"), only=names)
    found = with_features(plain.withColumn("linked", linked), "linked", only=("has_url",))
    return found.select("doc_id", *names, "has_url")


_OLD = rf"""
WITH f AS (SELECT doc_id, len({WORDS.format('text')}) AS n, length(text) AS c, length(regexp_replace(text, '[\p{{L}}\s]', '', 'g')) AS s,
  len(list_filter({WORDS.format('text')}, lambda w: length(w) <= 2)) AS w2 FROM documents),
r AS (SELECT doc_id, CASE WHEN n NOT BETWEEN 100 AND 350 THEN 'word_count' WHEN s * 100 > c * 15 THEN 'symbols' WHEN w2 * 100 > n * 25 THEN 'short_words' END AS reason FROM f)"""


@query(f"{_OLD} SELECT doc_id, reason FROM r")
def filter_old_abstract(spark, sf):
    return filters.with_reason(docs(spark, sf), "old_abstract").select("doc_id", "reason")


@query(f"{_OLD} SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def filter_reason_topk(spark, sf):
    return chunk.reason_tally(filters.with_reason(docs(spark, sf), "old_abstract"))


# Fixed values, written out for the SQL: stop words at a sentence's start, and those of archives.
_START = "'" + "', '".join("the a an in it he she this that they we i its his her their our at on by as of to for and but".split()) + "'"
_STOP = "'" + "', '".join(
    """that with they have were would will which what their from this been there very into could then them him her she his you the and but for not are was
    had has its our more some when than also just like about over after before being other much well only even back know here time down still again never same
    away make made take took look because though without through every might must each where while always already between""".split()
) + "'"


@query(rf"""
WITH f AS (SELECT doc_id, text AS t, {WORDS.format('text')} AS w, length(text) AS c FROM documents),
s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '\s', '', 'g') <> '') AS ss FROM f),
sw AS (SELECT doc_id, list_transform(ss, lambda x: len({WORDS.format('x')})) AS ns, list_transform(ss, lambda x: lower({WORDS.format('x')}[1])) AS st FROM s),
cw AS (SELECT doc_id, unnest(list_filter(list_transform(list_filter(w, lambda x: length(x) > 3), lambda x: trim(lower(x), '.,!?";:()')), lambda x: x NOT IN ({_STOP}))) AS v FROM f),
ct AS (SELECT doc_id, max(n) AS top, sum(n) AS total FROM (SELECT doc_id, v, count(*) AS n FROM cw GROUP BY doc_id, v) GROUP BY doc_id),
sc AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(st, lambda x: x NOT IN ({_START}))) AS v FROM sw) GROUP BY doc_id, v) GROUP BY doc_id),
q AS (SELECT doc_id, list_sum(list_transform(regexp_extract_all(t, '"([^"]*)"', 1), lambda x: len({WORDS.format('x')}))) AS qw,
  length(regexp_replace(t, '[^0-9]', '', 'g')) AS dg, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS up, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS al FROM f)
SELECT f.doc_id, CASE
  WHEN len(w) < 50 THEN 'too_short' WHEN regexp_matches(t, '^\p{{Ll}}') THEN 'starts_lower' WHEN regexp_matches(t, 'https?://') THEN 'url'
  WHEN dg * 100 > c * 8 THEN 'digits' WHEN up * 100 > al * 15 THEN 'upper' WHEN coalesce(qw, 0) * 100 > len(w) * 30 THEN 'quoted'
  WHEN list_sum(ns) / len(ns) < 8 OR list_sum(ns) / len(ns) > 45 THEN 'mean_sentence'
  WHEN len(list_filter(ns, lambda x: x <= 3)) / len(ns) > CAST(0.30 AS DOUBLE) THEN 'short_sentences'
  WHEN list_max(ns) > 100 THEN 'long_sentence' WHEN len(ns) >= 4 AND coalesce(sc.top, 0) / len(ns) > CAST(0.40 AS DOUBLE) THEN 'repeated_start'
  WHEN coalesce(ct.top / ct.total, 0) > CAST(0.04 AS DOUBLE) THEN 'top_word' END AS reason
FROM f JOIN sw USING (doc_id) JOIN q USING (doc_id) LEFT JOIN ct USING (doc_id) LEFT JOIN sc USING (doc_id)""")
def filter_archive(spark, sf):
    return filters.with_reason(docs(spark, sf), "archive", least_words=50).select("doc_id", "reason")


# Fixed values, written out for the SQL: what stories say besides, and spellings of dialect.
_STORY = _STOP + ", '" + "', '".join("said your upon shall whom such those these long ever came come went going looked tell told".split()) + "'"
_DIALECT = r"(?i)\b(warn''t|hain''t|gov''ment|sivilized|hick''ry|gwyne|wuz\b|git\b|fer\b|yer\b|woulda|coulda|shoulda|gonna|wanna|ain''t gonna|hafta|gotta)\b"


def _judged(content, rules):
    """SQL for rules over features of texts parted at white space behind . ! or ?; content: SQL from w, the words, to those that count."""
    return rf"""
WITH f AS (SELECT doc_id, text AS t, {WORDS.format('text')} AS w, length(text) AS c FROM documents),
s AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '\s', '', 'g') <> ''), lambda x: len({WORDS.format('x')})) AS ns FROM f),
cw AS (SELECT doc_id, unnest({content}) AS v FROM f),
ct AS (SELECT doc_id, list(n ORDER BY n DESC) AS tops, sum(n) AS total FROM (SELECT doc_id, v, count(*) AS n FROM cw GROUP BY doc_id, v) GROUP BY doc_id),
q AS (SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(t, '"([^"]*)"', 1), lambda x: len({WORDS.format('x')}))), 0) AS qw, length(regexp_replace(t, '[^"]', '', 'g')) AS qc,
  length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS up, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS al, length(regexp_replace(t, '[\p{{L}}\s]', '', 'g')) AS sy FROM f)
SELECT f.doc_id, CASE {rules} END AS reason FROM f JOIN s USING (doc_id) JOIN q USING (doc_id) LEFT JOIN ct USING (doc_id)"""


@query(_judged(
    f"list_filter(list_transform(list_filter(w, lambda x: length(x) > 3), lambda x: trim(lower(x), '.,!?\";:')), lambda x: x NOT IN ({_STORY}))",
    rf"""WHEN regexp_matches(t, '^\p{{Ll}}') THEN 'starts_lower' WHEN qw * 100 > len(w) * 30 THEN 'quoted' WHEN regexp_matches(t, '{_DIALECT}') THEN 'dialect'
    WHEN tops[1] / total > CAST(0.03 AS DOUBLE) THEN 'top_word' WHEN list_sum(ns) / len(ns) < 10 OR list_sum(ns) / len(ns) > 40 THEN 'mean_sentence' WHEN qc * 100 > c * 5 THEN 'quote_chars'
    WHEN len(list_filter(ns, lambda x: x <= 3)) / len(ns) > CAST(0.30 AS DOUBLE) THEN 'short_sentences' WHEN list_sum(tops[1:10]) / total > CAST(0.60 AS DOUBLE) THEN 'top10_words'
    WHEN list_max(ns) > 100 THEN 'long_sentence'""",
))
def filter_book(spark, sf):
    return filters.with_reason(docs(spark, sf), "book").select("doc_id", "reason")


@query()
def filter_modern(spark, sf):
    return filters.with_reason(docs(spark, sf), "modern", least_words=50).select("doc_id", "reason")


@query(_judged(
    f"list_transform(list_filter(w, lambda x: length(x) > 3 AND lower(x) NOT IN ({_STOP})), lambda x: trim(lower(x), '.,!?\";:()'))",
    r"""WHEN len(w) NOT BETWEEN 100 AND 350 THEN 'word_count' WHEN sy * 100 > c * 15 THEN 'symbols' WHEN regexp_matches(t, '^\p{Ll}') THEN 'starts_lower' WHEN up * 100 > al * 20 THEN 'upper'
    WHEN list_sum(ns) / len(ns) < 8 OR list_sum(ns) / len(ns) > 60 THEN 'mean_sentence' WHEN tops[1] / total > CAST(0.05 AS DOUBLE) THEN 'top_word'""",
))
def filter_abstract(spark, sf):
    return filters.with_reason(docs(spark, sf), "abstract").select("doc_id", "reason")


@query(f"""WITH a AS ({registry.ORACLE['filter_archive']}), {_OLD.strip()[5:]},
k AS (SELECT f.* FROM f JOIN a USING (doc_id) WHERE a.reason IS NULL)
SELECT 'word_count' AS "check", count(*) FILTER (n NOT BETWEEN 100 AND 350) AS n FROM k UNION ALL SELECT 'symbols', count(*) FILTER (s * 100 > c * 15) FROM k UNION ALL SELECT 'short_words', count(*) FILTER (w2 * 100 > n * 25) FROM k
UNION ALL SELECT 'archive', count(*) FILTER (a.reason IS NOT NULL) FROM k JOIN a USING (doc_id)""")
def quality_recheck(spark, sf):
    """What the archive filter kept: how much of it breaks each abstract rule, and any archive rule, which is none."""
    at = files.workspace(spark, "kept")
    filters.with_reason(docs(spark, sf).select("doc_id", "text"), "archive", least_words=50).where("reason is null").select("doc_id", "text").write.parquet(at)
    kept = spread(spark.read.parquet(at))
    own = filters.quality_counts(kept, "archive", least_words=50).agg(F.lit("archive").alias("check"), F.sum("n").alias("n"))
    return filters.quality_counts(kept, "old_abstract").unionByName(own)


_CHUNK = rf"""
WITH f AS (SELECT doc_id, lang, {WORDS.format('text')} AS w FROM documents),
c AS (SELECT doc_id, lang, w, unnest(range(0, (len(w) + 49) // 50)) AS k FROM f),
h AS (SELECT doc_id, lang, k, w[k * 50 + 1:k * 50 + 50] AS x FROM c),
r AS (SELECT doc_id, lang, CAST(k AS INT) AS chunk_no, array_to_string(x, ' ') AS chunk FROM h WHERE len(x) BETWEEN 20 AND 50)"""


def _chunks(spark, sf):
    return chunk.fixed_chunks(docs(spark, sf).select("doc_id", "lang", "text"), size=50, least=20, most=50).drop("text")


@query(f"{_CHUNK} SELECT doc_id, chunk_no, md5(chunk) AS h FROM r")
def chunk_fixed(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_no", F.md5("chunk").alias("h"))


@query(f"""{_CHUNK}, n AS (SELECT doc_id, chunk_no, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM r)
SELECT doc_id, chunk_no FROM n WHERE n <= 6 OR (k >= (n - 6) // 2 AND k < (n - 6) // 2 + 6)""")
def middle_slice(spark, sf):
    return chunk.middle_slice(_chunks(spark, sf), "doc_id", 6).select("doc_id", "chunk_no")


@query(f"""{_CHUNK} SELECT lang, doc_id, chunk_no FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, chunk_no) AS k FROM r) WHERE k <= 25""")
def target_per_category(spark, sf):
    made = _chunks(spark, sf).withColumn("o", F.struct("doc_id", "chunk_no"))
    return chunk.until_target(made, "lang", 25, "o").select("lang", "doc_id", "chunk_no")


@query()
def sentence_chunks(spark, sf):
    return chunk.sentence_chunks(docs(spark, sf), "archive", size=80, least=40, most=100, skip=2).select("doc_id", "chunk_no", F.md5("chunk").alias("h"), "word_count")


@query(r"""
SELECT md5(t) AS h, y AS is_generated FROM (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, CAST(CASE role WHEN 'user' THEN 0 ELSE 1 END AS INT) AS y FROM conversations WHERE role IN ('user', 'assistant')) WHERE t <> ''""")
def explode_answers(spark, sf):
    c = table(spark, sf, "conversations")
    said = lambda r: F.to_json(F.collect_list(F.when(F.col("role") == r, F.col("text"))))
    nested = c.groupBy("conv_id").agg(said("user").alias("human_answers"), said("assistant").alias("chatgpt_answers"))
    return chunk.explode_answers(nested).select(F.md5("text").alias("h"), "is_generated")


_PROFILE = rf"""count(*) AS rows, count(*) FILTER (quality = 1) AS ai_rows, count(*) FILTER (quality = 0) AS human_rows,
  count(*) FILTER (quality IS NULL OR quality NOT IN (0, 1)) AS other_rows, round(count(*) FILTER (quality = 1) * 100.0 / count(*), 2)::DOUBLE AS ai_percent,
  round(count(*) FILTER (quality = 0) * 100.0 / count(*), 2)::DOUBLE AS human_percent, count(*) FILTER (text IS NULL) AS null_texts, count(*) FILTER (quality IS NULL) AS null_labels,
  count(*) - count(DISTINCT text) AS duplicate_texts, {STATS.format('w', 'words')}, {STATS.format('c', 'chars')},
  round(avg(w) FILTER (quality = 1), 6) AS ai_mean_words, round(avg(w) FILTER (quality = 0), 6) AS human_mean_words
FROM (SELECT lang, text, quality, CAST(len({WORDS.format('text')}) AS INT) AS w, CAST(length(text) AS INT) AS c FROM documents LEFT JOIN labels USING (doc_id))"""


def _labelled(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")


@query(f"SELECT {_PROFILE}")
def corpus_profile(spark, sf):
    return profile.corpus_profile(_labelled(spark, sf), label="quality")


@query(f"SELECT lang, {_PROFILE} GROUP BY ROLLUP (lang)")
def profile_rollup(spark, sf):
    return profile.corpus_profile(_labelled(spark, sf), label="quality", by="lang")


@query("SELECT count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75, max(n_chars) AS max FROM documents")
def describe_lengths(spark, sf):
    return profile.describe(docs(spark, sf), "n_chars")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def source_frequencies(spark, sf):
    return profile.frequencies(docs(spark, sf), "source", "lang")


@query(f"""
WITH w AS (SELECT quality, CAST(len({WORDS.format('text')}) AS INT) AS n FROM documents JOIN labels USING (doc_id))
SELECT quality, count(*) AS rows, {STATS.format('n', 'words')}, round(stddev_samp(n), 6) AS std_words, round(count(*) * 100.0 / (SELECT count(*) FROM w), 2)::DOUBLE AS percent FROM w GROUP BY quality""")
def class_shares(spark, sf):
    return profile.class_shares(_labelled(spark, sf).where("quality is not null"), "quality")


@query(rf"""
WITH a AS (SELECT text AS t0, {LEAKLESS} AS t1 FROM documents), b AS (SELECT *, {SQUEEZE.format('t1')} AS t2 FROM a), c AS (SELECT *, lower(t2) AS t3 FROM b)
SELECT 'labels' AS step, count(*) FILTER (t1 <> t0) AS changed FROM c UNION ALL SELECT 'squeeze', count(*) FILTER (t2 <> t1) FROM c UNION ALL SELECT 'lower', count(*) FILTER (t3 <> t2) FROM c""")
def cleaning_report(spark, sf):
    return profile.step_report(docs(spark, sf), "text", [("labels", T.strip_leak_labels), ("squeeze", T.squeeze), ("lower", F.lower)])


@query(rf"""
WITH c AS (SELECT doc_id AS item_id, word, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format('lower(text)')}) AS word FROM documents) GROUP BY doc_id, word)
SELECT item_id, word, n, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, word) AS k FROM c) WHERE k <= 3""")
def top_words(spark, sf):
    return profile.top_words(docs(spark, sf).select(F.col("doc_id").alias("item_id"), "text"), "item_id")


_TOKENS = "list_filter(string_split(translate(lower(text), '!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 33)), ' '), lambda w: w <> '')"
_VOCAB = f"""
WITH t AS (SELECT item_id, w, i FROM (SELECT item_id, unnest({_TOKENS}) AS w, unnest(range(0, len({_TOKENS}))) AS i FROM (SELECT doc_id AS item_id, text FROM documents))),
c AS (SELECT w AS word, count(*) AS n, min((item_id, i)) AS f FROM t GROUP BY w),
v AS (SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, f) + 1 AS INT) AS id FROM c)"""


@query(f"{_VOCAB} SELECT word, n, id FROM v")
def vocabulary(spark, sf):
    return tokens.vocabulary(docs(spark, sf), "text", "doc_id")


@query(f"""{_VOCAB}, e AS (SELECT item_id, list(CASE WHEN id < 200 THEN id ELSE 1 END ORDER BY i) AS ids FROM t JOIN v ON w = word GROUP BY item_id)
SELECT doc_id, coalesce(array_to_string(list_resize(ids, 20, 0), ','), repeat('0,', 19) || '0') AS ids FROM documents LEFT JOIN e ON doc_id = item_id""")
def encode_pad(spark, sf):
    d = docs(spark, sf)
    made = tokens.encode(d, tokens.vocabulary(d, "text", "doc_id"), "text", "doc_id", 20, num_words=200)
    return made.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview FROM documents")
def previews(spark, sf):
    return docs(spark, sf).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(r"SELECT page_id, regexp_matches(trim(url), '(?i)^https?://[^\s/$.?#].[^\s]*$') AS valid, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM pages")
def url_slugs(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", T.valid_url(F.col("url")).alias("valid"), T.slug(F.col("url")).alias("slug"))


@query()
def tfidf_lr(spark, sf):
    """Fit TF-IDF with logistic regression on labelled documents and score them."""
    rows = _labelled(spark, sf).where("quality is not null").select("doc_id", "text", F.col("quality").alias("y"))
    _, scored = tokens.fit_written(tokens.tfidf_pipeline(), rows, files.workspace(spark, "terms"), "doc_id", "y")
    return scored.select("doc_id", "y", F.col("prediction").cast("int").alias("pred"))


_W = r"len(regexp_extract_all(text, '\S+'))"


@query(f"""SELECT source, count(*) AS rows, CAST(sum({_W}) AS BIGINT) AS words, min({_W}) AS min_words, max({_W}) AS max_words, count(*) FILTER (quality = 1) AS ai_rows,
  round(avg({_W}), 6) AS mean_words, true AS quartiles_hold, true AS distinct_holds FROM (SELECT DISTINCT ON (doc_id) * FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source""")
def profile_from_days(spark, sf):
    """The profile by source, merged from a table of daily sketches that was written in two parts, and whether its quartiles and distinct
    counts lie within their errors of the exact ones."""
    docs = _labelled(spark, sf).withColumns({"day": F.format_string("2024-01-%02d", F.col("doc_id") % 30 + 1), "is_generated": F.col("quality")})
    at = files.workspace(spark, "profile")
    for part in (F.col("doc_id") % 30 < 20, F.col("doc_id") % 30 >= 20):
        sketches.add_days(docs.where(part), at, by=("source",))
    got = sketches.profile(spark, at, "source")
    words = docs.select("source", T.word_count(F.col("text")).alias("w"), F.xxhash64("text").alias("h"))
    exact = words.groupBy("source").agg(F.count_distinct("h").alias("texts"))
    ranks = words.join(got.select("source", *[f"words_q{q}" for q in (25, 50, 75)]), "source").groupBy("source").agg(
        *[F.avg(F.when(F.col("w") < F.col(f"words_q{q}"), 1.0).otherwise(0.0)).alias(f"below{q}") for q in (25, 50, 75)],
        *[F.avg(F.when(F.col("w") <= F.col(f"words_q{q}"), 1.0).otherwise(0.0)).alias(f"upto{q}") for q in (25, 50, 75)],
    )
    held = [(F.col(f"below{q}") - sketches.RANK_ERROR <= q / 100) & (F.col(f"upto{q}") + sketches.RANK_ERROR >= q / 100) for q in (25, 50, 75)]
    near = F.abs(F.col("distinct_texts") - F.col("texts")) <= F.greatest(F.lit(1.0), 3 * sketches.DISTINCT_ERROR * F.col("texts"))
    return got.join(exact, "source").join(ranks, "source").select(
        "source", "rows", "words", "min_words", "max_words", "ai_rows", "mean_words", (held[0] & held[1] & held[2]).alias("quartiles_hold"), near.alias("distinct_holds")
    )
