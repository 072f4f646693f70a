"""Secret scans with DataFrame functions alone: patterns, and sliding-window entropy over candidate strings.

Base patterns find assignments, access keys and long hex runs; places are code points, the end exclusive. Matches are taken
leftmost and non-overlapping with open repetition, and those too short are dropped afterwards, which differs from asking for
the length in the pattern. Places come from the gaps between matches, summed in blocks, so cost stays near linear in matches.

The entropy scan reads candidate strings, maximal runs of `[A-Za-z0-9+/_=-]` of at least WINDOW characters. A fold keeps the
counts of the WINDOW last characters, packed into a few numbers, and the sum of c log2 c, in fixed point, and updates both by the
character that comes and the one that goes. Windows whose Shannon entropy reaches the threshold of the candidate's class (hex digits; letters with
digits; letters) hit; the span goes from the first hit window to the end of the last. Base spans are cut
out of a candidate first, and each part left of at least WINDOW characters is a candidate of its own. Candidates on the allow
list add nothing; base spans are never suppressed.

A narrow plan: no shuffle, no Python. Null texts are empty; null ids and repeated rows pass through, an empty table gives no rows.
Very long texts are read whole, in one row's arrays. Other columns stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

#: kind, pattern, group whose length counts, least length. In the order in which spans at one place are listed.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Where the run of a pattern's last class is the match, asking for its least length at once gives the same matches.
SHORT_CUT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Bits of entropy from which a window of a class hits; the most that 20 characters can have is 4.32.
THRESHOLDS = {"hex": 3.0, "mixed": 3.7, "letters": 4.1}
#: Candidates that are no secrets: identifiers in the common 8-4-4-4-12 form, and strings that say they are examples.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|redacted|your[_-]",
    r"^[A-Za-z]+([/_=-]+[A-Za-z]+)+$",
)
SCALE = 1_000_000
BLOCK = 256
#: The symbols of candidates; counts up to WINDOW + 1 of COUNT_BITS each, PER_WORD in a 64-bit number, so WORDS numbers for all.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
COUNT_BITS = 5
PER_WORD = 60 // COUNT_BITS
WORDS = -(-len(SYMBOLS) // PER_WORD)


def _prefix_sums(steps: Column) -> Column:
    """Sum of all entries before each one, in blocks: about BLOCK steps an entry."""
    zero = F.lit(0).cast("long")
    add = lambda x: F.aggregate(x, zero, lambda a, b: a + b)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
    before = F.transform(blocks, lambda x, b: add(F.slice(blocks, F.lit(1), b)))
    return F.transform(steps, lambda x, i: F.element_at(before, F.floor(i / BLOCK).cast("int") + 1) + add(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))


def _located(df: DataFrame, text: str, pattern: str, out: str, group: int | None = None) -> DataFrame:
    """Add `out`: array of (s, e, v) for the pattern's matches; v is the group's text."""
    t = F.col(text)
    m, g, v, p = fresh(df, "matches", "gaps", "values", "places")
    df = df.withColumn(m, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    some = F.size(m) > 0
    value = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else F.col(m)
    df = df.withColumn(g, F.when(some, F.transform(F.split(t, pattern, -1), lambda x: F.length(x).cast("long"))))
    df = df.withColumn(v, F.when(some, value))
    df = df.withColumn(p, F.when(some, _prefix_sums(F.transform(m, lambda x, i: F.element_at(g, i + 1) + F.length(x)))))
    found = F.transform(
        m,
        lambda x, i: F.struct(
            (F.element_at(p, i + 1) + F.element_at(g, i + 1)).alias("s"),
            (F.element_at(p, i + 1) + F.element_at(g, i + 1) + F.length(x)).alias("e"),
            F.element_at(v, i + 1).alias("v"),
        ),
    )
    empty = F.expr("cast(array() as array<struct<s:bigint,e:bigint,v:string>>)")
    return df.withColumn(out, F.when(some, found).otherwise(empty)).drop(m, g, v, p)


def _entropy_span(candidate: str) -> str:
    """SQL for (first, last) of the windows that hit in a candidate (s, e, v), null where none does."""
    table = "array(" + ",".join(f"{round(c * math.log2(c) * SCALE) if c else 0}L" for c in range(WINDOW + 2)) + ")"
    most = round(WINDOW * math.log2(WINDOW) * SCALE)
    limit = {k: most - round(v * WINDOW * SCALE) for k, v in THRESHOLDS.items()}
    v = f"{candidate}.v"
    limits = f"case when {v} rlike '^([0-9a-f]+|[0-9A-F]+)$' then {limit['hex']}L when {v} rlike '[0-9]' and {v} rlike '[A-Za-z]' then {limit['mixed']}L else {limit['letters']}L end"
    # a symbol's count in the window that ends before i, from its word of packed counts
    count = lambda j: f"cast(shiftright(acc.n[codes.w[{j}]], codes.s[{j}]) & {2**COUNT_BITS - 1} as int)"
    gone = f"({count(f'i - {WINDOW}')} + if(codes.c[i] = codes.c[i - {WINDOW}], 1, 0))"
    return f"""
    aggregate(
      sequence(0, size(codes.c) - 1),
      named_struct('n', array_repeat(0L, {WORDS}), 'sum', 0L, 'first', cast(null as bigint), 'last', cast(null as bigint)),
      (acc, i) -> aggregate(
        array(named_struct(
          'n', case when i < {WINDOW} then transform(acc.n, (k, at) -> if(at = codes.w[i], k + shiftleft(1L, codes.s[i]), k))
                    when codes.c[i] = codes.c[i - {WINDOW}] then acc.n
                    else transform(acc.n, (k, at) -> k + if(at = codes.w[i], shiftleft(1L, codes.s[i]), 0L) - if(at = codes.w[i - {WINDOW}], shiftleft(1L, codes.s[i - {WINDOW}]), 0L)) end,
          'sum', acc.sum + {table}[{count('i')} + 1] - {table}[{count('i')}] + if(i < {WINDOW}, 0L, {table}[{gone} - 1] - {table}[{gone}]))),
        acc,
        (old, now) -> named_struct(
          'n', now.n, 'sum', now.sum,
          'first', coalesce(old.first, if(i >= {WINDOW - 1} and now.sum <= codes.most, cast(i - {WINDOW - 1} as bigint), null)),
          'last', if(i >= {WINDOW - 1} and now.sum <= codes.most, cast(i + 1 as bigint), old.last))),
      acc -> named_struct('first', acc.first, 'last', acc.last))""", limits


#: SQL for a candidate's symbols by number, the word of packed counts that each is counted in, and its place there.
_CODES = f"""
  aggregate(array(transform(split({{v}}, ''), k -> instr('{SYMBOLS}', k) - 1)), cast(null as struct<c:array<int>,w:array<int>,s:array<int>>),
    (nothing, c) -> named_struct('c', c, 'w', transform(c, k -> cast(k div {PER_WORD} as int)), 's', transform(c, k -> k % {PER_WORD} * {COUNT_BITS})))"""


#: SQL for the candidates without the base spans: parts of at least WINDOW characters.
_PART = "if({end} - acc.at >= %d, concat(acc.out, array(named_struct('s', acc.at, 'e', {end}, 'v', substring(x.v, cast(acc.at - x.s + 1 as int), cast({end} - acc.at as int))))), acc.out)" % WINDOW
_UNCOVERED = f"""
  flatten(transform({{cand}}, x -> if(not exists({{base}}, b -> b.s < x.e and b.e > x.s), array(x),
    aggregate(array_sort(filter({{base}}, b -> b.s < x.e and b.e > x.s)),
      named_struct('at', x.s, 'out', cast(array() as array<struct<s:bigint,e:bigint,v:string>>)),
      (acc, b) -> named_struct('at', greatest(acc.at, b.e), 'out', {_PART.format(end="b.s")}),
      acc -> {_PART.format(end="x.e")}))))"""


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add `out`: array of (s, rank, e, kind), sorted, of base spans (rank 0 to 2) and entropy spans (rank 3)."""
    t, base, cand, hits_, *names = fresh(docs, "text", "base", "cand", "hits", *(kind for kind, *_ in BASE))
    df = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    for rank, ((kind, pattern, group, least), name) in enumerate(zip(BASE, names)):
        df = _located(df, t, SHORT_CUT.get(kind, pattern), name, group or None)
        df = df.withColumn(
            name,
            F.transform(F.filter(name, lambda x: F.length(x.v) >= least), lambda x: F.struct(x.s.alias("s"), F.lit(rank).alias("rank"), x.e.alias("e"), F.lit(kind).alias("kind"))),  # noqa: B023
        )
    df = df.withColumn(base, F.concat(*names)).drop(*names)
    df = _located(df, t, CANDIDATE, cand)
    df = df.withColumn(cand, F.expr(_UNCOVERED.format(cand=cand, base=base)))
    allowed = lambda x: F.rlike(x.v, F.lit("|".join(f"({a})" for a in ALLOW)))
    df = df.withColumn(cand, F.filter(cand, lambda x: ~allowed(x)))
    fold, limits = _entropy_span("x")
    hits = F.expr(f"""
      transform({cand}, x -> named_struct('at', x.s, 'w',
        aggregate(array(named_struct('codes', {_CODES.format(v="x.v")}, 'most', {limits})),
          named_struct('first', cast(null as bigint), 'last', cast(null as bigint)),
          (nothing, given) -> aggregate(array(named_struct('c', given.codes.c, 'w', given.codes.w, 's', given.codes.s, 'most', given.most)), nothing, (none, codes) -> {fold}))))""")
    df = df.withColumn(hits_, F.when(F.size(cand) > 0, hits))
    added = F.transform(F.filter(hits_, lambda h: h.w.first.isNotNull()), lambda h: F.struct((h.at + h.w.first).alias("s"), F.lit(3).alias("rank"), (h.at + h.w.last).alias("e"), F.lit("entropy").alias("kind")))
    return df.withColumn(out, F.array_sort(F.when(F.col(hits_).isNull(), F.col(base)).otherwise(F.concat(base, added)))).drop(t, base, cand, hits_)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): counts of the base kinds, the hash of the base spans, and all spans as text."""
    df = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), out="found")
    base = F.filter("found", lambda x: x.rank < len(BASE))
    counts = [F.size(F.filter("found", lambda x: x.rank == rank)).cast("long").alias(f"n_{kind}") for rank, (kind, *_) in enumerate(BASE)]  # noqa: B023
    return df.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


MARK = "[SECRET]"


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by a mark, all rows and columns kept; n_chars follows where there is one."""
    names = docs.columns
    (spans,) = fresh(docs, "spans")
    df = find_spans(docs, out=spans)
    joined = F.expr(f"""
      aggregate({spans}, named_struct('at', 0L, 'out', cast(array() as array<string>)),
        (acc, x) -> if(x.e <= acc.at, acc, named_struct('at', x.e, 'out',
          if(x.s < acc.at, acc.out, concat(acc.out, array(substring(text, cast(acc.at + 1 as int), cast(x.s - acc.at as int)), '{MARK}'))))),
        acc -> concat(array_join(acc.out, ''), substring(text, cast(acc.at + 1 as int))))""")
    df = df.withColumn("text", F.when(F.size(spans) > 0, joined).otherwise(F.col("text"))).select(*names)
    return df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else df
