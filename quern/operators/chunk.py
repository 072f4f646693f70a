"""Chunkers: fixed width, sentence-aware with carry-over, caps, and nested answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import fresh
from .grid import let


def fixed_chunks(df: DataFrame, text: str = "text", size: int = 400, least: int = 100, most: int = 600, out: str = "chunk") -> DataFrame:
    """A row per run of `size` words; runs with fewer than `least` or more than `most` words go. Adds chunk_no and `out`."""
    words, part = fresh(df, "w", "c")
    w = T.words(F.col(text))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / size).cast("int") - 1, F.lit(0))), lambda k: F.slice(words, k * size + 1, F.lit(size)))
    found = df.withColumn(words, w).select(*df.columns, F.posexplode(cut).alias("chunk_no", part))
    return found.where(F.size(part).between(least, most)).select(*df.columns, "chunk_no", F.array_join(part, " ").alias(out))


# size, least and most words, the share and least number of sentences skipped at either end, whether always
PROFILES = {
    "book": dict(size=400, least=200, most=500, share=10, skip=50, always=True, split="any"),
    "archive": dict(size=400, least=200, most=500, share=10, skip=10, always=False, split="capital"),
    "modern": dict(size=400, least=200, most=500, share=20, skip=10, always=False, split="protected"),
}


def cut_sentences(sentences: Column, size: int, least: int, most: int, share: int, skip: int, always: bool) -> Column:
    """Array of (chunk, word_count). Gather words sentence by sentence. With `size` words or more together, the first `size` make a candidate, cut behind its
    last . ! or ? if that lies past character size // 2; what is left over carries on. One candidate a sentence at most."""
    none = "cast(array() as array<{}>)".format

    def trimmed(all_):
        ends = F.greatest(F.lit(skip), F.floor(F.size(all_) / share).cast("int"))
        inner = F.slice(all_, ends + 1, F.greatest(F.lit(0), F.size(all_) - 2 * ends))
        return inner if always else F.when(F.size(all_) > 2 * ends, inner).otherwise(all_)

    def gathered(done: Column, held: Column) -> Column:
        """One step with `size` words or more: the candidate, and what is held after it."""
        upto = lambda text: let(F.regexp_extract(text, r"(?s)^.*[.!?]", 0), lambda cut: F.when(F.length(cut) - 1 > size // 2, cut).otherwise(text))
        candidate = let(F.array_join(F.slice(held, 1, size), " "), lambda text: let(upto(text), lambda cut: F.struct(cut.alias("chunk"), F.size(F.split(cut, " ")).alias("word_count"))))
        return let(
            candidate,
            lambda c: F.struct(
                F.when(c["word_count"].between(least, most), F.concat(done, F.array(c))).otherwise(done).alias("done"),
                F.slice(held, c["word_count"] + 1, F.size(held)).alias("held"),
            ),
        )

    start = F.struct(F.expr(none("struct<chunk:string,word_count:int>")).alias("done"), F.expr(none("string")).alias("held"))
    step = lambda acc, sentence: let(F.concat(acc["held"], T.words(sentence)), lambda held: F.when(F.size(held) < size, F.struct(acc["done"].alias("done"), held.alias("held"))).otherwise(gathered(acc["done"], held)))
    return F.aggregate(let(sentences, trimmed), start, step, lambda acc: acc["done"])


def sentence_chunks(df: DataFrame, profile: str = "book", text: str = "text", key: str = "doc_id", **other) -> DataFrame:
    """(key, chunk_no, chunk, word_count): the carry-over makes a document's chunks sequential, so each document is one fold over its
    sentences; a narrow plan of expressions. Null texts and those without a candidate have no chunk."""
    how = {**PROFILES[profile], **other}
    split: Column = {"any": T.sentences_any, "capital": T.sentences_capital, "protected": T.sentences_protected}[how.pop("split")](F.col(text))
    chunks = F.when(F.col(text).isNotNull(), cut_sentences(split, **how))
    return df.select(key, F.posexplode(chunks).alias("chunk_no", "c")).select(key, "chunk_no", "c.chunk", "c.word_count")


def first_raw(df: DataFrame, key: str, raw: int = 9) -> DataFrame:
    """Only the first `raw` chunks of each document are looked at."""
    return df.where(F.col("chunk_no") < raw)


def at_most(df: DataFrame, key: str, n: int, order: str = "chunk_no") -> DataFrame:
    """The first n rows of each key."""
    (k,) = fresh(df, "k")
    return df.withColumn(k, F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col(k) <= n).drop(k)


def middle_slice(df: DataFrame, key: str, most: int = 150, order: str = "chunk_no") -> DataFrame:
    """Of each key with more than `most` rows the centred ones."""
    w = Window.partitionBy(key)
    k, n = fresh(df, "k", "n")
    ranked = df.withColumns({k: F.row_number().over(w.orderBy(order)) - 1, n: F.count("*").over(w)})
    first = F.when(F.col(n) > most, F.floor((F.col(n) - most) / 2)).otherwise(0)
    return ranked.where((F.col(k) >= first) & (F.col(k) < first + F.greatest(F.lit(most), F.when(F.col(n) > most, F.lit(0)).otherwise(F.col(n))))).drop(k, n)


def reason_tally(df: DataFrame, reason: str = "reason", k: int = 10) -> DataFrame:
    """The k most frequent reasons."""
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason).limit(k)


def until_target(df: DataFrame, category: str, target: int, order: str) -> DataFrame:
    """Each category's first `target` rows."""
    return at_most(df, category, target, order)


def explode_answers(df: DataFrame, human: str = "human_answers", machine: str = "chatgpt_answers") -> DataFrame:
    """(text, is_generated) from two columns of JSON lists. Broken JSON and what is no list give nothing; entries that are no
    strings, and blank ones, are skipped; the rest is stripped."""

    def one(column: str, label: int) -> Column:
        return F.transform(json_strings(F.col(column)), lambda x: F.struct(T.strip(x).alias("text"), F.lit(label).alias("is_generated")))

    none = F.expr("cast(array() as array<struct<text:string,is_generated:int>>)")
    both = F.concat(F.coalesce(one(human, 0), none), F.coalesce(one(machine, 1), none))
    return df.select(F.explode(both).alias("a")).select("a.text", "a.is_generated").where("text <> ''")


def json_strings(c: Column) -> Column:
    """The strings of a JSON list; entries of other types are left out, which from_json to strings would turn into text."""
    parsed = F.try_parse_json(c)
    items = F.try_variant_get(parsed, "$", "array<variant>")
    return F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))



def fill_topics(rows: DataFrame, topic: str, order: str, topics: list[str], draw: Column, target: int, per_topic: int, attempts: int = 300) -> DataFrame:
    """The rows of the named topics in their order, then of other topics in the order of `draw`, at most `attempts` of them, until
    `target` rows are there. A topic gives its first `per_topic` rows by `order`; the one that reaches the target is taken whole."""
    turn, drawn, n, before, place = fresh(rows, "turn", "drawn", "n", "before", "place")
    sizes = rows.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.least(F.count("*"), F.lit(per_topic)).alias(n)).withColumns({turn: F.array_position(F.array(*map(F.lit, topics)), F.col(topic)), drawn: draw})
    named = sizes.where(F.col(turn) > 0).withColumn(drawn, F.lit(None).cast(sizes.schema[drawn].dataType))
    others = sizes.where(F.col(turn) == 0).orderBy(drawn, topic).limit(attempts).withColumn(turn, F.lit(len(topics) + 1).cast("long"))
    # no more rows than topics and attempts, so one task adds them up
    ahead = Window.orderBy(turn, drawn, topic).rowsBetween(Window.unboundedPreceding, -1)
    taken = named.unionByName(others).withColumn(before, F.coalesce(F.sum(n).over(ahead), F.lit(0))).where(F.col(before) < target).select(topic)
    first = Window.partitionBy(topic).orderBy(order)
    return rows.join(taken, topic, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) <= per_topic).drop(place)
