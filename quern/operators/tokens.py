"""Word tokenizer with a frequency vocabulary, padding, vector alignment, TF-IDF with logistic regression, and scoring hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: characters that part words besides blanks.
FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
OOV = 1
#: Parts that the words of one count are ranked in.
SLICES = 64


def tokens(c: Column) -> Column:
    """Lower-case words between blanks and FILTERS."""
    return F.filter(F.split(F.translate(F.lower(c), FILTERS, " " * len(FILTERS)), " "), lambda w: w != "")


def vocabulary(df: DataFrame, text: str, key: str, limit: int | None = None, oov: bool = True) -> DataFrame:
    """(word, n, id): ids by falling frequency, ties by first place (least key, then place in the text). Ids begin at 2 with an
    out-of-vocabulary id, else at 1. With `limit` the rank is over a top-k only."""
    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("__k"), F.posexplode(tokens(F.col(text))).alias("__p", "word"))
    place = F.struct("__k", "__p")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        # key and place as one number, a null key before all others: numbers are counted by hash, while structs would have every word sorted
        place = F.coalesce(F.col("__k").cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)")) * F.lit(2**31).cast("decimal(10,0)") + F.col("__p")
    counts = found.groupBy("word").agg(F.count("*").alias("n"), F.min(place).alias("__f"))
    order = [F.desc("n"), F.asc("__f")]
    first = 2 if oov else 1
    if limit is not None:
        top = counts.orderBy(*order).limit(limit)
        return top.withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + (first - 1)).select("word", "n", "id")
    # Words of one count are cut at quantiles of their first key, where there are many; slices are counted, and a word's
    # rank is its slice's offset plus its place there. Counts that occur are few, as they grow by the square of their number.
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double")
    first_key = F.col("__f.__k") if kind in ("float", "double") else F.col("__f").cast("double")
    cuts = counts.agg(F.percentile_approx(first_key, [k / SLICES for k in range(1, SLICES)], 1000).alias("__cuts")) if numeric else None
    sliced = counts.crossJoin(cuts).withColumn("__s", F.size(F.filter("__cuts", lambda c: c < first_key))).drop("__cuts") if numeric else counts.withColumn("__s", F.lit(0))
    sizes = sliced.groupBy(F.col("n").alias("__n"), F.col("__s").alias("__z")).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__n"), "__z").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__n", "__z", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("n", "__s").orderBy("__f"))
    ranked = sliced.withColumn("__i", rank).join(offsets, (F.col("n") == F.col("__n")) & (F.col("__s") == F.col("__z")))
    return ranked.select("word", "n", (F.col("__before") + F.col("__i") + (first - 1)).cast("int").alias("id"))


def encode(df: DataFrame, vocab: DataFrame, text: str, key: str, length: int, padding: str = "post", truncating: str = "post", num_words: int | None = None, oov: bool = True, out: str = "ids") -> DataFrame:
    """(key, ids): sequences of `length` ids, 0 for padding, OOV for unknown words and ids from num_words on (left out without
    an OOV id). Words meet their ids in a join, so the vocabulary may be of any size. With an OOV id every word has a place in the
    sequence, so words that are cut off are left out before the join."""
    words = tokens(F.col(text))
    if oov:
        words = F.slice(words, 1, length) if truncating == "post" else F.slice(words, F.greatest(F.size(words) - length + 1, F.lit(1)), F.lit(length))
    found = df.select(F.col(key).alias("__k"), F.posexplode_outer(words).alias("__p", "word"))
    keep = vocab.select("word", "id") if num_words is None else vocab.select("word", "id").where(F.col("id") < num_words)
    joined = found.join(keep, "word", "left").withColumn("id", F.coalesce("id", F.lit(OOV)) if oov else F.col("id"))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("__p").isNotNull() & F.col("id").isNotNull(), F.struct("__p", "id")))), lambda x: x.id)
    return joined.groupBy("__k").agg(ids.alias("__i")).select(F.col("__k").alias(key), pad(F.col("__i"), length, padding, truncating).alias(out))


def pad(ids: Column, length: int, padding: str = "post", truncating: str = "post") -> Column:
    cut = F.slice(ids, 1, length) if truncating == "post" else F.when(F.size(ids) > length, F.slice(ids, F.size(ids) - length + 1, F.lit(length))).otherwise(ids)
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(cut), F.lit(0)))
    return F.concat(cut, zeros) if padding == "post" else F.concat(zeros, cut)


def align_vectors(vocab: DataFrame, lines: DataFrame, dim: int) -> DataFrame:
    """(word, id, vector, found) of a vector file's lines (value: word and dim numbers); zeros for words it lacks."""
    parts = F.split("value", " ")
    vectors = lines.where(F.size(parts) == dim + 1).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, dim), lambda x: x.try_cast("double")).alias("v"))
    joined = vocab.join(vectors.dropDuplicates(["word"]), "word", "left")
    return joined.select("word", "id", F.coalesce("v", F.array_repeat(F.lit(0.0), dim)).alias("vector"), F.col("v").isNotNull().alias("found"))


def match_rate(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.round(F.avg(F.col("found").cast("int")), 6).alias("match_rate"))


def tfidf_pipeline(text: str = "text", label: str = "y", terms: int = 20_000, max_iter: int = 1000, weight: str | None = None):
    """Words and pairs of words without stop words, the most frequent terms, L2-normalized TF-IDF, logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover

    stages = [
        RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"(?U)\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="__w", outputCol="__c"),
        NGram(n=2, inputCol="__c", outputCol="__g"),
        SQLTransformer(statement="SELECT *, concat(__c, __g) AS __t FROM __THIS__"),
        CountVectorizer(inputCol="__t", outputCol="__tf", vocabSize=terms),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, **({"weightCol": weight} if weight else {})),
    ]
    return Pipeline(stages=stages)


def fit_written(pipeline, df: DataFrame, at: str, *columns: str):
    """(model, scored): a tfidf_pipeline fitted to df, and df's `columns` with its predictions. The terms' counts are written to the folder `at`
    once, and the later stages and the scoring read them instead of taking the texts apart again."""
    from pyspark.ml import Pipeline, PipelineModel

    stages = pipeline.getStages()
    k = next(i for i, s in enumerate(stages) if type(s).__name__ == "CountVectorizer") + 1
    counting = Pipeline(stages=stages[:k]).fit(df)
    counting.transform(df).select(*columns, stages[k - 1].getOutputCol()).write.parquet(at)
    counted = df.sparkSession.read.parquet(at)
    weighing = Pipeline(stages=stages[k:]).fit(counted)
    return PipelineModel([*counting.stages, *weighing.stages]), weighing.transform(counted)


def cross_validate(df: DataFrame, make: Callable, fold: str = "fold", label: str = "y") -> DataFrame:
    """(fold, accuracy, precision, recall, f1): fit on the other folds, score one, for each fold."""
    from .evaluation import confusion, with_rates

    out = None
    for r in df.select(fold).distinct().orderBy(fold).collect():  # k rows
        model = make().fit(df.where(F.col(fold) != r[0]))
        scored = model.transform(df.where(F.col(fold) == r[0])).withColumn("pred", F.col("prediction").cast("int"))
        one = with_rates(confusion(scored, label, "pred"), strict=False).withColumn(fold, F.lit(r[0]))
        out = one if out is None else out.unionByName(one)
    return out


def score_texts(df: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]], text: str = "text", out: str = "score") -> DataFrame:
    """Score with an external model, loaded once in a Python worker. Texts of fewer than 10 characters get null. A batch that fails is
    tried again text by text, so one bad text costs its own score only; score_errors() has the reasons."""
    return _scored(df, load, text).select(*[F.col(f"`{c}`") for c in df.columns], F.col("__scored.score").alias(out))


def score_errors(df: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]], text: str = "text") -> DataFrame:
    """The rows whose text the model refuses, with the error."""
    return _scored(df, load, text).where("__scored.error is not null").select(*[F.col(f"`{c}`") for c in df.columns], F.col("__scored.error").alias("error"))


def _scored(df: DataFrame, load: Callable, text: str) -> DataFrame:
    import pandas as pd

    state: dict = {}

    @F.pandas_udf("struct<score:double,error:string>")
    def run(texts):
        if "model" not in state:
            state["model"] = load()
        out = pd.DataFrame({"score": pd.Series(None, index=texts.index, dtype="float64"), "error": pd.Series(None, index=texts.index, dtype="object")})
        ok = texts.index[texts.notna() & (texts.str.len() >= 10)]
        try:
            if len(ok):
                out.loc[ok, "score"] = [float(x) for x in state["model"](texts[ok].tolist())]
        except Exception:  # noqa: BLE001  the model's errors are not known here
            for k in ok:
                try:
                    out.loc[k, "score"] = float(state["model"]([texts[k]])[0])
                except Exception as e:  # noqa: BLE001
                    out.loc[k, "error"] = f"{type(e).__name__}: {e}"
        return out

    return df.withColumn("__scored", run(F.col(text)))


def score_images(df: DataFrame, load: Callable, content: str = "content", out: str = "score", batch: int = 64) -> DataFrame:
    """Score arrays of pixels with an external model through predict_batch_udf, which loads it once in a worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    return df.withColumn(out, predict_batch_udf(load, return_type=DoubleType(), batch_size=batch)(F.col(content)))


#: Model families that read plain RGB only, as they learn their own artifact features.
RGB_ONLY = ("clip_vit_b32", "dual_artifact_cnn")


def check_preprocessing(family: str, mode: str) -> None:
    """Raise for a model family that does not go with a mode of preprocessing."""
    if family.strip().lower() in RGB_ONLY and mode.strip().lower() != "rgb":
        raise ValueError(f"{family} takes mode rgb, not {mode}")
