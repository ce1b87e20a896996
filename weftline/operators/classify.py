"""Text classifiers: languages by function words, and linear models of hashed word n-grams by MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

# Words that tell a language.
STOPWORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "wir", "haben"], "en": ["the", "and", "of", "to", "is", "that", "was", "it", "with", "for"],
    "es": ["el", "la", "los", "que", "y", "en", "es", "una", "por", "muy"], "fr": ["le", "la", "les", "des", "et", "est", "une", "que", "pas", "pour"],
    "it": ["il", "la", "che", "di", "non", "per", "una", "è", "gli", "molto"], "nl": ["de", "het", "een", "en", "is", "van", "niet", "dat", "wij", "heel"],
    "pt": ["o", "a", "os", "que", "e", "não", "uma", "para", "muito", "é"],
}


def language_scores(words: Column) -> dict[str, Column]:
    def hits(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda x: x.isin(known)))

    return {k: hits(v) for k, v in sorted(STOPWORDS.items())}


def identify_language(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds identified and identified_score: the language of most telling words (of equal ones the first by name) and its share
    of all telling words; null without any."""
    hits = language_scores(F.col("_words"))
    split = df.select("*", T.words(F.lower(F.col(text_col))).alias("_words"))
    out = split.select("*", *[c.alias(f"_h_{k}") for k, c in hits.items()]).drop("_words")
    most = F.greatest(*[F.col(f"_h_{k}") for k in hits])
    pick = F.coalesce(*[F.when((F.col(f"_h_{k}") == most) & (most > 0), F.lit(k)) for k in hits])
    total = sum((F.col(f"_h_{k}") for k in list(hits)[1:]), F.col(f"_h_{list(hits)[0]}"))
    return out.withColumn("identified", pick).withColumn("identified_score", F.try_divide(most, total)).drop(*[f"_h_{k}" for k in hits])


def train_linear(df: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 17, iterations: int = 25) -> PipelineModel:
    """Logistic regression on hashed words and word pairs. The model has a fixed size, whatever the number of rows."""
    words = SQLTransformer(statement=f"SELECT *, filter(split(lower(coalesce({text_col}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '') AS _w FROM __THIS__")
    both = SQLTransformer(statement="SELECT *, concat(_w, _b) AS _t FROM __THIS__")
    stages = [words, NGram(n=2, inputCol="_w", outputCol="_b"), both, HashingTF(numFeatures=features, inputCol="_t", outputCol="_f"), StringIndexer(inputCol=label_col, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc"), LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=iterations, regParam=1e-3, probabilityCol="_p", predictionCol="_k", rawPredictionCol="_r")]
    return Pipeline(stages=stages).fit(df)


def predict_linear(model: PipelineModel, df: DataFrame, text_col: str = "text", out: str = "predicted") -> DataFrame:
    """Adds <out> and <out>_score: the likeliest label and its probability."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[-2].labels
    run = PipelineModel([s for s in model.stages if not isinstance(s, type(model.stages[-2]))])
    scored = run.transform(df)
    names = F.array(*[F.lit(x) for x in labels])
    p = vector_to_array("_p")
    cols = [c for c in df.columns]
    return scored.select(*cols, F.element_at(names, F.col("_k").cast("int") + 1).alias(out), F.array_max(p).alias(f"{out}_score"))
