"""Category model on Spark ML: text and amount features, random forest, prediction."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    IndexToString,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    StopWordsRemover,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from outlay.operators.transactions import REVIEW_BELOW, categorize_keywords

MIN_DOCS = 2
TREES, DEPTH, MIN_LEAF, SEED = 100, 20, 2, 42
TEST_SHARE = 0.2
#: Training rows of a task. Trees are grown from cached parts, which are read again for every level.
TRAIN_ROWS = 100_000
WORDS = r"\b\w\w+\b"
INTERNAL = ("text", "words", "kept", "pairs", "terms", "counts", "tfidf", "unit", "amount_vec", "amount_z")


def with_text(df: DataFrame) -> DataFrame:
    blank = F.lit("")
    return df.withColumn(
        "text", F.concat_ws(" ", F.coalesce("vendor", blank), F.coalesce("description", blank))
    ).withColumn("amount", F.col("amount").cast("double"))


def feature_stages(terms: int = 200) -> list:
    """TF-IDF of the ``terms`` most frequent words and word pairs, and the standardised amount.
    All is fitted on the training rows only."""
    return [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=WORDS, gaps=False),
        StopWordsRemover(inputCol="words", outputCol="kept"),
        NGram(n=2, inputCol="kept", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(kept, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=terms, minDF=MIN_DOCS),
        IDF(inputCol="counts", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="unit"),
        VectorAssembler(inputCols=["amount"], outputCol="amount_vec"),
        StandardScaler(inputCol="amount_vec", outputCol="amount_z", withMean=True),
        VectorAssembler(inputCols=["unit", "amount_z"], outputCol="features"),
    ]


def fit_features(df: DataFrame) -> PipelineModel:
    return Pipeline(stages=feature_stages()).fit(with_text(df))


def split(df: DataFrame, key: str, test_share: float = TEST_SHARE) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key within the label: about the same share of
    every label, and the same rows on every run, also after lost executors."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(SEED)), "category", F.col(key).cast("string")))
    place = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / float(1 << 32)
    marked = df.withColumn("_place", place)
    return marked.where(F.col("_place") >= test_share).drop("_place"), marked.where(F.col("_place") < test_share).drop("_place")


def spread(df: DataFrame) -> DataFrame:
    """The rows in parts of about ``TRAIN_ROWS``, however few files they come from; a table of so many rows stays as it is."""
    parts = -(-df.count() // TRAIN_ROWS)
    return df.repartition(parts) if parts > 1 else df


def train(df: DataFrame) -> PipelineModel:
    """Fit on rows ``(vendor, description, amount, category)``."""
    rows = with_text(spread(df))
    labels = StringIndexer(inputCol="category", outputCol="label", handleInvalid="keep").fit(rows)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH,
        minInstancesPerNode=MIN_LEAF, seed=SEED,
    )
    names = IndexToString(inputCol="prediction", outputCol="category_ml", labels=labels.labels)
    # The label index is not part of the saved model, so new rows need no category.
    fitted = Pipeline(stages=[*feature_stages(), forest]).fit(labels.transform(rows))
    return PipelineModel(stages=[*fitted.stages, names])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``category_ml`` and ``confidence_ml`` (the largest class probability)."""
    out = model.transform(with_text(df))
    probability = F.array_max(vector_to_array(F.col("probability")))
    return out.withColumn("confidence_ml", probability).select(*df.columns, "category_ml", "confidence_ml")


def metrics(predicted: DataFrame) -> DataFrame:
    """Per category: rows, precision, recall, F1; from one pass over the confusion counts."""
    cells = predicted.groupBy("category", "category_ml").agg(F.count("*").alias("n"))
    hit = F.when(F.col("category") == F.col("category_ml"), F.col("n")).otherwise(0)
    sides = cells.select(F.col("category").alias("c"), F.col("n").alias("actual"), F.lit(0).alias("given"), hit.alias("hit")).unionByName(
        cells.select(F.col("category_ml").alias("c"), F.lit(0).alias("actual"), F.col("n").alias("given"), F.lit(0).alias("hit"))
    )
    per = sides.groupBy(F.col("c").alias("category")).agg(
        F.sum("actual").alias("support"), F.sum("given").alias("predicted"), F.sum("hit").alias("hits")
    )
    p, r = F.try_divide("hits", "predicted"), F.try_divide("hits", "support")
    return per.select(
        "category", "support", "predicted", "hits",
        F.coalesce(p, F.lit(0.0)).alias("precision"),
        F.coalesce(r, F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
    )


def accuracy(predicted: DataFrame) -> DataFrame:
    same = F.col("category") == F.col("category_ml")
    return predicted.agg(F.avg(same.cast("double")).alias("accuracy"), F.count("*").alias("test_size"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """The saved model, or None where none has been saved."""
    try:
        return PipelineModel.load(path)
    except (AnalysisException, OSError):
        return None
    except Exception as e:  # the JVM's missing-path error has no class of its own
        if "does not exist" in str(e):
            return None
        raise


def categorize(df: DataFrame, model_path: str | None = None, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """Categories by the saved model if there is one, else by keywords; ``method`` says which."""
    model = load(model_path) if model_path else None
    if model is None:
        return categorize_keywords(df, dictionary).withColumn("method", F.lit("Keyword-based"))
    out = predict(model, df)
    return (
        out.withColumn("category", F.col("category_ml"))
        .withColumn("category_confidence", F.col("confidence_ml"))
        .withColumn("needs_review", F.col("confidence_ml") < REVIEW_BELOW)
        .withColumn("method", F.lit("ML-based"))
    )
