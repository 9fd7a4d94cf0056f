"""Classifier training with pyspark.ml, and the settings to choose from."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from verdictflow.functions.scores import over_threshold

# Word ids of these models.
VOCABULARY = 1 << 16

# Settings to choose from, by name: (regularisation, elastic-net mixing).
SETTINGS = {
    "none": (0.0, 0.0),
    "ridge_low": (0.01, 0.0),
    "ridge_mid": (0.1, 0.0),
    "ridge_high": (0.5, 0.0),
    "mixed_low": (0.01, 0.5),
    "mixed_mid": (0.1, 0.5),
    "mixed_high": (0.5, 0.5),
    "lasso_low": (0.01, 1.0),
    "lasso_mid": (0.1, 1.0),
}


def setting(index):
    """Name and values of the setting at a position, for one setting per run."""
    return list(SETTINGS.items())[index]


def text_features(text_col="combined_text", n_features=VOCABULARY):
    """Stages from text to a sparse TF-IDF vector."""
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}]+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=n_features),
        IDF(inputCol="_counts", outputCol="features"),
    ]


def classifier(reg=0.01, mixing=0.0, iterations=5, label_col="label"):
    return LogisticRegression(
        labelCol=label_col, regParam=reg, elasticNetParam=mixing, maxIter=iterations
    )


def train_pipeline(training, text_col="combined_text", **settings):
    """A fitted pipeline from text to prediction."""
    return Pipeline(stages=[*text_features(text_col), classifier(**settings)]).fit(training)


def predict_logits(model, posts):
    """`posts` with the raw margin of class 1 as `logits` and the thresholded `pred`."""
    scored = model.transform(posts)
    logits = vector_to_array(F.col("rawPrediction")).getItem(1)
    return scored.select(*posts.columns, logits.alias("logits")).withColumn(
        "pred", over_threshold(F.col("logits"))
    )


def bayes_pipeline(text_col="combined_text", label_col="label", smoothing=1.0):
    """Stages from text to a multinomial naive-Bayes model over a fixed vocabulary of word ids.

    The ids are those of `word_id`, as text, so the model has one size whatever it is trained on,
    and the counts behind it are sums: the fit is the same in any order of rows.
    """
    ids = SQLTransformer(
        statement=f"""SELECT *, transform(
            filter(split(lower({text_col}), '[^\\\\p{{L}}]+'), w -> w <> ''),
            w -> cast(crc32(cast(w AS binary)) % {VOCABULARY} AS string)) AS _ids FROM __THIS__"""
    )
    vocabulary = [str(i) for i in range(VOCABULARY)]
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_ids", outputCol="features")
    learner = NaiveBayes(labelCol=label_col, modelType="multinomial", smoothing=smoothing)
    return Pipeline(stages=[ids, counts, learner])


def margin_of(model, posts, threshold=0.5):
    """`posts` with the log odds of class 1 as `logits` and the thresholded `pred`."""
    raw = vector_to_array(F.col("rawPrediction"))
    scored = model.transform(posts).select(*posts.columns, (raw[1] - raw[0]).alias("logits"))
    return scored.withColumn("pred", over_threshold(F.col("logits"), threshold))
