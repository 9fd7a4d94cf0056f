"""A corpus from documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return
the columns of their input; a stage that changes texts keeps `n_chars` in step.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictflow.llm import decontaminate, jaccard_join, mixing, secret_scan, toxicity
from verdictflow.session import stage


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counted(docs: DataFrame) -> DataFrame:
    """`docs` with `n_chars`, where there is one, equal to the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    size = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go.

    A NULL or empty text is scored as one without toxic words; repeated rows go or stay together.
    """
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id.

    A text that is NULL or has no words is in no class: its rows stay, those equal in id and text once.
    A NULL id stays only if no other id is in the class.
    """
    return jaccard_join.keep_one_of_each(docs)


def cut_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans shared with test items are cut out; documents that are mostly such spans go.

    A text that is NULL or has no words stays as it is; repeated rows are treated alike.
    """
    return _counted(decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all rows stay, a NULL text as NULL."""
    return _counted(secret_scan.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with the number of their `repeats`.

    A document without words, or with a NULL text, is taken with full passes over its source only;
    NULL is a source. Rows equal in id, text and source are taken or left together.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("test items", cut_test_items),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: The toxicity field is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what a stage keeps is written before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
